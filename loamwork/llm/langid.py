"""Language identification by compression with per-language zstandard dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, small_batches, trainable

UNKNOWN = "und"


@dataclass
class LanguageModel:
    """Raw-content dictionaries by language, most frequent language first."""

    dictionaries: dict[str, bytes] = field(default_factory=dict)
    #: Texts are compressed in blocks of so many bytes, each with a fresh dictionary.
    block_bytes: int = 4096
    #: Blocks shorter than this follow a stretch of the dictionary, as zstandard stores very short input raw.
    carrier_below: int = 512
    level: int = 12


def normalise(text: str) -> str:
    """Lower case; anything but letters becomes one space."""
    return re.sub(r"[\W\d_]+", " ", text.lower()).strip()


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 400, piece_chars: int = 2000, dictionary_bytes: int = 65536, max_languages: int = 100, seed: int = 11) -> LanguageModel:
    """Dictionaries from labelled rows that are not held out.

    About *docs_per_language* rows of each language are chosen by a hash of
    their id, and a hash-chosen piece of at most *piece_chars* characters of
    each makes up the dictionary; the *max_languages* labels with the most rows
    are learnt, so that stray labels cannot fill the driver.  These bounds hold
    at every input size.  Only the rates are taken from counts over all rows.  Rows with a null id, text
    or label teach nothing; no labelled row gives an empty model.
    """
    docs = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    rows = docs.where(trainable(F.col("i")) & F.col("l").isNotNull())
    most = rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(max_languages)
    counts = {r["l"]: r["n"] for r in most.collect()}
    if not counts:
        return LanguageModel()
    rates = rows.sparkSession.createDataFrame([(k, min(1.0, docs_per_language / n)) for k, n in counts.items()], "l string, rate double")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("i")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    start = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("i")), F.greatest(F.lit(1), F.length("t") - piece_chars)).cast("int") + 1
    chosen = rows.join(F.broadcast(rates), "l").where((draw < F.col("rate")) & F.col("t").isNotNull())
    pieces: dict[str, list[tuple[int, str]]] = {}
    for r in chosen.select("l", F.xxhash64(F.lit(seed), F.col("i"), F.col("t")).alias("h"), F.col("t").substr(start, F.lit(piece_chars)).alias("t")).collect():
        pieces.setdefault(r["l"], []).append((r["h"], normalise(r["t"])))
    order = sorted(pieces, key=lambda k: (-counts[k], k))
    blobs = {k: " ".join(t for _, t in sorted(pieces[k]) if t).encode("utf-8", "ignore")[:dictionary_bytes] for k in order}
    return LanguageModel({k: b for k, b in blobs.items() if b})


class Scorer:
    """Compressors of a model, built once in each task."""

    def __init__(self, model: LanguageModel):
        import zstandard

        self.model, self.by = model, []
        for name, blob in model.dictionaries.items():
            own = zstandard.ZstdCompressionDict(blob, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=model.level)
            compress = zstandard.ZstdCompressor(level=model.level, dict_data=own, write_content_size=False, write_checksum=False).compress
            carrier = blob[:256] + b" "
            self.by.append((name, compress, carrier, len(compress(carrier))))

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of the whole text with each language's dictionary."""
        data, step = normalise(text).encode("utf-8", "ignore"), self.model.block_bytes
        blocks = [data[i : i + step] for i in range(0, len(data), step)]
        out = []
        for _, compress, carrier, own in self.by:
            total = 0
            for b in blocks:
                total += len(compress(carrier + b)) - own if len(b) < self.model.carrier_below else len(compress(b))
            out.append(total)
        return out

    def best(self, text: str | None) -> tuple[str, float]:
        """The language with the smallest size, and by which share it beats the next."""
        if text is None or not self.by or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        sizes = self.sizes(text)
        ranked = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        if len(ranked) == 1:
            return self.by[0][0], 1.0
        first, second = sizes[ranked[0]], sizes[ranked[1]]
        return self.by[ranked[0]][0], min(1.0, max(0.0, (second - first) / max(1, second)))


def identify(model: LanguageModel, text: Column, min_margin: float = 0.01) -> Column:
    """struct(lang_pred, score, rejected) of a text column.

    The whole text is compressed block by block.  ``score`` is the share of
    bytes that the best dictionary saves over the second best; ties go to the
    language with more training rows.  ``rejected`` marks margins below
    *min_margin*.  A null text, one without letters, or an empty model gives
    ``und``, score 0, rejected; a model of one language gives score 1.
    """

    small_batches()

    @F.arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for texts in batches:  # text by text, so that a batch is held once, in Arrow
            found = [scorer.best(t.as_py()) for t in texts]
            names, scores = [f[0] for f in found], [f[1] for f in found]
            rejected = [n == UNKNOWN or s < min_margin for n, s in found]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["lang_pred", "score", "rejected"])
        del scorer
        give_back()

    return udf(text)


def predict(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.01) -> DataFrame:
    """One row per input row: id, lang_pred, score, rejected.  See identify()."""
    found = docs.select(F.col(id_col), identify(model, F.col(text_col), min_margin).alias("found"))
    return found.select(id_col, "found.*")
