"""Retrieval: BM25, vectors, rank fusion, related chunks, query rewriting.

Queries are a table (qid, text or vector), so that any number of searches is one
plan; the corpus is read once for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.greedy import cut
from ..functions.setjoin import give_back, small_batches
from ..functions.sets import let
from ..functions.text import BLANK, words

K1, B = 1.2, 0.75
#: Columns of a piece of postings.
PIECE = ["ids", "len", "term", "doc", "tf", "n", "known", "total"]

#: Words that a lexical query does without.
STOP_WORDS = """a about according across after all also an and are as at be by can could did do does exact find for from get
give have how i if in into is it its just me my need of on once out or please show should that the tell than then there
these this those to under up use used using was were what when where which who will why with would you your""".split()


def top(rows: DataFrame, k: int, by: str = "qid", score: str = "score", tie: str = "id") -> DataFrame:
    """The k best rows of each query with their rank from 1; Spark keeps k per task before it shuffles."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _postings(corpus: DataFrame, wanted) -> DataFrame:
    """How often documents (id, w, len) hold the wanted terms, in pieces (ids, len, term, doc, tf, n, known, total).

    term is a place in *wanted*, doc one in ids; n, known and total count documents, those with a length, and words.
    """
    import pyarrow as pa

    shared = corpus.sparkSession.sparkContext.broadcast(wanted.to_pylist())

    def pack(batches):
        import numpy as np
        import pyarrow.compute as pc

        terms = pa.array(shared.value, pa.string())
        for batch in batches:
            n = batch.num_rows
            held = np.diff(batch["w"].offsets.to_numpy())
            at = pc.fill_null(pc.index_in(batch["w"].flatten().cast(pa.string()), terms), -1).to_numpy().astype("int64")
            key, tf = np.unique(at[at >= 0] * n + np.repeat(np.arange(n), held)[at >= 0], return_counts=True)
            size = pc.fill_null(batch["len"], 0).to_numpy()
            data = [pa.array([x.astype("int32").tobytes()], pa.binary()) for x in (size, key // max(n, 1), key % max(n, 1), tf)]
            counts = [pa.array([int(x)], pa.int64()) for x in (n, n - batch["len"].null_count, size.sum())]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch["id"]), *data, *counts], PIECE)
        give_back()

    small_batches()
    kind = corpus.schema["id"].dataType.simpleString()
    rows = corpus.select("id", "len", F.coalesce("w", F.array().cast("array<string>")).alias("w"))
    return cut(rows.mapInArrow(pack, f"ids array<{kind}>, len binary, term binary, doc binary, tf binary, n bigint, known bigint, total bigint"))


def _df(pieces: DataFrame, wanted) -> DataFrame:
    """term, df: the documents that hold a wanted term, by pieces of postings."""
    import pyarrow as pa

    shared = pieces.sparkSession.sparkContext.broadcast(wanted.to_pylist())

    def count(batches):
        import numpy as np

        df = np.zeros(len(shared.value), "int64")
        for batch in batches:
            for x in batch["term"]:
                df += np.bincount(np.frombuffer(x.as_buffer(), "int32"), minlength=len(df))
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(shared.value, pa.string()).take(pa.array(at)), pa.array(df[at])], ["term", "df"])

    return pieces.select("term").mapInArrow(count, "term string, df bigint")


def _least(most: int) -> str:
    """The smallest unsigned kind of number that holds *most*."""
    return "u1" if most < 1 << 8 else "u2" if most < 1 << 16 else "u4"


def _joined(pieces: DataFrame, n_blocks: int) -> DataFrame:
    """Pieces of postings as blocks (ids, len, term, doc, tf), documents by id and postings by term and document; doc and tf in as few bytes as they need."""

    def join(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held = [batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)]
        if not held:
            return
        ids = pa.concat_arrays([b["ids"].flatten() for b in held])
        size, term, tf = (np.concatenate([np.frombuffer(b[c][0].as_buffer(), "int32") for b in held]) for c in ("len", "term", "tf"))
        first = np.cumsum([0, *(len(b["ids"][0].values) for b in held)])
        doc = np.concatenate([np.frombuffer(b["doc"][0].as_buffer(), "int32") + at for b, at in zip(held, first, strict=False)])
        by_id = pc.sort_indices(ids, null_placement="at_start").to_numpy().astype("int64")
        place = np.empty(len(by_id), "int64")
        place[by_id] = np.arange(len(by_id))
        order = np.lexsort((place[doc], term))
        data = [pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in ((size[by_id], "int32"), (term[order], "int32"), (place[doc][order], _least(len(by_id))), (tf[order], _least(tf.max(initial=0))))]
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(by_id)], pa.int32()), ids.take(pa.array(by_id))), *data], PIECE[:5])
        give_back()

    kinds = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in PIECE[:5])
    return cut(pieces.select(*PIECE[:5]).repartition(n_blocks).mapInArrow(join, kinds))


def _asked(weights: DataFrame, wanted, n_blocks: int) -> DataFrame:
    """Weights (qid, term, idf, avg_len) as blocks of queries (qids, first, qterm, idf, avg_len)."""
    import pyarrow as pa

    shared = weights.sparkSession.sparkContext.broadcast(wanted.to_pylist())

    def pack(batches):
        import numpy as np
        import pyarrow.compute as pc

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        sizes = np.diff(rows["t"].offsets.to_numpy())
        t = rows["t"].flatten()
        qterm = pc.index_in(t.field("term").cast(pa.string()), pa.array(shared.value, pa.string())).to_numpy()
        data = [np.cumsum([0, *sizes]).astype("int32"), qterm.astype("int32"), t.field("idf").to_numpy().astype("float64")]
        qids = pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), rows["qid"])
        yield pa.RecordBatch.from_arrays([qids, *(pa.array([x.tobytes()], pa.binary()) for x in data), rows["avg_len"].slice(0, 1)], ["qids", "first", "qterm", "idf", "avg_len"])

    kind = weights.schema["qid"].dataType.simpleString()
    own = weights.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("t"), F.first("avg_len").alias("avg_len"))
    return cut(own.repartition(n_blocks).mapInArrow(pack, f"qids array<{kind}>, first binary, qterm binary, idf binary, avg_len double"))


def _best_docs(pairs: DataFrame, k: int, digits: int) -> DataFrame:
    """The k best documents (qid, id, score) of each query in each pair of a block of queries and one of postings."""

    def best(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                part = {c: np.frombuffer(batch[c][i].as_buffer(), "float64" if c == "idf" else "int32") for c in ("first", "qterm", "idf", "len", "term")}
                part |= {c: np.frombuffer(batch[c][i].as_buffer(), f"u{max(1, batch[c][i].as_buffer().size // max(1, len(part['term'])))}") for c in ("doc", "tf")}
                qids, ids, first, doc, tf = batch["qids"][i].values, batch["ids"][i].values, part["first"], part["doc"].astype("int64"), part["tf"]
                weight = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * part["len"] / batch["avg_len"][i].as_py()))[doc])
                begin, end = np.searchsorted(part["term"], part["qterm"], "left"), np.searchsorted(part["term"], part["qterm"], "right")
                slots = np.zeros((4 * k, -(-len(ids) // (4 * k))))
                score, out = slots.reshape(-1), []
                for q in range(len(qids)):
                    score.fill(0)
                    for j in range(first[q], first[q + 1]):
                        at = slice(begin[j], end[j])
                        score[doc[at]] += part["idf"][j] * weight[at]
                    least = np.partition(slots.max(axis=1), -k)[-k]  # k documents have as much
                    found = np.nonzero(score >= least - 2 * 10.0**-digits if least > 1e-3 else score)[0]
                    value = np.round(score[found], digits)
                    keep = np.lexsort((found, -value))[:k]
                    out.append((np.full(len(keep), q), found[keep], value[keep]))
                q, found, value = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), ids.take(pa.array(found)), pa.array(value)], ["qid", "id", "score"])
        give_back()

    kind, qkind = (pairs.schema[c].dataType.elementType.simpleString() for c in ("ids", "qids"))
    return pairs.mapInArrow(best, f"qid {qkind}, id {kind}, score double")


def bm25(corpus: DataFrame, queries: DataFrame, k: int = 10, digits: int = 6, most: int = 8192, asked: int = 2048) -> DataFrame:
    """BM25 top-k: corpus (id, text), queries (qid, text) to qid, id, score, rank (SRH-01).

    Only terms that some query holds are kept of the corpus.  Blocks of *most*
    documents meet blocks of *asked* queries; a pair of blocks keeps its k best
    per query, so that no row per query and document is shuffled.  Rows that
    share their id are one document where their lengths agree, and are summed
    where not; they are joined term by term.  Queries are cut at 1024 characters.
    """
    terms = cut(queries.select("qid", F.explode(F.array_distinct(words(F.substring("text", 1, 1024)))).alias("term")).distinct())
    wanted = terms.select("term").distinct().toArrow()["term"].combine_chunks()
    again = cut(corpus.groupBy("id").count().where("count > 1").select(F.col("id").alias("twice")))
    same = F.col("id").eqNullSafe(F.col("twice"))
    docs = corpus.select("id", words(F.col("text")).alias("w")).withColumn("len", F.size("w"))
    pieces = _postings(docs.join(F.broadcast(again), same, "left_anti"), wanted)
    repeated = docs.join(F.broadcast(again), same, "left_semi")
    rest = repeated.select("id", "len", F.explode("w").alias("term")).join(terms.select("term").distinct(), "term", "left_semi").groupBy("term", "id", "len").agg(F.count("*").alias("tf"))
    some = not again.isEmpty()
    counts, df = pieces.select("n", "known", "total"), _df(pieces, wanted)
    if some:
        rest = cut(rest)
        counts = counts.union(repeated.agg(F.count("*"), F.count("len"), F.sum("len")))
        df = df.union(rest.groupBy("term").agg(F.count("*")))
    stats = counts.agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("known")).alias("avg_len"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = terms.join(df.groupBy("term").agg(F.sum("df").alias("df")).join(F.broadcast(stats)).select("term", idf.alias("idf"), "avg_len"), "term")
    weights = cut(weights.select("qid", "term", "idf", "avg_len"))
    n_docs, n_queries = (pieces.agg(F.sum("n")).first()[0] or 0), weights.select("qid").distinct().count()
    n_blocks = max(1, -(-n_docs // most))
    blocks = _joined(pieces, n_blocks).coalesce(-(-n_blocks // 4))  # a task keeps k of four blocks
    found = _best_docs(_asked(weights, wanted, max(1, -(-n_queries // asked))).crossJoin(blocks), k, digits)
    if some:
        own = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
        found = found.union(rest.join(weights, "term").groupBy("qid", "id").agg(F.round(F.sum(own), digits).alias("score")))
    return top(found, k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _blocks(rows: DataFrame, kind: str, most: int = 8192) -> DataFrame:
    """rows (id, vector) as (ids, size, data): vectors of one size side by side, about *most* rows a partition."""

    def pack(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by("id").combine_chunks()
        sizes = pc.list_value_length(table["vector"])
        for size in pc.unique(sizes).to_pylist():
            own = table.filter(pc.equal(sizes, size))
            data = pc.list_flatten(own["vector"]).to_numpy().astype("float64").tobytes()
            ids = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own["id"].combine_chunks())
            yield pa.RecordBatch.from_arrays([ids, pa.array([size], pa.int32()), pa.array([data], pa.binary())], ["ids", "size", "data"])

    return rows.repartition(max(1, -(-rows.count() // most))).mapInArrow(pack, f"ids array<{kind}>, size int, data binary")


def vector_search(corpus: DataFrame, queries: DataFrame, k: int = 10, digits: int = 6, where: Column | None = None) -> DataFrame:
    """Exact cosine top-k: corpus (id, vector), queries (qid, qvector) (SRH-02, 07).

    Any number of queries is compared with all rows, block by block as a matrix
    product; a pair of blocks keeps its k best per query, ties by id, before the
    shuffle.  Vectors of another size match nothing; a vector of zeros or with
    nulls has a null score, which comes last.
    """
    rows = corpus if where is None else corpus.where(where)
    rows = rows.select("id", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    asked = queries.select(F.col("qid").alias("id"), F.col("qvector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    kind, qkind = rows.schema["id"].dataType.simpleString(), asked.schema["id"].dataType.simpleString()

    def nearest(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for n in range(batch.num_rows):
                qids, ids = batch["qids"][n].values, batch["ids"][n].values
                size = batch["size"][n].as_py()
                if size != batch["qsize"][n].as_py():
                    continue
                q = np.frombuffer(batch["qdata"][n].as_py()).reshape(len(qids), size)
                x = np.frombuffer(batch["data"][n].as_py()).reshape(len(ids), size)
                qq, xx = (q * q).sum(axis=1), (x * x).sum(axis=1)
                for at in range(0, len(q), 256):
                    with np.errstate(invalid="ignore", divide="ignore"):
                        score = np.round(q[at : at + 256] @ x.T / np.sqrt(np.outer(qq[at : at + 256], xx)), digits)
                    score[~np.isfinite(score)] = -np.inf
                    least = np.partition(score, -k, axis=1)[:, -k, None] if k < len(x) else np.full((len(score), 1), -np.inf)
                    tied = score == least
                    room = k - (score > least).sum(axis=1, keepdims=True)
                    i, j = np.nonzero((score > least) | (tied & (np.cumsum(tied, axis=1) <= room)))
                    found = score[i, j]
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(i + at)), ids.take(pa.array(j)), pa.array(found, mask=np.isinf(found))], ["qid", "id", "score"])

    pairs = _blocks(asked, qkind).select(F.col("ids").alias("qids"), F.col("size").alias("qsize"), F.col("data").alias("qdata")).crossJoin(_blocks(rows, kind))
    return top(pairs.mapInArrow(nearest, f"qid {qkind}, id {kind}, score double"), k)


def distance_score(distance: Column) -> Column:
    """1 / (1 + d); 0 for a negative distance (SRH-03)."""
    return F.when(distance < 0, 0.0).otherwise(1.0 / (1.0 + distance))


def fuse(lists: list[tuple[DataFrame, float]], k: int, rank_base: int = 1, constant: int = 60, digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (qid, id, rank from 1) with weights (SRH-04 to 06)."""
    parts = [rows.select("qid", "id", (F.lit(float(w)) / (constant + F.col("rank") - 1 + rank_base)).alias("s")) for rows, w in lists]
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    return top(union.groupBy("qid", "id").agg(F.round(F.sum("s"), digits).alias("score")), k)


def related(hits: DataFrame, chunks: DataFrame, primary: DataFrame, k: int) -> DataFrame:
    """Chunks related to a primary chunk through several queries (SRH-09).

    hits (qid, query, id, score): hits of the queries made for primary chunk
    qid; chunks (id, file, idx and, if known, content); primary (qid, pid).  The primary itself,
    chunks of the same content and its direct neighbours in its file are left
    out; the rest is ordered by number of queries, other files first, best score.
    """
    same_text = F.xxhash64("content") if "content" in chunks.columns else F.lit(None).cast("bigint")
    chunks = chunks.select("id", "file", "idx", same_text.alias("same"))
    p = chunks.select(F.col("id").alias("pid"), F.col("file").alias("pfile"), F.col("idx").alias("pidx"), F.col("same").alias("psame"))
    rows = hits.join(primary, "qid").join(p, "pid").join(chunks, "id")
    same = F.col("file") == F.col("pfile")
    rows = rows.where((F.col("id") != F.col("pid")) & ~F.coalesce(F.col("same") == F.col("psame"), F.lit(False)) & ~(same & (F.abs(F.col("idx") - F.col("pidx")) <= 1)))
    out = rows.groupBy("qid", "id").agg(F.count_distinct("query").alias("n_queries"), F.max("score").alias("max_score"), F.max(same.cast("int")).alias("same_file"))
    w = Window.partitionBy("qid").orderBy(F.desc("n_queries"), "same_file", F.desc("max_score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rewrite(query: Column, max_terms: int = 16, max_chars: int = 140) -> Column:
    """A wordy question as a lexical query: site terms, quoted phrases, the words that matter (SRH-18)."""
    plain = F.trim(F.regexp_replace(query, BLANK, " "))
    phrase = F.transform(F.regexp_extract_all(plain, F.lit('"([^"]+)"'), F.lit(1)), lambda p: F.trim(p))
    phrase = F.transform(F.filter(phrase, lambda p: F.length(p) >= 2), lambda p: F.concat(F.lit('"'), p, F.lit('"')))
    rest = F.regexp_replace(F.regexp_replace(plain, '"[^"]+"', " "), r"[?!,;(){}\[\]]", " ")
    keep = lambda t: t.isin("AND", "OR", "NOT") | (~F.lower(t).isin(*STOP_WORDS) & ((F.length(t) > 1) | t.rlike("^[0-9]$")))
    token = F.filter(F.regexp_extract_all(rest, F.lit(r"[A-Za-z0-9$@._:/-]+"), F.lit(0)), keep)

    def distinct(a: Column) -> Column:
        return let(F.transform(a, F.lower), lambda low: F.filter(a, lambda x, i: F.array_position(low, F.lower(x)) == i + 1))

    token = distinct(token)
    site = lambda t: F.lower(t).startswith("site:")
    merged = F.slice(F.concat(F.filter(token, site), distinct(phrase), F.filter(token, lambda t: ~site(t))), 1, max_terms)
    text = F.array_join(merged, " ")
    cut = F.regexp_replace(F.substring(text, 1, max_chars), " [^ ]*$", "")
    return F.when(text == "", plain).when(F.length(text) <= max_chars, text).otherwise(cut)


def render(hits: DataFrame, chars: int = 10_000, mark: str = "... (truncated)") -> DataFrame:
    """Numbered result text per query, cut with a mark (SRH-20, RWD-10)."""
    line = F.struct("rank", F.concat(F.col("rank").cast("string"), F.lit(". "), "content", F.lit(" (score "), F.format_number("score", 3), F.lit(")")).alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["t"]), "\n")
    whole = hits.groupBy("qid").agg(text.alias("text"))
    cut = F.concat(F.rtrim(F.substring("text", 1, chars - len(mark))), F.lit(mark))
    return whole.select("qid", F.when(F.length("text") > chars, cut).otherwise(F.col("text")).alias("text"))


def best_mode(modes: set[str], order: tuple[str, ...] = ("hybrid", "vector", "lexical")) -> str:
    """The first mode of an order that a backend offers (SRH-08)."""
    for m in order:
        if m in modes:
            return m
    raise ValueError("no search mode")


def chunk_count(chunks: DataFrame, by: str) -> DataFrame:
    """Chunks by a column (SRH-12)."""
    return chunks.groupBy(by).agg(F.count("*").alias("n"))


def file_chunks(chunks: DataFrame) -> DataFrame:
    """Each file's chunks in order: file, n_chunks, ids (SRH-13).  chunks: id, file, idx; a null index counts as 0."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("idx", F.lit(0)).alias("idx"), "id"))), lambda s: s["id"])
    return chunks.groupBy("file").agg(F.count("*").alias("n_chunks"), ordered.alias("ids"))


def knows_files(chunks: DataFrame) -> bool:
    """Whether chunks say which file and place they come from (SRH-13): by the schema, without reading rows."""
    return {"file", "idx"} <= set(chunks.columns)


def content_of(*fields: str) -> Column:
    """One field as it is, several as a JSON object (SRH-14)."""
    return F.col(fields[0]).cast("string") if len(fields) == 1 else F.to_json(F.struct(*fields))


def renamed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Fields under the names of another store; others stay (SRH-16).  Turn the map round for the way back."""
    return rows.withColumnsRenamed(names)


def dimensions(vectors: DataFrame) -> DataFrame:
    """Vectors by their dimension (SRH-17); null vectors have none."""
    return vectors.groupBy(F.size("vector").alias("dimension")).agg(F.count("*").alias("n"))


def checked_dimension(vectors: DataFrame, wanted: int) -> DataFrame:
    """The same rows; reading one of another dimension is an error (SRH-17)."""
    good = F.size("vector") == wanted
    return vectors.withColumn("vector", F.when(good, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit(f"expected {wanted} dimensions, got "), F.size("vector").cast("string")))))


def search_texts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (qid, id, score, rank) with the chunks' content (SRH-10); hits of unknown chunks are left out."""
    return hits.join(chunks.select("id", "content"), "id")
