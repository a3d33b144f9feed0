"""Sum-of-squares online packing of token sequences into windows of fixed length."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

#: Beyond so many open windows a packer closes them by cutting, which bounds its memory.
#: Where rests of all lengths occur, open windows level off far below (731 at most over
#: 51,000 documents in one packer); only where nearly all are longer than half a window,
#: so that no two fit, does each document open one.
OPEN_WINDOWS = 4096


class ByteBpe:
    """Token ids of a byte-level BPE file, as the tokenizers library gives them.

    The rank file of the same vocabulary, several times as fast, serves texts of
    ASCII and Latin letters; any other text (rare characters, the special
    token's string, very long white space) goes through tokenizers itself.
    """

    UNUSUAL = re.compile(r"[^\x00-\x7e\xa1-ɏ]|<\||\s{500}")

    def __init__(self, json_name: str, ranks_name: str | None, pattern: str | None = None):
        import public_tokenizers

        self.path = public_tokenizers.path(json_name)
        self.slow = None
        self.fast = None
        if ranks_name:
            import base64

            import tiktoken

            with open(public_tokenizers.path(ranks_name), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def exact(self, text: str) -> list[int]:
        """Ids by the tokenizers library, loaded for the first text that needs it."""
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        if self.fast is None or self.UNUSUAL.search(text):
            return self.exact(text)
        return self.fast.encode_ordinary(text)


class SumOfSquares:
    """Places pieces of at most *size* tokens online.

    ``level[h]`` counts the open windows filled to h.  A piece goes to the level,
    or to a new window, for which the sum of squares of these counts becomes
    smallest; ties go to the fullest window.  Windows that become full leave.
    """

    def __init__(self, size: int):
        self.size, self.next = size, 0
        self.level = np.zeros(size + 1, dtype=np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(size + 1)]
        self.n_open = 0

    def place(self, piece: tuple, length: int) -> list[tuple] | None:
        """Place a piece; the pieces of the window if it became full."""
        fill = 0
        if length < self.size:
            top = self.size - length
            level = self.level
            grown = 2 * level[length : self.size + 1] + 1
            grown[top] = 0
            change = grown - 2 * level[: top + 1] + 1
            change[0] = grown[0]
            change[1:][level[1 : top + 1] == 0] = np.iinfo(np.int64).max
            fill = top - int(change[::-1].argmin())
        if fill:
            window = self.open[fill].pop()
            self.level[fill] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        if fill + length == self.size:
            return window
        self.open[fill + length].append(window)
        self.level[fill + length] += 1
        self.n_open += 1
        return None

    def take(self) -> list[tuple[int, list[tuple]]]:
        """All open windows with their fill, fullest first; none stays open."""
        found = [(h, w) for h in range(self.size, 0, -1) for w in self.open[h]]
        self.level[:] = 0
        self.open = [[] for _ in range(self.size + 1)]
        self.n_open = 0
        return found


def refill(windows: list[tuple[int, list[tuple]]], size: int) -> list[list[tuple]]:
    """Cut the emptiest windows' pieces into the gaps of the fullest; all but the last become full."""
    out, low = [], len(windows) - 1
    for high, (fill, window) in enumerate(windows):
        if high > low:
            break
        while fill < size and low > high:
            left, donor = windows[low]
            doc, start, ids, total = donor.pop()
            n = min(size - fill, len(ids))
            window.append((doc, start, ids[:n], total))
            if n < len(ids):
                donor.append((doc, start + n, ids[n:], total))
            fill += n
            windows[low] = (left - n, donor)
            if not donor:
                low -= 1
        out.append(window)
    return out


def powers(window: list[tuple]) -> list[list[tuple]]:
    """Cut a window into windows whose lengths are powers of two, longest first."""
    fill, pieces, out = sum(len(p[2]) for p in window), list(window), []
    for k in reversed(range(fill.bit_length())):
        if not fill >> k & 1:
            continue
        need, own = 1 << k, []
        while need:
            doc, start, ids, total = pieces.pop(0)
            n = min(need, len(ids))
            own.append((doc, start, ids[:n], total))
            if n < len(ids):
                pieces.insert(0, (doc, start + n, ids[n:], total))
            need -= n
        out.append(own)
    return out


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, tokenizer: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken", open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pack all texts into sequences of at most *size* tokens.

    Each partition of the input is one online packer, so nothing is shuffled and
    a packer holds only its open windows.  A document is its token ids and then
    *end_id*.  Whole windows of a longer document become sequences of their own,
    and its rest is placed like a shorter one.  At the end of a partition (or at
    *open_windows* open ones) the windows that are still open fill each other by
    cutting; the last one is cut into sequences of power-of-two length, which
    need no padding.

    Returns a row per piece: id, ``start``, ``length``, ``ids`` (binary,
    little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id`` (partition
    in the upper bits), ``offset``.  A null or empty text is *end_id* alone; null
    and repeated ids are packed like others; an empty table gives an empty
    table; other columns are ignored.
    """
    small_batches()
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, packer = ByteBpe(tokenizer, ranks), SumOfSquares(size)
        sequence = TaskContext.get().partitionId() << 32
        kind = None
        rows: list[tuple] = []

        def emit(window: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, total in window:
                rows.append((doc, start, len(ids), ids.tobytes(), total, sequence, offset))
                offset += len(ids)
            sequence += 1

        def flushed() -> pa.RecordBatch:
            names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=names)
            rows.clear()
            return batch

        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                doc, text = doc.as_py(), text.as_py()
                ids = np.array([*encoder.encode(text or ""), end_id], dtype="<u4")
                total = len(ids)
                whole = total - total % size
                for start in range(0, whole, size):
                    emit([(doc, start, ids[start : start + size], total)])
                if whole < total:
                    full = packer.place((doc, whole, ids[whole:], total), total - whole)
                    if full:
                        emit(full)
                if packer.n_open > open_windows:
                    *full, last = refill(packer.take(), size)
                    for window in full:
                        emit(window)
                    fill = sum(len(p[2]) for p in last)
                    if fill == size:
                        emit(last)
                    else:
                        packer.open[fill].append(last)
                        packer.level[fill], packer.n_open = 1, 1
                if len(rows) >= 2000:
                    yield flushed()
            yield flushed()
        if packer.n_open:
            *full, last = refill(packer.take(), size)
            for window in [*full, *powers(last)]:
                emit(window)
            yield flushed()
        del encoder, packer
        give_back()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
