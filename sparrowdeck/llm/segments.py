"""Windows of a sequence cut into runs that share a minimiser, and the search for repeated ones.

Two equal windows have the same minimiser at the same place in the window, so all copies of a window meet at one
minimiser. Shared by substring removal over bytes and over words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, map_batches, materialize

#: Distinct strings with one key above which they are cut into finer pieces.
HOT = 256
#: Positions in one numpy step, and bytes of text at a time.
STEP = 1 << 16
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_A_INV, _B_INV = (np.uint64(pow(int(x), -1, 1 << 64)) for x in (_A, _B))
TABLE = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** i for i below n, modulo 2 ** 64."""
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        got = _powers[int(base)] = np.cumprod(got, dtype=np.uint64)
    return got[:n]


def stirred(x: np.ndarray) -> np.ndarray:
    """Mix the bits of 64-bit values, so that high bits depend on all."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Polynomial hash of any range of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: np.uint64, inverse: np.uint64):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(base, n), out=self.sums[1:])
        self.inverse = powers(inverse, n + 1)

    def grams(self, k: int) -> np.ndarray:
        return stirred((self.sums[k:] - self.sums[:-k]) * self.inverse[: len(self.sums) - k])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return stirred((self.sums[end] - self.sums[start]) * self.inverse[start])


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` neighbours."""
    have = 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    return np.minimum(key[: len(key) - (width - have)], key[width - have :]) if have < width else key


def runs(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of pieces that stand one after the other: piece, start in the sequence, windows, place of the
    minimiser after the start, minimiser, hash.

    a, b: two 64-bit values for each symbol. The minimiser is the least gram hash (upper half, leftmost on a tie).
    """
    none = np.zeros(0, np.int64)
    has = lengths >= window
    if not has.any():
        return none, none, none, none, none, none
    first = np.cumsum(lengths) - lengths
    hashes = Rolling(a, _A, _A_INV).grams(gram)
    key = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    where = (sliding_min(key, window - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    from .common import ranges

    at = ranges(first[has], lengths[has] - window + 1)
    where = where[at]
    cut = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    start = at[cut]
    count = np.diff(np.append(cut, len(at)))
    whole = Rolling(b, _B, _B_INV).of(start, start + count + window - 1)
    return np.searchsorted(first + lengths, start, side="right"), start, count, where[cut].astype(np.int64) - start, hashes[where[cut]].view(np.int64), whole.view(np.int64)


def segments(docs: DataFrame, values: Callable[[list[bytes]], Iterator[tuple]], window: int, gram: int) -> DataFrame:
    """(doc_id, start, nwin, off, mini, seg) of all runs of windows of all texts.

    Rows without a doc_id have no place in the order of documents and take no part.
    values gives (document numbers, offsets, lengths, a, b) of pieces; pieces of a long document overlap by window - 1.
    """

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        from .common import texts

        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for doc, offset, lengths, a, b in values(texts(batch)):
            piece, start, count, off, mini, seg = runs(a, b, lengths, window, gram)
            if len(piece):
                first = np.cumsum(lengths) - lengths
                yield {"doc_id": ids[doc[piece]], "start": start - first[piece] + offset[piece], "nwin": count, "off": off, "mini": mini, "seg": seg}

    return map_batches(docs.select("doc_id", "text").where("doc_id IS NOT NULL"), cut, "doc_id long, start long, nwin int, off int, mini long, seg long")


class Repeats:
    """Runs whose minimiser occurs again, as tables in the shared folder.

    occurrences: (doc_id, start, nwin, off, mini, seg); distinct: (mini, seg, n, doc_id, start, nwin, off) with the first
    occurrence of each distinct run; mixed: those of `distinct` at minimisers with several distinct runs. `hot` are those
    with more than so many; their runs are cut into pieces, whose keys take more of the text than the minimiser.

    The lists of minimisers are tables too, so that both sides of a join are plain shuffles: only then does Spark split
    the rows of a minimiser that is everywhere over several tasks.
    """

    def __init__(self, found: DataFrame, owner: str, hot: int = HOT):
        found = materialize(found, owner, "runs")  # each text is cut and hashed once; counting and choosing read the table
        # Counting needs the minimiser only, and partial sums keep a minimiser that is everywhere to a row a task.
        again = materialize(found.groupBy("mini").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("mini"), owner, "again")
        self.occurrences = materialize(found.join(again, "mini", "left_semi"), owner, "occurrences")
        drop_table(found, owner)
        grouped = self.occurrences.groupBy("mini", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "start")).alias("first"), F.max("nwin").alias("nwin"), F.max("off").alias("off"))
        self.distinct = materialize(grouped.select("mini", "seg", "n", "first.doc_id", "first.start", "nwin", "off"), owner, "distinct")
        kinds = materialize(self.distinct.groupBy(F.col("mini").alias("m")).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), owner, "kinds")
        mixed = self.distinct.join(kinds, F.col("mini") == F.col("m"))
        self.mixed = mixed.select("mini", "doc_id", "start", "nwin", "off", (F.col("kinds") > hot).alias("hot"))

    def copies(self) -> DataFrame:
        """Occurrences of runs that occur more than once, with the place of the first one."""
        more = self.distinct.where("n > 1").select(F.col("mini").alias("m"), F.col("seg").alias("s"), F.col("doc_id").alias("first_doc"), F.col("start").alias("first_start"))
        return self.occurrences.join(more, (F.col("mini") == F.col("m")) & (F.col("seg") == F.col("s"))).select("doc_id", "start", "nwin", "first_doc", "first_start")


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, z): texts deflated before they travel, about a third of their size."""
    import zstandard

    def squeeze(batch: pa.RecordBatch) -> Iterator[dict]:
        from .common import texts

        press = zstandard.ZstdCompressor(level=1)
        yield {"doc_id": batch.column("doc_id"), "z": [press.compress(t) for t in texts(batch)]}

    return map_batches(docs.select("doc_id", "text"), squeeze, "doc_id long, z binary")


def unpacked(z: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(z)
