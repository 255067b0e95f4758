"""Best-fit packing: length patterns fitted to the length histogram by non-negative least squares."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_batches, materialize
from .tokens import WordEncoder, cut_words

CAPACITY = 4096
END_ID = 1
#: Length classes and the most documents of a pattern that is fitted.
CLASSES, DEPTH = 64, 3
#: Groups into which the pieces of one length are dealt for their ranks.
BUCKETS = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def patterns(classes: int = CLASSES, depth: int = DEPTH) -> np.ndarray:
    """All multisets of at most `depth` classes (1 to classes) that fill a sequence of `classes` units: rows of counts."""
    out: list[list[int]] = []

    def grow(left: int, most: int, got: list[int]) -> None:
        if not left:
            out.append(got)
        elif len(got) < depth:
            for c in range(min(left, most), 0, -1):
                if c * (depth - len(got)) < left:
                    break
                grow(left - c, c, [*got, c])

    grow(classes, classes, [])
    table = np.zeros((len(out), classes + 1))
    for k, p in enumerate(out):
        for c in p:
            table[k, c] += 1
    return table


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |a x - b| over x >= 0 by the active-set method."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        active[best] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (s <= 0)
            if not low.any():
                x = s
                break
            step = np.min(x[low] / (x[low] - s[low] + 1e-300))
            x = x + step * (s - x)
            active &= x > 1e-12
            x[~active] = 0
    return x


class Plan:
    """Sequences for a histogram of lengths, as (lengths of a sequence, times it is repeated).

    Fitted patterns of length classes come first: the class of each place gives its longest lengths, the last place
    the longest that still fits, and what fits then fills up. Residuals are packed the same way from the longest down.
    Every step is taken as often as the counts allow, so steps number a few for each distinct length, not for each piece.
    """

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, classes: int = CLASSES, depth: int = DEPTH):
        self.capacity = capacity
        self.left = {k: v for k, v in histogram.items() if v}
        self.lengths = sorted(self.left)
        self.steps: list[tuple[list[int], int]] = []
        unit = max(1, -(-capacity // classes))
        count = np.zeros(classes + 1)
        for length, n in self.left.items():
            count[-(-length // unit)] += n
        if self.left:
            table = patterns(classes, depth)
            # classes weigh by their length: a unit of a long one is as dear as one of a short one
            fitted = np.rint(nnls((table * np.arange(classes + 1)).T, count * np.arange(classes + 1))).astype(np.int64)
            for k in np.argsort(-fitted, kind="stable"):
                if fitted[k] <= 0:
                    break
                self._repeat([c for c in range(classes, 0, -1) for _ in range(int(table[k, c]))], unit, int(fitted[k]))
        while self.lengths:
            self._emit([], None)

    def _longest(self, most: int, used: dict[int, int], least: int = 0) -> int | None:
        """Longest length up to `most` of which more are left than used."""
        at = bisect.bisect_right(self.lengths, most) - 1
        while at >= 0 and self.lengths[at] > least:
            length = self.lengths[at]
            if self.left[length] > used.get(length, 0):
                return length
            at -= 1
        return None

    def _repeat(self, places: list[int], unit: int, times: int) -> None:
        while times > 0:
            used: dict[int, int] = {}
            got: list[int] = []
            for c in places[:-1]:
                length = self._longest(min(c * unit, self.capacity - sum(got)), used, (c - 1) * unit)
                if length is None:
                    return
                got.append(length)
                used[length] = used.get(length, 0) + 1
            times -= self._emit(got, times)

    def _emit(self, got: list[int], times: int | None) -> int:
        """Fill a sequence that begins with `got` by best fit; repeat it as often as counts and `times` allow."""
        used: dict[int, int] = {}
        for length in got:
            used[length] = used.get(length, 0) + 1
        room = self.capacity - sum(got)
        while room > 0 and (length := self._longest(room, used)) is not None:
            got = [*got, length]
            used[length] = used.get(length, 0) + 1
            room -= length
        n = min(self.left[k] // m for k, m in used.items())
        n = max(1, n if times is None else min(n, times))
        self.steps.append((got, n))
        for k, m in used.items():
            self.left[k] -= m * n
            if not self.left[k]:
                del self.left[k]
                self.lengths.pop(bisect.bisect_left(self.lengths, k))
        return n


def slots(steps: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each place of each step: length, first rank it takes, times, first sequence, offset. Sorted by length, rank."""
    rows, taken, sequence = [], {}, 0
    for lengths, n in steps:
        offset = 0
        for length in lengths:
            rank = taken.get(length, 0)
            rows.append((length, rank, sequence, offset))
            taken[length] = rank + n
            offset += length
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T, strict=True))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """Pieces of the documents' ids: (doc_id, piece, start, length, ids_crc32). Longer documents are cut at the capacity."""
    encoder: list[WordEncoder] = []

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        if not encoder:
            encoder.append(WordEncoder(tokenizer))
        all_ids, ends = encoder[0].closed(cut_words(batch.column(text).cast(pa.string())), end_id)
        size = np.diff(ends, prepend=0)
        count = -(-size // capacity)
        row = np.repeat(np.arange(len(size)), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = piece * capacity
        length = np.minimum(capacity, size[row] - start)
        at = (np.cumsum(size) - size)[row] + start
        crc = [zlib.crc32(all_ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
        yield {"doc_id": batch.column("doc_id").take(pa.array(row)), "piece": piece, "start": start, "length": length, "ids_crc32": crc}

    return map_batches(docs.select("doc_id", text), cut, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, depth: int = DEPTH, buckets: int = BUCKETS, owner: str = "op9") -> DataFrame:
    """Add sequence_id and offset to pieces of at most `capacity` tokens.

    The histogram (at most `capacity` rows) goes to the driver, where patterns are fitted to it; the places of the plan
    (bounded by the capacity as well, not by the data) go back. Pieces of one length are interchangeable: each gets its
    rank among them, in two steps so that a length that a third of all rows have is never one task, and takes the place
    of that rank.
    """
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = materialize(dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), owner, "histogram")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    place = slots(Plan(histogram, capacity, classes, depth).steps)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("length").alias("l"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.join(counts, (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b"))).withColumn("rank", F.col("ahead") + F.row_number().over(within) - 1)
    shared = pieces.sparkSession.sparkContext.broadcast(place)

    def settle(batch: pa.RecordBatch) -> Iterator[dict]:
        p = shared.value
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        wide = np.int64(1) << np.int64(45)
        at = np.searchsorted(p["length"] * wide + p["rank"], length * wide + rank, side="right") - 1
        out = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
        yield out | {"sequence_id": p["sequence"][at] + rank - p["rank"][at], "offset": p["offset"][at]}

    return map_batches(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), settle, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, owner: str = "op9") -> DataFrame:
    """Token pieces of the documents and their places in sequences.

    A null text is empty and gives the end id alone; equal rows are packed each; texts of any length are cut into pieces;
    an empty table gives an empty result; only doc_id and text are read.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(materialize(token_pieces(docs, tokenizer, capacity, end_id), owner, "pieces", spread=True), capacity, owner=owner)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and places of the documents table in sequences of 4096 ids."""
    return pack_documents(documents(spark, sf_dir))
