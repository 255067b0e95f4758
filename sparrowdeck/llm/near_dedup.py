"""SimHash near-duplicate components over a Gray-order hierarchical index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fewer, map_batches, materialize, release, small_batches, task_count, texts
from .segments import stirred
from .substring_dedup import word_hashes

#: Fingerprints link at so many differing bits or fewer.
DISTANCE = 3
SHINGLE = 3
SEED = 42
#: A cell with more fingerprints than this is dealt out as pairs of salts ...
HOT = 600
#: ... of at most so many salts; beyond that the salts grow.
MOST_SALTS = 64
#: Fan-out of the index and shingles unpacked at a time.
FAN, AT_ONCE = 8, 100_000
#: Rows of cells that one task gets, about.
AT_TASK = 100_000


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority of the bits of the shingles' XXH64; zero without words."""
    words = text.lower().split()  # of bytes: A-Z only, breaks are the six ASCII ones
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        ones += np.unpackbits(hashes[at : at + AT_ONCE].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batch: pa.RecordBatch) -> Iterator[dict]:
    values = np.fromiter((fingerprint(t) for t in texts(batch)), np.uint64, batch.num_rows)
    yield {"doc_id": batch.column("doc_id"), "fp": values.view(np.int64)}


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """Codes (rows of 64-bit lanes) in Gray order, FAN to a node; a node keeps the bits its codes share as mask and pattern."""

    def __init__(self, codes: np.ndarray):
        self.order = np.lexsort([gray_rank(lane) for lane in codes.T[::-1]])
        self.codes = codes[self.order]
        every, pattern = np.full(codes.shape, ~np.uint64(0)), self.codes
        self.levels = [(every, pattern)]
        low, high = self.codes, self.codes
        while len(low) > 1:
            cuts = np.arange(0, len(low), FAN)
            low, high = np.bitwise_and.reduceat(low, cuts), np.bitwise_or.reduceat(high, cuts)
            self.levels.append((~(low ^ high), low))

    def pairs(self, distance: int, at_once: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indexes of pairs within the distance, each pair once, in chunks. Differences in the bits that two nodes have
        fixed add up on the way down; a pair of groups is dropped as soon as they exceed the distance."""
        top = len(self.levels) - 1
        zero = np.zeros(1, np.int64)
        stack = [(top, zero, zero, np.zeros((1, self.codes.shape[1]), np.uint64), np.zeros(1, np.int64))]
        while stack:
            level, a, b, seen, differ = stack.pop()
            if level == 0:
                keep = a < b
                if keep.any():
                    yield self.order[a[keep]], self.order[b[keep]]
                continue
            if len(a) > max(1, at_once // FAN**2):
                half = len(a) // 2
                stack += [(level, a[:half], b[:half], seen[:half], differ[:half]), (level, a[half:], b[half:], seen[half:], differ[half:])]
                continue
            mask, pattern = self.levels[level - 1]
            n = len(mask)
            x = np.repeat(a * FAN, FAN * FAN) + np.tile(np.repeat(np.arange(FAN), FAN), len(a))
            y = np.repeat(b * FAN, FAN * FAN) + np.tile(np.tile(np.arange(FAN), FAN), len(b))
            ok = (x < n) & (y < n) & (x <= y)
            parent = np.repeat(np.arange(len(a)), FAN * FAN)[ok]
            x, y = x[ok], y[ok]
            fixed = mask[x] & mask[y]
            far = differ[parent] + np.bitwise_count((pattern[x] ^ pattern[y]) & fixed & ~seen[parent]).sum(axis=1)
            near = far <= distance
            if near.any():
                stack.append((level - 1, x[near], y[near], fixed[near], far[near].astype(np.int64)))


def forest(n: int, chunks: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least index of the component of each of n items, from chunks of links."""
    root = np.arange(n)
    for a, b in chunks:
        while True:
            x, y = root[a], root[b]
            open_ = x != y
            if not open_.any():
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    return root


def schemes(distance: int, blocks: int) -> list[int]:
    """Masks of all choices of `blocks` - `distance` of so many blocks: codes within the distance agree on one of them."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in pairwise(edges)]
    return [sum(block[k] for k in chosen) for chosen in combinations(range(blocks), blocks - distance)]


def blocks_for(codes: int, distance: int = DISTANCE, cell: int = HOT) -> int:
    """The fewest blocks whose agreeing bits leave less than a quarter of `cell` codes to a cell on average."""
    return next((b for b in range(distance + 1, 2 * distance + 2) if codes >> (64 * (b - distance) // b) < cell // 4), 2 * distance + 2)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def salted(cells: DataFrame, hot: int, owner: str, *columns: str) -> DataFrame:
    """Deal out the rows (cell, fp, ...) of cells with more than `hot` of them: rows get salts, and each pair of salts is a
    cell of its own, (cell, a, b), so nothing gathers in one task and no pair is lost. Beyond MOST_SALTS the salts grow.

    The list of such cells is a table, so its size is known when the join is planned: a short one is broadcast.
    """
    often = cells.groupBy(F.col("cell").alias("k")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
    often = materialize(often.select("k", F.least(F.lit(MOST_SALTS), F.ceil(F.col("n") / hot)).cast("int").alias("salts")), owner, "often")
    dealt = cells.join(often, F.col("cell") == F.col("k"), "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return dealt.select("cell", F.least("salt", "other").alias("a"), F.greatest("salt", "other").alias("b"), "fp", *columns)


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Join what a task got with itself over an index, one table after the other; the rows of a task are few (AT_TASK)."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got)
    fp, mask = (table.column(c).to_numpy() for c in ("fp", "mask"))
    for m in np.unique(mask):
        codes = np.unique(fp[mask == m])
        # the bits that cells agree on lead the order, so that cells are upper nodes of the index
        bits = [k for k in range(64) if int(m) >> k & 1] + [k for k in range(64) if not int(m) >> k & 1]
        turned = np.zeros(len(codes), np.uint64)
        for lead, k in enumerate(bits):
            turned |= ((codes.view(np.uint64) >> np.uint64(k)) & np.uint64(1)) << np.uint64(63 - lead)
        root = forest(len(codes), GrayIndex(turned[:, None]).pairs(distance))
        linked = root != np.arange(len(codes))
        if linked.any():
            yield pa.RecordBatch.from_arrays([pa.array(codes[linked]), pa.array(codes[root[linked]])], names=["u", "v"])


def links(codes: DataFrame, distance: int = DISTANCE, hot: int = HOT, blocks: int | None = None, owner: str = "links") -> DataFrame:
    """Edges (u, v) between fingerprints that span the components. codes: a column fp of distinct ones.

    Two codes within the distance agree on one of the choices of blocks: each code goes to a cell for each choice, and
    each task joins what it got with itself over an index. The more codes, the more bits a cell takes, so cells stay
    small; one that many codes share all the same is dealt out (see salted). Only edges of a spanning forest leave a task.
    """
    n = codes.count()
    masks = schemes(distance, blocks or blocks_for(n, distance, hot))
    cells = codes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    cells = cells.withColumn("cell", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
    dealt = salted(cells, hot, owner, "mask")
    tasks = max(task_count(dealt), n * len(masks) // AT_TASK)
    return small_batches(dealt.repartition(tasks, "cell", "a", "b").select("fp", "mask")).mapInArrow(lambda it: _links(it, distance), "u long, v long").where("u != v").distinct()


def components(edges: DataFrame, owner: str) -> DataFrame:
    """(node, root) of all nodes of the edges with the least node of their component: alternating stars, on Spark.

    Each round links every node to the least neighbour of its neighbours; tables in the shared folder cut the lineage.
    Labels only fall, so rounds end; a chain of n nodes takes about log n of them.
    """
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), owner, "edges")
    last = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).withColumn("m", F.least("m", "c"))
        large = both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.where("m < c").select("c", "m")).distinct()
        down = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = large.join(down, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        new = materialize(small.union(down.select("c", "m")).distinct(), owner, "edges")
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges = new
        if tuple(state) == last:
            break
        last = tuple(state)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, hot: int = HOT, blocks: int | None = None, owner: str = "op10") -> DataFrame:
    """(doc_id, fp, component_id) of each row.

    A null or wordless text has fingerprint zero and links like any other; a text of any length is one fingerprint, its
    shingles are unpacked AT_ONCE at a time; equal rows get equal results; a row without a doc_id links like any other and
    gets its component, which is null if no row of the component has an id; an empty table gives an empty result; only
    doc_id and text are read. Equal fingerprints are collapsed before anything else, so a text copied any number of times
    is one code.
    """
    fps = materialize(map_batches(docs.select("doc_id", "text"), _fingerprints, "doc_id long, fp long"), owner, "fps", spread=True)
    codes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), owner, "codes")
    roots = components(links(codes.select("fp"), distance, hot, blocks, owner), owner)
    placed = codes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    known = placed.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    known = placed.join(known, F.col("root") == F.col("r")).select(F.col("fp").alias("k_fp"), "component_id")
    out = materialize(fps.join(known, F.col("fp") == F.col("k_fp")).select("doc_id", "fp", "component_id"), f"{owner}-result", "result")
    release(docs.sparkSession, owner)
    return out


# ---- similar documents: the same index over wide fingerprints, confirmed by exact similarity

#: Words of a shingle and the least Jaccard similarity of two sets of shingles.
WORDS, SIMILARITY = 5, 0.8
#: 64-bit lanes of a wide fingerprint; the first two are compared, cells are chosen from all.
LANES, COMPARED = 4, 2
#: Share of the pairs at exactly the least similarity that meet in a cell.
RECALL = 0.97
#: Codes that an average cell may have, and codes of a cell that are compared without an index. A smaller cell takes a
#: longer key and so more tables: 24 for 200,000 texts, 66 for 12 million.
CELL, DIRECT = 64, 256
CODES = "doc_id long, " + ", ".join(f"c{k} long" for k in range(LANES)) + ", size int, s0 long, s1 long, prefix array<long>, parity binary"
#: Shingles are counted in so many documents, or one in COUNTED_SHARE if that is more, to put the frequent ones last: those
#: found OFTEN times, at most MOST_FREQUENT. Only how many pairs are compared depends on it, never which are found.
COUNTED, COUNTED_SHARE, OFTEN, MOST_FREQUENT = 10_000, 64, 4, 200_000
#: Rows of shingles looked at together, and pairs held before they leave a task.
TOGETHER, PAIRS = 1 << 16, 1 << 18
_LANE = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) for k in range(LANES)], np.uint64)


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of a text in lower case (A-Z): of the whole sequence where it is shorter,
    none without words."""
    w = word_hashes(text.lower())
    if not len(w):
        return w
    k = min(words, len(w))
    mixed = sum((w[i : len(w) - k + 1 + i] * (_LANE[0] + np.uint64(2 * i)) for i in range(k)), np.zeros(len(w) - k + 1, np.uint64))
    return np.unique(stirred(mixed))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Majority of the bits of LANES derived hashes of each shingle; zero without shingles."""
    ones = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(hashes), AT_ONCE // LANES):
        lanes = stirred(stirred(hashes[at : at + AT_ONCE // LANES, None] ^ _LANE) + _LANE)
        ones += np.unpackbits(lanes.astype(">u8").view(np.uint8).reshape(len(lanes), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.frombuffer(np.packbits(2 * ones > len(hashes)).tobytes(), ">u8").astype(np.uint64)


def differing(similarity: float) -> float:
    """Expected share of differing bits of two fingerprints of sets of that Jaccard similarity and equal size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables_for(codes: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """(bits of a cell's key, tables). Keys get longer with the number of codes, so that a cell stays small; there are as
    many tables as let RECALL of the least similar pairs meet."""
    bits = min(32, max(8, math.ceil(math.log2(max(codes, 1) / CELL + 1))))
    meet = (1 - differing(similarity)) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - meet))


def spanning(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Numbers of the edges of a least spanning forest of n items: each component takes its least edge, round by round.

    The weight is a distance of fingerprints, so an edge that is taken may not be similar enough by count while one that
    is left is; remaining_pairs() finds those."""
    place = np.lexsort((b, a, weight))
    rank = np.empty(len(place), np.int64)
    rank[place] = np.arange(len(place))
    root, chosen = np.arange(n), []
    while len(rank):
        x, y = root[a[place[rank]]], root[b[place[rank]]]
        rank, x, y = (z[x != y] for z in (rank, x, y))
        if not len(rank):
            break
        best = np.full(n, len(place))
        np.minimum.at(best, x, rank)
        np.minimum.at(best, y, rank)
        picked = np.unique(best[best < len(place)])
        chosen.append(place[picked])
        ends = forest(n, iter([(root[a[place[picked]]], root[b[place[picked]]])]))
        root = ends[root]
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def _cells(batch: pa.RecordBatch, keys: np.ndarray) -> Iterator[dict]:
    """A row for each table: the cell is the table's number and the code's bits at the table's places."""
    codes = np.stack([batch.column(f"c{k}").to_numpy().view(np.uint64) for k in range(LANES)], axis=1)
    bits = np.unpackbits(codes.astype(">u8").view(np.uint8).reshape(len(codes), -1), axis=1).astype(np.int64)
    weight = np.int64(1) << np.arange(keys.shape[1], dtype=np.int64)
    for t, places in enumerate(keys):
        yield {"cell": (bits[:, places] @ weight) | (np.int64(t) << np.int64(32)), "fp": batch.column("node"), **{f"c{k}": batch.column(f"c{k}") for k in range(COMPARED)}}


def _alike(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a least spanning forest of the codes within `most` bits, cell by cell (rows come sorted)."""

    def edges(cell: np.ndarray, node: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        size = np.diff(np.append(begin, len(cell)))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.unique(size[(size > 1) & (size <= DIRECT)]):
            x, y = np.triu_indices(k, 1)
            first = begin[size == k][:, None]
            for at in range(0, len(first), max(1, (1 << 20) // len(x))):
                p, q = (first[at : at + max(1, (1 << 20) // len(x))] + x).reshape(-1), (first[at : at + max(1, (1 << 20) // len(x))] + y).reshape(-1)
                near = np.bitwise_count(codes[p] ^ codes[q]).sum(axis=1) <= most
                a.append(p[near])
                b.append(q[near])
        for k in np.flatnonzero(size > DIRECT):
            kept = np.zeros((2, 0), np.int64)
            for p, q in GrayIndex(codes[begin[k] : begin[k] + size[k]]).pairs(most):
                both = np.concatenate((kept, [p, q]), axis=1)
                far = np.bitwise_count(codes[begin[k] + both[0]] ^ codes[begin[k] + both[1]]).sum(axis=1)
                kept = both[:, spanning(int(size[k]), both[0], both[1], far)]
            a.append(begin[k] + kept[0])
            b.append(begin[k] + kept[1])
        p, q = np.concatenate(a), np.concatenate(b)
        kept = spanning(len(cell), p, q, np.bitwise_count(codes[p] ^ codes[q]).sum(axis=1)) if len(p) else p
        u, v = node[p[kept]], node[q[kept]]
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    held: list[tuple] = []
    rows = 0
    for batch in batches:
        salts = batch.column("a").to_numpy().astype(np.int64) * MOST_SALTS + batch.column("b").to_numpy()
        cell = batch.column("cell").to_numpy() * np.int64(MOST_SALTS**2) + salts
        held.append((cell, batch.column("fp").to_numpy(), np.stack([batch.column(f"c{k}").to_numpy().view(np.uint64) for k in range(COMPARED)], axis=1)))
        rows += len(cell)
        if rows >= 1 << 16:
            cell, node, codes = (np.concatenate(x) for x in zip(*held, strict=True))
            done = len(cell) - int(np.argmax(cell[::-1] != cell[-1])) if (cell != cell[-1]).any() else 0  # the last cell may go on
            if done:
                yield from edges(cell[:done], node[:done], codes[:done])
            held, rows = [(cell[done:], node[done:], codes[done:])], len(cell) - done
    if rows:
        yield from edges(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[dict]:
    yield {"s_id": batch.column("doc_id"), "set": [shingle_set(t, words).tobytes() for t in texts(batch)]}


def _confirmed(batch: pa.RecordBatch, similarity: float, columns: list[str]) -> Iterator[dict]:
    keep = []
    for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        keep.append(both >= similarity * (len(x) + len(y) - both))
    kept = batch.filter(pa.array(keep, pa.bool_()))
    yield {c: kept.column(c) for c in columns}


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, similarity: float, owner: str) -> DataFrame:
    """The rows (u, v, ...) of a table of pairs of documents whose sets are similar enough by count."""
    ends = materialize(pairs.select(F.col("u").alias("w_id")).union(pairs.select("v")).distinct(), owner, "ends")
    sets = materialize(map_batches(docs.join(ends, F.col("doc_id") == F.col("w_id"), "left_semi"), lambda b: _sets(b, words), "s_id long, set binary"), owner, "sets")
    left = pairs.join(sets, F.col("u") == F.col("s_id")).select(*pairs.columns, F.col("set").alias("left"))
    both = left.join(sets, F.col("v") == F.col("s_id")).select(*pairs.columns, "left", F.col("set").alias("right"))
    columns = pairs.columns
    return map_batches(both, lambda b: _confirmed(b, similarity, columns), ", ".join(f"{c} long" for c in columns))


def frequent_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles that many documents have, in order of their values; class of each, higher where it is more frequent).

    This only orders shingles. Any order finds the same pairs (see prefix), this one with fewer comparisons; so some
    documents are counted, those of least hash, and the list is bounded.
    """
    every = max(1, min(COUNTED_SHARE, docs.count() // COUNTED))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        found, n = np.unique(np.concatenate([shingle_set(t, words) for t in texts(batch)]), return_counts=True)
        yield {"g": found.view(np.int64), "n": n}

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    counts = map_batches(some, run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    got = counts.orderBy(F.desc("n"), "g").limit(MOST_FREQUENT).toArrow()
    values = got.column("g").to_numpy().view(np.uint64)
    order = np.argsort(values)
    return values[order], 1 + np.log2(got.column("n").to_numpy()[order]).astype(np.int64)


def prefix(hashes: np.ndarray, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first n - least + 1 of n hashes, rare ones first, where sets that are similar share at least `least` of them.

    Two sets that share `least` have their first common hash, in an order that is the same for all, in both prefixes.
    """
    if not len(hashes):
        return hashes
    values, level = frequent
    known = np.zeros(len(hashes), np.int64)
    if len(values):
        at = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
        known = np.where(values[at] == hashes, level[at], 0)
    least = math.ceil(similarity * len(hashes) - 1e-6)
    return hashes[np.argsort(known, kind="stable")][: len(hashes) - least + 1]  # within a class, by value


def parity(hashes: np.ndarray) -> bytes:
    """512 bits: whether the number of hashes that fall to each is odd. Two sets differ in at least as many hashes as bits."""
    return np.packbits((np.bincount((hashes >> np.uint64(55)).astype(np.int64), minlength=512) & 1).astype(np.uint8)).tobytes()


def _meeting(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v, cu, cv, room, n) of sets of different components that share n shingles of their prefixes here, and may
    be similar by their sizes if they share `room` at least (rows come sorted by cell). Every pair of a cell is looked at.

    Of the two prefixes, one ends first in the order; what it lacks of the other up to there, its set lacks. So sets share
    at most what their prefixes do and the rest of that set. Pairs whose parity shows that they differ in too many shingles
    stay behind: that is certain, so no similar pair does.
    """
    names = ["cell", "a", "b", "fp", "size", "rest", "comp"]

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.concatenate(held)
        pairs = pairs[np.lexsort(pairs.T)]
        first = np.flatnonzero(np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(axis=1))))
        n = np.diff(np.append(first, len(pairs)))
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in pairs[first].T), pa.array(n)], names=["u", "v", "cu", "cv", "room", "n"])

    def pairs(cell: np.ndarray, a: np.ndarray, b: np.ndarray, fp: np.ndarray, size: np.ndarray, rest: np.ndarray, comp: np.ndarray, bits: np.ndarray) -> Iterator[np.ndarray]:
        begin = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        counts = np.diff(np.append(begin, len(cell)))
        last = np.repeat(begin + counts, counts)
        x, step = np.arange(len(cell)), 0
        while len(x):
            step += 1
            x = x[x + step < last[x]]
            y = x + step
            ok = (comp[x] != comp[y]) & (np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-6)
            p, q = x[ok], y[ok]
            least = np.ceil(similarity / (1 + similarity) * (size[p] + size[q]) - 1e-6).astype(np.int64)
            ok = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1, dtype=np.int64) <= size[p] + size[q] - 2 * least
            p, q, least = p[ok], q[ok], least[ok]
            if len(p):
                turned = fp[p] < fp[q]
                p, q = np.where(turned, q, p), np.where(turned, p, q)
                yield np.stack([fp[p], fp[q], comp[p], comp[q], least - np.maximum(rest[p], rest[q])], axis=1)

    def whole() -> Iterator[list[np.ndarray]]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            bits = np.frombuffer(b"".join(batch.column("parity").to_pylist()), np.uint64).reshape(-1, 8)
            held.append([*(batch.column(c).to_numpy().astype(np.int64) for c in names), bits])
            rows += batch.num_rows
            if rows >= TOGETHER:
                got = [np.concatenate(x) for x in zip(*held, strict=True)]
                other = (got[0] != got[0][-1]) | (got[1] != got[1][-1]) | (got[2] != got[2][-1])
                done = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0  # the last cell may go on
                if done:
                    yield [x[:done] for x in got]
                held, rows = [[x[done:] for x in got]], rows - done
        if rows:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]

    held: list[np.ndarray] = []
    for got in whole():
        for some in pairs(*got):
            held.append(some)
            if sum(map(len, held)) >= PAIRS:
                yield out(held)
                held = []
    if held:
        yield out(held)


def remaining_pairs(sets: DataFrame, similarity: float, hot: int, owner: str) -> DataFrame:
    """(u, v, cu, cv): all pairs of sets of different components that may be similar; none that is similar is missing.

    sets: (fp, comp, size, prefix, parity), one row for each distinct set. Sets that share a shingle of their prefixes meet in its
    cell; cells of one component are left, those with more than `hot` sets are dealt out (see salted), where a pair may be
    counted more than once, so that too many pairs go on, never too few.
    """
    cells = sets.select("fp", "comp", "size", "parity", (F.col("size") - F.size("prefix")).alias("rest"), F.explode("prefix").alias("cell"))
    alive = cells.groupBy(F.col("cell").alias("k")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("k")
    # tables, so that joins with what is short need no shuffle
    alive = materialize(alive, owner, "alive")
    cells = materialize(cells.join(alive, F.col("cell") == F.col("k"), "left_semi"), owner, "cells")
    dealt = salted(cells, hot, owner, "size", "rest", "comp", "parity")
    dealt = dealt.repartition(task_count(dealt), "cell", "a", "b").sortWithinPartitions("cell", "a", "b", "fp")
    met = small_batches(dealt).mapInArrow(lambda it: _meeting(it, similarity), "u long, v long, cu long, cv long, room long, n long")
    met = met.groupBy("u", "v", "cu", "cv").agg(F.max("room").alias("room"), F.sum("n").alias("n")).where("n >= room")
    return materialize(met.select("u", "v", "cu", "cv"), owner, "rest")


def similar_documents(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, hot: int = HOT, owner: str = "similar") -> DataFrame:
    """(doc_id, component_id) of each row with an id: documents whose sets of word shingles have a Jaccard similarity of
    `similarity` or more are linked, and a component's id is its least doc_id. No link is missing.

    Wide fingerprints of the sets go to cells of several tables, chosen bits of the fingerprint each; in a cell, codes
    near each other are found directly or, in large cells, over the index; a least spanning forest of them leaves the
    task, and of its edges those stay whose sets are similar enough by count. Equal fingerprints are one code.

    That joins nearly all that is similar. An exact join finds the rest: sets that are similar share a shingle of their
    prefixes (see prefix), so all pairs that do, and whose components still differ, are counted too. Distinct sets take
    part in it, not codes, so that a link of any text of a code counts.

    A null or wordless text has the empty set, and all such are linked; a text of any length is one set; equal rows get
    equal results; rows without an id take no part and are not returned; rows that share an id are one document; an empty
    table gives an empty result; only doc_id and text are read.
    """
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, words))

    def fingerprints(batch: pa.RecordBatch) -> Iterator[dict]:
        sets = [shingle_set(t, words) for t in texts(batch)]
        codes = np.array([wide_fingerprint(s) for s in sets], np.uint64).reshape(-1, LANES).view(np.int64)
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
        first = [prefix(s, similarity, shared.value) for s in sets]
        ends = np.cumsum([0, *map(len, first)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*first, np.zeros(0, np.uint64)]).view(np.int64)))
        yield {"doc_id": batch.column("doc_id"), **{f"c{k}": codes[:, k] for k in range(LANES)}, "size": [len(s) for s in sets], "s0": digests[:, 0], "s1": digests[:, 1], "prefix": lists, "parity": [parity(s) for s in sets]}

    lanes = [f"c{k}" for k in range(LANES)]
    prints = materialize(map_batches(docs, fingerprints, CODES), owner, "prints", spread=True)
    codes = materialize(prints.groupBy(*lanes).agg(F.min("doc_id").alias("node")), owner, "codes")
    n = codes.count()
    bits, tables = tables_for(n, similarity)
    r = np.random.default_rng(13)
    keys = np.array([r.permutation(64 * LANES)[:bits] for _ in range(tables)])
    cells = map_batches(codes, lambda b: _cells(b, keys), "cell long, fp long, " + ", ".join(f"c{k} long" for k in range(COMPARED)))
    dealt = salted(cells, hot, owner, *lanes[:COMPARED])
    share, width = differing(similarity), 64 * COMPARED
    most = math.ceil(width * share + 3 * math.sqrt(width * share * (1 - share)))
    tasks = max(task_count(docs), n * tables // AT_TASK)
    dealt = dealt.repartition(tasks, "cell", "a", "b").sortWithinPartitions("cell", "a", "b", "fp")
    near = materialize(small_batches(dealt).mapInArrow(lambda it: _alike(it, most), "u long, v long").where("u != v").distinct(), owner, "near")
    roots = components(confirmed(near, docs, words, similarity, owner), owner)
    known = codes.join(roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").select(*[F.col(c).alias(f"k_{c}") for c in lanes], F.coalesce("root", "node").alias("comp"))
    known = materialize(known, owner, "known")
    same = [F.col(c) == F.col(f"k_{c}") for c in lanes]
    # equal sets have equal columns but for the id
    sets = prints.where("size > 0").groupBy("s0", "s1").agg(F.min("doc_id").alias("fp"), *[F.first(c).alias(c) for c in (*lanes, "size", "prefix", "parity")])
    sets = materialize(sets.join(known, same).select("fp", "comp", "size", "prefix", "parity"), owner, "distinct")
    rest = confirmed(remaining_pairs(sets, similarity, hot, owner), docs, words, similarity, owner)
    joined = components(rest.select(F.col("cu").alias("u"), F.col("cv").alias("v")), owner)
    known = known.join(joined, F.col("comp") == F.col("node"), "left").select(*[f"k_{c}" for c in lanes], F.coalesce("root", "comp").alias("component_id"))
    out = materialize(prints.join(known, same).select("doc_id", "component_id"), f"{owner}-result", "result")
    release(docs.sparkSession, owner)
    return out


def deduplicated(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, hot: int = HOT, owner: str = "dedup") -> DataFrame:
    """The documents whose id is the least of their component; see similar_documents. Rows that share a doc_id are one
    document and stay together; rows without an id stay too, since no other row can stand for them. All columns stay,
    whatever their names; an empty table gives an empty one."""
    stays = F.max(F.col("doc_id") == F.col("component_id"))
    gone = similar_documents(docs, words, similarity, hot, owner).groupBy("doc_id").agg(stays.alias("stays")).where("NOT stays").select(F.col("doc_id").alias("gone_id"))
    # a table, so that texts need not travel where it is short enough to be broadcast
    gone = materialize(gone, f"{owner}-result", "gone")
    out = docs.select(F.struct("*").alias("row")).join(gone, F.col("row.doc_id") == F.col("gone_id"), "left_anti")
    return fewer(out.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document by the contract's parameters: 3-word shingles, 3 bits."""
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
