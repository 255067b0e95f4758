"""Removal of repeated byte strings (a Burrows-Wheeler transform decides) and of repeated word windows (sorting decides)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fewer, map_batches, materialize, ranges, release, small_batches, task_count, to_batch
from .segments import HOT, STEP, TABLE, Repeats, packed, segments, stirred, unpacked

#: Bytes of a repeated string, and of the grams its minimiser is chosen from.
BYTES, BYTE_GRAM = 100, 28
#: Words of a repeated window, and of the grams its minimiser is chosen from.
WORDS, WORD_GRAM = 35, 8
#: Bytes of strings that one transform takes.
BLOCK = 1 << 16
END = 0xFF  # never a byte of UTF-8
#: Places of the minimiser in a window, together in one piece of a run at a hot minimiser.
BYTE_SPAN, WORD_SPAN = 10, 4
STRINGS = "key long, piece boolean, seg long, doc_id long, start long, nwin int, string binary"
FOUND = "doc_id long, lo long, hi long"
SINGLE = "wa long, wb long, doc_id long, lo long"


# ---- the transform


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` bytes at least, by doubling from 8-byte keys."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for t in range(8):
        key = (key << np.uint64(8)) | padded[t : t + n]
    have = 8
    while True:
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        if have >= depth or new[-1] == n - 1:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = new
        key = (rank + np.uint64(1)) << np.uint64(32)
        key[: n - have] |= rank[have:] + np.uint64(1)
        have *= 2


def prefix_groups(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, number of the group of each): suffixes of a group share their first `least` bytes.

    Intervals of the transform are extended to the left by one byte, breadth first. An interval of prefix length l that
    ends where no common prefix is known yet fixes the common prefix there to l - 1, so values come up in increasing
    order, and the search ends at `least`: what is still open then is at least that long. END ends a string and is
    never extended over. Suffixes of fewer than `least` bytes may fall into any group.
    """
    n = len(text)
    order = suffix_order(text, least + 1)
    bwt = text[order - 1]  # of the first suffix: the last byte, which is END
    by_symbol = np.argsort(bwt, kind="stable")
    left = np.empty(n, np.int64)  # place of the suffix one byte longer
    left[by_symbol] = np.arange(n)
    symbol = bwt[by_symbol]
    same = symbol[1:] == symbol[:-1]
    before, after = np.full(n, -1), np.full(n, n)
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    known = np.zeros(n + 1, bool)
    lo, hi = np.zeros(1, np.int64), np.full(1, n)
    for length in range(least):
        at = ranges(lo, hi - lo)
        sizes = hi - lo
        starts, ends = before[at] < np.repeat(lo, sizes), after[at] >= np.repeat(hi, sizes)
        if length:
            inside = bwt[at] != END
            starts &= inside
            ends &= inside
        new_lo, new_hi = np.sort(left[at[starts]]), np.sort(left[at[ends]]) + 1
        open_ = ~known[new_hi]
        lo, hi = new_lo[open_], new_hi[open_]
        if not len(lo):
            break
        known[hi] = True
    return order, np.cumsum(known[:n])


def later_windows(strings: list[bytes], doc: np.ndarray, start: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """(number of the string, first window, end window) of windows that an earlier place (doc, start) has too."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    text = np.frombuffer(bytes([END]).join(strings) + bytes([END]), np.uint8)
    order, group = prefix_groups(text, width)
    begins = np.cumsum(lengths + 1) - lengths - 1
    owner = np.searchsorted(begins, order, side="right") - 1
    inner = order - begins[owner]
    fits = inner + width <= lengths[owner]
    owner, inner, group = owner[fits], inner[fits], group[fits]
    by = np.lexsort((start[owner] + inner, doc[owner], group))
    owner, inner, group = owner[by], inner[by], group[by]
    later = np.concatenate(([False], group[1:] == group[:-1])) if len(group) else np.zeros(0, bool)
    owner, inner = owner[later], inner[later]
    by = np.lexsort((inner, owner))
    owner, inner = owner[by], inner[by]
    if len(owner):
        cut = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (inner[1:] != inner[:-1] + 1))))
        ends = np.append(cut[1:], len(owner)) - 1
        yield from zip(owner[cut].tolist(), inner[cut].tolist(), (inner[ends] + 1).tolist(), strict=True)


# ---- sorting word windows


def repeated_windows(strings: list[bytes], width: int) -> Iterator[tuple[int, int, int]]:
    """(number of the string, first window, end window) of windows that occur again, by sorting all windows."""
    rows = []
    for k, s in enumerate(strings):
        w = s.split(b" ")
        rows += [(b" ".join(w[i : i + width]), k, i) for i in range(len(w) - width + 1)]
    rows.sort()
    hit = sorted((k, i) for x, (g, k, i) in enumerate(rows) if (x and rows[x - 1][0] == g) or (x + 1 < len(rows) and rows[x + 1][0] == g))
    at = 0
    while at < len(hit):
        end = at
        while end + 1 < len(hit) and hit[end + 1] == (hit[end][0], hit[end][1] + 1):
            end += 1
        yield hit[at][0], hit[at][1], hit[end][1] + 1
        at = end + 1


# ---- from texts to runs and back


def byte_values(got: list[bytes], window: int = BYTES) -> Iterator[tuple]:
    """Pieces of texts as two 64-bit values for each byte."""
    pieces = [(d, o, t[o : o + STEP + window - 1]) for d, t in enumerate(got) if len(t) >= window for o in range(0, len(t) - window + 1, STEP)]
    yield from _joined(pieces, len, lambda part: (TABLE[0][x := np.frombuffer(b"".join(part), np.uint8)], TABLE[1][x]))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word; long texts are cut between words first."""
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + STEP)
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        parts.append(_hashes(text[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _hashes(text: bytes) -> np.ndarray:
    from .segments import _A, _A_INV, Rolling

    x = np.frombuffer(text, np.uint8)
    out = np.concatenate(([True], _SPACE[x], [True]))
    start, end = np.flatnonzero(out[:-1] & ~out[1:]), np.flatnonzero(~out[:-1] & out[1:])
    return Rolling(TABLE[0][x], _A, _A_INV).of(start, end)


def word_values(got: list[bytes], window: int = WORDS) -> Iterator[tuple]:
    """Pieces of texts as two 64-bit values for each word. Many texts are hashed in one step."""
    group, size = [], 0

    def flush() -> Iterator[tuple]:
        hashed = word_hashes(b"\n".join(t for _, t in group))
        # words of each text: count breaks once more, by splitting at the joints
        counts = np.fromiter((len(t.split()) for _, t in group), np.int64, len(group))
        ends = np.cumsum(counts)
        pieces = [(d, o, hashed[e - c + o : min(e, e - c + o + STEP + window - 1)]) for (d, _), c, e in zip(group, counts.tolist(), ends.tolist(), strict=True) if c >= window for o in range(0, c - window + 1, STEP)]
        yield from _joined(pieces, len, lambda part: (x := np.concatenate(part), stirred(x ^ np.uint64(0x5851F42D4C957F2D))))

    for d, t in enumerate(got):
        group.append((d, t))
        size += len(t)
        if size >= STEP:
            yield from flush()
            group, size = [], 0
    if group:
        yield from flush()


def _joined(pieces: list, length: Callable, values: Callable) -> Iterator[tuple]:
    at = 0
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and (end == at or size + length(pieces[end][2]) <= STEP):
            size += length(pieces[end][2])
            end += 1
        part = pieces[at:end]
        yield (np.array([p[0] for p in part]), np.array([p[1] for p in part]), np.array([length(p[2]) for p in part]), *values([p[2] for p in part]))
        at = end


class Bytes:
    """Windows of bytes: all but the first occurrence are removed."""

    def __init__(self, width: int, gram: int, span: int = BYTE_SPAN):
        self.width, self.gram, self.span = width, gram, span

    def symbols(self, text: bytes) -> bytes:
        return text

    def string(self, part: bytes) -> bytes:
        return bytes(part)

    def search(self, strings: list[bytes], doc: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
        return list(later_windows(strings, doc, start, self.width))


class Words:
    """Windows of words: all occurrences of repeated ones are removed."""

    def __init__(self, width: int, gram: int, span: int = WORD_SPAN):
        self.width, self.gram, self.span = width, gram, span

    def symbols(self, text: bytes) -> list[bytes]:
        return text.split()

    def string(self, part: list[bytes]) -> bytes:
        return b" ".join(part)

    def search(self, strings: list[bytes], doc: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
        return list(repeated_windows(strings, self.width))


def pieces(kind: Bytes | Words, part: bytes | list[bytes], off: int, nwin: int) -> Iterator[tuple[int, int, bytes]]:
    """(first window, windows, core) of the pieces of a run.

    Windows go together if the minimiser's place in them falls into one of fixed ranges of `span` places. The core is
    what all windows with such a place have: window - span + 1 symbols about the minimiser. Equal windows have their
    minimiser at the same place, so they come into pieces with the same core.
    """
    for r in range((off - nwin + 1) // kind.span, off // kind.span + 1):
        low, high = r * kind.span, min((r + 1) * kind.span - 1, kind.width - kind.gram)
        first, last = max(0, off - high), min(nwin - 1, off - low)
        yield first, last - first + 1, b"%d " % r + kind.string(part[off - low : off - high + kind.width])


def _signed(data: bytes, size: int = 8) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=size).digest(), "big", signed=True)


def extracted(docs: DataFrame, mixed: DataFrame, kind: Bytes | Words) -> DataFrame:
    """Packed strings of the first occurrence of each mixed run: one with the minimiser as its key or, at hot minimisers,
    one for each piece, with a hash of its core as key."""
    wanted = mixed.groupBy(F.col("doc_id").alias("w_id")).agg(F.collect_list(F.struct("mini", "hot", "start", "nwin", "off")).alias("runs"))
    rows = packed(docs).join(wanted, F.col("doc_id") == F.col("w_id")).select("doc_id", "z", "runs")
    names = [k.split()[0] for k in STRINGS.split(", ")]

    def pull(batch: pa.RecordBatch) -> Iterator[dict]:
        out: list[tuple] = []
        for doc, z, got in zip(batch.column("doc_id").to_pylist(), batch.column("z").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            body = kind.symbols(unpacked(z))
            for r in got:
                part = body[r["start"] : r["start"] + r["nwin"] + kind.width - 1]
                if not r["hot"]:
                    out.append((r["mini"], False, 0, doc, r["start"], r["nwin"], kind.string(part)))
                    continue
                for first, n, core in pieces(kind, part, r["off"], r["nwin"]):
                    string = kind.string(part[first : first + n + kind.width - 1])
                    out.append((_signed(core), True, _signed(string), doc, r["start"] + first, n, string))
            if len(out) > 10_000:
                yield dict(zip(names, map(list, zip(*out, strict=True)), strict=True))
                out = []
        if out:
            yield dict(zip(names, map(list, zip(*out, strict=True)), strict=True))

    return map_batches(rows, pull, STRINGS)


def _by_block(batches: Iterator[pa.RecordBatch], kind: Bytes | Words) -> Iterator[pa.RecordBatch]:
    """Feed the strings of whole keys, about BLOCK bytes at a time, to the search; gives the spans that it removes."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "lo", "hi")])
    rows: list[tuple] = []
    size = 0

    def found() -> Iterator[pa.RecordBatch]:
        doc, start = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        if got := kind.search([r[1] for r in rows], doc, start):
            k, lo, hi = (np.array(x) for x in zip(*got, strict=True))
            yield to_batch({"doc_id": doc[k], "lo": start[k] + lo, "hi": start[k] + hi + kind.width - 1}, schema)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "string", "doc_id", "start")), strict=True):
            if size >= BLOCK and row[0] != rows[-1][0]:
                yield from found()
                rows, size = [], 0
            rows.append(row)
            size += len(row[1])
    if rows:
        yield from found()


def _single(batch: pa.RecordBatch, kind: Bytes | Words) -> Iterator[dict]:
    """Each window of a piece on its own, by a 128-bit hash."""
    out: dict[str, list] = {c.split()[0]: [] for c in SINGLE.split(", ")}
    for doc, start, n, string in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "nwin", "string")), strict=True):
        body = kind.symbols(string)
        for i in range(n):
            d = hashlib.blake2b(kind.string(body[i : i + kind.width]), digest_size=16).digest()
            for c, v in zip(out, (int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), doc, start + i), strict=True):
                out[c].append(v)
    yield out


def _spans(docs: DataFrame, known: Repeats, kind: Bytes | Words, owner: str, hot: int = HOT) -> DataFrame:
    """Removed spans.

    Equal strings are one string before they travel, and all of them but the first (for words: all) go. Distinct strings
    of one key meet in one task, where the search decides. Where a key has over `hot` of them, they are cut into pieces
    with keys that take more of the text: runs of a minimiser into pieces of `span` windows, and those at last into
    single windows, where equal strings are all that there is to find.
    """
    every = isinstance(kind, Words)
    tail = kind.width - 1
    strings = materialize(extracted(docs, known.mixed, kind), owner, "strings")
    parts = strings.where("piece")
    grouped = parts.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "start")).alias("first"), F.max("nwin").alias("nwin"), F.min("string").alias("string"))
    one = materialize(grouped.select("key", "seg", "n", "first.doc_id", "first.start", "nwin", "string"), owner, "pieces")
    kinds = materialize(one.groupBy(F.col("key").alias("m")).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), owner, "kinds")
    several = one.join(kinds, F.col("key") == F.col("m"))
    columns = ["key", "doc_id", "start", "string"]
    mixed = strings.where("NOT piece").select(*columns).union(several.where(F.col("kinds") <= hot).select(*columns))
    dealt = mixed.repartition(task_count(mixed), "key").sortWithinPartitions("key", "doc_id", "start")
    found = small_batches(dealt).mapInArrow(lambda it: _by_block(it, kind), FOUND)
    single = materialize(map_batches(several.where(F.col("kinds") > hot).select("doc_id", "start", "nwin", "string"), lambda b: _single(b, kind), SINGLE), owner, "single")
    shared = materialize(single.groupBy(F.col("wa").alias("ka"), F.col("wb").alias("kb")).agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("doc_id", "lo")).alias("f")).where("k > 1"), owner, "shared")
    again = single.join(shared, (F.col("wa") == F.col("ka")) & (F.col("wb") == F.col("kb")))
    again = again if every else again.where((F.col("doc_id") != F.col("f.doc_id")) | (F.col("lo") != F.col("f.lo")))
    more = one.where("n > 1").select(F.col("key").alias("m"), F.col("seg").alias("s"), F.col("doc_id").alias("first_doc"), F.col("start").alias("first_start"))
    copies = known.copies().union(parts.join(more, (F.col("key") == F.col("m")) & (F.col("seg") == F.col("s"))).select("doc_id", "start", "nwin", "first_doc", "first_start"))
    copies = copies if every else copies.where((F.col("doc_id") != F.col("first_doc")) | (F.col("start") != F.col("first_start")))
    equal = copies.select("doc_id", F.col("start").alias("lo"), (F.col("start") + F.col("nwin") + tail).alias("hi"))
    every_span = equal.union(found).union(again.select("doc_id", "lo", (F.col("lo") + kind.width).alias("hi")))
    # spans are few; once they are written, the large tables can go
    out = materialize(every_span, f"{owner}-spans", "spans")
    release(docs.sparkSession, owner)
    return out


def merged(spans: list, limit: int | None = None) -> list[tuple[int, int]]:
    """Spans as maximal runs in order; touching ones are one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            if hi > out[-1][1]:
                out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def with_spans(docs: DataFrame, spans: DataFrame, read: Callable[[bytes, list], dict], schema: str) -> DataFrame:
    """Apply read(text, merged spans) to each document."""
    # Spans of a document number at most its positions; rows of all tasks meet by document.
    grouped = spans.groupBy(F.col("doc_id").alias("s_id")).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    rows = packed(docs).join(grouped, F.col("doc_id") == F.col("s_id"), "left").select("doc_id", "z", "spans")
    names = [c.split()[0] for c in schema.split(", ")]

    def apply(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {n: [] for n in names}
        for doc, z, got in zip(batch.column("doc_id").to_pylist(), batch.column("z").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            row = read(unpacked(z), merged([(x["lo"], x["hi"]) for x in got or []])) | {"doc_id": doc}
            for n in names:
                out[n].append(row[n])
        yield out

    return fewer(map_batches(rows, apply, schema))


def repeated_byte_spans(docs: DataFrame, window: int = BYTES, gram: int = BYTE_GRAM, hot: int = HOT, owner: str = "op5") -> DataFrame:
    """(doc_id, lo, hi) of bytes covered by a string of `window` bytes that also starts earlier."""
    found = segments(docs, lambda got: byte_values(got, window), window, gram)
    return _spans(docs, Repeats(found, owner, hot), Bytes(window, gram), owner, hot)


def repeated_word_spans(docs: DataFrame, window: int = WORDS, gram: int = WORD_GRAM, hot: int = HOT, owner: str = "op6") -> DataFrame:
    """(doc_id, lo, hi) of words covered by a window of `window` words that also starts elsewhere."""
    found = segments(docs, lambda got: word_values(got, window), window, gram)
    return _spans(docs, Repeats(found, owner, hot), Words(window, gram), owner, hot)


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for lo, hi in spans:
        kept.append(text[at:lo])
        at = hi
    return b"".join([*kept, text[at:]])


def suffix_dedup(docs: DataFrame, window: int = BYTES, gram: int = BYTE_GRAM, hot: int = HOT, owner: str = "op5") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept): each text without bytes that an earlier equal string covers.

    Runs of windows with one minimiser are collapsed where equal; the distinct ones of a minimiser travel to one task,
    which builds Burrows-Wheeler transforms over some 64 KiB of whole minimisers (what fits a cache) and extends its
    intervals until they are `window` bytes deep. Where a minimiser has over `hot` distinct runs (a passage with a
    different neighbour in each document), its runs are cut into a few pieces whose keys are most of a window's text, and
    these are transformed; see _spans for the last resort.

    A null text is empty; a row without a doc_id takes no part and is returned unchanged; doc_id must be unique (rows that
    share one are taken as one document for the order, and each is returned); texts shorter than the window are
    unchanged; a text of any length is cut into pieces that overlap by a window less one; an empty table gives an empty
    result; only doc_id and text are read. `kept` is bytes: a span can end inside a character.
    """
    return with_spans(docs, repeated_byte_spans(docs, window, gram, hot, owner), lambda t, s: {"n_bytes": len(t), "n_removed": sum(h - lo for lo, h in s), "n_spans": len(s), "kept": _without(t, s)}, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def word_window_dedup(docs: DataFrame, window: int = WORDS, gram: int = WORD_GRAM, hot: int = HOT, owner: str = "op6") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text without words that a window occurring elsewhere too covers.

    Super-k-mers (consecutive windows with one minimiser) travel as one string of words to the task of their minimiser,
    which sorts its windows and counts them exactly; equal super-k-mers are collapsed before they travel, and those of
    very frequent minimisers are cut finer as in suffix_dedup. Nulls, short, very long and empty inputs and repeated rows
    are as there.
    """

    def read(text: bytes, spans: list) -> dict:
        w = text.split()
        kept: list[bytes] = []
        at = 0
        for lo, hi in spans:
            kept += w[at:lo]
            at = hi
        kept += w[at:]
        return {"n_words": len(w), "n_removed": len(w) - len(kept), "kept": b" ".join(kept)}

    return with_spans(docs, repeated_word_spans(docs, window, gram, hot, owner), read, "doc_id long, n_words long, n_removed long, kept binary")


def without_repeats(docs: DataFrame, text: str = "text", window: int = BYTES, gram: int = BYTE_GRAM, hot: int = HOT, owner: str = "substrings") -> DataFrame:
    """The documents without the bytes that suffix_dedup removes. A character that loses a byte goes as a whole; n_chars,
    if there, is counted anew; all rows stay, even those that nothing is left of.

    Null texts stay null; rows without an id, empty, short and very long texts and repeated rows are as in suffix_dedup;
    all columns stay, whatever their names; an empty table gives an empty one.
    """
    spans = repeated_byte_spans(docs.select("doc_id", F.col(text).alias("text")), window, gram, hot, owner)
    grouped = spans.groupBy(F.col("doc_id").alias("s_id")).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    rows = docs.select(F.struct("*").alias("row")).join(grouped, F.col("row.doc_id") == F.col("s_id"), "left")

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        row = batch.column("row")
        out = {f.name: row.field(i) for i, f in enumerate(row.type)}
        body = [t if not s or t is None else _without(t, merged([(x["lo"], x["hi"]) for x in s])).decode("utf-8", "ignore") for t, s in zip(out[text].cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True)]
        body = [t.decode() if isinstance(t, bytes) else t for t in body]
        out[text] = body
        if "n_chars" in out:
            out["n_chars"] = [None if t is None else len(t) for t in body]
        yield out

    fields = docs.schema
    return fewer(map_batches(rows.select("row", "spans"), cut, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the documents table without repeated strings of 100 bytes, by digest."""
    return suffix_dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the documents table without repeated windows of 35 words, by digest."""
    return word_window_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
