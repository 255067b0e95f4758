"""Removal of repeated strings and windows, and near-duplicate components, against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparrowdeck.llm import near_dedup as nd
from sparrowdeck.llm import substring_dedup as sd


def brute_bytes(rows, width):
    """{doc_id: (n_removed, n_spans, kept)} by a dictionary of all strings."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        t = (text or "").encode()
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - width + 1):
            if t[i : i + width] in seen:
                gone[i : i + width] = True
            seen.add(t[i : i + width])
        runs = int(np.sum(gone[:-1] & ~np.concatenate(([False], gone[:-2])))) if len(t) else 0
        out[doc] = (len(t), int(gone.sum()), runs, bytes(b for b, g in zip(t, gone, strict=False) if not g))
    return out


def brute_words(rows, width):
    at = defaultdict(int)
    split = {d: (t or "").encode().split() for d, t in rows}
    for w in split.values():
        for i in range(len(w) - width + 1):
            at[tuple(w[i : i + width])] += 1
    out = {}
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if at[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        out[d] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def check_bytes(spark, rows, width=100, **kw):
    got = {r[0]: tuple(r[1:4]) + (bytes(r[4]),) for r in sd.suffix_dedup(frame(spark, rows), width, **kw).collect()}
    assert got == brute_bytes(rows, width)


def check_words(spark, rows, width=35, **kw):
    got = {r[0]: (r[1], r[2], bytes(r[3])) for r in sd.word_window_dedup(frame(spark, rows), width, **kw).collect()}
    assert got == brute_words(rows, width)


def made(seed, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 5))) for _ in range(60)]
    line = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared = [line(r.randint(30, 90)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [line(r.randint(0, 60)) for _ in range(3)] + r.sample(shared, r.randint(0, 3))
        r.shuffle(parts)
        rows.append((i * 3 + 1, "\n".join(parts)))
    rows += [(1000 + i, rows[i][1]) for i in range(10)]
    for i in range(10):
        w = rows[20 + i][1].split(" ")
        w[len(w) // 2] = "changed"
        rows.append((2000 - i, " ".join(w)))
    rows += [(3000, None), (3001, ""), (3002, "ab" * 400), (3003, "x" * 99), (3004, "x" * 100), (3005, "x" * 500), (3006, "a b " * 100), (5, "y" * 5000)]
    return rows


@pytest.mark.parametrize("hot", [256, 2])
def test_bytes_against_brute_force(spark, hot):
    check_bytes(spark, made(1), hot=hot)


@pytest.mark.parametrize("hot", [256, 2])
def test_words_against_brute_force(spark, hot):
    check_words(spark, made(2), hot=hot)


def test_pieces_of_long_texts(spark, monkeypatch):
    from sparrowdeck.llm import segments

    rows = made(3, 20)
    for mod in (sd, segments):
        monkeypatch.setattr(mod, "STEP", 700)
    got = list(sd.byte_values([t.encode() for _, t in rows if t], 100))
    assert max(len(x[3]) for x in got) <= 2 * 799
    whole = sd.word_hashes(rows[3][1].encode())
    assert len(whole) == len(rows[3][1].split())


def test_documents_table(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_bytes(spark, rows)
    check_words(spark, rows)


def test_queries_give_digests(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {d: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for d, x in brute_bytes(rows, 100).items()}
    assert {r[0]: tuple(r[1:]) for r in sd.op5_suffix_array_dedup(spark, sf).collect()} == want
    words = {d: (*x[:2], hashlib.sha256(x[2]).hexdigest()) for d, x in brute_words(rows, 35).items()}
    assert {r[0]: tuple(r[1:]) for r in sd.op6_substring_dedup(spark, sf).collect()} == words


def test_empty_table(spark):
    assert sd.suffix_dedup(frame(spark, [])).count() == 0
    assert sd.word_window_dedup(frame(spark, [])).count() == 0
    assert nd.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_groups_of_the_transform(seed):
    r = random.Random(seed)
    strings = [bytes(r.choice(b"ab" if seed % 2 else b"abcd") for _ in range(r.randint(1, 60))) for _ in range(20)]
    strings += strings[:3]
    least = r.choice([3, 7, 12])
    text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
    order, group = sd.prefix_groups(text, least)
    of = {}
    for place, g in zip(order.tolist(), group.tolist(), strict=True):
        w = text[place : place + least].tobytes()
        if len(w) == least and b"\xff" not in w:
            of.setdefault(w, set()).add(g)
    assert all(len(x) == 1 for x in of.values())
    assert len({next(iter(x)) for x in of.values()}) == len(of)


# ---- SimHash


def brute_fingerprint(text):
    import re

    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}
    changed = True
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3]
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return root


@pytest.mark.parametrize("hot", [600, 3])
def test_components_against_brute_force(spark, sf, hot):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = made(4, 30)
    docs = docs.union(frame(spark, [(d + 100_000, t) for d, t in extra]))
    prints = {r[0]: brute_fingerprint(r[1]) for r in docs.collect()}
    root = brute_components(prints)
    got = {r[0]: (r[1] % (1 << 64), r[2]) for r in nd.near_duplicates(docs, hot=hot).collect()}
    assert got == {d: (prints[d], root[d]) for d in prints}


def test_links_of_clustered_codes(spark):
    r = random.Random(5)
    codes = set()
    for _ in range(8):
        c = r.getrandbits(64)
        for _ in range(60):
            x = c
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
            codes.add(x)
    codes = sorted(codes)
    root = brute_components(dict(enumerate(codes)))
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    frame_ = spark.createDataFrame([(c,) for c in signed], "fp long")
    for hot, blocks in ((600, None), (7, None), (600, 5), (20, 6)):
        got = dict(nd.components(nd.links(frame_, hot=hot, blocks=blocks), "test").collect())
        groups = defaultdict(set)
        for i, c in enumerate(signed):
            groups[got.get(c, c)].add(i)
        assert {min(g): g for g in groups.values()} == {k: {i for i, x in root.items() if x == k} for k in set(root.values())}


def test_blocks_grow_with_the_codes():
    assert [nd.blocks_for(n) for n in (10, 9_000_000, 50_000_000, 10**11)] == [4, 4, 5, 6]
    for blocks in (4, 5, 6):
        assert all(bin(m).count("1") >= 64 * (blocks - 3) // blocks - 3 for m in nd.schemes(3, blocks))


def jaccard(a, b):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def brute_similar(rows):
    """Components of texts of a five-word Jaccard similarity of 0.8 or more."""
    root = {d: d for d, _ in rows}
    links = [(a, b) for k, (a, s) in enumerate(rows) for b, t in rows[k + 1 :] if jaccard(s, t) >= 0.8]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return root


def near_rows(seed, n=40):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(4000)]
    rows = []
    for g in range(n):
        base = [r.choice(vocab) for _ in range(r.choice([30, 120, 250]))]
        rows.append((len(rows) * 7 % 1009, " ".join(base)))
        for _ in range(r.choice([0, 1, 1, 8])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((len(rows) * 7 % 1009, " ".join(w).upper() if r.random() < 0.2 else " ".join(w)))
    return [*rows, (5000, None), (5001, ""), (5002, " \n"), (5003, "one two"), (5004, "ONE two"), (5005, "one"), (5006, "a b c " * 5000), (5007, "a b c " * 5000)]


@pytest.mark.parametrize("hot", [600, 4])
def test_similar_documents_against_brute_force(spark, hot):
    rows = near_rows(3)
    want = brute_similar(rows)
    got = dict(nd.similar_documents(frame(spark, rows), hot=hot).collect())
    # cells find nearly all pairs at the least similarity, and never join what is not similar
    assert sum(got[d] == want[d] for d in want) >= 0.98 * len(want)
    for d, c in got.items():
        assert want[d] == want[c]


def edge_rows(n=220):
    """Pairs of texts that share 79 to 82 of 100 shingles, and chains in which only some links hold."""
    r = random.Random(17)
    rows = []
    for g in range(n):
        base = [f"g{g}w{r.randrange(10**6)}" for _ in range(94)]
        far = [f"h{g}w{r.randrange(10**6)}" for _ in range(30)]
        rows += [(10 * g, " ".join(base)), (10 * g + 1, " ".join([*base[: 83 + g % 4], *far[: 11 - g % 4]]))]
        if g % 4 == 0:  # near the second, not near the first
            rows.append((10 * g + 2, " ".join([*base[6 : 83 + g % 4], *far[: 15 - g % 4]])))
    return rows


@pytest.mark.parametrize("hot", [600, 3])
def test_no_pair_at_the_limit_is_missed(spark, hot):
    rows = edge_rows()
    pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[0] // 10 == b[0] // 10]
    assert sum(0.8 <= jaccard(a[1], b[1]) < 0.84 for a, b in pairs) > 150 and any(jaccard(a[1], b[1]) < 0.8 for a, b in pairs)
    want = {}
    for d, t in rows:  # texts of different groups share nothing
        mine = [(e, u) for e, u in rows if e // 10 == d // 10]
        want[d] = brute_similar(mine)[d]
    assert dict(nd.similar_documents(frame(spark, rows), hot=hot).collect()) == want


@pytest.mark.parametrize("hot", [600, 2])
def test_the_exact_join_alone_finds_every_pair(spark, hot, monkeypatch):
    """No set has a component yet: all similar pairs have to meet, also in dealt cells and among frequent shingles."""
    monkeypatch.setattr(nd, "OFTEN", 3)
    monkeypatch.setattr(nd, "TOGETHER", 50)
    rows = [(d, t) for d, t in near_rows(6) if nd.shingle_set((t or "").encode()).size]
    rows = list({nd.shingle_set(t.encode()).tobytes(): (d, t) for d, t in rows}.values())
    frequent = nd.frequent_shingles(frame(spark, rows), nd.WORDS)
    assert len(frequent[0])
    sets = [(d, d, len(s := nd.shingle_set(t.encode())), nd.prefix(s, 0.8, frequent).view(np.int64).tolist(), nd.parity(s)) for d, t in rows]
    sets = spark.createDataFrame(sets, "fp long, comp long, size int, prefix array<long>, parity binary")
    met = nd.remaining_pairs(sets, 0.8, hot, "test")
    got = {(r["u"], r["v"]) for r in nd.confirmed(met, frame(spark, rows), nd.WORDS, 0.8, "test").collect()}
    want = {(max(a, b), min(a, b)) for k, (a, s) in enumerate(rows) for b, t in rows[k + 1 :] if jaccard(s, t) >= 0.8}
    assert got == want and len(want) > 50


def test_large_cells_take_the_index(monkeypatch):
    monkeypatch.setattr(nd, "DIRECT", 48)
    r = random.Random(1)
    centre = [r.getrandbits(64) for _ in range(2)]
    codes = np.array([[c ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 6))) & (2**64 - 1) for c in centre] for _ in range(150)], np.uint64)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(150, np.int64)), pa.array(np.zeros(150, np.int32)), pa.array(np.zeros(150, np.int32)), pa.array(np.arange(150)), *(pa.array(codes[:, k].view(np.int64)) for k in range(2))], names=["cell", "a", "b", "fp", "c0", "c1"])
    edges = [(u, v) for b in nd._alike(iter([batch]), 8) for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    near = {(i, j) for i in range(150) for j in range(i) if int(np.bitwise_count(codes[i] ^ codes[j]).sum()) <= 8}
    assert set(edges) <= near and len(edges) == len(set(edges))

    def parts(links):
        root = list(range(150))
        for _ in range(150):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert parts(edges) == parts(near)


def test_a_row_without_id_links_others(spark):
    base = brute_fingerprint("a b c d e f g h")
    codes = [base, base ^ 0b111, base ^ 0b111111]
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    edges = nd.links(spark.createDataFrame([(c,) for c in signed], "fp long")).collect()
    assert len(edges) == 2


def test_deduplicated_keeps_columns_and_rows_without_id(spark):
    rows = [(None, "a b c d e f", 1, 2), (7, "a b c d e f", 1, 2), (7, "a b c d e f", 1, 2), (8, "a b c d e f", 3, 4), (9, None, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id long, component_id long")
    out = nd.deduplicated(docs)
    assert out.columns == docs.columns and sorted(str(r[0]) for r in out.collect()) == ["7", "7", "9", "None"]
    assert nd.deduplicated(docs.where("false")).count() == 0


def test_rows_without_id_take_no_part(spark):
    rows = [(None, "some words in a row " * 40), (3, "z" + "some other words here " * 3), (9, "z" + "some other words here " * 3)]
    got = {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in sd.suffix_dedup(frame(spark, rows), 30).collect()}
    want = brute_bytes(rows[1:], 30)
    assert got == want | {None: (800, 0, 0, rows[0][1].encode())}
    assert sd.word_window_dedup(frame(spark, rows), 10).where("doc_id IS NULL AND n_removed = 0").count() == 1


def test_rows_without_id_and_clashing_columns(spark):
    rows = [(None, "a b c d e f", 1, 2), (7, "a b c d e f", 1, 2), (7, "a b c d e f", 1, 2), (8, None, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long, u long")
    got = sorted((str(r[0]), r[2]) for r in nd.near_duplicates(docs).collect())
    assert got == [("7", 7), ("7", 7), ("8", 8), ("None", 7)]
    assert sd.suffix_dedup(docs.withColumn("lo", F.lit(1))).count() == 4
    assert sd.word_window_dedup(docs.withColumn("lo", F.lit(1))).count() == 4


def test_long_texts_through_the_operators(spark, monkeypatch):
    """Texts of several pieces, with repeats inside and over the joints of pieces."""
    r = random.Random(9)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(30_000))
    rows = [(1, long), (2, long[70_000:180_000]), (3, "x" + long[65_400:65_700] + "y"), (4, "z " * 40_000)]
    got = {r[0]: (r[1], r[2], r[3]) for r in sd.suffix_dedup(frame(spark, rows)).collect()}
    assert got[1] == (len(long), 0, 0) and got[2] == (110_000, 110_000, 1) and got[3] == (302, 300, 1)
    assert got[4] == (80_000, 79_998, 1)
    words = {r[0]: (r[1], r[2]) for r in sd.word_window_dedup(frame(spark, rows)).collect()}
    inner = len(rows[1][1].split()) - (rows[1][1][0] != " " and long[69_999] != " ") - (long[180_000] != " ")
    assert words[2][1] == inner and words[4] == (40_000, 40_000)


def test_hot_pieces_keep_rows_linear():
    """A run gives at most a row for each range of places, and every window is in exactly one of them."""
    kind = sd.Bytes(100, 28)
    for off, nwin in ((72, 73), (72, 1), (40, 41), (60, 10), (35, 5)):
        part = bytes(range(256))[: nwin + 99]
        got = list(sd.pieces(kind, part, off, nwin))
        assert len(got) <= 8 and sorted(i for a, n, _ in got for i in range(a, a + n)) == list(range(nwin))
        for a, n, core in got:
            inner = core.split(b" ", 1)[1]
            assert all(inner in part[i : i + 100] for i in range(a, a + n)) and len(inner) >= 91
