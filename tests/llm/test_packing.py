"""Pattern packing: exact round trip of ids, gapless sequences, few of them."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparrowdeck.llm import pattern_packing as pp
from sparrowdeck.llm.token_output import best_fit_decreasing
from sparrowdeck.llm.tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        assert 1 <= r["length"] <= capacity and r["offset"] + r["length"] <= capacity
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
    return len(by)


def test_documents_table(spark, sf):
    t = Tokenizer.from_file(PATH)
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = pp.op9_best_fit_packing(spark, sf).collect()
    n = check(rows, 4096)
    assert n == -(-sum(r["length"] for r in rows) // 4096)
    got = {(r["doc_id"], r["piece"]): r for r in rows}
    want = 0
    for d, x in docs.items():
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            p = ids[k : k + 4096]
            r = got[d, k // 4096]
            assert (r["start"], r["length"], r["ids_crc32"]) == (k, len(p), zlib.crc32(np.array(p, "<u4").tobytes()))
            want += 1
    assert want == len(rows)


def test_words_encode_alone():
    t = Tokenizer.from_file(PATH)
    odd = ["", " ", "A b  c", "<|endoftext|> x<|startoftext|>y", "don't\tI'LL\n\nx́ e ́İΣ", " a\x1cb\x85c", "1234 5,6;7", "Word.*** ÉÀ!! x_y a_ b#$% c.d. e'f. g<h> i|j ÿ÷ß [k] l\\ m\u00ad n\u0301.", "näive ﬁ \U0001f600\U0001f600"]
    assert [np.frombuffer(x, "<u4").tolist() for x in WordEncoder(PATH).encode(odd)] == [t.encode(x, add_special_tokens=False).ids for x in odd]


@pytest.mark.parametrize("seed", range(5))
def test_plan(seed):
    r = np.random.default_rng(seed)
    kinds = [r.integers(1, 4097, 3000), np.full(5000, 700), np.minimum(4096, r.lognormal(6, 1, 20000).astype(int) + 1), r.integers(2000, 2100, 501), np.array([4096, 4096, 1])]
    lengths, counts = np.unique(kinds[seed], return_counts=True)
    plan = pp.Plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True)))
    used = defaultdict(int)
    for got, n in plan.steps:
        assert sum(got) <= 4096
        for length in got:
            used[length] += n
    assert used == dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    plain = len(best_fit_decreasing(kinds[seed].tolist(), 4096))
    assert sum(n for _, n in plan.steps) <= 1.01 * plain + 1
    assert len(plan.steps) < 12_000


def test_nnls():
    r = np.random.default_rng(1)
    a, x = r.random((30, 12)), np.maximum(0, r.normal(size=12))
    assert np.allclose(pp.nnls(a, a @ x), x, atol=1e-6)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, "word " * 9000)]
    got = pp.pack_documents(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, length long")).collect()
    assert check(got, 4096) == -(-sum(r["length"] for r in got) // 4096)
    assert sorted(r["length"] for r in got if r["doc_id"] == 4) == [9001 - 8192, 4096, 4096]
    assert sum(r["doc_id"] == 3 for r in got) == 2
    assert pp.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
