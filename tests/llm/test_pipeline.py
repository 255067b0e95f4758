"""The pipeline against plain versions of its stages, each on its own input."""

import re
from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sparrowdeck.llm import quality
from tests.llm.test_dedup import brute_bytes, brute_similar
from tests.llm.test_packing import check


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The input and what each stage made of it."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path_factory.mktemp('pipeline')}/{k}"
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_quality_rules(stages):
    before, after = rows(stages[0]), rows(stages[1])
    verdict = {r["doc_id"]: r for r in quality.quality_rules(stages[0]).collect()}
    assert set(after) == {d for d, r in verdict.items() if r["kept"]}
    for d, r in after.items():
        left = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        assert left == verdict[d]["n_words"] - verdict[d]["n_removed_words"] and r["n_chars"] == len(r["text"])
        assert set(r["text"].split("\n")) <= set(before[d]["text"].split("\n"))


def test_near_dedup(stages):
    before, after = rows(stages[1]), rows(stages[2])
    root = brute_similar(sorted((d, r["text"]) for d, r in before.items()))
    assert set(after) == set(root.values())
    assert all(after[d]["text"] == before[d]["text"] for d in after)


def test_suffix_array_dedup(stages):
    before, after = rows(stages[2]), rows(stages[3])
    want = brute_bytes([(d, r["text"]) for d, r in before.items()], 100)
    assert set(after) == set(before)
    assert all(after[d]["text"] == want[d][3].decode("utf-8", "ignore") for d in after)


def test_mixing(stages):
    before, after = rows(stages[3]), defaultdict(list)
    for r in stages[4].collect():
        after[r["doc_id"]].append(r["text"])
    assert set(after) <= set(before) and all(len(t) <= 3 for t in after.values())
    for d, t in after.items():
        assert all(before[d]["text"] == x for x in t)
    words = lambda df: df.agg(F.sum(F.size(quality.words(F.col("text"))))).first()[0]
    most = max(len(r["text"].split()) for r in before.values())
    sources = stages[3].select("source").distinct().count()
    assert abs(words(stages[4]) - words(stages[3])) <= sources * most / 2


def test_packing(stages):
    out = stages[5].collect()
    n = check(out, 4096)
    assert n <= -(-sum(r["length"] for r in out) // 4096) + 1
    assert sum(r["piece"] == 0 for r in out) == stages[4].count()


def test_run(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf)
    key = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(got) == key(stages[5])


ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, size int, fp long, spans string, keep_id long, component_id long, host string"


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    words = [f"w{k}" for k in range(400)]
    body = " ".join(words[:200])
    rest = (None, 1, 2, "s", 3, 4, "h")
    rows_ = [(1, body, "en", "a", 5), (1, body, "en", "a", 5), (2, body, None, None, None), (3, None, "en", "a", 1), (4, "", None, "b", 0), (None, " ".join(words[100:300]), None, None, 7), (5, " ".join(f"v{k}" for k in range(60_000)), "en", "b", 9), (6, "short text", "en", "b", 2), (7, "\n".join(words), "en", "c", 3)]
    return [(*r, *rest) for r in rows_]


def test_stages_on_an_odd_table(spark, sf, tmp_path):
    docs = spark.createDataFrame(odd_rows(), ODD)
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf).write.parquet(f"{tmp_path}/{k}")
        out.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert out[-1].dtypes == docs.dtypes
    ids = [sorted(str(r["doc_id"]) for r in df.collect()) for df in out]
    assert ids[1] == ["1", "1", "2", "5", "7", "None"]  # empty and short texts fail the base rules
    assert ids[2] == ["1", "1", "5", "7", "None"] and ids[3] == ids[2]  # equal texts leave one document, rows of one id stay
    check(out[5].collect(), 4096)


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.createDataFrame([], ODD)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, sf)
        assert got.count() == 0 and (k == 4 or got.columns == docs.columns)
