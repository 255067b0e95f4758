"""Quality rules and mixing on small tables: SQL agrees, edges are defined."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sparrowdeck.llm import mixing, quality


def both(spark, query, sql, rows, tmp_path):
    schema = "doc_id long, text string, source string, lang string, n_chars long"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(sql)
    df = query(spark, str(tmp_path))
    place = [want.columns.index(c) for c in df.columns]
    fix = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    return sorted((fix(r) for r in df.collect()), key=repr), sorted((fix([r[i] for i in place]) for r in want.fetchall()), key=repr)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(k, n=60):
    return " ".join(f"{WORDS[(k * 7 + i * (k % 5 + 1)) % 20]}{k}{i}" for i in range(n))


def rows():
    out = [(i, f"{text(i)}\nAccept  all COOKIES now\n{'same line' if i % 2 else 'x'}", f"h{i % 2}", "en", 1) for i in range(40)]
    out += [(100 + i, text(100) + "\nend", "h0", "en", 1) for i in range(30)]
    out += [(200, None, "h0", None, None), (201, "", "h1", None, None), (202, " \n\t ", None, None, None), (203, "a b c a b c a b c " * 20, None, "x", 1), (204, "é ü $#* <b>\n\nq\nq\nq", "h0", "x", 1)]
    out += [(205, "line of few words\n" * 3 + text(205), "h1", "x", 1)]
    return out


def test_quality_agrees_with_sql(spark, tmp_path):
    got, want = both(spark, quality.op1_quality_rules, quality.ORACLE, rows(), tmp_path)
    assert got == want
    by = {r[0]: r for r in got}
    assert by[1][8] == 6 and by[0][8] == 5  # the frequent lines go
    assert by[1][7] and by[100][7] and not by[200][7]


def test_copies_do_not_make_lines_frequent(spark):
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows(), "doc_id long, text string, source string, lang string, n_chars long")).collect()}
    assert all(got[100 + i]["n_removed_words"] == 0 and got[100 + i]["kept"] for i in range(30))


def test_clean_takes_lines_out(spark):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows()], "doc_id long, text string, source string, lang string, n_chars long, host long, row int")
    out = {r["doc_id"]: r for r in quality.clean(docs).collect()}
    assert "COOKIES" not in out[1]["text"] and out[1]["n_chars"] == len(out[1]["text"]) and out[1]["host"] == 1
    assert out[100]["text"] == text(100) + "\nend" and 200 not in out


def long_line_rows(n=300, bearers=60):
    """Documents of which some are one long common line and a few words of their own."""
    common = text(3, 300)
    return [(i, f"{common}\n{text(1000 + i, 6)}" if i < bearers else text(1000 + i, 90), "h", "en", 1) for i in range(n)]


@pytest.mark.parametrize("bearers, gone", [(60, True), (20, True), (9, False)])
def test_bearers_of_one_long_line_go(spark, tmp_path, bearers, gone):
    got, want = both(spark, quality.op1_quality_rules, quality.ORACLE, long_line_rows(bearers=bearers), tmp_path)
    assert got == want
    assert all(r[7] == (not gone or r[0] >= bearers) and (r[8] == 300) == (gone and r[0] < bearers) for r in got)


def test_null_ids_repeated_rows_and_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(100_000))
    rows_ = [(None, text(1), "h"), (1, text(2), "h"), (1, text(2), "h"), (2, long, None), (3, "x " * 50_000, "h")]
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["n_words"], r["kept"]) for r in quality.quality_rules(spark.createDataFrame(rows_, "doc_id long, text string, source string")).collect()), key=repr)
    assert got == sorted([(True, None, 60, True), (False, 1, 60, True), (False, 1, 60, True), (False, 2, 100_000, True), (False, 3, 50_000, False)], key=repr)


def test_limit_falls_with_the_host(spark):
    m = spark.createDataFrame([("h", 1, k) for k in range(80)] + [("h", 2, k) for k in range(60)], "host string, line long, body_hash long")
    hosts = spark.createDataFrame([("h", 10_000)], "host string, n_docs long")
    assert [r["line"] for r in quality.frequent_lines(m, hosts, quality.MIN_DOCS, quality.SQUARES).collect()] == [1]


def test_depleted_documents_go(spark):
    shared = [text(k, 12) for k in range(5)]
    docs = spark.createDataFrame([(i, "\n".join([*shared, text(500 + i, 20)]), "h") for i in range(100)] + [(999, text(99), "h")], "doc_id long, text string, source string")
    assert {r["doc_id"] for r in quality.quality_rules(docs).where("kept").collect()} == {999}


def test_documents_of_mostly_shared_text_count_each(spark):
    shared = [text(k, 12) for k in range(5)]
    docs = spark.createDataFrame([(i, "\n".join([*shared, text(500 + i, 20)]), "h") for i in range(20)] + [(999, text(99), "h")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    assert all(got[i]["n_removed_words"] == 60 and not got[i]["kept"] for i in range(20)) and got[999]["kept"]


def test_mixing_agrees_with_sql(spark, tmp_path):
    got, want = both(spark, mixing.op8_source_mixing, mixing.ORACLE, rows(), tmp_path)
    assert got == want


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 1000, 5], [0, 0, 7], [100, 1, 1, 1, 1, 1]])
def test_targets_against_the_loop(spark, sizes):
    total, weights = sum(sizes), [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    fixed = {}
    while True:
        left = total - sum(fixed.values())
        open_ = [i for i in range(len(sizes)) if i not in fixed]
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > 3 * sizes[i]]
        if not over:
            break
        fixed |= {i: 3 * sizes[i] for i in over}
    want = [fixed.get(i, share.get(i)) for i in range(len(sizes))]
    got = mixing.targets(spark.createDataFrame([(f"s{i:02}", s) for i, s in enumerate(sizes)], "source string, source_size long")).orderBy("source").collect()
    assert [r["target"] for r in got] == pytest.approx(want)


def test_mix_meets_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.mix(docs)
    per = got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert all(abs(r["t"] - r["g"]) <= 1 and r["over"] <= 0 for r in per)
    out = mixing.sampled(docs)
    words = out.select(F.size(quality.words(F.col("text"))).alias("n")).agg(F.sum("n")).first()[0]
    most = got.agg(F.max("size")).first()[0]
    assert abs(words - got.agg(F.sum("taken")).first()[0]) <= len(per) * most / 2 and out.columns == docs.columns
    assert out.join(docs, ["doc_id", "text"], "left_anti").count() == 0  # whole documents only


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality.quality_rules(docs).count() == mixing.mix(docs).count() == quality.clean(docs).count() == mixing.sampled(docs).count() == 0


def test_mixing_repeated_rows_and_a_long_text(spark):
    rows_ = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "d", "s"), (2, "w " * 100_000, "t"), (3, None, None)]
    out = mixing.mix(spark.createDataFrame([(*r, 9) for r in rows_], "doc_id long, text string, source string, size int")).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in out) == [(0, 1), (1, 3), (1, 3), (2, 100_000), (3, 0)]
    for s in ("s", "t"):
        mine = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 1 and all(r["taken"] <= 3 * r["size"] for r in mine)
