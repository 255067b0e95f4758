"""Quality rules by cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, documents, fewer, materialize, words

SYMBOLS = "#*$%&|<>"
#: A line is boilerplate of a host from this many distinct documents on ...
MIN_DOCS = 10
#: ... if so many times the square of their number also reaches the host's distinct documents. So the share that makes a
#: line boilerplate falls as a host grows (7 % of 100 documents, 0.07 % of a million), and removal doesn't dwindle.
SQUARES = 2
#: A document is depleted if fewer than this percentage of its words remain.
MIN_LEFT_PERCENT = 30


def normalised(line: Column) -> Column:
    """The words of a line with A-Z in lower case, one space between them."""
    return F.translate(F.array_join(line, " "), UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed, and written into the plan, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def again(ordered: Column, x: Column, i: Column) -> Column:
    """Whether a neighbour in sorted (hash, place) pairs has the hash of x at i."""
    return ((i > 0) & (F.get(ordered, i - 1)["h"] == x["h"])) | ((i < F.size(ordered) - 1) & (F.get(ordered, i + 1)["h"] == x["h"]))


def covering(at: Column) -> Column:
    """Words that 3-word windows at these sorted places cover."""
    each = F.transform(at, lambda p, i: F.when(i < F.size(at) - 1, F.least(F.lit(3), F.get(at, i + 1) - p)).otherwise(3))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)


def measured(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """Each document's base counts, hash of its whole text and lines, from one pass over its text.

    Documents are told apart by that hash, so one text that was copied a thousand times counts as one document, and texts
    that share all but a few words as many.
    """
    step = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    step = step.withColumn("raw", F.split("body", "\n"))
    step = step.withColumn("split", F.transform("raw", words))
    step = step.withColumn("w", F.flatten("split"))
    hashed = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.struct(F.xxhash64(F.get(F.col("w"), i), F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2)).alias("h"), i.alias("i"))))
    in_order = F.sort_array(F.coalesce(hashed, F.array().cast("array<struct<h:bigint,i:int>>")))
    covered = let(in_order, lambda s: let(F.array_sort(F.transform(F.filter(s, lambda x, i: again(s, x, i)), lambda x: x["i"])), covering))
    dups = let(F.filter("raw", lambda x, i: F.size(F.get(F.col("split"), i)) > 0), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return step.select(
        "doc_id",
        "host",
        F.xxhash64("body").alias("body_hash"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        dups.cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.transform(F.filter("split", lambda x: F.size(x) > 0), lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.size(x).cast("long").alias("n"))).alias("lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def frequent_lines(lines: DataFrame, hosts: DataFrame, min_docs: int, squares: int) -> DataFrame:
    """(host, line) of the lines over both limits. lines: (host, line, body_hash); hosts: (host, n_docs)."""
    counted = lines.groupBy("host", "line").agg(F.count_distinct("body_hash").alias("n")).where(F.col("n") >= min_docs)
    return counted.join(hosts, counted["host"].eqNullSafe(hosts["host"])).where(squares * F.col("n") * F.col("n") >= F.col("n_docs")).select(counted["host"], "line")


def judged(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, squares: int = SQUARES, min_left_percent: int = MIN_LEFT_PERCENT, owner: str = "op1") -> DataFrame:
    """Base counts, removed lines and verdict of each document; see quality_rules.

    What one pass over the texts measures (a few numbers for each document and line) is written as a table, since
    counting, removal and the verdict all read it.
    """
    m = materialize(measured(docs, text, host), owner, "measured", spread=True)
    each = m.select("doc_id", "host", "body_hash", F.explode("lines").alias("l")).select("doc_id", "host", "body_hash", F.col("l.line").alias("line"))
    hosts = m.groupBy("host").agg(F.count_distinct("body_hash").alias("n_docs"))
    often = frequent_lines(each, hosts, min_docs, squares).withColumnRenamed("host", "o_host").withColumnRenamed("line", "o_line")
    cut = each.join(often, F.col("host").eqNullSafe(F.col("o_host")) & (F.col("line") == F.col("o_line")))
    cut = cut.groupBy(F.col("doc_id").alias("c_id"), F.col("host").alias("c_host")).agg(F.collect_set("line").alias("cut_lines"))
    out = m.join(cut, F.col("doc_id").eqNullSafe(F.col("c_id")) & F.col("host").eqNullSafe(F.col("c_host")), "left")
    removed = F.aggregate(F.filter("lines", lambda x: F.array_contains("cut_lines", x["line"])), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    out = out.withColumn("n_removed_words", F.when(F.col("cut_lines").isNull(), F.lit(0).cast("long")).otherwise(removed)).withColumn("base_failed", base_failed())
    left = 100 * (F.col("n_words") - F.col("n_removed_words")) >= min_left_percent * F.col("n_words")
    return out.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(left))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, squares: int = SQUARES, min_left_percent: int = MIN_LEFT_PERCENT) -> DataFrame:
    """Verdict of each document: base counts, words in removed lines, kept.

    Lines with a word are normalised and hashed; distinct documents (by a hash of the whole text) are counted for each line of a host.
    Lines over the limits are removed; a document of which too few words remain is rejected, as is one that fails the
    base rules. A null text has no words and fails the base rules; a null host is a host of its own; equal rows get equal
    verdicts and are all returned; a null doc_id is a value like any other; a text of any length is measured whole, in
    arrays of its words and lines; an empty table gives an empty result. Only doc_id, text and host are read, so further
    columns, whatever their names, don't matter. Exact copies of a text count once: else the lines of a text that was
    copied a thousand times would be boilerplate, and all its copies would go.

    Counting goes through partial sums, so a line that a third of the documents carry is one row a task. The join of
    lines with the frequent ones is an equi-join that Spark broadcasts or splits by size.
    """
    return judged(docs, text, host, min_docs, squares, min_left_percent).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def clean(docs: DataFrame, text: str = "text", host: str = "source", owner: str = "op1", **options: int) -> DataFrame:
    """The documents that quality_rules keeps, without the lines it removes; n_chars, if there, is counted anew.

    Nulls, ties, repeated rows, empty and very long texts are as there: a null or empty text fails the base rules and
    goes, repeated rows stay or go together. All columns stay, whatever their names; an empty table gives an empty one.
    """
    good = judged(docs, text, host, owner=owner, **options).where("kept").groupBy("doc_id", "host", "body_hash").agg(F.first("cut_lines").alias("cut"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("r_id"), F.col(host).cast("string").alias("r_host"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("r_hash"))
    out = rows.join(good, F.col("r_id").eqNullSafe(F.col("doc_id")) & F.col("r_host").eqNullSafe(F.col("host")) & (F.col("r_hash") == F.col("body_hash")))
    left = F.array_join(F.filter(F.split(F.col(f"row.{text}"), "\n"), lambda x: ~F.array_contains("cut", F.xxhash64(normalised(words(x))))), "\n")
    out = out.select("row", F.when(F.col("cut").isNull(), F.col(f"row.{text}")).otherwise(left).alias("new_text"))
    return fewer(out.select(*[(F.col("new_text") if c == text else F.length("new_text").cast("long") if c == "n_chars" else F.col("row")[c]).alias(c) for c in docs.columns]))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules, with their defaults, over the documents table."""
    return quality_rules(documents(spark, sf_dir))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS body FROM documents),
w AS (SELECT doc_id, host, body, md5(body) AS text_id, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS t(i)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, unnest([0, 1, 2]) AS t(k) GROUP BY 1),
base AS (SELECT w.doc_id, host, body, text_id, len(w)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
raw_lines AS (SELECT doc_id, host, text_id, unnest(string_split(body, chr(10))) AS l FROM base),
lines AS (SELECT doc_id, host, text_id, l, trim(regexp_replace(translate(l, '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n
  FROM raw_lines WHERE len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) > 0),
dup AS (SELECT doc_id, (count(*) - count(DISTINCT l))::BIGINT AS n_dup_lines FROM lines GROUP BY 1),
hosts AS (SELECT host, count(DISTINCT text_id) AS n_docs FROM base GROUP BY 1),
often AS (SELECT f.host, line FROM (SELECT host, line, count(DISTINCT text_id) AS n FROM lines GROUP BY 1, 2) f JOIN hosts h ON f.host IS NOT DISTINCT FROM h.host
  WHERE n >= {MIN_DOCS} AND {SQUARES} * n * n >= n_docs),
cut AS (SELECT doc_id, sum(n)::BIGINT AS n_removed FROM lines l JOIN often o ON l.line = o.line AND l.host IS NOT DISTINCT FROM o.host GROUP BY 1)
SELECT b.doc_id, n_words, length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - coalesce(n_removed, 0)) >= {MIN_LEFT_PERCENT} * n_words) AS kept,
  coalesce(n_removed, 0)::BIGINT AS n_removed_words
FROM base b LEFT JOIN dup USING (doc_id) LEFT JOIN cut USING (doc_id)
"""
