"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, fewer, materialize, words

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No target is over so many times its source's size.
MOST = 3
SEED = 17
#: Key ranges into which each source is dealt for its prefix sums.
BUCKETS = 1024


def uniform(doc_id: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) that depends on the id and the seed only: 52 bits of MD5."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def quality_weight(text: Column) -> Column:
    """Sampling weight of a document in [0.05, 1]: the share of its characters that are not symbols, squared."""
    body = F.coalesce(text, F.lit(""))
    clean = F.length(F.translate(body, "#*$%&|<>{}[]=\\^~_", "")).cast("double")
    share = F.when(F.length(body) == 0, F.lit(1.0)).otherwise(clean / F.length(body))
    return F.greatest(F.lit(0.05), share * share)


def ranked(sizes: DataFrame, owner: str = "op8") -> DataFrame:
    """Add to (source, source_size) each source's place in code point order, null last. Sources are dealt by ranges, the
    numbers of sources in the ranges (a row for each task) are added up, and each range is numbered on its own."""
    order = F.col("source").asc_nulls_last()
    dealt = materialize(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()), owner, "sources", spread=True)
    counts = dealt.groupBy(F.col("part").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.select("q", F.coalesce(F.sum("n").over(Window.orderBy("q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return dealt.join(ahead, F.col("part") == F.col("q")).select("source", "source_size", place.alias("place"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, owner: str = "op8") -> DataFrame:
    """Target of each source. sizes: (source, source_size), a row for each source.

    The whole size is shared by weight; a share over most times its source's size stops there and the rest is shared
    again among the others. So a target is min(most * size, level * weight), and the level rises from round to round, by
    sums over all sources, until no further source stops.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    at = materialize(ranked(sizes, owner).withColumn("weight", F.get(cycle, F.col("place") % len(weights))), owner, "weighed")
    stop = F.lit(float(most)) * F.col("source_size") / F.col("weight")
    level, known = 0.0, -1
    while True:
        stops = stop < F.lit(level)
        total, over, left, n = at.agg(F.sum("source_size"), F.sum(F.when(stops, F.col("source_size") * most)), F.sum(F.when(~stops, F.col("weight"))), F.count(F.when(stops, 1))).first()
        if n == known or not left:
            break
        level, known = (float(total or 0) - float(over or 0)) / left, n
    return at.select("source", "source_size", F.least(F.lit(float(most)) * F.col("source_size"), F.lit(level) * F.col("weight")).alias("target"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, buckets: int = BUCKETS, whole: bool = False, owner: str = "op8") -> DataFrame:
    """What the mix takes of each row: doc_id, source, row_key and body_hash (which equal rows share), size, source_size,
    target, taken.

    Each source gives whole epochs first; what its target still wants is the fractional part. Documents get exponential
    keys -ln(u) / quality; in the order of keys they are taken whole until the fractional budget ends, and the document
    at its edge gives its first words only, so a source misses its target by less than a word; or, if `whole`, it is taken
    whole or not at all, whichever comes nearer the target.

    A null text has size 0 and gives nothing; null sources are one source, last; ties of keys go by doc_id and then by
    size, and rows that still tie, such as repeated ones, are interchangeable; a text of any length is one number; an
    empty table gives an empty result; only doc_id, text and source are read.

    Each text is read once, into a table of a few numbers. Prefix sums never bring a source together: documents are dealt
    by ranges of their key, sums of ranges (at most `buckets` rows a source) are accumulated, and each range is summed on
    its own. The table of sources has one row for each source.
    """
    rows = docs.select("doc_id", F.col(source).alias("source"), *row_key(docs, text, source), F.size(words(F.col(text))).cast("long").alias("size"), quality_weight(F.col(text)).alias("quality"))
    rows = rows.withColumn("key", -F.log(uniform(F.col("doc_id"), seed)) / F.col("quality"))
    rows = rows.withColumn("bucket", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * buckets).cast("int")).drop("quality")
    rows = materialize(rows, owner, "sizes")
    ranges = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    goal = targets(ranges.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, most, owner)
    plan = ranges.join(goal.withColumnRenamed("source", "g"), F.col("source").eqNullSafe(F.col("g"))).select(F.col("source").alias("p"), F.col("bucket").alias("b"), "ahead", "source_size", "target")
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("p")) & (F.col("bucket") == F.col("b")))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    joined = joined.withColumn("prefix", F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    room = F.greatest(F.lit(0), rest - F.col("prefix"))
    part = F.when(2 * room >= F.col("size"), F.col("size")).otherwise(0) if whole else F.least(F.col("size"), room)
    taken = epochs * F.col("size") + part
    return joined.select("doc_id", "source", "row_key", "body_hash", "size", "source_size", "target", taken.cast("long").alias("taken"))


def row_key(docs: DataFrame, text: str, source: str) -> list[Column]:
    """Two numbers by which equal documents are known: of id, source and text, and of the text alone. Neither is null."""
    body = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return [F.xxhash64("doc_id", F.col("doc_id").isNull(), F.col(source), F.col(source).isNull(), body).alias("row_key"), body.alias("body_hash")]


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of each document; see mixed()."""
    return fewer(mixed(docs, **options).drop("row_key", "body_hash"))


def sampled(docs: DataFrame, text: str = "text", source: str = "source", **options: object) -> DataFrame:
    """The mix itself: each document as it is, once for every time that the mix takes it whole. Documents without words
    are never taken; nulls, ties, repeated rows, long texts and empty tables are as in mixed(); all columns stay.

    Texts travel once, to meet what was decided for them. Repeated rows share what the mix takes of them: each gets the
    same number of copies, and the first ones one more.
    """
    taken = mixed(docs, text=text, source=source, whole=True, **options).where("size > 0")
    decided = taken.groupBy(F.col("row_key").alias("k"), F.col("body_hash").alias("h")).agg(F.sum(F.expr("taken div size")).alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0")
    rows = docs.select(F.struct("*").alias("row"), *row_key(docs, text, source))
    rows = rows.join(decided, (F.col("row_key") == F.col("k")) & (F.col("body_hash") == F.col("h")))
    place = F.row_number().over(Window.partitionBy("row_key", "body_hash").orderBy("row_key"))
    out = rows.withColumn("place", place).withColumn("times", F.expr("CAST(copies div rows + IF(place <= copies % rows, 1, 0) AS INT)")).where("times > 0")
    out = out.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return fewer(out.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the documents table by the contract's weights."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS body, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  (('0x' || substr(md5(doc_id::VARCHAR || ':{SEED}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
q AS (SELECT *, CASE WHEN body = '' THEN 1.0::DOUBLE ELSE length(translate(body, '#*$%&|<>{{}}[]=\^~_', ''))::DOUBLE / length(body) END AS share FROM d),
k AS (SELECT doc_id, source, size, -ln(u) / greatest(0.05::DOUBLE, share * share) AS key FROM q),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY 1),
a AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight FROM s),
b AS (SELECT *, 3.0::DOUBLE * source_size / weight AS stop FROM a),
c AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(source_size * 3) OVER o, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM b
  WINDOW o AS (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, (SELECT level FROM c WHERE level <= stop ORDER BY stop, source NULLS LAST LIMIT 1) * weight)::DOUBLE AS target FROM c),
p AS (SELECT k.doc_id, k.size, t.source_size, t.target, coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prefix
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, floor(target + 0.5)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, budget - epochs * source_size - prefix)))::BIGINT AS taken FROM e
"""
