"""Functions of the graph and object vocabularies as column builders.

A node is a struct (id, labels, props), a relationship a struct (id, src, dst, type, props), and a path a struct of two
arrays, nodes and relationships, with one node more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- nodes, relationships and paths


def id_of(x: Column) -> Column:
    return x["id"]


def element_id(x: Column) -> Column:
    """The id as text."""
    return x["id"].cast("string")


def labels(node: Column) -> Column:
    return node["labels"]


def type_of(relationship: Column) -> Column:
    return relationship["type"]


def properties(x: Column) -> Column:
    return x["props"]


def keys(x: Column) -> Column:
    """Names of the properties, in order."""
    return F.array_sort(F.map_keys(x["props"]))


def start_node(relationship: Column) -> Column:
    return relationship["src"]


def end_node(relationship: Column) -> Column:
    return relationship["dst"]


def nodes(path: Column) -> Column:
    return path["nodes"]


def relationships(path: Column) -> Column:
    return path["relationships"]


def length(path: Column) -> Column:
    """Relationships of a path."""
    return F.size(path["relationships"]).cast("long")


# ---- lists


def size(xs: Column) -> Column:
    """Elements of a list; null for null."""
    return F.when(xs.isNotNull(), F.size(xs).cast("long"))


def head(xs: Column) -> Column:
    return F.get(xs, F.lit(0))


def last(xs: Column) -> Column:
    return F.get(xs, F.size(xs) - 1)


def tail(xs: Column) -> Column:
    """All but the first element."""
    return F.when(F.size(xs) > 1, F.slice(xs, F.lit(2), F.size(xs) - 1)).when(xs.isNotNull(), F.slice(xs, F.lit(1), F.lit(0)))


def range_(first: Column, end: Column, step: int = 1) -> Column:
    """Numbers from first to end, both inclusive; empty if the step leads away from the end."""
    if not step:
        raise ValueError("a step is not zero")
    leads = (end >= first) if step > 0 else (end <= first)
    return F.when(leads, F.sequence(first.cast("long"), F.when(leads, end.cast("long")).otherwise(first.cast("long")), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def element(xs: Column) -> Column:
    """The one element of a collection; any other number of elements is an error."""
    return F.when(F.size(xs) == 1, F.get(xs, F.lit(0))).otherwise(F.raise_error(F.lit("ELEMENT takes a collection of one element")))


def flatten(xs: Column) -> Column:
    return F.flatten(xs)


def list_to_set(xs: Column) -> Column:
    """Distinct elements, each where it is first."""
    return F.array_distinct(xs)


def unique(xs: Column) -> Column:
    """Whether no element occurs twice."""
    return F.size(F.array_distinct(xs)) == F.size(xs)


# ---- numbers and conversions


def sign(x: Column) -> Column:
    return F.signum(x).cast("long")


def rand(seed: int | None = None) -> Column:
    return F.rand(seed)


def log(x: Column) -> Column:
    """Natural logarithm."""
    return F.log(x)


def to_integer(x: Column) -> Column:
    """A number without its fraction, also from text; null where there is none."""
    return x.try_cast("double").try_cast("long")


def to_float(x: Column) -> Column:
    return x.try_cast("double")


def to_string(x: Column) -> Column:
    return x.cast("string")


# ---- time and space


def timestamp(x: Column) -> Column:
    """Milliseconds since 1970."""
    return F.unix_millis(x.cast("timestamp"))


def date(x: Column) -> Column:
    return x.try_cast("date")


def time(x: Column) -> Column:
    """The time of day as text, to the microsecond."""
    return F.date_format(x, "HH:mm:ss.SSSSSS")


def datetime(x: Column) -> Column:
    return x.try_cast("timestamp_ntz")


def duration(days: int = 0, hours: int = 0, minutes: int = 0, seconds: int = 0) -> Column:
    return F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes), F.lit(seconds))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(a: Column, b: Column) -> Column:
    """Straight distance of two points of the plane."""
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


# ---- queries


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as nodes, orders as relationships to their clerk's number, and paths of both."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    node = F.struct(F.col("o_custkey").alias("id"), F.array(F.lit("Customer"), F.col("o_orderstatus")).alias("labels"), F.create_map(F.lit("price"), F.col("o_totalprice").cast("string"), F.lit("area"), F.lit("x")).alias("props"))
    edge = F.struct(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 100).alias("dst"), F.lit("ORDERED").alias("type"), F.create_map(F.lit("on"), F.lit("y")).alias("props"))
    path = F.struct(F.array(F.col("o_custkey"), F.col("o_orderkey") % 100).alias("nodes"), F.array("o_orderkey").alias("relationships"))
    return o.select("o_orderkey", "o_totalprice", "o_orderdate", node.alias("node"), edge.alias("edge"), path.alias("path"))


def graph_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e, p = F.col("node"), F.col("edge"), F.col("path")
    return _orders(spark, sf_dir).select("o_orderkey", id_of(n).alias("id"), element_id(e).alias("eid"), F.array_join(labels(n), "|").alias("labels"), type_of(e).alias("type"), F.array_join(keys(n), "|").alias("keys"), properties(e)["on"].alias("prop"), start_node(e).alias("a"), end_node(e).alias("b"), length(p).alias("len"), size(nodes(p)).alias("n"), last(nodes(p)).alias("last_node"), head(relationships(p)).alias("rel"))


def list_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    xs = range_(F.lit(1), F.col("n_nationkey") % 4)
    both = F.array(xs, F.array(F.lit(1).cast("long"), F.lit(9).cast("long")))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", size(xs).alias("n"), head(xs).alias("first"), last(xs).alias("last"), F.array_join(tail(xs), ",").alias("tail"), F.array_join(range_(F.lit(9), F.lit(1), -4), ",").alias("down"), F.array_join(list_to_set(flatten(both)), ",").alias("set"), unique(flatten(both)).alias("unique"), element(F.array("n_name")).alias("only"))


def number_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_acctbal")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", sign(c).alias("sign"), F.round(log(F.abs(c) + 1), 8).alias("log"), F.round(F.exp(c / 10000), 8).alias("exp"), to_integer(F.concat(F.col("c_custkey").cast("string"), F.lit(".9"))).alias("whole"), to_integer(F.col("c_name")).alias("none"), to_float(F.lit("1.5")).alias("float"), to_string(F.col("c_nationkey")).alias("text"), ((rand(1) >= 0) & (rand(1) < 1)).alias("rand"))


def time_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp_ntz")
    here = point(F.col("event_id") % 10, F.lit(0))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", timestamp(F.col("ts")).alias("ms"), date(at).alias("day"), F.substring(time(at), 1, 8).alias("time"), datetime(F.lit("2024-02-29 01:02:03")).alias("at"), (at + duration(days=1, minutes=30)).alias("later"), F.round(distance(here, point(F.lit(0), F.lit(3))), 8).alias("far"))


QUERIES = {"gql_graph_functions": graph_functions, "gql_list_functions": list_values, "gql_number_functions": number_values, "gql_time_functions": time_values}
ORACLES = {
    "gql_graph_functions": "SELECT o_orderkey, o_custkey AS id, o_orderkey::VARCHAR AS eid, 'Customer|' || o_orderstatus AS labels, 'ORDERED' AS type, 'area|price' AS keys, 'y' AS prop, o_custkey AS a, o_orderkey % 100 AS b, 1::BIGINT AS len, 2::BIGINT AS n, o_orderkey % 100 AS last_node, o_orderkey AS rel FROM orders",
    "gql_list_functions": "SELECT n_nationkey, n_nationkey % 4 AS n, CASE WHEN n_nationkey % 4 > 0 THEN 1 END::BIGINT AS first, nullif(n_nationkey % 4, 0)::BIGINT AS last, CASE n_nationkey % 4 WHEN 2 THEN '2' WHEN 3 THEN '2,3' ELSE '' END AS tail, '9,5,1' AS down, CASE n_nationkey % 4 WHEN 2 THEN '1,2,9' WHEN 3 THEN '1,2,3,9' ELSE '1,9' END AS set, n_nationkey % 4 = 0 AS \"unique\", n_name AS only FROM nation",
    "gql_number_functions": "SELECT c_custkey, sign(c_acctbal)::BIGINT AS sign, round(ln(abs(c_acctbal) + 1), 8) AS log, round(exp(c_acctbal / 10000), 8) AS exp, c_custkey AS whole, NULL::BIGINT AS none, 1.5::DOUBLE AS float, c_nationkey::VARCHAR AS text, TRUE AS rand FROM customer",
    "gql_time_functions": "SELECT event_id, epoch_us(ts) // 1000 AS ms, ts::DATE AS day, strftime(ts, '%H:%M:%S') AS time, TIMESTAMP '2024-02-29 01:02:03' AS at, ts + INTERVAL 1 DAY + INTERVAL 30 MINUTE AS later, round(sqrt((event_id % 10) * (event_id % 10) + 9), 8) AS far FROM events",
}
