"""The object vocabulary over documents with nested collections, as column builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .gql import element, flatten, last, list_to_set, unique
from .gql import head as first

Test = Callable[[Column], Column]


def some(xs: Column, test: Test) -> Column:
    """Whether the test is true for an element; an unknown test is not true, and a null collection has none."""
    return F.coalesce(F.exists(xs, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def any_(x: Column, xs: Column) -> Column:
    """x = ANY xs."""
    return some(xs, lambda y: x == y)


def for_all(xs: Column, test: Test) -> Column:
    """Whether the test is true for every element; so it is for no elements."""
    return F.coalesce(F.forall(xs, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(True))


def struct(**fields: Column) -> Column:
    """STRUCT(name: value, ...)."""
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def list_(*values: Column) -> Column:
    return F.array(*values)


def set_(*values: Column) -> Column:
    """Distinct values, in order of their first places."""
    return F.array_distinct(F.array(*values))


def bag(xs: Column) -> Column:
    """The elements without an order that counts: sorted, so that equal bags are equal."""
    return F.array_sort(xs)


def select_from(df: DataFrame, collection: str, name: str, **fields: Column) -> DataFrame:
    """SELECT fields FROM df d, d.collection name: a row for each element, of which the fields may speak by its name."""
    return df.withColumn(name, F.explode(collection)).select(*[v.alias(k) for k, v in fields.items()])


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents with their orders inside. A customer's orders are one aggregate."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))).alias("orders"))


def document_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    xs = F.col("orders")
    statuses = F.transform(xs, lambda x: x["status"])
    return _customers(spark, sf_dir).select(
        "o_custkey",
        some(xs, lambda x: x["price"] > 250_000).alias("rich"),
        for_all(xs, lambda x: x["status"] != "F").alias("none_done"),
        any_(F.lit("P"), statuses).alias("pending"),
        F.array_join(bag(list_to_set(statuses)), "").alias("statuses"),
        unique(statuses).alias("unlike"),
        element(set_(F.lit(1), F.lit(1))).alias("one"),
        F.size(flatten(list_(statuses, statuses))).alias("twice"),
        struct(n=F.size(xs), lo=first(F.array_sort(F.transform(xs, lambda x: x["key"]))), hi=last(F.array_sort(F.transform(xs, lambda x: x["key"])))).alias("s"),
    ).select("*", "s.n", "s.lo", "s.hi").drop("s")


QUERIES = {
    "oql_documents": document_tests,
    "oql_members": lambda s, d: select_from(_customers(s, d), "orders", "o", customer=F.col("o_custkey"), order_key=F.col("o.key"), price=F.col("o.price")),
}
ORACLES = {
    "oql_documents": """SELECT o_custkey, bool_or(o_totalprice > 250000) AS rich, bool_and(o_orderstatus <> 'F') AS none_done, bool_or(o_orderstatus = 'P') AS pending, string_agg(DISTINCT o_orderstatus, '' ORDER BY o_orderstatus) AS statuses,
      count(*) = count(DISTINCT o_orderstatus) AS unlike, 1 AS one, (2 * count(*))::INTEGER AS twice, count(*)::INTEGER AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY o_custkey""",
    "oql_members": "SELECT o_custkey AS customer, o_orderkey AS order_key, o_totalprice AS price FROM orders",
}
