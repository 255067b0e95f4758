"""Record validation: rules as column expressions that are true where a value breaks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Rule = Callable[[Column], Column]
# Fixed value: the pattern of an address. Letters are lower case; a quoted local part is allowed.
EMAIL = r'''^((([a-z]|\d|[!#\$%&'\*\+\-\/=\?\^_`{\|}~]|[\u00A0-\uD7FF\uF900-\uFDCF\uFDF0-\uFFEF])+(\.([a-z]|\d|[!#\$%&'\*\+\-\/=\?\^_`{\|}~]|[\u00A0-\uD7FF\uF900-\uFDCF\uFDF0-\uFFEF])+)*)|((\x22)((((\x20|\x09)*(\x0d\x0a))?(\x20|\x09)+)?(([\x01-\x08\x0b\x0c\x0e-\x1f\x7f]|\x21|[\x23-\x5b]|[\x5d-\x7e]|[\u00A0-\uD7FF\uF900-\uFDCF\uFDF0-\uFFEF])|(\\([\x01-\x09\x0b\x0c\x0d-\x7f]|[\u00A0-\uD7FF\uF900-\uFDCF\uFDF0-\uFFEF]))))*(((\x20|\x09)*(\x0d\x0a))?(\x20|\x09)+)?(\x22)))@((([a-z]|\d|[\u00A0-\uD7FF\uF900-\uFDCF\uFDF0-\uFFEF])|(([a-z]|\d|[\u00A0-\uD7FF\uF900-\uFDCF\uFDF0-\uFFEF])([a-z]|\d|-||_|~|[\u00A0-\uD7FF\uF900-\uFDCF\uFDF0-\uFFEF])*([a-z]|\d|[\u00A0-\uD7FF\uF900-\uFDCF\uFDF0-\uFFEF])))\.)+(([a-z]|[\u00A0-\uD7FF\uF900-\uFDCF\uFDF0-\uFFEF])+|(([a-z]|[\u00A0-\uD7FF\uF900-\uFDCF\uFDF0-\uFFEF])+([a-z]+|\d|-|\.{0,1}|_|~|[\u00A0-\uD7FF\uF900-\uFDCF\uFDF0-\uFFEF])?([a-z]|[\u00A0-\uD7FF\uF900-\uFDCF\uFDF0-\uFFEF])))$'''


def _or_null(fails: Column) -> Column:
    """A null value breaks the rule."""
    return F.coalesce(fails, F.lit(True))


def not_null() -> Rule:
    return lambda x: x.isNull()


def null() -> Rule:
    return lambda x: x.isNotNull()


def equal_to(v: Any) -> Rule:
    return lambda x: _or_null(x != v)


def not_equal_to(v: Any) -> Rule:
    """A null value passes unless it is compared with null."""
    return (lambda x: x.isNull()) if v is None else lambda x: F.coalesce(x == v, F.lit(False))


def greater_than(v: Any) -> Rule:
    return lambda x: _or_null(x <= v)


def greater_or_equal(v: Any) -> Rule:
    return lambda x: _or_null(x < v)


def less_than(v: Any) -> Rule:
    return lambda x: _or_null(x >= v)


def less_or_equal(v: Any) -> Rule:
    return lambda x: _or_null(x > v)


def between(lo: Any, hi: Any) -> Rule:
    """Bounds excluded."""
    return lambda x: _or_null((x <= lo) | (x >= hi))


def between_or_equal(lo: Any, hi: Any) -> Rule:
    return lambda x: _or_null(~x.between(lo, hi))


def length(lo: int, hi: int | None = None, of_array: bool = False) -> Rule:
    """Exact length, or a range with bounds included."""
    n = F.size if of_array else F.length
    return lambda x: _or_null(F.when(x.isNull(), None).otherwise(~n(x).between(lo, lo if hi is None else hi)))


def min_length(n: int, of_array: bool = False) -> Rule:
    return lambda x: _or_null(F.when(x.isNull(), None).otherwise((F.size if of_array else F.length)(x) < n))


def max_length(n: int, of_array: bool = False) -> Rule:
    return lambda x: _or_null(F.when(x.isNull(), None).otherwise((F.size if of_array else F.length)(x) > n))


def empty(of_array: bool = False) -> Rule:
    """Text of white space only is empty; null passes."""
    return lambda x: F.coalesce(F.size(x) > 0 if of_array else F.trim(x) != "", F.lit(False)) & x.isNotNull()


def not_empty(of_array: bool = False) -> Rule:
    return lambda x: _or_null(F.when(x.isNull(), None).otherwise(F.size(x) == 0 if of_array else F.trim(x) == ""))


def contains(v: Any, of_array: bool = False) -> Rule:
    return lambda x: _or_null(~(F.array_contains(x, v) if of_array else x.contains(v)))


def not_contains(v: Any, of_array: bool = False) -> Rule:
    """Null passes."""
    return lambda x: F.coalesce(F.array_contains(x, v) if of_array else x.contains(v), F.lit(False))


def starts_with(v: str) -> Rule:
    return lambda x: _or_null(~x.startswith(v))


def not_starts_with(v: str) -> Rule:
    return lambda x: _or_null(x.startswith(v))


def ends_with(v: str) -> Rule:
    return lambda x: _or_null(~x.endswith(v))


def not_ends_with(v: str) -> Rule:
    return lambda x: _or_null(x.endswith(v))


def matches(pattern: str) -> Rule:
    return lambda x: _or_null(~x.rlike(pattern))


def email() -> Rule:
    return matches(EMAIL)


def custom(fails: Rule) -> Rule:
    return fails


@dataclass(frozen=True)
class Check:
    name: str
    value: Column
    rule: Rule
    each: bool = False
    when: Column | None = None

    def fails(self) -> Column:
        got = F.coalesce(F.exists(self.value, self.rule), F.lit(False)) if self.each else self.rule(self.value)
        return got if self.when is None else F.coalesce(self.when, F.lit(False)) & got


@dataclass(frozen=True)
class Profile:
    """Checks in order. cascade: all failures of a row; else the first one."""

    checks: tuple[Check, ...] = ()
    cascade: bool = True
    condition: Column | None = field(default=None)

    def rule_for(self, name: str, column: str | Column, *rules: Rule, each: bool = False) -> Profile:
        value = F.col(column) if isinstance(column, str) else column
        return replace(self, checks=(*self.checks, *(Check(name if len(rules) == 1 else f"{name}.{k}", value, r, each, self.condition) for k, r in enumerate(rules))))

    def rule_for_each(self, name: str, column: str | Column, *rules: Rule) -> Profile:
        return self.rule_for(name, column, *rules, each=True)

    def when(self, condition: Column, build: Callable[[Profile], Profile]) -> Profile:
        """Rules that count only where a condition is true."""
        inner = build(replace(self, checks=(), condition=condition if self.condition is None else self.condition & condition))
        return replace(self, checks=(*self.checks, *inner.checks))

    def child(self, name: str, build: Callable[[Profile], Profile]) -> Profile:
        """Rules of a nested record, named under it."""
        inner = build(replace(self, checks=()))
        return replace(self, checks=(*self.checks, *(replace(c, name=f"{name}.{c.name}") for c in inner.checks)))

    def failures(self) -> Column:
        """The names of broken checks."""
        names = [F.when(c.fails(), F.lit(c.name)) for c in self.checks]
        if not names:
            return F.array().cast("array<string>")
        return F.array_compact(F.array(*names)) if self.cascade else F.array_compact(F.array(F.coalesce(*names)))


def validate(df: DataFrame, profile: Profile, column: str = "failures") -> DataFrame:
    return df.withColumn(column, profile.failures())


def order_rules() -> Profile:
    """Rules for the orders table."""
    return (
        Profile()
        .rule_for("price", "o_totalprice", between(1000, 400000))
        .rule_for("status", "o_orderstatus", length(1), not_equal_to("P"))
        .rule_for("priority", "o_orderpriority", starts_with("1"), contains("-"))
        .when(F.col("o_orderstatus") == "F", lambda p: p.rule_for("late", "o_orderkey", greater_than(500)))
    )


def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(spark.read.parquet(f"{sf_dir}/orders.parquet"), order_rules()).select("o_orderkey", F.array_join("failures", ",").alias("failures"))


def violation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(spark.read.parquet(f"{sf_dir}/orders.parquet"), order_rules()).select(F.explode("failures").alias("failure")).groupBy("failure").agg(F.count(F.lit(1)).alias("n"))


def validate_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = replace(order_rules(), cascade=False)
    return validate(spark.read.parquet(f"{sf_dir}/orders.parquet"), first).select("o_orderkey", F.array_join("failures", ",").alias("failure"))


def validate_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of eight kinds, and whether the rule accepts them."""
    key = F.col("c_custkey")
    kinds = [F.concat(F.lit("user"), key.cast("string"), F.lit("@example.com")), F.lit("User@example.com"), F.lit("a..b@x.co"), F.lit('"q q"@x.co'), F.lit("a@b"), F.lit("x@y.c,o"), F.lit("a.b+c@sub.x-y.org"), F.lit(None).cast("string")]
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.coalesce(*[F.when(key % 8 == i, x) for i, x in enumerate(kinds)]).alias("mail"))
    return validate(df, Profile().rule_for("mail", "mail", email())).select("c_custkey", (F.size("failures") == 0).alias("accepted"))


def validate_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that the other queries leave out."""
    p = (
        Profile()
        .rule_for("null", "nation", null())
        .rule_for("not_null", "nation", not_null())
        .rule_for("equal", "nation", equal_to(4))
        .rule_for("ge", "nation", greater_or_equal(5))
        .rule_for("lt", "nation", less_than(20))
        .rule_for("le", "nation", less_or_equal(19))
        .rule_for("between", "nation", between_or_equal(2, 21))
        .rule_for("size", "name", length(3, 30), min_length(4), max_length(18))
        .rule_for("empty", "blank", empty())
        .rule_for("not_empty", "blank", not_empty())
        .rule_for("parts", "parts", contains("BUILDING", True), not_contains("x", True))
        .rule_for("ends", "name", ends_with("7"), not_starts_with("Cust"))
        .rule_for("regex", "name", matches("[0-4]$"))
    )
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    df = c.select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(3)).alias("nation"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.lit("  ")).otherwise(F.lit("b")).alias("blank"), F.array("c_mktsegment", F.lit("x")).alias("parts"))
    return validate(df, p).select("c_custkey", F.array_join("failures", ",").alias("failures"))


QUERIES = {"validate_addresses": validate_addresses, "validate_others": validate_others, "validate_rows": validate_rows, "violation_counts": violation_counts, "validate_first": validate_first}
_FAILS = """list_filter([CASE WHEN coalesce(o_totalprice <= 1000 OR o_totalprice >= 400000, TRUE) THEN 'price' END, CASE WHEN coalesce(length(o_orderstatus) <> 1, TRUE) THEN 'status.0' END,
  CASE WHEN coalesce(o_orderstatus = 'P', FALSE) THEN 'status.1' END, CASE WHEN coalesce(NOT starts_with(o_orderpriority, '1'), TRUE) THEN 'priority.0' END, CASE WHEN coalesce(NOT contains(o_orderpriority, '-'), TRUE) THEN 'priority.1' END,
  CASE WHEN o_orderstatus = 'F' AND coalesce(o_orderkey <= 500, TRUE) THEN 'late' END], lambda x: x IS NOT NULL)"""
_OTHERS = """list_filter([CASE WHEN k IS NOT NULL THEN 'null' END, CASE WHEN k IS NULL THEN 'not_null' END, CASE WHEN coalesce(k <> 4, TRUE) THEN 'equal' END, CASE WHEN coalesce(k < 5, TRUE) THEN 'ge' END, CASE WHEN coalesce(k >= 20, TRUE) THEN 'lt' END,
  CASE WHEN coalesce(k > 19, TRUE) THEN 'le' END, CASE WHEN coalesce(k < 2 OR k > 21, TRUE) THEN 'between' END, CASE WHEN length(c_name) NOT BETWEEN 3 AND 30 THEN 'size.0' END, CASE WHEN length(c_name) < 4 THEN 'size.1' END, CASE WHEN length(c_name) > 18 THEN 'size.2' END,
  CASE WHEN c_custkey % 2 <> 0 THEN 'empty' END, CASE WHEN c_custkey % 2 = 0 THEN 'not_empty' END, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'parts.0' END, 'parts.1',
  CASE WHEN NOT ends_with(c_name, '7') THEN 'ends.0' END, CASE WHEN starts_with(c_name, 'Cust') THEN 'ends.1' END, CASE WHEN NOT regexp_matches(c_name, '[0-4]$') THEN 'regex' END], lambda x: x IS NOT NULL)"""
ORACLES = {
    "validate_addresses": "SELECT c_custkey, c_custkey % 8 IN (0, 3, 6) AS accepted FROM customer",
    "validate_others": f"SELECT c_custkey, array_to_string({_OTHERS}, ',') AS failures FROM (SELECT *, nullif(c_nationkey, 3) AS k FROM customer)",
    "validate_rows": f"SELECT o_orderkey, array_to_string({_FAILS}, ',') AS failures FROM orders",
    "violation_counts": f"SELECT failure, count(*) AS n FROM (SELECT unnest({_FAILS}) AS failure FROM orders) GROUP BY 1",
    "validate_first": f"SELECT o_orderkey, coalesce({_FAILS}[1], '') AS failure FROM orders",
}
