"""Record mapping: a profile of members of a target in terms of a source, as one projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import cut


@dataclass(frozen=True)
class Mapping:
    """Members in order: (target name, expression over the source). nulls: what a null source value does to the target's
    own value: "never" ignore it (it overwrites), "always" ignore it, or "defaults" (ignore nulls and defaults too)."""

    members: tuple[tuple[str, Column], ...] = ()
    nulls: str = "never"

    def member(self, target: str, source: str | Column) -> Mapping:
        return replace(self, members=(*self.members, (target, F.col(source) if isinstance(source, str) else source)))

    def all_members(self, source: Sequence[str], target: Sequence[str]) -> Mapping:
        """Members of the same name on both sides."""
        have = {c.lower() for c in source}
        return replace(self, members=(*self.members, *((c, F.col(c)) for c in target if c.lower() in have)))

    def nested(self, target: str, build: Callable[[Mapping], Mapping]) -> Mapping:
        inner = build(Mapping())
        return self.member(target, F.struct(*[c.alias(n) for n, c in inner.members]))

    def collection(self, target: str, source: str | Column, each: Callable[[Column], Column], existing: str | Column | None = None, merge: bool = False) -> Mapping:
        """Elements mapped one by one; merge puts the target's own first; a null source leaves the target as it is."""
        new = F.transform(F.col(source) if isinstance(source, str) else source, each)
        if existing is not None:
            old = F.col(existing) if isinstance(existing, str) else existing
            new = F.coalesce(F.concat(F.coalesce(old, F.slice(new, 1, 0)), new) if merge else new, old)
        return self.member(target, new)

    def columns(self, current: dict[str, Column] | None = None, defaults: dict[str, object] | None = None) -> list[Column]:
        """The projection; current: the target's own values by name."""
        out = []
        for name, new in self.members:
            old = (current or {}).get(name)
            if old is not None and self.nulls != "never":
                if self.nulls == "defaults" and name in (defaults or {}):
                    new = F.when(new == F.lit(defaults[name]), None).otherwise(new)
                new = F.coalesce(new, old)
            out.append(new.alias(name))
        return out


def map_rows(df: DataFrame, mapping: Mapping, **options: object) -> DataFrame:
    return df.select(*mapping.columns(**options))


# ---- layered and expiring entries


def layered(*layers: DataFrame, path: str = "path") -> DataFrame:
    """One row a path, from the last layer that has it."""
    rows = [df.withColumn("layer", F.lit(k)) for k, df in enumerate(layers)]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    values = [c for c in every.columns if c not in (path, "layer")]
    return every.groupBy(path).agg(F.max_by(F.struct(*values), "layer").alias("v"), F.max("layer").alias("layer")).select(path, "v.*", "layer")


def bind_object(pairs: DataFrame, schema: str, path: str = "path", value: str = "value", key: str = "id") -> DataFrame:
    """Objects from path/value pairs: one row a key, the fields of a DDL schema read from paths of their names; a nested
    struct reads from paths below its own, an array of scalars from the indexes below it, a map from its last segments."""

    def leaf(at: str, kind: T.DataType) -> Column:
        return F.max(F.when(F.lower(path) == at.lower(), F.col(value))).cast(kind)

    def below(at: str) -> Column:
        """(segment, value) of the paths one step below."""
        inside = F.lower(F.substring(path, 1, len(at) + 1)) == f"{at}:".lower()
        rest = F.substring(F.col(path), F.lit(len(at) + 2), F.length(path))
        return F.collect_list(F.when(inside & ~F.contains(rest, F.lit(":")), F.struct(rest.alias("k"), F.col(value).alias("v"))))

    def read(at: str, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.struct(*[read(f"{at}:{f.name}", f.dataType).alias(f.name) for f in kind.fields])
        if isinstance(kind, T.ArrayType):
            placed = F.array_sort(F.transform(below(at), lambda x: F.struct(x["k"].cast("int").alias("i"), x["v"].alias("v"))))
            return F.transform(placed, lambda x: x["v"].cast(kind.elementType))
        if isinstance(kind, T.MapType):
            return F.map_from_entries(F.transform(below(at), lambda x: F.struct(x["k"], x["v"].cast(kind.valueType))))
        return leaf(at, kind)

    return pairs.groupBy(key).agg(*[read(f.name, f.dataType).alias(f.name) for f in T._parse_datatype_string(schema).fields])


def bind_array(pairs: DataFrame, path: str = "path", value: str = "value", key: str = "id") -> DataFrame:
    """Arrays from pairs whose last path segment is an index, in its order. A group is one object's elements."""
    at = F.element_at(F.split(path, ":"), -1).cast("int")
    return pairs.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("i"), F.col(value).alias("v")))), lambda x: x["v"]).alias("items"))


def bind_map(pairs: DataFrame, path: str = "path", value: str = "value", key: str = "id") -> DataFrame:
    return pairs.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.element_at(F.split(path, ":"), -1).alias("k"), F.col(value).alias("v")))).alias("items"))


def unexpired(entries: DataFrame, now: Column) -> DataFrame:
    """Entries (absolute, relative end, last_access, sliding interval; each may be null) that have not expired."""
    end = F.least("absolute", "relative")  # skips nulls
    return entries.where(F.coalesce(now < end, F.lit(True)) & F.coalesce(now < F.col("last_access") + F.col("sliding"), F.lit(True)))


def upsert(store: DataFrame, changes: DataFrame, key: str = "key") -> DataFrame:
    """Replace entries by changes; a change whose columns but the key are all null removes."""
    values = [c for c in store.columns if c != key]
    kept = store.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes.where(" OR ".join(f"`{c}` IS NOT NULL" for c in values)).select(*store.columns))


def cleared(store: DataFrame) -> DataFrame:
    """The store without entries."""
    return store.where(F.lit(False))


def evict(entries: DataFrame, limit: int, compaction: float = 0.05) -> DataFrame:
    """Entries (size, priority, last_access, keep boolean) after eviction to limit less its compaction share.

    Lowest priority goes first, then the least recently used; those to keep are exempt. Sizes are summed per (priority,
    last_access), dealt out by ranges of these; the sums of ranges, as many as there are tasks, are added up first, and
    each range is summed on its own.
    """
    total = entries.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if total <= limit:
        return entries
    need = total - int(limit * (1 - compaction))
    steps = entries.where(~F.col("keep")).groupBy("priority", "last_access").agg(F.sum("size").alias("step"))
    steps = cut(steps.repartitionByRange("priority", "last_access").withColumn("part", F.spark_partition_id()))
    ahead = steps.groupBy(F.col("part").alias("q")).agg(F.sum("step").alias("n")).select("q", F.coalesce(F.sum("n").over(Window.orderBy("q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("part").orderBy("priority", "last_access").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.join(F.broadcast(ahead), F.col("part") == F.col("q")).select(F.col("priority").alias("p"), F.col("last_access").alias("l"), (F.col("ahead") + F.coalesce(F.sum("step").over(within), F.lit(0))).alias("before"))
    out = entries.join(steps, (F.col("priority") == F.col("p")) & (F.col("last_access") == F.col("l")), "left")
    return out.where(F.col("keep") | (F.col("before") >= need)).select(*entries.columns)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def map_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = Mapping().all_members(["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderkey", "missing"]).member("customer", "o_custkey").nested("money", lambda m: m.member("total", "o_totalprice").member("status", F.lower("o_orderstatus")))
    return map_rows(spark.read.parquet(f"{sf_dir}/orders.parquet"), mapping).select("o_orderkey", "customer", F.col("money.total").alias("total"), F.col("money.status").alias("status"))


def map_merge_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _events(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("types"))
    mapping = Mapping().member("user_id", "user_id").collection("all_types", "types", F.upper, F.array(F.lit("SEEN")), merge=True)
    return map_rows(per, mapping).select("user_id", F.array_join("all_types", ",").alias("all_types"))


def map_null_handling(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = Mapping(nulls="defaults").member("k", F.nullif(F.col("c_nationkey"), F.lit(3))).member("segment", "c_mktsegment")
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return df.select("c_custkey", *mapping.columns({"k": F.lit(-1), "segment": F.lit("none")}, {"segment": "BUILDING"}))


def layered_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    one = lambda kind: e.where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("path")).agg(F.max("event_id").alias("value"))
    return layered(one("click"), one("view"), one("purchase"))


def evict_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", F.length("props").cast("long").alias("size"), (F.col("user_id") % 3).alias("priority"), F.col("event_id").alias("last_access"), (F.col("event_id") % 10 == 0).alias("keep"))
    return evict(e, 40_000, 0.1).select("event_id")


def expiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entries of three kinds of expiry, of which those are left that had not expired at a moment."""
    e = _events(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    kind = F.col("event_id") % 4
    entries = e.select(
        "event_id",
        F.when(kind < 2, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).alias("absolute"),
        F.when(kind == 1, F.col("ts") + F.expr("INTERVAL '06' HOUR")).alias("relative"),
        F.when(kind == 2, F.col("ts")).alias("last_access"),
        F.when(kind == 2, F.expr("INTERVAL '2' DAY")).alias("sliding"),
    )
    return unexpired(entries, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).select("event_id")


def latest_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's value from the highest of four layers of events that has one."""
    e = _events(spark, sf_dir)
    layers = [e.where(F.col("event_id") % 4 == k).groupBy(F.col("user_id").alias("path")).agg(F.min("value").alias("value")) for k in range(4)]
    return layered(*layers)


def bound_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as path/value pairs and back as typed objects."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = lambda c: F.col(c).cast("string")
    entries = F.array(*[F.struct(F.lit(p).alias("path"), v.alias("value")) for p, v in (("Status", text("o_orderstatus")), ("money:total", text("o_totalprice")), ("money:by", text("o_custkey")), ("tags:1", F.lit("b")), ("tags:0", F.lit("a")), ("limits:low", F.lit("1")), ("limits:high", F.lit("2")))])
    pairs = o.select(F.col("o_orderkey").alias("id"), F.explode(entries).alias("p")).select("id", "p.path", "p.value")
    got = bind_object(pairs, "status string, money struct<total: decimal(18,2), by: bigint>, tags array<string>, limits map<string, int>")
    return got.select("id", "status", "money.total", "money.by", F.array_join("tags", "").alias("tags"), (F.col("limits")["low"] + F.col("limits")["high"]).alias("limits"))


def changed_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache by nation: some entries replaced, some removed; a cleared one adds nothing."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    store = n.select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("long").alias("v"))
    changes = store.where("v > 1").select("key", F.when(F.col("v") > 2, F.col("v") * 10).alias("v"))
    return upsert(store, changes).union(cleared(store))


QUERIES = {"expiry_filter": expiring, "layered_lookup": latest_layer, "bind_objects": bound_orders, "cache_upsert": changed_cache}
QUERIES |= {"map_members": map_members, "map_merge_arrays": map_merge_arrays, "map_null_handling": map_null_handling, "layered_users": layered_users, "evict_lru": evict_lru}
ORACLES = {
    "expiry_filter": "SELECT event_id FROM events WHERE CASE event_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN TIMESTAMP '2024-01-15 12:00:00' < least(TIMESTAMP '2024-02-01', ts + INTERVAL 6 HOURS) WHEN 2 THEN TIMESTAMP '2024-01-15 12:00:00' < ts + INTERVAL 2 DAYS ELSE TRUE END",
    "layered_lookup": "SELECT user_id AS path, arg_max(m, layer) AS value, max(layer)::INTEGER AS layer FROM (SELECT user_id, (event_id % 4) AS layer, min(value) AS m FROM events GROUP BY 1, 2) GROUP BY user_id",
    "bind_objects": "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice::DECIMAL(18,2) AS total, o_custkey AS by, 'ab' AS tags, 3 AS limits FROM orders",
    "cache_upsert": "SELECT n_name AS key, (CASE WHEN n_regionkey > 2 THEN n_regionkey * 10 ELSE n_regionkey END)::BIGINT AS v FROM nation WHERE n_regionkey <> 2",
    "map_members": "SELECT o_orderkey, o_custkey AS customer, o_totalprice AS total, lower(o_orderstatus) AS status FROM orders",
    "map_merge_arrays": "SELECT user_id, 'SEEN,' || string_agg(DISTINCT upper(event_type), ',' ORDER BY upper(event_type)) AS all_types FROM events GROUP BY user_id",
    "map_null_handling": "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS k, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment FROM customer",
    "layered_users": "SELECT user_id AS path, arg_max(m, layer) AS value, max(layer)::INTEGER AS layer FROM (SELECT user_id, max(event_id) AS m, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS layer FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY user_id, event_type) GROUP BY user_id",
    "evict_lru": """WITH e AS (SELECT event_id, length(props)::BIGINT AS size, user_id % 3 AS priority, event_id % 10 = 0 AS keep FROM events),
      t AS (SELECT sum(size) AS total FROM e), r AS (SELECT event_id, keep, CASE WHEN keep THEN 0 ELSE coalesce(sum(size) OVER (PARTITION BY keep ORDER BY priority, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS before FROM e)
      SELECT event_id FROM r, t WHERE total <= 40000 OR keep OR before >= total - 36000""",
}
