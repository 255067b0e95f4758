"""Key-value commands over a frame of (key binary, value binary, etag long)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.compat import successor

SCHEMA = "key binary, value binary, etag long"


class CommandError(ValueError):
    """A command that is not accepted."""


def get(store: DataFrame, key: bytes) -> DataFrame:
    return store.where(F.col("key") == F.lit(key))


def exists(store: DataFrame, key: bytes) -> DataFrame:
    """One row, whatever the store has."""
    return get(store, key).agg((F.count(F.lit(1)) > 0).alias("exists"))


def scan(store: DataFrame, start: bytes | None = None, end: bytes | None = None, prefix: bytes | None = None, limit: int | None = None) -> DataFrame:
    """Entries in ascending key order, from start (inclusive) to end (exclusive), or with a prefix."""
    if prefix is not None:
        start, end = prefix, successor(prefix)
    if start is not None:
        store = store.where(F.col("key") >= F.lit(start))
    if end is not None:
        store = store.where(F.col("key") < F.lit(end))
    store = store.orderBy("key")
    return store if limit is None else store.limit(limit)


def latest(entries: DataFrame) -> DataFrame:
    """The entry of the highest etag for each key: the state after a series of puts. A key's puts are one aggregate."""
    return entries.groupBy("key").agg(F.max_by("value", "etag").alias("value"), F.max("etag").alias("etag"))


@dataclass
class Change:
    """A store after a command, whether it applied, and the key's etag."""

    store: DataFrame
    applied: bool
    etag: int | None


def put(store: DataFrame, key: bytes, value: bytes, if_absent: bool = False, if_etag: int | None = None) -> Change:
    """Upsert; with a condition only if the key is absent, or its etag is the given one."""
    top, now = store.agg(F.max("etag"), F.max(F.when(F.col("key") == F.lit(key), F.col("etag")))).first()
    if (if_absent and now is not None) or (if_etag is not None and now != if_etag):
        return Change(store, False, now)
    etag = (top or 0) + 1
    row = store.sparkSession.createDataFrame([(bytearray(key), bytearray(value), etag)], SCHEMA)
    return Change(store.where(F.col("key") != F.lit(key)).unionByName(row), True, etag)


def put_all(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert many entries (key, value, etag, and an optional column expected, null for none) in one pass.

    Of several changes to a key the one of the highest etag counts. A change with an expectation applies only if the
    store's entry has that etag.
    """
    w = Window.partitionBy("key").orderBy(F.desc("etag"))
    if "expected" not in changes.columns:
        changes = changes.withColumn("expected", F.lit(None).cast("long"))
    one = changes.withColumn("n", F.row_number().over(w)).where("n = 1").select(F.col("key").alias("k"), F.col("value").alias("v"), F.col("etag").alias("e"), "expected")
    both = store.join(one, F.col("key") == F.col("k"), "full")
    applies = F.col("k").isNotNull() & (F.col("expected").isNull() | F.coalesce(F.col("etag") == F.col("expected"), F.lit(False)))
    pick = lambda new, old: F.when(applies, F.col(new)).otherwise(F.col(old)).alias(old)
    return both.select(pick("k", "key"), pick("v", "value"), pick("e", "etag")).where("key IS NOT NULL")


def delete(store: DataFrame, key: bytes, if_etag: int | None = None) -> Change:
    now = store.where(F.col("key") == F.lit(key)).agg(F.max("etag")).first()[0]
    if now is None or (if_etag is not None and now != if_etag):
        return Change(store, False, now)
    return Change(store.where(F.col("key") != F.lit(key)), True, now)


def command(store: DataFrame, text: str, parameters: Mapping[str, object] | None = None) -> DataFrame | Change:
    """Run GET, EXISTS, PUT, DELETE or SCAN; operands are parameters such as @key."""
    words = text.strip().rstrip(";").split()
    if not words:
        raise CommandError("the command is empty")
    given = {str(k).lstrip("@"): v for k, v in (parameters or {}).items()}

    def bound(word: str, kind: type) -> object:
        if not word.startswith("@") or word[1:] not in given:
            raise CommandError(f"no value for {word}")
        value = given[word[1:]]
        value = value.encode() if isinstance(value, str) and kind is bytes else value
        if not isinstance(value, kind):
            raise CommandError(f"{word} has to be {kind.__name__}")
        return value

    verb, rest = words[0].upper(), words[1:]
    upper = [w.upper() for w in rest]
    if verb == "GET" and len(rest) == 1:
        return get(store, bound(rest[0], bytes))
    if verb == "EXISTS" and len(rest) == 1:
        return exists(store, bound(rest[0], bytes))
    if verb == "PUT" and len(rest) in (2, 4):
        key, value = bound(rest[0], bytes), bound(rest[1], bytes)
        if len(rest) == 2:
            return put(store, key, value)
        if upper[2] == "IF":
            return put(store, key, value, if_absent=True) if upper[3] == "ABSENT" else put(store, key, value, if_etag=bound(rest[3], int))
    if verb == "DELETE" and (len(rest) == 1 or (len(rest) == 3 and upper[1] == "IF")):
        return delete(store, bound(rest[0], bytes), bound(rest[2], int) if len(rest) == 3 else None)
    if verb == "SCAN":
        options: dict[str, object] = {}
        for name, word in zip(upper[::2], rest[1::2], strict=False):
            key = {"FROM": "start", "TO": "end", "PREFIX": "prefix", "LIMIT": "limit"}.get(name)
            if key is None or key in options:
                break
            options[key] = int(word) if key == "limit" and word.isdigit() else bound(word, int if key == "limit" else bytes)
        if 2 * len(options) == len(rest) and not ("prefix" in options and {"start", "end"} & set(options)):
            return scan(store, **options)
    raise CommandError(f"cannot read {text!r}: GET @k | EXISTS @k | PUT @k @v [IF ABSENT | IF @etag] | DELETE @k [IF @etag] | SCAN [FROM @a] [TO @b] | [PREFIX @p] [LIMIT n]")


# ---- queries: events as a store, keyed by type and id


def events_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(_key().cast("binary").alias("key"), F.col("props").cast("binary").alias("value"), F.col("event_id").alias("etag"))


def _key() -> Column:
    return F.concat_ws(":", "event_type", F.lpad(F.col("event_id").cast("string"), 8, "0"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "etag")


def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of events of each type, keyed by type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.concat(F.lit("b:"), "event_type").cast("binary").alias("key")).agg(F.count(F.lit(1)).cast("string").cast("binary").alias("value"), F.max("event_id").alias("etag"))


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after commands of which some do not apply."""
    store = _three(spark, sf_dir)
    for text, given in (("PUT @k @v", {"k": "a", "v": "1"}), ("PUT @k @v IF ABSENT", {"k": "a", "v": "2"}), ("PUT @k @v IF ABSENT", {"k": "c", "v": "3"}), ("PUT @k @v IF @e", {"k": "c", "v": "4", "e": -5}), ("DELETE @k", {"k": "b:view"}), ("DELETE @k IF @e", {"k": "b:click", "e": -5})):
        store = command(store, text, given).store
    return store.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


QUERIES = {
    "kv_get": lambda s, d: _shown(command(_three(s, d), "GET @k", {"k": "b:view"})),
    "kv_exists": lambda s, d: command(_three(s, d), "EXISTS @k", {"k": "b:view"}).union(command(_three(s, d), "EXISTS @k", {"k": "b:zzz"})),
    "kv_put_delete": _commands,
    "kv_scan": lambda s, d: _shown(scan(events_store(s, d), b"click:", b"purchase:")),
    "kv_prefix": lambda s, d: _shown(scan(events_store(s, d), prefix=b"purchase:")),
    "kv_scan_limit": lambda s, d: _shown(scan(events_store(s, d), limit=17)),
    "kv_latest_put": lambda s, d: latest(s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").cast("binary").alias("key"), F.col("event_type").cast("binary").alias("value"), F.col("event_id").alias("etag"))).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "etag"),
    "kv_put_if_etag": lambda s, d: _shown(put_all(events_store(s, d), events_store(s, d).where("etag % 3 = 0").select("key", F.lit(b"new").alias("value"), (F.col("etag") + 1_000_000_000).alias("etag"), F.when(F.col("etag") % 2 == 0, F.col("etag")).otherwise(-1).alias("expected")))),
}
_STORE = "(SELECT event_type || ':' || lpad(event_id::VARCHAR, 8, '0') AS key, props AS value, event_id AS etag FROM events)"
ORACLES = {
    "kv_get": "SELECT 'b:' || event_type AS key, count(*)::VARCHAR AS value, max(event_id) AS etag FROM events WHERE event_type = 'view' GROUP BY event_type",
    "kv_exists": 'SELECT count(*) > 0 AS "exists" FROM events WHERE event_type = \'view\' UNION ALL SELECT FALSE',
    "kv_put_delete": "SELECT 'b:' || event_type AS key, count(*)::VARCHAR AS value FROM events WHERE event_type <> 'view' GROUP BY event_type UNION ALL SELECT 'a', '1' UNION ALL SELECT 'c', '3'",
    "kv_scan": f"SELECT * FROM {_STORE} WHERE key >= 'click:' AND key < 'purchase:' ORDER BY key",
    "kv_prefix": f"SELECT * FROM {_STORE} WHERE starts_with(key, 'purchase:') ORDER BY key",
    "kv_scan_limit": f"SELECT * FROM {_STORE} ORDER BY key LIMIT 17",
    "kv_latest_put": "SELECT user_id::VARCHAR AS key, arg_max(event_type, event_id) AS value, max(event_id) AS etag FROM events GROUP BY user_id",
    "kv_put_if_etag": f"SELECT key, CASE WHEN etag % 6 = 0 THEN 'new' ELSE value END AS value, CASE WHEN etag % 6 = 0 THEN etag + 1000000000 ELSE etag END AS etag FROM {_STORE}",
}
