"""Five-field schedules as predicates, and their occurrences in a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields in order with their bounds; the week begins with Sunday, 0.
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 6))


def values(field: str, least: int, most: int) -> set[int]:
    """The numbers a field stands for: *, a, a-b, */n, a-b/n and lists of these.

    */n counts from the field's least number. A lone a-b/n leaves its upper bound out; in a list it does not.
    """
    parts = field.split(",")
    out: set[int] = set()
    for part in parts:
        base, slash, step = part.partition("/")
        n = int(step) if slash else 1
        if n < 1:
            raise ValueError(f"bad step in {field}")
        if base == "*":
            lo, hi = least, most
        else:
            a, dash, b = base.partition("-")
            lo, hi = int(a), int(b) if dash else int(a) if not slash else most
            if dash and slash and len(parts) == 1:
                hi -= 1
        if not (least <= lo <= most and hi <= most):
            raise ValueError(f"{field} is out of {least}-{most}")
        out |= set(range(lo, hi + 1, n))
    return out


def matches(expression: str, ts: Column) -> Column:
    """Whether a timestamp's minute is one of the schedule. Day of month and day of week both have to match."""
    fields = expression.split()
    if len(fields) != len(FIELDS):
        raise ValueError("a schedule has five fields")
    of = (F.minute(ts), F.hour(ts), F.dayofmonth(ts), F.month(ts), F.dayofweek(ts) - 1)
    out = F.lit(True)
    for text, (_, lo, hi), part in zip(fields, FIELDS, of, strict=True):
        got = values(text, lo, hi)
        if len(got) < hi - lo + 1:
            out = out & part.isin(*sorted(got))
    return out


def occurrences(spark: SparkSession, expression: str, start: str, end: str) -> DataFrame:
    """(ts) of a schedule from start (inclusive) to end (exclusive): the days that match, each with the minutes of a day
    that the first two fields name."""
    fields = expression.split()
    matches(expression, F.lit(None).cast("timestamp_ntz"))  # a bad schedule fails here
    minutes = [60 * h + m for h in sorted(values(fields[1], *FIELDS[1][1:])) for m in sorted(values(fields[0], *FIELDS[0][1:]))]
    days = spark.sql("SELECT CAST(d AS TIMESTAMP_NTZ) AS day FROM (SELECT explode(sequence(to_date(:a), to_date(:b))) AS d)", args={"a": start, "b": end})
    days = days.where(matches(f"* * {' '.join(fields[2:])}", F.col("day")))
    at = days.withColumn("minute", F.explode(F.array(*map(F.lit, minutes)))).select((F.col("day") + F.make_dt_interval(mins=F.col("minute"))).alias("ts"))
    return at.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))


QUERIES = {
    "cron_occurrences": lambda s, d: occurrences(s, "*/20 8-18/5 * * 1,3-5", "2024-01-01 00:00:00", "2024-03-01 00:00:00"),
    "cron_events": lambda s, d: s.read.parquet(f"{d}/events.parquet").where(matches("*/5 * 1-15 * *", F.col("ts"))).select("event_id"),
}
ORACLES = {
    "cron_occurrences": "SELECT ts FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-29 23:59:00', INTERVAL 1 MINUTE) AS g(ts) WHERE minute(ts) IN (0, 20, 40) AND hour(ts) IN (8, 13) AND dayofweek(ts) IN (1, 3, 4, 5)",
    "cron_events": "SELECT event_id FROM events WHERE minute(ts) % 5 = 0 AND day(ts) <= 15",
}
