"""Column builders for semantics in which the dialect differs from Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import INTEGERS


def in_list(x: Column, values: Sequence[object]) -> Column:
    """x IN (values): null candidates never match and never make the result unknown; a null x is unknown."""
    some = [v for v in values if v is not None]
    return F.when(x.isNull(), F.lit(None).cast("boolean")).otherwise(x.isin(*some) if some else F.lit(False))


def not_in_list(x: Column, values: Sequence[object]) -> Column:
    """x NOT IN (values), with null candidates left out."""
    return ~in_list(x, values)


def like(x: Column, pattern: str) -> Column:
    """LIKE with % and _ and no escape character: a backslash is itself."""
    return x.like(pattern.replace("\\", "\\\\"))


def divide(df: DataFrame, left: str, right: str) -> Column:
    """left / right of a frame: truncating on integers."""
    kinds = dict(df.select(F.expr(left).alias("a"), F.expr(right).alias("b")).dtypes)
    return F.expr(f"({left}) div ({right})") if {kinds["a"], kinds["b"]} <= INTEGERS else F.expr(f"({left}) / ({right})")


def text_only(df: DataFrame, column: str, upper: bool) -> Column:
    """UPPER / LOWER: other types than text pass through."""
    c = F.col(column)
    return (F.upper(c) if upper else F.lower(c)) if dict(df.dtypes)[column] == "string" else c


def long_length(x: Column) -> Column:
    """LENGTH as a 64-bit integer of code points."""
    return F.length(x).cast("long")


def successor(prefix: bytes) -> bytes | None:
    """The least key above all keys with this prefix; none if there is no end."""
    p = bytearray(prefix)
    while p and p[-1] == 0xFF:
        p.pop()
    if not p:
        return None
    p[-1] += 1
    return bytes(p)
