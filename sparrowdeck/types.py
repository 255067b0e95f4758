"""The dialect's type names and their Spark types."""

from __future__ import annotations

import re

# The dialect's names for each storable kind, and the Spark SQL type that holds it. A time of day has no
# type in Spark and is kept as microseconds; a GUID is its lower-case text.
TYPE_NAMES = {
    "BOOLEAN": "BOOLEAN", "BOOL": "BOOLEAN",
    "TINYINT": "TINYINT",
    "SMALLINT": "SMALLINT", "INT2": "SMALLINT",
    "INT": "INT", "INTEGER": "INT", "INT4": "INT",
    "BIGINT": "BIGINT", "INT8": "BIGINT",
    "REAL": "FLOAT", "FLOAT4": "FLOAT",
    "FLOAT": "DOUBLE", "FLOAT8": "DOUBLE", "DOUBLE": "DOUBLE",
    "DECIMAL": "DECIMAL", "NUMERIC": "DECIMAL",
    "CHAR": "STRING", "CHARACTER": "STRING", "VARCHAR": "STRING", "TEXT": "STRING",
    "BINARY": "BINARY", "VARBINARY": "BINARY", "BLOB": "BINARY", "BYTEA": "BINARY",
    "DATE": "DATE",
    "TIME": "BIGINT",
    "TIMESTAMP": "TIMESTAMP_NTZ", "DATETIME": "TIMESTAMP_NTZ",
    "TIMESTAMPTZ": "TIMESTAMP",
    "INTERVAL": "INTERVAL DAY TO SECOND",
    "UUID": "STRING", "GUID": "STRING",
    "JSON": "STRING", "JSONB": "VARIANT",
}
INTEGERS = {"tinyint", "smallint", "int", "bigint"}


def spark_type(name: str) -> str:
    """The Spark SQL type of a dialect type such as VARCHAR(10) or NUMERIC(18, 4).

    Lengths are not enforced. One argument of DECIMAL is its precision; without any it is DECIMAL(38, 18).
    """
    m = re.fullmatch(r"\s*([A-Za-z][A-Za-z0-9]*)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*", name)
    if not m or m[1].upper() not in TYPE_NAMES:
        raise ValueError(f"unknown type {name!r}")
    base = TYPE_NAMES[m[1].upper()]
    if base != "DECIMAL":
        return base
    return f"DECIMAL({m[2] or 38},{m[3] or (0 if m[2] else 18)})"
