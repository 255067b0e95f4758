"""All queries of the library and their oracle SQL, gathered from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions import cron, oql
from .functions import gql as gql_functions
from .operators import graph, keyvalue, mapping, tables, validation
from .plans import gql, relational, statements
from .sources import formats, yaml
from .streaming import events

MODULES = (relational, statements, keyvalue, tables, graph, validation, mapping, formats, yaml, cron, gql_functions, oql, gql, events)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
