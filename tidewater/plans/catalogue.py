"""Every registered query: QUERIES runs an operator on the driver's tables, ORACLE says the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.plans import behaviour, confusion, evidence, flows, graphs, ir, layouts, matching, projects, reporting, returns, sinks, snapshots, symbols, verdicts, verification

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

for module in (matching, symbols, verdicts, graphs, evidence, reporting, ir, behaviour, flows, layouts, snapshots, sinks, verification, confusion, returns, projects):
    QUERIES |= module.QUERIES
    ORACLE |= module.ORACLE
