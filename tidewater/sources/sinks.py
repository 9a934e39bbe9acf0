"""Sinks: JSON lines and SARIF 2.1.0."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# SARIF levels of severities.
LEVEL = {"Error": "error", "Warning": "warning", "Note": "note"}


def to_json(issues: DataFrame) -> DataFrame:
    return issues.select(F.to_json(F.struct(*sorted(issues.columns))).alias("value"))


def results(issues: DataFrame) -> DataFrame:
    """One SARIF result a row, as a struct built by the JVM; any number of issues is written without a driver in between."""
    level = F.create_map(*[F.lit(x) for kv in LEVEL.items() for x in kv])
    region = F.struct(F.col("line").cast("int").alias("startLine"))
    place = F.array(F.struct(F.struct(F.struct(F.col("module_id").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    message = F.struct(F.format_string("%s in %s: %s", "issue_kind", "function", "symbol").alias("text"))
    return issues.select(F.to_json(F.struct(F.col("issue_kind").alias("ruleId"), level[F.col("severity")].alias("level"), message.alias("message"), place.alias("locations"))).alias("value"))


def sarif(issues: DataFrame, limit: int | None = None) -> str:
    """One SARIF document of every issue, with the rules that occur. The document is one string on the driver; ``results`` writes any
    number of issues without it. Where a ``limit`` leaves issues out, the run's properties say how many."""
    rules = [r["issue_kind"] for r in issues.select("issue_kind").distinct().orderBy("issue_kind").collect()]
    rows = issues.orderBy("module_id", "line", "issue_kind")
    got = [json.loads(r["value"]) for r in results(rows if limit is None else rows.limit(limit)).toLocalIterator()]
    for r in got:
        r["ruleIndex"] = rules.index(r["ruleId"])
    driver = {"name": "tidewater", "rules": [{"id": r} for r in rules]}
    run = {"tool": {"driver": driver}, "results": got}
    left_out = 0 if limit is None else issues.count() - len(got)
    if left_out:
        run["properties"] = {"resultsLeftOut": left_out}
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]}, sort_keys=True)
