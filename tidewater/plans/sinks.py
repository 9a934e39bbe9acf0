"""Queries of the sinks: every line is an issue whose kind, place, flow and boundary come from its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.plans.tables import read
from tidewater.sources import sarif

QUERIES, ORACLE = {}, {}
#: The kinds, and one that has no rule.
_KINDS = [k for k, _ in sarif.RULES] + ["LengthTruncation"]


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, text = F.col, lambda *parts: F.concat(*parts)
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (c("l_partkey") % len(_KINDS) + 1).cast("int"))
    cwe = F.try_element_at(F.create_map(*[F.lit(x) for kv in sarif.RULES if kv[1] for x in kv]), kind)
    file = F.when(c("l_linenumber") < 6, text(F.lit("o"), c("l_orderkey"), F.lit(".c")))
    made = F.struct(text(F.lit("s"), c("l_suppkey"), F.lit(".c")).alias("file"), c("l_linenumber").cast("int").alias("line"), F.lit("made").alias("description"))
    freed = F.struct(F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), text(F.lit('freed "'), c("l_returnflag"), F.lit('"')).alias("description"))
    trace = F.when(c("l_linestatus") == "O", F.array(made, freed)).when(c("l_returnflag") == "A", F.array(freed))
    boundary = F.when(c("l_returnflag") == "R", F.struct(text(F.lit("f"), c("l_suppkey")).alias("caller"), F.lit("Rust").alias("caller_lang"), text(F.lit("g"), c("l_partkey")).alias("callee"), F.lit("C").alias("callee_lang"), c("l_linestatus").alias("kind")))
    severity = F.when(c("l_returnflag") == "R", "Error").when(c("l_returnflag") == "A", "Warning").otherwise("Note")
    return read(spark, sf_dir, "lineitem").select(
        kind.alias("kind"), severity.alias("severity"), text(F.lit('order "'), c("l_orderkey"), F.lit('"')).alias("description"), cwe.alias("cwe"), file.alias("file"), c("l_partkey").cast("int").alias("line"), F.when(c("l_linenumber") != 2, c("l_linenumber").cast("int")).alias("column"), trace.alias("trace"), boundary.alias("boundary")
    )


def k2_sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every issue as a SARIF result (K-2)."""
    return sarif.results(issues(spark, sf_dir), "TW/")


QUERIES["k2_sarif_results"] = k2_sarif_results
_CWE = " ".join(f"WHEN {i} THEN ' (CWE-{cwe})'" for i, (_, cwe) in enumerate(sarif.RULES) if cwe)
_NAME = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS))
_MADE = """'{"location":{"physicalLocation":{"artifactLocation":{"uri":"s' || l_suppkey || '.c"},"region":{"startLine":' || l_linenumber || '}},"message":{"text":"made"}}},'"""
_FREED = """'{"location":{"message":{"text":' || to_json('freed "' || l_returnflag || '"') || '}}}'"""
_FLOW = lambda inner: f"""',"codeFlows":[{{"threadFlows":[{{"locations":[' || {inner} || ']}}]}}]'"""
ORACLE["k2_sarif_results"] = f"""WITH x AS (SELECT *, l_partkey % {len(_KINDS)} AS k FROM lineitem)
SELECT '{{"ruleId":"TW/' || (CASE k {_NAME} END) || '"' || CASE WHEN k < {len(sarif.RULES)} THEN ',"ruleIndex":' || k ELSE '' END || ',"level":"' || CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'warning' ELSE 'note' END
|| '","message":{{"text":' || to_json('order "' || l_orderkey || '"' || (CASE k {_CWE} ELSE '' END)) || '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || CASE WHEN l_linenumber < 6 THEN 'o' || l_orderkey || '.c' ELSE 'unknown' END
|| '"}},"region":{{"startLine":' || CASE WHEN l_linenumber < 6 THEN l_partkey || ',"startColumn":' || CASE WHEN l_linenumber <> 2 THEN l_linenumber ELSE 1 END ELSE '1' END || '}}}}}}]'
|| CASE WHEN l_linestatus = 'O' THEN {_FLOW(_MADE + " || " + _FREED)} WHEN l_returnflag = 'A' THEN {_FLOW(_FREED)} ELSE '' END
|| CASE WHEN l_returnflag = 'R' THEN ',"relatedLocations":[{{"message":{{"text":"FFI boundary: f' || l_suppkey || ' (Rust) -> g' || l_partkey || ' (C) [' || l_linestatus || ']"}}}}]' ELSE '' END || '}}' AS value FROM x"""
