"""Gating of issues by semantic facts, and reconciliation of candidates on one resource."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gate(issues: DataFrame, facts: DataFrame, rules: DataFrame, symbol: str = "symbol", caller: str = "caller", kind: str = "issue_kind", key: str = "issue_id") -> DataFrame:
    """``issues`` with ``gate_verdict``: that of the first rule (by priority) of the issue's kind whose semantic kind the symbol,
    or the caller where the rule probes it, has in ``facts`` (symbol, kind); else Allow. Two equi-joins and one minimum."""
    f = facts.select(F.col("symbol").alias("_sym"), F.col("kind").alias("_kind")).distinct()
    r = F.broadcast(rules.select(F.col("issue_kind").alias("_ik"), F.col("semantic_kind").alias("_kind"), F.col("probe").alias("_probe"), "verdict", "priority"))
    sides = F.explode(F.array(F.struct(F.lit("symbol").alias("_probe"), F.col(symbol).alias("_sym")), F.struct(F.lit("caller").alias("_probe"), F.col(caller).alias("_sym"))))
    probes = issues.select(key, F.col(kind).alias("_ik"), sides.alias("p")).select(key, "_ik", "p._probe", "p._sym")
    met = probes.join(f, "_sym").join(r, ["_ik", "_kind", "_probe"])
    first = met.groupBy(key).agg(F.min_by("verdict", "priority").alias("gate_verdict"))
    return issues.join(first, key, "left").withColumn("gate_verdict", F.coalesce("gate_verdict", F.lit("Allow")))


def reconcile(rows: DataFrame, keys: list[str], fault: str, verdict_rank: str, idx: str, subsumes: DataFrame) -> DataFrame:
    """``rows`` with ``action`` and ``cause``: within one resource a reportable cause (rank 2 or more) subsumes its effects, the
    first cause by idx wins; of what is left each fault class keeps the best verdict, the lower idx on ties."""
    causes = rows.filter(F.col(verdict_rank) >= 2).groupBy(*keys, fault).agg(F.min(idx).alias("_cause")).withColumnRenamed(fault, "cause")
    s = F.broadcast(subsumes)
    hit = rows.join(s, F.col(fault) == s["effect"]).join(causes, [*keys, "cause"]).filter(F.col("_cause") != F.col(idx)).groupBy(*keys, idx).agg(F.min("_cause").alias("cause_idx"))
    out = rows.join(hit, [*keys, idx], "left")
    w = Window.partitionBy(*keys, fault, F.col("cause_idx").isNull()).orderBy(F.col(verdict_rank).desc(), F.col(idx))
    out = out.withColumn("_n", F.row_number().over(w))
    action = F.when(F.col("cause_idx").isNotNull(), "Subsumed").when(F.col("_n") > 1, "Duplicate").otherwise("Keep")
    return out.withColumn("action", action).drop("_n")
