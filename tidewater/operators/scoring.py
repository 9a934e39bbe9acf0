"""Scores, verdicts and metrics as column arithmetic over broadcast dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def risk_mult(base: Column, weight: Column, mean_confidence: Column, confirmed: Column) -> Column:
    """base * verdict weight * (0.7 + 0.3 * mean evidence confidence); without evidence 0.7, or 0.85 if confirmed."""
    evidence = F.coalesce(0.7 + 0.3 * mean_confidence, F.when(confirmed, 0.85).otherwise(0.7))
    return clamp(base * F.coalesce(weight, F.lit(0.5)) * evidence)


def risk_add(base: Column, weight: Column, is_ffi: Column, family_unknown: Column, evidence: Column, safe: Column) -> Column:
    """base * weight + 0.15 at a boundary - 0.1 for an unknown family + 0.02 an evidence, 0.1 at most; 0 if explained safe."""
    score = base * weight + F.when(is_ffi, 0.15).otherwise(0.0) - F.when(family_unknown, 0.1).otherwise(0.0) + F.least(0.02 * evidence, F.lit(0.1))
    return F.when(safe, 0.0).otherwise(clamp(score))


# Base severity by issue kind, and the lower bounds of the confidence tiers.
BASE_SEVERITY = {"use_after_free": 0.65, "double_free": 0.60, "cross_language_free": 0.55, "cross_family_free": 0.55, "buffer_overflow": 0.70, "borrow_escape": 0.50, "memory_leak": 0.45, "conditional_leak": 0.45, "command_injection": 0.60}
TIERS = [(0.85, "Critical"), (0.70, "High"), (0.50, "Medium")]


def confidence(kind: Column, has_debug: Column, has_chain: Column, frequency: Column, distance: Column, detectors: Column) -> Column:
    """Base, clearer provenance, rarer patterns, a shorter taint path and agreeing detectors, added up and clamped."""
    base = F.lit(0.50)
    for k, v in BASE_SEVERITY.items():
        base = F.when(kind == k, v).otherwise(base)
    provenance = F.when(has_debug, 0.2).when(has_chain, 0.1).otherwise(-0.1)
    rare = F.when(frequency > 0, -F.least(0.03 * F.log(frequency + 1.0), F.lit(0.3))).otherwise(0.0)
    near = F.when(distance > 0, F.least(0.15 / F.greatest(distance, F.lit(1)), F.lit(0.15))).otherwise(0.0)
    return clamp(base + provenance + rare + near + F.when(detectors >= 2, 0.15).otherwise(0.0))


def tier(score: Column) -> Column:
    out = F.lit("Low")
    for bound, name in reversed(TIERS):
        out = F.when(score >= bound, name).otherwise(out)
    return out


# How safe a pointer's provenance is.
PROVENANCE = {"Heap": 0.9, "Global": 0.8, "Stack": 0.2, "Unknown": 0.5}


def ffi_safety(syscall: Column, provenance: Column, interior: Column) -> Column:
    p = F.lit(0.5)
    for k, v in PROVENANCE.items():
        p = F.when(provenance == k, v).otherwise(p)
    return F.least(0.6 * syscall + 0.4 * p + F.when(interior, 0.1).otherwise(0.0), F.lit(1.0))


def path_states(df: DataFrame, keys: list[str], state: str) -> DataFrame:
    """Total, owned, safe and unknown exit states, the leak ratio, its confidence and the leak type, in one aggregation."""
    s = F.col(state)
    owned, safe = s == "Owned", s.isin("Released", "Null", "Escaped")
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(owned).alias("owned"), F.count_if(safe).alias("safe"), F.count_if(~owned & ~safe).alias("unknown"), F.every(owned).alias("_all"), F.some(owned).alias("_any"))
    ratio = F.col("owned") / F.col("total")
    sure = 1 - F.col("unknown") / F.col("total")
    kind = F.when(F.col("_all"), "Definite").when(F.col("_any"), "Conditional").when(F.col("unknown") > 0, "NeedsModel").otherwise("Safe")
    return out.select(*keys, "total", "owned", "safe", "unknown", F.round(ratio, 6).alias("leak_ratio"), F.when(sure >= 0.9, "High").when(sure >= 0.65, "Medium").otherwise("Low").alias("confidence"), kind.alias("leak_type"))


def cross_validated(counting: Column, path: Column) -> Column:
    """What counting and path states say together."""
    leak = ("Definite", "Conditional")
    return (
        F.when(counting == path, counting)
        .when(counting == "NeedsModel", path)
        .when(path == "NeedsModel", counting)
        .when((counting == "Safe") & path.isin(*leak), "Safe")
        .when(counting.isin(*leak) & (path == "Safe"), counting)
        .otherwise("Conditional")
    )


def precision_metrics(df: DataFrame, expected: Column, found: Column) -> DataFrame:
    """Confusion matrix and its ratios in one pass; empty denominators give 1 (precision, recall) or 0 (rates)."""
    c = df.agg(F.count_if(found & expected).alias("tp"), F.count_if(found & ~expected).alias("fp"), F.count_if(~found & expected).alias("fn"), F.count_if(~found & ~expected).alias("tn"))
    over = lambda a, b, e: F.when(b > 0, a / b).otherwise(F.lit(e))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    c = c.withColumn("precision", over(tp, tp + fp, 1.0)).withColumn("recall", over(tp, tp + fn, 1.0)).withColumn("fp_rate", over(fp, tp + fp, 0.0))
    both = F.col("precision") + F.col("recall")
    c = c.withColumn("f1", over(2 * F.col("precision") * F.col("recall"), both, 0.0))
    passed = (F.col("precision") >= 0.88) & (F.col("fp_rate") <= 0.12)
    return c.select("tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1", "fp_rate")], passed.alias("gate_passed"))
