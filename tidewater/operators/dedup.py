"""Arg-max families: one survivor a key, under a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Ranks of severities, confidences and leak kinds.
SEVERITY_RANK = {"Error": 3, "Warning": 2, "Note": 1, "Help": 0}
CONFIDENCE_RANK = {"High": 2, "Medium": 1, "Low": 0}
LEAK_RANK = {"DefiniteLeak": 3, "ConditionalLeak": 2, "OwnershipEscapeLeak": 1}


def rank_of(name: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(-1)
    for k, v in ranks.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def arg_max(df: DataFrame, keys: list[str], order: list[Column], seq: str) -> DataFrame:
    """The first row of each key by ``order``, with ``dropped`` (how many others it had) and ``first_seq``, the position at
    which the key was first seen. Spark limits each group before the shuffle only for the rank, so the counts are a second
    window over the same partitioning."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("dropped", F.count(F.lit(1)).over(w) - 1).withColumn("first_seq", F.min(seq).over(w))
    return out.filter("_n = 1").drop("_n")


def dedup_issues(issues: DataFrame, keys: list[str], severity: Column, confidence: Column, seq: str) -> DataFrame:
    """One issue for each precise key: the most severe, then the most certain, then the first seen."""
    return arg_max(issues, keys, [severity.desc(), confidence.desc(), F.col(seq)], seq)


def dedup_leaks(rows: DataFrame, resource: str, kind: str, seq: str) -> DataFrame:
    """One leak for each resource, definite before conditional before escape; rows without a resource all stay."""
    known = F.col(resource).isNotNull()
    w = Window.partitionBy(resource).orderBy(rank_of(F.col(kind), LEAK_RANK).desc(), seq)
    best = rows.filter(known).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return best.unionByName(rows.filter(~known))


def majority(df: DataFrame, keys: list[str], label: str, unknown: str = "Unknown") -> DataFrame:
    """The most frequent label of each key other than ``unknown``; ties go to the smaller label."""
    counts = df.filter(F.col(label) != unknown).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("winner"), F.max("n").alias("votes"))


def histogram_text(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``label: count`` entries by falling count, joined to one text."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(label).alias("l"))))
    return counts.groupBy(*keys).agg(F.array_join(F.transform(entries, lambda e: F.concat(e["l"], F.lit(": "), (-e["m"]).cast("string"))), ", ").alias("summary"))
