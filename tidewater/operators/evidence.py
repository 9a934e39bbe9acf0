"""Evidence, verdict and layout operators: ordered decisions as CASE, keys unpivoted instead of OR-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Verdicts that a candidate's kind alone decides.
BASE_VERDICT = {
    "CallbackEscape": "Diagnostic", "NeedsModel": "Diagnostic", "AbiLayoutMismatch": "Diagnostic", "DoubleReclaim": "Confirmed", "UseAfterFree": "Confirmed", "InvalidBorrowedFree": "Confirmed", "NullDereference": "Confirmed",
    "OwnershipEscapeLeak": "Probable", "UncheckedFfiReturn": "Probable", "BoundaryMisuse": "Probable",
}
# Languages whose families share a heap.
LANGUAGE_GROUP = {"RUST": "rust", "C_": "c", "CPP": "c", "MIMALLOC": "c", "PYTHON": "python", "JAVA": "java", "CSHARP": "csharp", "GO_": "go"}


def base_verdict(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in BASE_VERDICT.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def cross_family_verdict(release_known: Column, compatible: Column, reachable: Column, destructor: Column, escape: Column, suppressed: Column) -> Column:
    """The first that holds decides."""
    return F.when(~release_known, "Probable").when(compatible, "ExplainedSafe").when(~reachable, "Probable").when(destructor, "ExplainedSafe").when(escape | suppressed, "Probable").otherwise("Confirmed")


def double_release_verdict(guarded: Column, other_caller: Column, pure: Column, same_instance: Column, aliased: Column, used_after: Column) -> Column:
    return F.when(guarded, "ExplainedSafe").when(pure & ~other_caller & ~same_instance, "ExplainedSafe").when(~aliased | ~same_instance, "Probable").when(used_after, "Diagnostic").otherwise("Confirmed")


def language_group(family: Column) -> Column:
    out = F.lit(None).cast("string")
    for prefix, group in LANGUAGE_GROUP.items():
        out = F.when(F.startswith(family, F.lit(prefix)), group).otherwise(out)
    return out


def prioritized(rows: DataFrame, key: str, branches: list[Column], names: list[str], otherwise: str) -> DataFrame:
    """The first branch that holds, as (priority, name): boundary rules by function, by pattern, by languages."""
    pick, number = F.lit(otherwise), F.lit(len(branches) + 1)
    for i in reversed(range(len(branches))):
        pick, number = F.when(branches[i], names[i]).otherwise(pick), F.when(branches[i], i + 1).otherwise(number)
    return rows.select(key, number.alias("priority"), pick.alias("rule"))


def bundle(candidates: DataFrame, facts: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Distinct facts of any of a candidate's names, sorted: the names are unpivoted, so one equi-join does what an OR would."""
    probe = candidates.select(key, F.explode(F.array(*map(F.col, names))).alias("symbol")).filter("symbol is not null").distinct()
    met = probe.join(facts, "symbol").select(key, "kind").distinct()
    return met.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("evidence"), F.count(F.lit(1)).alias("n_evidence"))


def edge_groups(edges: DataFrame, source: str, target: str, idx: str) -> DataFrame:
    """Edges by the instances that they touch; 0 is no instance. (instance, n_edges, first_idx, last_idx)."""
    both = edges.select(idx, F.explode(F.array_distinct(F.array(source, target))).alias("instance")).filter("instance != 0")
    return both.groupBy("instance").agg(F.count(F.lit(1)).alias("n_edges"), F.min(idx).alias("first_idx"), F.max(idx).alias("last_idx"))


def evict(entries: DataFrame, keys: list[str], order: list[str], size: str, target: float) -> DataFrame:
    """Least recently used entries of each key until their sizes reach the target."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("freed_before", F.coalesce(F.sum(size).over(w), F.lit(0.0))).filter(F.col("freed_before") < target)


# Size and alignment of scalar types in bytes.
SCALARS = {"i1": 1, "i8": 1, "i16": 2, "i32": 4, "i64": 8, "i128": 16, "float": 4, "double": 8, "ptr": 8}


def struct_layout(fields: Column) -> Column:
    """Offset end, padding and alignment of a struct of scalar fields, as a fold with alignment; unknown types take no space."""
    sizes = F.create_map(*[F.lit(x) for kv in SCALARS.items() for x in kv])
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("pad"), F.lit(1).alias("align"))

    def step(acc: Column, f: Column) -> Column:
        n = F.coalesce(F.try_element_at(sizes, f), F.lit(0))
        a = F.greatest(n, F.lit(1))
        gap = (a - acc["at"] % a) % a
        return F.struct((acc["at"] + gap + n).alias("at"), (acc["pad"] + gap).alias("pad"), F.greatest(acc["align"], a).alias("align"))

    def finish(acc: Column) -> Column:
        tail = (acc["align"] - acc["at"] % acc["align"]) % acc["align"]
        return F.struct((acc["at"] + tail).alias("size"), (acc["pad"] + tail).alias("padding"), acc["align"].alias("align"))

    return F.aggregate(fields, zero, step, finish)


def packed_order(fields: Column) -> Column:
    """The fields by falling size, then name: the order of least padding."""
    sizes = F.create_map(*[F.lit(x) for kv in SCALARS.items() for x in kv])
    keyed = F.transform(fields, lambda f: F.struct((-F.coalesce(F.try_element_at(sizes, f), F.lit(0))).alias("n"), f.alias("f")))
    return F.transform(F.array_sort(keyed), lambda x: x["f"])
