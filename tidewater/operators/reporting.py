"""Issue predicates, merges of competing hints, leak decisions, overlaps between producers, and the counters of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.dedup import LEAK_RANK

# Issue kinds at a language boundary, of one function's memory, of resource contracts, and those that only inform.
FFI_BOUNDARY = ["CrossLanguageFree", "OwnershipViolation", "FfiTypeMismatch", "AbiMismatch", "UncheckedReturn", "FfiUnsafeCall", "CallbackEscape", "LengthTruncation"]
LOCAL_MEMORY = ["DoubleFree", "UseAfterFree", "InvalidFree", "MemoryLeak", "BufferOverflow", "NullDereference", "IntegerOverflow"]
RESOURCE_CONTRACT = ["CrossFamilyFree", "ConditionalLeak", "DefiniteLeak", "BorrowEscape", "CallbackEscapeIssue", "NeedsModel", "WriteToImmutable", "DoubleReclaim", "OwnershipEscapeLeak"]
DIAGNOSTIC_ONLY = ["WriteToImmutable", "UncheckedReturn"]
# Exit states without a leak.
SAFE_EXITS = ["Released", "Null", "Escaped"]


def kind_flags(kind: Column) -> dict[str, Column]:
    """What a reader asks of an issue kind; a kind may have several flags or none."""
    return {
        "is_ffi_boundary": kind.isin(*FFI_BOUNDARY),
        "is_local_memory": kind.isin(*LOCAL_MEMORY),
        "is_resource_contract": kind.isin(*RESOURCE_CONTRACT),
        "is_uaf": kind == "UseAfterFree",
        "is_diagnostic_only": kind.isin(*DIAGNOSTIC_ONLY),
    }


def boundary_only(issues: DataFrame, kind: str) -> DataFrame:
    return issues.filter(kind_flags(F.col(kind))["is_ffi_boundary"])


def severity_flags(severity: Column, confidence: Column) -> dict[str, Column]:
    high = severity.isin("Error", "Warning")
    return {"is_high": high, "is_low": ~high, "is_actionable": confidence != "Low"}


def leak_type(states: DataFrame, keys: list[str], state: str, is_state: Column, is_alloc: Column, is_release: Column) -> DataFrame:
    """The leak decision of each key: exit states decide if there are any and they aren't only unknown or safe ones mixed; else the
    numbers of allocations and releases do. One aggregation."""
    s = F.when(is_state, F.col(state))
    agg = states.groupBy(*keys).agg(
        F.count(s).alias("exits"), F.coalesce(F.every(s == "Owned"), F.lit(False)).alias("_all"), F.coalesce(F.some(s == "Owned"), F.lit(False)).alias("_some"), F.coalesce(F.every(s.isin(*SAFE_EXITS)), F.lit(False)).alias("_safe"), F.coalesce(F.some(s == "Unknown"), F.lit(False)).alias("_unknown"),
        F.count_if(is_alloc).alias("allocs"), F.count_if(is_release).alias("releases"),
    )
    counted = F.when((F.col("allocs") > 0) & (F.col("releases") == 0), "Definite").when((F.col("allocs") > 0) & (F.col("releases") < F.col("allocs")), "Conditional").when(F.col("allocs") > 0, "Safe").otherwise("NeedsModel")
    by_state = F.when(F.col("exits") == 0, None).when(F.col("_safe"), "Safe").when(F.col("_all"), "Definite").when(F.col("_some"), "Conditional").when(~F.col("_unknown"), "Safe")
    return agg.select(*keys, "exits", "allocs", "releases", F.coalesce(by_state, counted).alias("leak_type"))


def adjusted(verdict: Column, has_paths: Column, total: Column, owned: Column, safe: Column) -> Column:
    """A verdict in the light of path states: all paths safe explain it, all paths leaking confirm it, anything else keeps it."""
    seen = has_paths & (total > 0)
    return F.when(seen & (safe == total), "ExplainedSafe").when(seen & (owned == total), "Confirmed").otherwise(verdict)


def definite_leak(escape_evidence: Column, path_evidence: Column, suppressed_high: Column, suppressed_medium: Column) -> Column:
    """Verdict of a definite leak from its bundle: an escape confirms; path evidence counts as paths that all leak, so it confirms
    over any suppression; high suppression explains, medium makes probable."""
    return F.when(escape_evidence | path_evidence, "Confirmed").when(suppressed_high, "ExplainedSafe").when(suppressed_medium, "Probable").otherwise("Confirmed")


def strongest(rows: DataFrame, keys: list[str], value: str, order: list[Column]) -> DataFrame:
    """The value that comes last by ``order`` for each key, by a partial aggregation: no sort, no window."""
    return rows.groupBy(*keys).agg(F.max_by(F.col(value), F.struct(*order)).alias(value))


def evidence_multiplier(rows: DataFrame, keys: list[str], confidence: str) -> DataFrame:
    """Mean confidence of each candidate's evidence, and the factor 0.7 to 1.0 that it gives."""
    mean = F.avg(confidence)
    return rows.groupBy(*keys).agg(F.count(confidence).alias("n_evidence"), F.round(mean, 6).alias("mean_confidence"), F.round(0.7 + 0.3 * mean, 6).alias("multiplier"))


def without_overlaps(candidates: DataFrame, is_runtime: Column) -> DataFrame:
    """Leak candidates without those of a runtime allocator whose caller is the function of a user candidate of the same family
    and at least the same strength. Columns: idx, kind, alloc_function, alloc_caller, family."""
    strength = F.lit(0)
    for kind, value in LEAK_RANK.items():
        strength = F.when(F.col("kind") == kind, value).otherwise(strength)
    rows = candidates.withColumn("_p", strength).withColumn("_runtime", is_runtime)
    user = rows.filter("not _runtime").groupBy(F.col("alloc_function").alias("_f"), F.col("family").alias("_family")).agg(F.max("_p").alias("_best"))
    same = (F.col("alloc_caller") == F.col("_f")) & (F.col("family") == F.col("_family")) & F.col("_runtime") & (F.col("_p") <= F.col("_best"))
    return rows.join(user, same, "left_anti").drop("_p", "_runtime")


def with_facts(candidates: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """How many facts each candidate gets: those of every one of its key columns, in callers and callees alike, once for each column
    that names them; empty and null keys name none. An unpivot and one equi join with facts that are counted by symbol first."""
    symbols = F.explode(F.array(*[F.col(k) for k in keys])).alias("symbol")
    named = candidates.select("idx", symbols).filter(F.col("symbol").isNotNull() & (F.col("symbol").cast("string") != ""))
    met = named.join(facts.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")), "symbol").groupBy("idx").agg(F.sum("_n").alias("n_facts"))
    return candidates.select("idx").join(met, "idx", "left").select("idx", F.coalesce("n_facts", F.lit(0)).alias("n_facts"))


def without_declarations(candidates: DataFrame, declared: DataFrame, defined: DataFrame) -> DataFrame:
    """Candidates (idx, kind, alloc_function, release_function, alloc_caller, release_caller) without double releases that only touch
    declarations: one of their functions is declared and not defined, and no known caller is defined. Other kinds all stay.

    The four names of the double releases are unpivoted, so the symbols (``declared`` and ``defined`` have a ``symbol``) are joined once.
    """
    symbols = declared.select("symbol", F.lit(0).alias("_d")).unionByName(defined.select("symbol", F.lit(1).alias("_d"))).groupBy("symbol").agg(F.max("_d").alias("_defined"))
    names = F.explode(F.array(*[F.struct(F.lit(c.endswith("function")).alias("own"), F.col(c).alias("symbol")) for c in ("alloc_function", "release_function", "alloc_caller", "release_caller")])).alias("n")
    of = candidates.filter("kind = 'DoubleRelease'").select("idx", names).select("idx", "n.*").join(symbols, "symbol")
    only = of.groupBy("idx").agg(F.bool_or(F.col("own") & (F.col("_defined") == 0)).alias("_a"), F.bool_or(~F.col("own") & (F.col("_defined") == 1)).alias("_b")).filter("_a and not _b").select("idx")
    return candidates.join(only, "idx", "left_anti")


def merged_edges(mine: DataFrame, other: DataFrame, offset: int) -> DataFrame:
    """Edges of two graphs; the other's instances are moved by ``offset``, but 0 stays the one instance that is no instance."""
    moved = lambda c: F.when(F.col(c) > 0, F.col(c) + (offset if offset > 1 else 0)).otherwise(F.col(c)).alias(c)
    return mine.select("source", "target").unionByName(other.select(moved("source"), moved("target")))


def pass_stats(passes: DataFrame, name: str, duration: str) -> DataFrame:
    """Numbers of foundation and analysis passes, and total, mean, largest and least duration."""
    d, base = F.col(duration), F.col(name).isin("CFG", "DFG")
    return passes.agg(F.count_if(base).alias("foundation_passes"), F.count_if(~base).alias("analysis_passes"), F.coalesce(F.sum(d), F.lit(0)).alias("total_ms"), F.round(F.coalesce(F.avg(d), F.lit(0.0)), 6).alias("avg_ms"), F.coalesce(F.max(d), F.lit(0)).alias("max_ms"), F.coalesce(F.min(d), F.lit(0)).alias("min_ms"))


def hit_rate(rows: DataFrame, keys: list[str], hit: Column, size: Column) -> DataFrame:
    """Lookups, hits, their share, and the bytes held, by key; a share without lookups is 0."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("lookups"), F.count_if(hit).alias("hits"), F.round(F.count_if(hit) / F.count(F.lit(1)), 6).alias("hit_rate"), F.sum(size).alias("bytes"))


def distinct_names(rows: DataFrame, name: str) -> DataFrame:
    """Names that differ by more than case, each in its least spelling, with its place in the case-insensitive order."""
    from pyspark.sql.window import Window

    some = rows.filter(F.col(name).isNotNull()).groupBy(F.lower(name).alias("folded")).agg(F.min(name).alias(name))
    return some.select(name, F.row_number().over(Window.orderBy("folded")).cast("long").alias("place"))
