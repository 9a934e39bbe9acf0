"""Verdicts of candidates from all that is known of them: evidence, semantic facts by confidence, resources; and last suppressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.evidence import base_verdict
from tidewater.operators.reporting import adjusted, definite_leak

# Semantic kinds that explain any candidate, those that explain leaks besides, and evidence that explains leaks.
SAFE_KINDS = ["RuntimeManagedResource", "StoredToOwner", "StoredToRuntime", "EscapedToCaller", "EscapedToOutParam", "RaiiDropRelease", "CppDestructor", "DestructorRelease"]
SAFE_LEAK_KINDS = ["GlobalProvenance", "AbortOnOom", "RefcountTransfer", "StaticLifetimeSink"]
SAFE_LEAK_EVIDENCE = ["ReturnToCaller", "OutParamInit", "OutParamOwnedOnSuccess", "OutParamNullOnError", "FieldStoreToOwner", "StaticLifetimeSink"]
# Leaks; words of a pattern's description that tell of an escape.
LEAKS = ["DefiniteLeak", "ConditionalLeak", "OwnershipEscapeLeak"]
ESCAPE_WORDS = ["escape", "Escape", "global", "Global", "ReturnAlias", "alias"]
# Issues that a runtime's own symbol can't have, and prefixes of functions that bridge languages.
NOT_OF_RUNTIME = ["FfiUnsafeCall", "ConditionalLeak", "DefiniteLeak", "OwnershipEscapeLeak", "CrossLanguageFree", "OwnershipViolation", "UseAfterFree", "InvalidFree", "BorrowEscape"]
BRIDGES = ["c_", "rust_", "py_", "java_", "go_"]
_SINGLE = ["OwnershipEscapeLeak", "PathStateRefinement", "BridgeHelper", "OwnershipTransfer", "GlobalStore", "IrPattern"]


def flags(evidence: DataFrame, facts: DataFrame, key: str = "idx") -> DataFrame:
    """(key, flags ...) from evidence (key, kind, description) and facts (key, kind, confidence): one aggregation of both, combined before
    the shuffle, so a candidate may have any number of them."""
    no = F.lit(False)
    e, kind = evidence.filter("kind is not null"), F.col("kind")
    escape = no
    for word in ESCAPE_WORDS:
        escape = escape | F.contains("description", F.lit(word))
    seen = {f"e_{n}": kind == n for n in _SINGLE} | {"e_safe_leak": kind.isin(SAFE_LEAK_EVIDENCE), "e_pattern_escape": (kind == "IrPattern") & F.coalesce(escape, no)}
    high, medium = F.coalesce(F.col("confidence") == "High", no), F.coalesce(F.col("confidence").isin("High", "Medium"), no)
    general, leak = kind.isin(SAFE_KINDS), kind.isin(SAFE_KINDS + SAFE_LEAK_KINDS)
    told = {"f_high": general & high, "f_medium": general & medium, "f_leak": leak, "f_leak_high": leak & high, "f_leak_medium": leak & medium}
    rows = e.select(key, *[c.alias(n) for n, c in seen.items()], *[no.alias(n) for n in told]).unionByName(facts.filter("kind is not null").select(key, *[no.alias(n) for n in seen], *[c.alias(n) for n, c in told.items()]))
    return rows.groupBy(key).agg(*[F.bool_or(n).alias(n) for n in [*seen, *told]])


def conditional_leak(escape: Column, paths: Column, high: Column, medium: Column, any_fact: Column) -> Column:
    """Verdict of a leak on some paths: an escape leaves it probable, a sure suppression explains it, a likely one leaves it probable, one
    of any confidence explains it. Path evidence counts as one path of two that leaks, which changes no verdict."""
    found = F.when(escape, "Probable").when(high, "ExplainedSafe").when(medium, "Probable").when(any_fact, "ExplainedSafe").otherwise("Probable")
    return adjusted(found, paths & ~escape, F.lit(2), F.lit(1), F.lit(1))


def borrow_escape(bridge: Column, transfer: Column, stored: Column, pattern: Column, pattern_escapes: Column) -> Column:
    """Verdict of a borrow that escapes: bridges and transfers explain it, a store to a global doesn't; a pattern does unless it is an escape."""
    return F.when(bridge | transfer, "ExplainedSafe").when(stored | pattern_escapes, "Probable").when(pattern, "ExplainedSafe").otherwise("Probable")


def verified(candidates: DataFrame, evidence: DataFrame, facts: DataFrame, key: str = "idx") -> DataFrame:
    """``candidates`` (key, kind, same_resource, reachable_release, own columns) with ``verdict``.

    Sure facts explain a candidate, unless it has the same resource with a reachable release, or is a borrow with a concrete escape.
    Otherwise its kind's rule decides, and likely facts make a confirmed verdict probable unless the resource is that strong. Kinds
    without a rule keep their base verdict, Probable if there is none. Candidates without evidence or facts have no flag set.
    """
    known = flags(evidence, facts, key)
    names = [c for c in known.columns if c != key]
    rows = candidates.join(known, key, "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in names})
    c, kind = F.col, F.col("kind")
    leak = F.coalesce(kind.isin(LEAKS), F.lit(False))
    high = F.when(leak, c("f_leak_high") | c("e_safe_leak")).otherwise(c("f_high"))
    medium = F.when(leak, c("f_leak_medium")).otherwise(c("f_medium"))
    strong = F.coalesce(c("same_resource") & c("reachable_release"), F.lit(False))
    concrete = (kind == "BorrowEscape") & (c("e_GlobalStore") | c("e_pattern_escape"))
    own = (
        F.when(kind == "DefiniteLeak", definite_leak(c("e_OwnershipEscapeLeak"), c("e_PathStateRefinement"), c("f_leak_high") | c("e_safe_leak"), c("f_leak_medium")))
        .when(kind == "ConditionalLeak", conditional_leak(c("e_OwnershipEscapeLeak"), c("e_PathStateRefinement"), c("f_leak_high") | c("e_safe_leak"), c("f_leak_medium"), c("f_leak") | c("e_safe_leak")))
        .when(kind == "BorrowEscape", borrow_escape(c("e_BridgeHelper"), c("e_OwnershipTransfer"), c("e_GlobalStore"), c("e_IrPattern"), c("e_pattern_escape")))
        .otherwise(F.coalesce(base_verdict(kind), F.lit("Probable")))
    )
    weaker = F.when(medium & ~high & ~strong & (own == "Confirmed"), "Probable").otherwise(own)
    return rows.withColumn("verdict", F.when(high & ~strong & ~F.coalesce(concrete, F.lit(False)), "ExplainedSafe").otherwise(weaker)).drop(*names)


def suppressed(kind: Column, symbol: Column, function: Column, symbol_is_runtime: Column, function_is_user: Column, symbol_is_libc: Column) -> Column:
    """Why an issue that passed every gate is still held back, the first reason that holds; null if none does. A null function is no user's."""
    user = F.coalesce(function_is_user, F.lit(False)) & function.isNotNull()
    twice, leak = kind.isin("DoubleFree", "UseAfterFree"), kind.isin(LEAKS)
    at_bridge = F.lit(False)
    for prefix in BRIDGES:
        at_bridge = at_bridge | F.startswith(F.coalesce(function, F.lit("")), F.lit(prefix))
    return (
        F.when(symbol_is_runtime & ~user & kind.isin(NOT_OF_RUNTIME), "RuntimeSymbol")
        .when(~user & leak, "RuntimeCallerLeak")
        .when(symbol_is_libc & twice & ((F.coalesce(function, F.lit("")) == symbol) | ~user), "LibcSymbol")
        .when(at_bridge & ~user & twice, "BridgeFunction")
    )
