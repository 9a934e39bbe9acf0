"""The whole analysis over parsed IR: facts, contract edges, life cycles, candidates, verdicts, issues. Every stage is lazy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import symbols as S
from tidewater.operators import dedup, gate, matching, scoring
from tidewater.operators import dimensions as D


def call_meta(spark: SparkSession, ir: dict[str, DataFrame], families: DataFrame | None = None) -> DataFrame:
    """Calls with languages, flags, family, effect and the boundary predicate. Unknown callers that the module defines are C."""
    defined = ir["functions"].filter("not is_declaration").select("module_id", F.col("name").alias("_d")).distinct()
    c = ir["calls"].join(defined, (ir["calls"]["module_id"] == defined["module_id"]) & (F.col("caller") == F.col("_d")), "left").select(ir["calls"]["*"], F.col("_d").isNotNull().alias("_defined"))
    lang = S.language(F.col("caller"))
    c = c.withColumn("caller_lang", F.when((lang == "Unknown") & F.col("_defined"), "C").otherwise(lang)).drop("_defined").withColumn("callee_lang", S.language(F.col("callee")))
    known = (F.col("caller_lang") != "Unknown") & (F.col("callee_lang") != "Unknown")
    c = c.withColumn("cross_lang", known & (F.col("caller_lang") != F.col("callee_lang"))).withColumn("mangled", S.is_mangled(F.col("callee"))).withColumn("intrinsic", S.is_intrinsic(F.col("callee")))
    quiet = F.col("intrinsic") | F.contains("callee", F.lit("drop_in_place")) | F.contains("callee", F.lit("panic"))
    open_ = F.col("cross_lang") | (F.col("mangled") & (F.col("caller_lang") == "C")) | (~F.col("caller_lang").isin("Unknown", "C") & (F.col("callee_lang") == "Unknown") & F.col("is_external"))
    c = c.withColumn("is_boundary", open_ & ~quiet)
    dim = families if families is not None else D.family_symbols(spark)
    con = D.contracts(spark).select("function", F.when(F.col("type") == "Allocator", "Acquire").when(F.col("type") == "Deallocator", "Release").when(F.col("type") == "Releaser", "ConditionalRelease").when(F.col("type") == "Retainer", "Retain").alias("_ce"), F.concat(F.lit("LIB_"), F.upper("source")).alias("_cf"))
    c = c.join(F.broadcast(dim), F.col("callee") == F.col("symbol"), "left").drop("symbol").join(F.broadcast(con), F.col("callee") == F.col("function"), "left")
    return c.withColumn("family", F.coalesce("family", "_cf")).withColumn("effect", F.coalesce("effect", "_ce")).drop("function", "_cf", "_ce")


def instances(meta: DataFrame) -> DataFrame:
    """Acquires and releases by pointer: a release belongs to the acquire whose result register is its first argument."""
    e = meta.filter(F.col("effect").isNotNull())
    acquire = e.filter("effect = 'Acquire' and result is not null").select("module_id", F.col("caller").alias("func"), F.col("result").alias("reg"), F.col("call_idx").alias("acquire_idx"), F.col("callee").alias("acquire_fn"), F.col("family").alias("acquire_family"), F.col("is_boundary").alias("acquire_boundary"))
    arg = F.regexp_extract(F.concat_ws(" ", "args"), r"(%[-\w.$]+)", 1)
    other = e.filter("effect != 'Acquire'").select("module_id", F.col("caller").alias("func"), arg.alias("reg"), F.col("call_idx").alias("idx"), F.col("callee").alias("fn"), F.col("family").alias("fam"), "effect", F.col("is_boundary").alias("boundary"))
    return acquire.join(other, ["module_id", "func", "reg"], "left")


def returned(ir: dict[str, DataFrame]) -> DataFrame:
    """Registers that a function returns: their resource leaves it."""
    return ir["instructions"].filter("kind = 'Ret'").select("module_id", "func", F.explode("operands").alias("reg")).distinct()


def candidates(spark: SparkSession, ir: dict[str, DataFrame], meta: DataFrame) -> DataFrame:
    """Issue candidates: wrong family, double release, use after release, leaks."""
    inst = instances(meta)
    compat = D.family_compat(spark).select(F.col("acquire_family"), F.col("release_family").alias("fam"), F.lit(True).alias("_ok"))
    rel = inst.filter("effect in ('Release', 'ConditionalRelease')").join(F.broadcast(compat), ["acquire_family", "fam"], "left")
    base = ["module_id", "func", "reg", "acquire_idx", "acquire_fn", "acquire_family"]
    wrong = rel.filter("_ok is null and fam is not null and acquire_family is not null").select(*base, F.col("idx").alias("at"), F.col("fn").alias("release_fn"), F.col("fam").alias("release_family"), F.when(F.col("boundary") | F.col("acquire_boundary"), "CrossLanguageFree").otherwise("CrossFamilyFree").alias("kind"))
    again = matching.repeated_release(rel, ["module_id", "func", "reg", "acquire_idx"], ["idx"], F.col("effect") == "Release", "fn")
    double = again.select(*base, F.col("idx").alias("at"), F.col("fn").alias("release_fn"), F.col("fam").alias("release_family"), F.lit("DoubleRelease").alias("kind"))
    last = rel.filter("effect = 'Release'").groupBy(*base).agg(F.min("idx").alias("_freed"), F.min_by("fn", "idx").alias("release_fn"), F.min_by("fam", "idx").alias("release_family"))
    uses = ir["instructions"].filter("kind in ('Load', 'Store', 'GetElementPtr')").select("module_id", "func", F.explode("operands").alias("reg"), "inst_idx")
    after = last.join(uses, ["module_id", "func", "reg"]).filter(F.col("inst_idx") > F.col("_freed")).groupBy(*base, "release_fn", "release_family").agg(F.min("inst_idx").alias("at")).withColumn("kind", F.lit("UseAfterFree"))
    held = inst.groupBy(*base).agg(F.coalesce(F.bool_or(F.col("effect").isin("Release", "ConditionalRelease", "Escape")), F.lit(False)).alias("_gone"))
    leak = held.filter("not _gone").join(returned(ir), ["module_id", "func", "reg"], "left_anti").select(*base, F.col("acquire_idx").alias("at"), F.lit(None).cast("string").alias("release_fn"), F.lit(None).cast("string").alias("release_family"), F.lit("DefiniteLeak").alias("kind"))
    return wrong.unionByName(double).unionByName(after).unionByName(leak)


def issues(spark: SparkSession, ir: dict[str, DataFrame], families: DataFrame | None = None) -> DataFrame:
    """Verified, gated, reconciled and deduplicated issues with risk, severity and CWE."""
    meta = call_meta(spark, ir, families)
    cand = candidates(spark, ir, meta)
    safe = cand["acquire_family"].isin("GO_GC")
    verdict = F.when(safe & (F.col("kind") == "DefiniteLeak"), "ExplainedSafe").when(F.col("kind").isin("CrossFamilyFree", "CrossLanguageFree") & F.col("release_family").isNull(), "Probable").when(F.col("kind") == "DefiniteLeak", "Probable").otherwise("Confirmed")
    rows = cand.withColumn("verdict", verdict).join(F.broadcast(D.candidate_kinds(spark)), F.col("kind") == F.col("candidate_kind")).join(F.broadcast(D.verdicts(spark)), "verdict")
    rows = gate.reconcile(rows, ["module_id", "func", "reg", "acquire_idx"], "fault_class", "verdict_rank", "at", D.subsumes(spark)).filter("action = 'Keep' and verdict_rank >= 2")
    symbol = F.coalesce("release_fn", "acquire_fn")
    rows = rows.withColumn("symbol", symbol).withColumn("issue_id", F.sha2(F.concat_ws("|", "module_id", "func", "reg", "kind", F.col("at").cast("string")), 256))
    facts = meta.select(F.explode(F.array("callee", "caller")).alias("symbol")).distinct().withColumn("kind", S.semantic_kind(F.col("symbol"))).filter("kind != 'Unknown'")
    gated = gate.gate(rows, facts, D.gate_rules(spark), caller="func").filter("gate_verdict = 'Allow'")
    risk = scoring.risk_mult(F.col("base_mult"), F.col("weight_mult"), F.lit(None).cast("double"), F.col("verdict") == "Confirmed")
    out = gated.withColumn("risk", F.round(risk, 6))
    w = Window.partitionBy("module_id", "func", "issue_kind", "symbol", "at").orderBy(F.col("verdict_rank").desc(), "reg")
    out = out.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return out.select("module_id", F.col("func").alias("function"), "issue_kind", "severity", "verdict", "cwe", "symbol", "acquire_fn", "acquire_family", "release_family", F.col("at").alias("line"), "risk")


def project(ir: dict[str, DataFrame]) -> DataFrame:
    """Symbols that one module declares and another defines: all modules are analysed in one job."""
    from tidewater.operators.graph import cross_module

    return cross_module(ir["functions"].filter("not is_declaration"), ir["functions"].filter("is_declaration"), "name", "module_id")


__all__ = ["call_meta", "candidates", "dedup", "instances", "issues", "project", "returned"]
