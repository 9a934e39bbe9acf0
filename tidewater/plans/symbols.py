"""Queries of the symbol family. ``part`` and ``lineitem`` rows stand for calls: each names a registry symbol by its key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import symbols as S
from tidewater.operators import dimensions as D
from tidewater.plans.tables import read

QUERIES, ORACLE = {}, {}

#: Symbols that the rules tell apart, beside the registry's own.
EXTRA = [
    "_ZN4core3ptr13drop_in_place17h0123456789abcdefE", "_ZN3foo3barEv", "_ZN1a$LT$b$GT$", "_RNvCs_7raw_vec4grow", "_RNv9panicking", "_RNv5mutex", "_R5alloc", "_Zdlpv2", "std::rt::begin_panic", "core::panicking::x", "Java_com_x", "JNI_OnLoad", "DllImport.x", "System.Runtime.InteropServices.M",
    "IntPtr.Zero", "emscripten_val_new", "emscripten_run", "__import_a", "__export_b", "wasm_malloc", "wasm_free", "std::make_unique", "std::make_shared", "a::~b", "~c", "__cxa_throw", "runtime.SetFinalizer", "deferfree", "SafeHandle.x", "NewWeakGlobalRef", "Arc::into_raw", "execve", "strcpy", "getenv",
    "sprintf", "fgets", "llvm.memcpy", "pool_create", "pool_destroy", "node_new", "node_free", "raw_vec_grow", "MimallocArena.x", "highway_x", "Bun__f", "recvfrom", "fcntl", "stat", "fork", "abort", "Py_INCREF", "PyLong_FromLong", "PyGILState_Ensure", "",
]
SYMBOLS = [s for s, *_ in D.symbol_rows()] + EXTRA
_SQL_LIST = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in SYMBOLS) + "]"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as calls: caller and callee symbols, family key and order."""
    names = F.array(*map(F.lit, SYMBOLS))
    pick = lambda c: F.element_at(names, ((F.col(c) % len(SYMBOLS)) + 1).cast("int"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pick("l_suppkey").alias("caller"), pick("l_partkey").alias("callee"))


CALLS_SQL = f"""calls AS (SELECT l_orderkey, l_linenumber, list_extract({_SQL_LIST}, CAST(l_suppkey % {len(SYMBOLS)} AS INTEGER) + 1) AS caller,
  list_extract({_SQL_LIST}, CAST(l_partkey % {len(SYMBOLS)} AS INTEGER) + 1) AS callee FROM lineitem)"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as symbols, each several times."""
    return read(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, SYMBOLS)), ((F.col("p_partkey") % len(SYMBOLS)) + 1).cast("int")).alias("name"))


NAMES_SQL = f"names AS (SELECT p_partkey, list_extract({_SQL_LIST}, CAST(p_partkey % {len(SYMBOLS)} AS INTEGER) + 1) AS name FROM part)"


def _register(key: str, column, sql: str) -> None:
    QUERIES[key] = lambda spark, sf_dir: names(spark, sf_dir).select("p_partkey", "name", column(F.col("name")).alias("result"))
    ORACLE[key] = f"WITH {NAMES_SQL} SELECT p_partkey, name, {sql} AS result FROM names"


_register("f1_language", S.language, S.SQL["language"]("name"))
_register("f4_boundary_language", S.boundary_language, S.SQL["boundary_language"]("name"))
_register("f11_syscall", S.syscall, S.SQL["syscall"]("name"))
_register("f13_semantic_kind", S.semantic_kind, S.SQL["semantic_kind"]("name"))
_register("p13_runtime_caller", S.is_runtime_caller, S.SQL["is_runtime_caller"]("name"))
_register("p15_taint_source", S.is_source, S.SQL["is_source"]("name"))
_register("p15_taint_sink", S.is_sink, S.SQL["is_sink"]("name"))
_register("p18_noreturn", S.is_noreturn, "(name IN (" + ", ".join(f"'{n}'" for n in S.NORETURN) + ") OR starts_with(name, 'core::panicking') OR starts_with(name, 'alloc::raw_vec'))")
_register("f7_function_kind", lambda n: S.function_kind(n, F.col("p_partkey") % 2 == 0), f"CASE WHEN {S.SQL['is_libc']('name')} THEN 'LibC' WHEN {S.SQL['is_dangerous']('name')} OR starts_with(name, '__rust_') OR starts_with(name, '_Unwind_') THEN 'ExternalUnknown' WHEN p_partkey % 2 <> 0 THEN 'Internal' ELSE 'ExternalUnknown' END")
_register("f6_inferred_effect", S.inferred_effect, S.SQL["inferred_effect"]("name"))


def f2_module_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", S.module_language(F.col("url")).alias("result"))


QUERIES["f2_module_language"] = f2_module_language
ORACLE["f2_module_language"] = f"SELECT page_id, {S.SQL['module_language']('url')} AS result FROM pages"

PATTERNS = ["*", "Py*", "*free", "*alloc*", "close", "**"]


def p9_glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol against each of a few patterns: the list is fixed, so the patterns are exploded, not joined."""
    rows = names(spark, sf_dir).withColumn("pattern", F.explode(F.array(*map(F.lit, PATTERNS))))
    return rows.filter(S.glob_match(F.col("name"), F.col("pattern"))).select("p_partkey", "pattern")


QUERIES["p9_glob_match"] = p9_glob_match
ORACLE["p9_glob_match"] = f"""WITH {NAMES_SQL} SELECT p_partkey, pattern FROM names, (VALUES ('*'), ('Py*'), ('*free'), ('*alloc*'), ('close'), ('**')) AS v(pattern)
WHERE CASE pattern WHEN '*' THEN true WHEN 'Py*' THEN starts_with(name, 'Py') WHEN '*free' THEN suffix(name, 'free') WHEN '*alloc*' THEN contains(name, 'alloc') WHEN '**' THEN true ELSE name = pattern END"""

_FAM = D.sql_values("fam", "symbol, family, effect", D.symbol_rows())


def j1_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).join(F.broadcast(D.family_symbols(spark)), F.col("callee") == F.col("symbol"), "left").select("l_orderkey", "l_linenumber", "callee", "family", "effect")


QUERIES["j1_registry"] = j1_registry
ORACLE["j1_registry"] = f"WITH {CALLS_SQL}, {_FAM} SELECT l_orderkey, l_linenumber, callee, family, effect FROM calls LEFT JOIN fam ON callee = symbol"

_CON = D.sql_values("con", "function, ctype, ownership", [(f, k, o) for _, k, f, _, o, _ in D.contract_rows()])


def j3_contract_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect of a call by registry first, library contract second."""
    con = D.contracts(spark).select("function", F.col("type").alias("ctype"), "ownership")
    rows = calls(spark, sf_dir).join(F.broadcast(D.family_symbols(spark)), F.col("callee") == F.col("symbol"), "left").join(F.broadcast(con), F.col("callee") == F.col("function"), "left")
    by = F.when(F.col("effect").isNotNull(), "registry").when(F.col("ctype").isNotNull(), "contract").otherwise("none")
    return rows.groupBy("callee", by.alias("origin"), F.coalesce("effect", "ctype").alias("meaning")).agg(F.count(F.lit(1)).alias("n"))


QUERIES["j3_contract_fallback"] = j3_contract_fallback
ORACLE["j3_contract_fallback"] = f"""WITH {CALLS_SQL}, {_FAM}, {_CON} SELECT callee, CASE WHEN effect IS NOT NULL THEN 'registry' WHEN ctype IS NOT NULL THEN 'contract' ELSE 'none' END AS origin,
coalesce(effect, ctype) AS meaning, count(*) AS n FROM calls LEFT JOIN fam ON callee = symbol LEFT JOIN con ON callee = function GROUP BY ALL"""


def a2_function_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-caller counts and flags over annotated calls, in one aggregation."""
    rows = calls(spark, sf_dir).join(F.broadcast(D.family_symbols(spark)), F.col("callee") == F.col("symbol"), "left")
    cross = (S.language(F.col("caller")) != S.language(F.col("callee"))) & (S.language(F.col("caller")) != "Unknown") & (S.language(F.col("callee")) != "Unknown")
    return rows.groupBy("caller").agg(F.count(F.lit(1)).alias("call_count"), F.count_if(F.col("effect") == "Acquire").alias("allocs"), F.count_if(F.col("effect") == "Release").alias("releases"), F.coalesce(F.max(cross), F.lit(False)).alias("has_cross_language"))


QUERIES["a2_function_meta"] = a2_function_meta
_CROSS = "x.lc <> x.le AND x.lc <> 'Unknown' AND x.le <> 'Unknown'"
ORACLE["a2_function_meta"] = f"""WITH {CALLS_SQL}, {_FAM}, x AS (SELECT caller, effect, {S.SQL['language']('caller')} AS lc, {S.SQL['language']('callee')} AS le FROM calls LEFT JOIN fam ON callee = symbol)
SELECT caller, count(*) AS call_count, count(*) FILTER (WHERE effect = 'Acquire') AS allocs, count(*) FILTER (WHERE effect = 'Release') AS releases, bool_or({_CROSS}) AS has_cross_language FROM x GROUP BY caller"""

_COMPAT = D.sql_values("compat", "af, rf", D.compat_rows())


def f21_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often calls of one order acquire in one family and release in another, and whether the two go together."""
    fam = F.broadcast(D.family_symbols(spark))
    rows = calls(spark, sf_dir).join(fam, F.col("callee") == F.col("symbol")).filter("effect in ('Acquire', 'Release')")
    a = rows.filter("effect = 'Acquire'").select("l_orderkey", F.col("family").alias("acquire_family"))
    r = rows.filter("effect = 'Release'").select("l_orderkey", F.col("family").alias("release_family"))
    compat = F.broadcast(D.family_compat(spark).withColumn("compatible", F.lit(True)))
    out = a.join(r, "l_orderkey").groupBy("acquire_family", "release_family").agg(F.count(F.lit(1)).alias("n"))
    return out.join(compat, ["acquire_family", "release_family"], "left").withColumn("compatible", F.coalesce("compatible", F.lit(False)))


QUERIES["f21_compatibility"] = f21_compatibility
ORACLE["f21_compatibility"] = f"""WITH {CALLS_SQL}, {_FAM}, {_COMPAT}, x AS (SELECT l_orderkey, family, effect FROM calls JOIN fam ON callee = symbol),
p AS (SELECT a.family AS acquire_family, r.family AS release_family, count(*) AS n FROM x a JOIN x r ON a.l_orderkey = r.l_orderkey AND a.effect = 'Acquire' AND r.effect = 'Release' GROUP BY ALL)
SELECT p.*, EXISTS (SELECT 1 FROM compat WHERE af = acquire_family AND rf = release_family) AS compatible FROM p"""


def a3_language_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.operators.dedup import majority

    return majority(calls(spark, sf_dir).withColumn("lang", S.language(F.col("callee"))), ["l_orderkey"], "lang")


QUERIES["a3_language_vote"] = a3_language_vote
ORACLE["a3_language_vote"] = f"""WITH {CALLS_SQL}, x AS (SELECT l_orderkey, {S.SQL['language']('callee')} AS lang FROM calls), c AS (SELECT l_orderkey, lang, count(*) AS n FROM x WHERE lang <> 'Unknown' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, lang) AS k FROM c) SELECT l_orderkey, lang AS winner, n AS votes FROM r WHERE k = 1"""
