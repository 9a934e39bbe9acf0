"""Queries of projects of many modules. A supplier is a module: its order lines of the last number define a part's symbol, those before
declare one, the first four call one. For languages an order is a module, whose lines name functions in the manner of a language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.symbols import SQL as NAMES_SQL
from tidewater.operators import project
from tidewater.plans.tables import read

QUERIES, ORACLE = {}, {}


def modules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines, c = read(spark, sf_dir, "lineitem"), F.col
    functions = lines.filter("l_linenumber >= 5").select(c("l_suppkey").alias("module_id"), c("l_partkey").alias("name"), (c("l_linenumber") < 7).alias("is_declaration"))
    calls = lines.filter("l_linenumber < 5").select(c("l_suppkey").alias("module_id"), "l_orderkey", "l_linenumber", c("l_partkey").alias("callee"))
    return functions, calls


_SQL = """d AS (SELECT DISTINCT l_suppkey AS m, l_partkey AS s FROM lineitem WHERE l_linenumber = 7),
r AS (SELECT l_suppkey AS m, l_orderkey, l_linenumber, l_partkey AS s, EXISTS (SELECT 1 FROM d WHERE d.m = l_suppkey AND d.s = l_partkey) AS own, (SELECT count(*) FROM d WHERE d.s = l_partkey) AS k, (SELECT min(m) FROM d WHERE d.s = l_partkey) AS one FROM lineitem WHERE l_linenumber < 5),
x AS (SELECT m AS module_id, l_orderkey, l_linenumber, s AS callee, CASE WHEN own THEN 'Local' WHEN k = 0 THEN 'External' WHEN k = 1 THEN 'Unique' ELSE 'Ambiguous' END AS resolution, CASE WHEN own THEN m WHEN k = 1 THEN one END AS target FROM r)"""


def u4_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each symbol of the project is defined and declared (U-4)."""
    return project.symbols(modules(spark, sf_dir)[0])


QUERIES["u4_symbols"] = u4_symbols
ORACLE["u4_symbols"] = """SELECT l_partkey AS symbol, count(DISTINCT l_suppkey) FILTER (WHERE l_linenumber = 7) AS n_defined, count(DISTINCT l_suppkey) FILTER (WHERE l_linenumber < 7) AS n_declared, min(l_suppkey) FILTER (WHERE l_linenumber = 7) AS defined_in,
  count(DISTINCT l_suppkey) FILTER (WHERE l_linenumber = 7) > 1 AS ambiguous FROM lineitem WHERE l_linenumber >= 5 GROUP BY l_partkey"""


def j10_resolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call with the module that it ends up in (J-10)."""
    return project.resolved_calls(*modules(spark, sf_dir))


QUERIES["j10_resolved_calls"] = j10_resolved_calls
ORACLE["j10_resolved_calls"] = f"WITH {_SQL} SELECT * FROM x"


def u4_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules by the modules that they call into (U-4)."""
    return project.dependencies(project.resolved_calls(*modules(spark, sf_dir)))


QUERIES["u4_dependencies"] = u4_dependencies
ORACLE["u4_dependencies"] = f"WITH {_SQL} SELECT module_id, target, count(*) AS n_calls, count(DISTINCT callee) AS n_symbols FROM x WHERE resolution = 'Unique' GROUP BY module_id, target"

#: Beginnings of names: of one language by order, and of none that is known.
OWN = ["_RNv", "__rust_", "Py", "runtime.", "app::", "lib_"]
OTHER = ["lib_", "__cxa_", "llvm.", "c_", "__gxx_", "_Zplain"]


def a4_single_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which modules speak one language only (A-4)."""
    c, at = F.col, lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    head = F.when(c("l_suppkey") % 2 == 0, at(OWN, c("l_orderkey"))).otherwise(at(OTHER, c("l_partkey")))
    lines = read(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("module_id"), "l_returnflag", F.concat(head, c("l_partkey").cast("string")).alias("name"), F.concat(at(OWN, c("l_orderkey")), F.lit("main")).alias("caller"))
    functions = lines.filter("l_returnflag != 'R'").select("module_id", "name", (c("l_returnflag") == "N").alias("is_declaration"))
    return project.module_languages(functions, lines.filter("l_returnflag = 'R'").select("module_id", "caller", c("name").alias("callee")))


_AT = lambda names, k: f"[{', '.join(map(repr, names))}][{k} % {len(names)} + 1]"
_STARTS = lambda of: "(" + " OR ".join(f"starts_with(name, '{p}')" for p in project.RUNTIME[of]) + ")"
QUERIES["a4_single_language"] = a4_single_language
ORACLE["a4_single_language"] = f"""WITH l AS (SELECT l_orderkey AS m, l_returnflag AS f, CASE WHEN l_suppkey % 2 = 0 THEN {_AT(OWN, "l_orderkey")} ELSE {_AT(OTHER, "l_partkey")} END || l_partkey AS name, {_AT(OWN, "l_orderkey")} || 'main' AS caller FROM lineitem),
n AS (SELECT m, name, {NAMES_SQL["language"]("name")} AS lang, bool_or(decl) AS decl, bool_or(func) AS func FROM (SELECT m, name, f = 'N' AS decl, f <> 'R' AS func FROM l UNION ALL SELECT m, caller, FALSE, FALSE FROM l WHERE f = 'R') GROUP BY m, name),
g AS (SELECT m, coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang) FILTER (WHERE lang <> 'Unknown'), '') AS languages, count(DISTINCT lang) FILTER (WHERE lang <> 'Unknown') AS k, bool_or(func AND starts_with(name, '_Z')) AS has_cpp_symbols FROM n GROUP BY m),
e AS (SELECT g.*, CASE WHEN k = 1 THEN (SELECT count(*) FROM n WHERE n.m = g.m AND decl AND lang = 'Unknown' AND NOT starts_with(name, 'llvm.') AND NOT (g.languages = 'Rust' AND {_STARTS("Rust")}) AND NOT (g.languages = 'Cpp' AND {_STARTS("Cpp")})) ELSE 0 END AS foreign_externs FROM g)
SELECT m AS module_id, languages, foreign_externs, has_cpp_symbols, k = 0 OR (k = 1 AND foreign_externs < {project.FOREIGN_EXTERNS} AND NOT has_cpp_symbols) AS is_single_language FROM e"""
