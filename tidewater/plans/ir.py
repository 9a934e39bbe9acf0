"""Queries of the IR source and the instruction detectors. Each order is a function of textual IR and each of its lines an instruction;
the oracle says what the parser has to find without any text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators import detectors
from tidewater.plans.tables import read
from tidewater.sources import ir

QUERIES, ORACLE = {}, {}

#: Instruction by part key: text with %0 for the line's number and %1 for the supplier's, then kind, opcode, register made, and
#: comparison that the parser must find.
INSTRUCTIONS = [
    ("%v%0 = call ptr @ext%1(ptr %a, i64 %1), !dbg !%0", "Call", "call", True, None),
    ("%v%0 = trunc i64 %n to i32", "Conversion", "trunc", True, None),
    ("%v%0 = icmp eq i32 %o, %1", "ICmp", "icmp", True, "eq"),
    ("store ptr %p, ptr %s", "Store", "store", False, None),
    ("%v%0 = load ptr, ptr %s ; from the slot", "Load", "load", True, None),
    ("%v%0 = add i64 %n, 16", "BinaryOp", "add", True, None),
    ("call void @abort()", "Call", "call", False, None),
    ("unreachable", "Other", "unreachable", False, None),
    ("%v%0 = trunc i64 %n to i1", "Conversion", "trunc", True, None),
    ("ret void", "Ret", "ret", False, None),
    ("%v%0 = atomicrmw sub ptr %p, i32 1 seq_cst", "AtomicRmw", "atomicrmw", True, None),
    ("br i1 %c, label %x, label %y", "Br", "br", False, None),
    ("%v%0 = getelementptr i8, ptr %p, i64 4", "GetElementPtr", "getelementptr", True, None),
]


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One module for each order: a declaration of two functions, a definition, its instructions and the closing brace."""
    lines = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("m"), "l_orderkey").alias("module_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("line_no"), (F.col("l_partkey") % len(INSTRUCTIONS)).cast("int").alias("k"), (F.col("l_suppkey") % 50).alias("s"))
    text = F.element_at(F.array(*[F.lit(t) for t, *_ in INSTRUCTIONS]), F.col("k") + 1)
    body = lines.select("module_id", "line_no", F.replace(F.replace(text, F.lit("%0"), F.col("line_no").cast("string")), F.lit("%1"), F.col("s").cast("string")).alias("raw"))
    modules = lines.select("module_id").distinct()
    head = F.concat(F.lit("define void @fn"), F.substring("module_id", 2, 20), F.lit("(ptr %a, i64 %n) {"))
    fixed = [(-4, F.lit('target triple = "x86_64-unknown-linux-gnu"')), (-3, F.lit("declare ptr @ext7(ptr, i64)")), (-2, F.lit("declare void @abort()")), (-1, head), (1000, F.lit("}"))]
    frame = modules.select("module_id", F.explode(F.array(*[F.struct(F.lit(n).alias("line_no"), raw.alias("raw")) for n, raw in fixed])).alias("x")).select("module_id", "x.*")
    every = frame.unionByName(body)
    return every.select("module_id", "line_no", F.trim(F.regexp_replace("raw", r"\s*;.*$", "")).alias("line"), "raw")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return ir.parse(rows(spark, sf_dir))


def _quoted(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'"


#: The same instructions as rows; the first of a function is the fifth line of its module.
SQL = f"""d(k, kind, opcode, makes, pred) AS (VALUES {", ".join(f"({i}, " + ", ".join(_quoted(v) for v in x[1:]) + ")" for i, x in enumerate(INSTRUCTIONS))}),
l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
i AS (SELECT 'm' || l_orderkey AS module_id, 'fn' || l_orderkey AS func, n + 4 AS inst_idx, n, l_suppkey % 50 AS s, kind, opcode, pred, CASE WHEN makes THEN '%v' || n END AS dest, k
  FROM l JOIN d ON l_partkey % {len(INSTRUCTIONS)} = k)"""


def s8_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables(spark, sf_dir)["instructions"]
    return found.select("module_id", "func", F.col("inst_idx").cast("long").alias("inst_idx"), "kind", "opcode", "dest", "icmp_pred")


QUERIES["s8_instructions"] = s8_instructions
ORACLE["s8_instructions"] = f"WITH {SQL} SELECT module_id, func, inst_idx, kind, opcode, dest, pred AS icmp_pred FROM i"


def s7_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with their arguments and place, and whether the module declares the callee (S-7, S-10)."""
    found = tables(spark, sf_dir)["calls"]
    return found.select("module_id", "caller", "callee", "result", F.size("args").cast("long").alias("n_args"), "dbg", "is_external")


QUERIES["s7_calls"] = s7_calls
ORACLE["s7_calls"] = f"""WITH {SQL} SELECT module_id, func AS caller, CASE WHEN k = 0 THEN 'ext' || s ELSE 'abort' END AS callee, dest AS result, CASE WHEN k = 0 THEN 2 ELSE 0 END AS n_args, CASE WHEN k = 0 THEN CAST(n AS VARCHAR) END AS dbg, k = 6 OR s = 7 AS is_external
FROM i WHERE k IN (0, 6)"""


def s6_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["functions"].select("module_id", "name", "is_declaration", F.size("params").cast("long").alias("n_params"), "return_type")


QUERIES["s6_functions"] = s6_functions
ORACLE["s6_functions"] = """WITH o AS (SELECT DISTINCT l_orderkey AS o FROM lineitem) SELECT 'm' || o AS module_id, 'fn' || o AS name, FALSE AS is_declaration, 2 AS n_params, 'void' AS return_type FROM o
UNION ALL SELECT 'm' || o, 'ext7', TRUE, 2, 'ptr' FROM o UNION ALL SELECT 'm' || o, 'abort', TRUE, 0, 'void' FROM o"""


def s11_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["modules"].select("module_id", "target_triple", "pointer_size", "little_endian")


QUERIES["s11_modules"] = s11_modules
ORACLE["s11_modules"] = "SELECT DISTINCT 'm' || l_orderkey AS module_id, 'x86_64-unknown-linux-gnu' AS target_triple, 8 AS pointer_size, TRUE AS little_endian FROM lineitem"


def d22_termination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.termination(tables(spark, sf_dir)["instructions"])


QUERIES["d22_termination"] = d22_termination
ORACLE["d22_termination"] = f"""WITH {SQL} SELECT module_id, func, CASE WHEN bool_or(kind = 'Ret') THEN 'HasNormalReturn' WHEN bool_or(k IN (6, 7)) THEN 'OnlyAborts' ELSE 'Unknown' END AS termination, bool_or(k IN (6, 7)) AS has_abort_exit FROM i GROUP BY module_id, func"""


def d5_truncations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables(spark, sf_dir)
    calls = found["calls"].filter("is_external and callee != 'abort'").select("module_id", F.col("caller").alias("func"), "call_idx")
    return detectors.truncations(found["instructions"], calls, 2).select("module_id", F.col("inst_idx").cast("long").alias("inst_idx"), "register", "source_bits", "target_bits", "confidence")


QUERIES["d5_truncations"] = d5_truncations
ORACLE["d5_truncations"] = f"""WITH {SQL}, c AS (SELECT module_id, inst_idx FROM i WHERE k = 0 AND s = 7) SELECT t.module_id, t.inst_idx, '%n' AS register, 64 AS source_bits, 32 AS target_bits,
  CASE WHEN min(abs(c.inst_idx - t.inst_idx)) <= 2 THEN 'High' WHEN count(c.inst_idx) > 0 THEN 'Medium' ELSE 'Low' END AS confidence FROM i t LEFT JOIN c ON t.module_id = c.module_id WHERE t.k = 1 GROUP BY t.module_id, t.inst_idx"""


def d22_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.kind_counts(tables(spark, sf_dir)["instructions"], ["Load", "Store", "Call"])


QUERIES["p6_parsed_kinds"] = d22_kind_counts
ORACLE["p6_parsed_kinds"] = f"WITH {SQL} SELECT module_id, func, count(*) FILTER (WHERE kind = 'Load') AS n_load, count(*) FILTER (WHERE kind = 'Store') AS n_store, count(*) FILTER (WHERE kind = 'Call') AS n_call FROM i GROUP BY module_id, func"
