"""Query of confusing conversions: an order is a module with one function, each of its lines gives three instructions whose forms its
numbers choose, parsed from text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import confusion
from tidewater.plans import behaviour
from tidewater.sources import ir
from tidewater.spark import CHUNK

QUERIES, ORACLE = {}, {}
#: Text, the kind it may have, source and target type, whether it needs a boundary call in the function.
FORMS = [
    ("%v0 = sext i32 %x to i64", "SignedUnsigned", "i32", "i64", True), ("%v0 = zext nneg i8 %x to i16", "SignedUnsigned", "i8", "i16", True), ("%v0 = trunc i64 %x to i32", "TypeWidth", "i64", "i32", True), ("%v0 = trunc nuw i16 %x to i8", None, "i16", "i8", True),
    ("%v0 = inttoptr i64 %x to ptr", "PointerInteger", "i64", "ptr", False), ("%v0 = ptrtoint ptr %p to i32, !dbg !4", "PointerInteger", "ptr", "i32", False), ("%v0 = sitofp i32 %x to double", "FloatInteger", "i32", "double", False), ("%v0 = fptoui float %x to i8", "FloatInteger", "float", "i8", False),
    ("%v0 = bitcast ptr %p to i64", "UnsafeBitcast", "ptr", "i64", False), ("%v0 = bitcast i64 %x to double", None, "i64", "double", False), ("%v0 = bitcast i8* %p to i32*", "UnsafeBitcast", "i8*", "i32*", False), ("%v0 = bitcast ptr %p to ptr", None, "ptr", "ptr", False),
    ("%v0 = fpext float %x to double", None, "float", "double", False), ("%v0 = add i32 %x, 1", None, None, None, False), ("store i32 %x, ptr %p", None, None, None, False), ("%v0 = call ptr @malloc(i64 8)", None, None, None, False), ("call void @own()", None, None, None, False),
    ("%v0 = load i32, ptr %p", None, None, None, False), ("call void @free(ptr %p)", None, None, None, False), ("%v0 = trunc i128 %x to i64", "TypeWidth", "i128", "i64", True), ("%v0 = mul i32 %x, %x", None, None, None, False), ("call void %fp(ptr %p)", None, None, None, False), ("br label %x", None, None, None, False),
]
CALLS = {i: name for i, (text, *_) in enumerate(FORMS) for name in ("malloc", "free") if f"@{name}(" in text}


def d4_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusing conversions with their nearness to calls of the C library (D-4, F-31)."""
    a, b, r, k = F.col("a"), F.col("b"), F.col("r"), len(FORMS)
    short = 3 * behaviour.longest(spark, sf_dir) + 2 <= CHUNK
    line = lambda at, form, raw=None: F.struct(at.cast("int").alias("line_no"), form.cast("int").alias("k"), F.lit(raw).cast("string").alias("raw"))
    three = [line(3 * r - 2 + i, at % k) for i, at in enumerate((a, F.floor(a / k) + b, a + 7 * b))]
    head, foot = F.when(r == 1, line(F.lit(0), F.lit(None), "define void @f(ptr %p, i32 %x) {")), F.when(r == F.col("c"), line(3 * r + 1, F.lit(None), "}"))
    made = behaviour.owned(spark, sf_dir).select("module_id", F.explode(F.array(head, *three, foot)).alias("i")).filter("i is not null").select("module_id", "i.*")
    body = made.select("module_id", "line_no", F.coalesce("raw", F.element_at(F.array(*[F.lit(t) for t, *_ in FORMS]), F.col("k") + 1)).alias("raw"))
    lines = body.select("module_id", "line_no", ir.without_comment("raw").alias("line"), "raw")
    found = confusion.confusions(ir.parse(lines, short)["instructions"], F.col("callee").isin(*CALLS.values()), short=short)
    return found.select("module_id", (F.col("inst_idx") - 1).cast("long").alias("place"), "kind", "source_type", "target_type", "boundary_function", "confidence")


QUERIES["d4_confusions"] = d4_confusions
_TEXT = lambda v: "NULL" if v is None else f"'{v}'"
_FORMS = ", ".join(f"({i}, {_TEXT(kind)}, {_TEXT(s)}, {_TEXT(t)}, {need}, {_TEXT(CALLS.get(i))})" for i, (_, kind, s, t, need) in enumerate(FORMS))
ORACLE["d4_confusions"] = f"""WITH form(k, kind, s, t, need, callee) AS (VALUES {_FORMS}), own AS (SELECT l_orderkey AS h, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r, l_partkey AS a, l_suppkey AS b FROM lineitem),
i AS (SELECT h, 3 * r - 2 AS n, a % {len(FORMS)} AS k FROM own UNION ALL SELECT h, 3 * r - 1, (a // {len(FORMS)} + b) % {len(FORMS)} FROM own UNION ALL SELECT h, 3 * r, (a + 7 * b) % {len(FORMS)} FROM own),
j AS MATERIALIZED (SELECT h, n, form.* FROM i JOIN form USING (k)), c AS (SELECT h, n, callee FROM j WHERE callee IS NOT NULL), m AS (SELECT h, list(n ORDER BY n) AS ns, list(callee ORDER BY n) AS names FROM c GROUP BY h),
x AS (SELECT j.h, j.n, j.kind, s, t, need, ns IS NOT NULL AS met, list_filter(list_zip(ns, names), lambda z: abs(z[1] - j.n) <= 5) AS near FROM j LEFT JOIN m ON j.h = m.h WHERE j.kind IS NOT NULL)
SELECT 'm' || h AS module_id, CAST(n AS BIGINT) AS place, kind, s AS source_type, t AS target_type, near[1][2] AS boundary_function, CASE WHEN len(near) > 0 THEN 'High' WHEN met THEN 'Medium' ELSE 'Low' END AS confidence FROM x WHERE met OR NOT need"""
