"""Conversions that change what a value means beside calls across a boundary: signs, pointers, floats, widths, bit casts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.spark import carried

FUNC = ["module_id", "func"]
# Widths of types in bits; pointers have 64, others none.
WIDTHS = {"i1": 1, "i8": 8, "i16": 16, "i32": 32, "i64": 64, "i128": 128, "float": 32, "double": 64, "fp128": 128, "ppc_fp128": 128}
FLOATS = ["float", "double", "fp128", "ppc_fp128"]
# Instructions within which a call is near, and the least difference of widths that counts.
NEAR, LEAST_WIDTHS = 5, 16


def is_pointer(kind: Column) -> Column:
    return (kind == "ptr") | F.endswith(kind, F.lit("*"))


def width(kind: Column) -> Column:
    """Width of a type in bits, null if it has none."""
    known = F.create_map(*[F.lit(x) for kv in WIDTHS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, kind), F.when(is_pointer(kind), 64))


def converted(opcode: str, raw: str) -> tuple[Column, Column]:
    """Source and target type of a conversion's text, null where it has none: the words after the opcode's flags and after ``to``."""
    word = lambda pattern: F.nullif(F.regexp_extract(raw, pattern, 1), F.lit(""))
    source = word(rf"(?:^|\s){opcode}\s+(?:(?:nneg|nuw|nsw|fast|nnan|ninf|nsz|arcp|contract|afn|reassoc)\s+)*(\S+)")
    return source, F.regexp_replace(word(r"\sto\s+(\S+)"), r"[,)\]]+$", "")


def conversions(instructions: DataFrame, *more: str) -> DataFrame:
    """(module_id, func, inst_idx, opcode, source_type, target_type, more) of instructions that are conversions with both types in their text."""
    source, target = converted("(?:trunc|zext|sext|fptrunc|fpext|fptoui|fptosi|uitofp|sitofp|ptrtoint|inttoptr|bitcast|addrspacecast)", "raw_text")
    found = instructions.filter("kind = 'Conversion'").select(*FUNC, "inst_idx", *more, "opcode", source.alias("source_type"), target.alias("target_type"))
    return found.filter("source_type is not null and target_type is not null and target_type != ''")


def _near(numbered: DataFrame, is_boundary: Column, near: int) -> DataFrame:
    """Conversions with the first boundary call near them, and whether their function has any."""
    calls = numbered.filter(F.col("kind").isin("Call", "IndirectCall") & F.coalesce(is_boundary, F.lit(False))).select(*FUNC, "callee", "_at")
    around = calls.select(*FUNC, F.struct("_at", "callee").alias("_call"), F.explode(F.sequence(F.col("_at") - near, F.col("_at") + near)).alias("_at"))
    first = around.groupBy(*FUNC, "_at").agg(F.min("_call").alias("_call"))
    some = calls.select(*FUNC, F.lit(True).alias("_some")).distinct()
    return conversions(numbered, "_at").join(first, [*FUNC, "_at"], "left").join(some, FUNC, "left").withColumn("_some", F.coalesce("_some", F.lit(False)))


def confusions(instructions: DataFrame, is_boundary: Column, near: int = NEAR, short: bool = False) -> DataFrame:
    """(module_id, func, inst_idx, kind, source_type, target_type, boundary_function, confidence); ``is_boundary`` tells of a call's ``callee``
    whether it crosses a boundary.

    A conversion has the first kind that fits: sign extensions and widenings SignedUnsigned, PointerInteger, FloatInteger,
    TypeWidth for truncations of 16 bits or more, UnsafeBitcast between a pointer and another type. Signs and widths count only in
    functions with a boundary call. Confidence is High with such a call within ``near`` instructions, of several the first is named;
    Medium with one anywhere in the function; else Low. Instructions are numbered over stretches of each function and calls meet
    conversions by number, so a long function is no one task and no pairs of calls and conversions arise beyond ``near``. Where the
    caller knows all functions to be ``short``, each is one window and nothing is joined.
    """
    numbered = carried(instructions.filter("func is not null").select(*FUNC, "inst_idx", "kind", "opcode", "callee", "raw_text"), FUNC, "inst_idx", {}, "_at", short=short)
    boundary = F.when(F.col("kind").isin("Call", "IndirectCall") & F.coalesce(is_boundary, F.lit(False)), F.struct("_at", "callee"))
    whole = Window.partitionBy(*FUNC)
    met = conversions(numbered.withColumns({"_call": F.min(boundary).over(whole.orderBy("_at").rangeBetween(-near, near)), "_some": F.count(boundary).over(whole) > 0}), "_at", "_call", "_some") if short else _near(numbered, is_boundary, near)
    s, t, op = F.col("source_type"), F.col("target_type"), F.col("opcode")
    extends, floats = op.isin("sext", "zext"), op.isin("sitofp", "uitofp", "fptosi", "fptoui")
    kind = (
        F.when(extends & F.col("_some"), "SignedUnsigned")
        .when(op.isin("inttoptr", "ptrtoint"), "PointerInteger")
        .when(floats & (s.isin(FLOATS) != t.isin(FLOATS)), "FloatInteger")
        .when((op == "trunc") & F.col("_some") & (F.abs(width(s) - width(t)) >= LEAST_WIDTHS), "TypeWidth")
        .when((op == "bitcast") & ((is_pointer(s) != is_pointer(t)) | (is_pointer(s) & is_pointer(t) & (s != t))), "UnsafeBitcast")
    )
    sure = F.when(F.col("_call").isNotNull(), "High").when(F.col("_some"), "Medium").otherwise("Low")
    return met.select(*FUNC, "inst_idx", kind.alias("kind"), "source_type", "target_type", F.col("_call.callee").alias("boundary_function"), sure.alias("confidence")).filter("kind is not null")
