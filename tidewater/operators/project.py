"""Many modules as one project: which module a call ends up in, which modules depend on which, and which speak one language only.

``functions`` has (module_id, name, is_declaration), ``calls`` (module_id, caller, callee, own columns), as the IR source gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.rules import any_of
from tidewater.functions.symbols import is_intrinsic, language
from tidewater.spark import split_join

# Prefixes of what a language's own runtime is made of, and how many foreign functions make a module mixed.
RUNTIME = {"Rust": ["__rust_", "_ZN4core", "_ZN5alloc"], "C": ["__libc_", "__cxa_", "_Unwind_", "_tlv_"], "Cpp": ["__cxxabiv1", "__cxa_", "__gxx_"]}
FOREIGN_EXTERNS = 3


def symbols(functions: DataFrame) -> DataFrame:
    """(symbol, n_defined, n_declared, defined_in, ambiguous): in how many modules each symbol is defined and declared, and the first
    that defines it; ambiguous if several do. Two aggregations, the first of which makes repeated rows one; null names are no symbols."""
    each = functions.filter("name is not null").groupBy(F.col("name").alias("symbol"), "module_id").agg(F.bool_or(~F.col("is_declaration")).alias("_def"), F.bool_or("is_declaration").alias("_decl"))
    count = lambda what: F.count_if(F.col(what)).alias("n_defined" if what == "_def" else "n_declared")
    return each.groupBy("symbol").agg(count("_def"), count("_decl"), F.min(F.when(F.col("_def"), F.col("module_id"))).alias("defined_in")).withColumn("ambiguous", F.col("n_defined") > 1)


def resolved_calls(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """``calls`` with ``resolution`` and ``target``: Local if the call's own module defines the callee; else Unique with the one module
    that does, Ambiguous if several do, External if none does. Calls without a callee are External.

    One row a call, so a symbol that many modules define and call makes no pairs. Each module's callees are resolved once, and what
    they resolve to goes back to the calls; callees and (module, callee) that hold many rows are split.
    """
    defined = functions.filter("not is_declaration and name is not null").select("module_id", F.col("name").alias("callee"), F.lit(True).alias("_own")).distinct()
    where = defined.groupBy("callee").agg(F.count(F.lit(1)).alias("_n"), F.min("module_id").alias("_in"))
    asked = calls.filter("callee is not null").select("module_id", "callee").distinct().join(defined, ["module_id", "callee"], "left")
    known = split_join(asked, where, ["callee"], "left")
    kind = F.when(F.col("_own"), "Local").when(F.col("_n") == 1, "Unique").when(F.col("_n") > 1, "Ambiguous").otherwise("External")
    known = known.select("module_id", "callee", kind.alias("resolution"), F.when(F.col("_own"), F.col("module_id")).when(F.col("_n") == 1, F.col("_in")).alias("target"))
    return split_join(calls, known, ["module_id", "callee"], "left").withColumn("resolution", F.coalesce("resolution", F.lit("External")))


def dependencies(resolved: DataFrame) -> DataFrame:
    """(module_id, target, n_calls, n_symbols): modules and those that their calls surely end up in, from ``resolved_calls``. Symbols
    are counted over calls already summed up by symbol, so a symbol with very many calls is a number to the second aggregation."""
    by_symbol = resolved.filter("resolution = 'Unique'").groupBy("module_id", "target", "callee").agg(F.count(F.lit(1)).alias("_n"))
    return by_symbol.groupBy("module_id", "target").agg(F.sum("_n").alias("n_calls"), F.count(F.lit(1)).alias("n_symbols"))


def _of_runtime(name: Column, of: str) -> Column:
    return any_of(name, "prefix", RUNTIME[of])


def module_languages(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(module_id, languages, foreign_externs, has_cpp_symbols, is_single_language) for every module with a name.

    Languages are those that callers, callees and functions tell by their names, sorted and joined by commas. A module of one
    language, or of none, is single, unless its one language comes with FOREIGN_EXTERNS declarations of no known language, beside
    intrinsics and the language's own runtime, or with a mangled C++ name of its functions. foreign_externs counts these; it is 0
    where there is no one language to be foreign to.
    """
    c, no = F.col, F.lit(False)
    parts = [functions.select("module_id", "name", c("is_declaration").alias("_decl"), F.lit(True).alias("_func")), *[calls.select("module_id", c(side).alias("name"), no.alias("_decl"), no.alias("_func")) for side in ("caller", "callee")]]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("name is not null")
    names = every.groupBy("module_id", "name").agg(F.bool_or("_decl").alias("_decl"), F.bool_or("_func").alias("_func")).withColumn("_lang", language(c("name")))
    plain = c("_decl") & (c("_lang") == "Unknown") & ~is_intrinsic(c("name"))
    out = names.groupBy("module_id").agg(
        F.array_sort(F.collect_set(F.when(c("_lang") != "Unknown", c("_lang")))).alias("_langs"), F.count_if(plain).alias("_plain"), *[F.count_if(plain & _of_runtime(c("name"), of)).alias(f"_r_{of}") for of in RUNTIME],
        F.bool_or(c("_func") & F.startswith("name", F.lit("_Z"))).alias("has_cpp_symbols"),
    )
    one = F.when(F.size("_langs") == 1, F.element_at("_langs", 1))
    own = F.lit(0)
    for of in RUNTIME:
        own = F.when(one == of, c(f"_r_{of}")).otherwise(own)
    foreign = F.when(one.isNotNull(), c("_plain") - own).otherwise(F.lit(0))
    single = (F.size("_langs") == 0) | (one.isNotNull() & (foreign < FOREIGN_EXTERNS) & ~c("has_cpp_symbols"))
    return out.select("module_id", F.array_join("_langs", ",").alias("languages"), foreign.cast("long").alias("foreign_externs"), "has_cpp_symbols", F.coalesce(single, no).alias("is_single_language"))
