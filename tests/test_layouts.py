from pyspark.sql import functions as F

from tidewater.operators import layouts


def laid(spark, bodies):
    lines = spark.createDataFrame([("m", f'%"{n}" = type {b}' if " " in n else f"%{n} = type {b}") for n, b in bodies.items()] + [("m", "define void @f() {"), ("m", None), (None, "%A = type { i8 }")], "module_id string, line string")
    return {r["name"]: r for r in layouts.layouts(layouts.definitions(lines).filter("module_id is not null")).collect()}


def test_nested_types(spark):
    got = laid(spark, {
        "A": "{ i8, i32 }", "B": "<{ i8, i32, %A }>", "C": "{ i8, [3 x %A], %\"B x\" }", "B x": "{ double }", "V": "{ i8, <4 x float>, <8 x double> }", "E": "{ }", "P": "{ ptr, %P*, { i8, %Missing }*, i32 (i8*, i64)* }",
        "M": "{ i32, %Missing }", "N": "{ %M, i8 }", "O": "opaque", "Q": "{ %O, i64 }", "D": "{ { i8, { i16, i8 } }, [2 x [3 x { i8, i16 }]], i1 }",
    })
    assert got["B x"]["size"] == 8 and got["C"]["size"] == 40
    sizes = {n: (r["size"], r["align"], r["padding"], r["complete"], r["recursive"]) for n, r in got.items()}
    assert sizes["A"] == (8, 4, 3, True, False)
    assert sizes["B"] == (13, 1, 0, True, False)
    assert sizes["V"] == (96, 16, 15, True, False)
    assert sizes["E"] == (0, 1, 0, True, False)
    assert sizes["P"] == (32, 8, 0, True, False)
    assert sizes["M"] == (4, 4, 0, False, False) and sizes["N"] == (8, 4, 3, False, False)
    assert sizes["O"] == (0, 1, 0, False, False) and sizes["Q"] == (8, 8, 0, False, False)
    assert sizes["D"] == (32, 2, 1, True, False)
    assert [f["text"] for f in got["D"]["fields"]] == ["{i8, {i16, i8}}", "[2 x [3 x {i8, i16}]]", "i1"]
    assert [p["offset"] for p in got["D"]["places"]] == [0, 6, 30]


def test_types_that_hold_themselves(spark):
    got = laid(spark, {"A": "{ i8, %B }", "B": "{ [2 x %A] }", "C": "{ %B }", "L": "{ %L*, i8 }", "S": "{ %S }", "T": "{ i16 }"})
    assert {n: r["recursive"] for n, r in got.items()} == {"A": True, "B": True, "C": True, "L": False, "S": True, "T": False}
    assert got["L"]["size"] == 16 and got["A"]["size"] is None


def test_findings_and_languages(spark):
    lines = spark.createDataFrame([("m", "%A = type { i8, i64, i8 }"), ("m", "%E = type { }"), ("m", "%K = type <{ i8, i32 }>"), ("m", "%W = type { i64, i8 }")], "module_id string, line string")
    found = layouts.layouts(layouts.definitions(lines))
    got = {tuple(r) for r in layouts.findings(found).select("name", "issue", "field", "bytes").collect()}
    assert {("A", "StructPadding", 2, 7), ("A", "FieldOrdering", None, 8), ("A", "ExcessivePadding", None, 14), ("A", "EndiannessIssue", 2, 8), ("E", "EmptyStruct", None, 0), ("K", "EndiannessIssue", 2, 4), ("K", "BitfieldLayoutIssue", 1, 1), ("W", "EndiannessIssue", 1, 8)} == got
    pairs = found.withColumn("x", F.lit("c")).withColumn("y", F.when(F.col("name") == "A", "rust").when(F.col("name") == "E", "c"))
    assert [r["name"] for r in layouts.cross_language(pairs, "x", "y").collect()] == ["A"]


def test_empty_table(spark):
    none = spark.createDataFrame([], "module_id string, name string, body string")
    assert layouts.layouts(none).collect() == [] and layouts.findings(layouts.layouts(none)).collect() == []
