from pyspark.sql import functions as F

from tidewater.operators import confusion
from tidewater.sources import ir


def found(spark, body, size=None):
    rows = spark.createDataFrame([("m", "define void @f(ptr %p, i32 %x) {\n" + "\n".join(body) + "\n}\ndefine void @g() {\n%a = sext i8 %x to i32\n%b = inttoptr i64 %x to ptr\n}")], "module_id string, value string")
    got = confusion.confusions(ir.parse(ir.from_text(rows))["instructions"], F.col("callee") == "free")
    return {(r["func"], r["source_type"], r["target_type"]): (r["kind"], r["boundary_function"], r["confidence"]) for r in got.collect()}


def test_nearness_and_kinds(spark):
    far = ["%v = add i32 %x, 1"] * 5
    got = found(spark, ["%a = sext i32 %x to i64", *far, "call void @free(ptr %p)", *far[:4], "%b = trunc i64 %x to i16", "%c = trunc i32 %x to i24", "%d = bitcast ptr %p to double", "%e = bitcast i32 %x to float"])
    assert got == {
        ("f", "i32", "i64"): ("SignedUnsigned", None, "Medium"), ("f", "i64", "i16"): ("TypeWidth", "free", "High"), ("f", "ptr", "double"): ("UnsafeBitcast", None, "Medium"), ("g", "i64", "ptr"): ("PointerInteger", None, "Low"),
    }


def test_long_function_equals_a_scan(spark):
    import random

    rng = random.Random(5)
    body = [rng.choice(["%a = sitofp i32 %x to double", "call void @free(ptr %p)", "%v = add i32 %x, 1", "ret void", "store i32 %x, ptr %p"]) if i % 90 > 40 else "%v = add i32 %x, 1" for i in range(3000)]
    rows = spark.createDataFrame([("m", "define void @f() {\n" + "\n".join(body) + "\n}")], "module_id string, value string")
    got = {r["inst_idx"] - 2: r["confidence"] for r in confusion.confusions(ir.parse(ir.from_text(rows))["instructions"], F.col("callee") == "free").collect()}
    want = {i: "High" if any("free" in t for t in body[max(0, i - 5) : i + 6]) else "Medium" for i, t in enumerate(body) if "sitofp" in t}
    assert got == want


def test_short_modules_are_dealt_once(spark):
    """d4_confusions and j18_last_stores deal order lines once; the text made from them is neither shuffled again nor joined."""
    from tidewater.plans.catalogue import QUERIES

    for name in ("d4_confusions", "j18_last_stores"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan, name
