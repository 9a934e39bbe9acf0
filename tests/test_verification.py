import pytest

from tidewater.operators import verification as V

CANDIDATE = "idx long, kind string, same_resource boolean, reachable_release boolean"
EVIDENCE, FACT = "idx long, kind string, description string", "idx long, kind string, confidence string"
#: kind, strong resource, evidence, facts, verdict
CASES = [
    ("DefiniteLeak", False, [], [], "Confirmed"),
    ("DefiniteLeak", False, [], [("StaticLifetimeSink", "High")], "ExplainedSafe"),
    ("DefiniteLeak", False, [], [("RefcountTransfer", "Medium")], "Probable"),
    ("DefiniteLeak", False, [("PathStateRefinement", None)], [("RefcountTransfer", "Medium")], "Probable"),
    ("DefiniteLeak", True, [("PathStateRefinement", None)], [("RefcountTransfer", "High")], "Confirmed"),
    ("DefiniteLeak", False, [("ReturnToCaller", None)], [], "ExplainedSafe"),
    ("ConditionalLeak", False, [], [("StoredToOwner", "Low")], "ExplainedSafe"),
    ("ConditionalLeak", False, [], [("StoredToOwner", "Medium")], "Probable"),
    ("ConditionalLeak", True, [("OwnershipEscapeLeak", None)], [("StoredToOwner", "High")], "Probable"),
    ("BorrowEscape", False, [("GlobalStore", None)], [("StoredToOwner", "High")], "Probable"),
    ("BorrowEscape", False, [("BridgeHelper", None), ("GlobalStore", None)], [], "ExplainedSafe"),
    ("BorrowEscape", False, [("IrPattern", "heap to global")], [], "Probable"),
    ("BorrowEscape", False, [("IrPattern", None)], [], "ExplainedSafe"),
    ("BorrowEscape", False, [], [], "Probable"),
    ("UseAfterFree", False, [("ReturnToCaller", None)], [("GlobalProvenance", "High")], "Confirmed"),
    ("UseAfterFree", False, [], [("CppDestructor", "Medium"), ("CppDestructor", None)], "Probable"),
    ("UseAfterFree", True, [], [("CppDestructor", "High")], "Confirmed"),
    (None, False, [(None, None)], [(None, "High")], "Probable"),
]


def test_each_rule(spark):
    made = spark.createDataFrame([(i, k, s, True) for i, (k, s, *_) in enumerate(CASES)], CANDIDATE)
    evidence = spark.createDataFrame([(i, *e) for i, case in enumerate(CASES) for e in case[2]], EVIDENCE)
    facts = spark.createDataFrame([(i, *f) for i, case in enumerate(CASES) for f in case[3]], FACT)
    got = {r["idx"]: r["verdict"] for r in V.verified(made, evidence, facts).collect()}
    assert got == {i: case[4] for i, case in enumerate(CASES)}


@pytest.mark.parametrize("issue, reason", [
    (("DefiniteLeak", "rt", "rt_f", True, False, False), "RuntimeSymbol"), (("DefiniteLeak", "rt", "main", True, True, False), None), (("DefiniteLeak", "x", None, False, True, False), "RuntimeCallerLeak"),
    (("DoubleFree", "free", "free", False, True, True), "LibcSymbol"), (("DoubleFree", "free", "main", False, True, True), None), (("DoubleFree", "own", "c_free", False, False, False), "BridgeFunction"), (("NullDereference", "rt", "c_x", True, False, True), None),
])
def test_last_suppressions(spark, issue, reason):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([issue], "kind string, symbol string, function string, r boolean, u boolean, l boolean")
    assert rows.select(V.suppressed(*map(F.col, rows.columns)).alias("x")).first()["x"] == reason
