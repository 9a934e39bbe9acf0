from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import symbols as S
from tidewater.operators import dedup, gate, graph, lifecycle, matching, scoring
from tidewater.operators import dimensions as D


def test_fifo_equals_a_queue(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    cases = ["RAR", "ARRAR", "AAR", ""] + ["".join(rng.choice(list("ARx"), rng.integers(1, 14))) for _ in range(60)]
    for g, seq in enumerate(cases):
        queue, n, done = deque(), 0, 0
        for i, e in enumerate(seq):
            rows.append((g, i, e))
            if e == "A":
                n += 1
                queue.append(i)
            elif e == "R" and queue:
                done += 1
                want[g, i] = want[g, queue.popleft()] = done
            elif e == "R":
                want[g, i] = None
    out = matching.fifo_match(spark.createDataFrame(rows, "g int, i int, e string"), ["g"], ["i"], F.col("e") == "A", F.col("e") == "R")
    got = {(r["g"], r["i"]): (r["role"], r["match_no"]) for r in out.collect()}
    for (g, i), (role, no) in got.items():
        assert no == want.get((g, i)), (cases[g], i)
        assert role == {"A": "acquire", "x": "other"}.get(cases[g][i], "orphan" if no is None else "release")


def test_zip_pairs_null_keys_and_tails(spark):
    rows = [("c", None, 1, True), ("c", None, 2, False), ("c", "f", 3, True), ("c", "f", 4, True), ("c", "f", 5, False)]
    df = spark.createDataFrame(rows, "c string, f string, i int, a boolean")
    assert sorted(map(tuple, matching.zip_pairs(df, ["c", "f"], ["i"], F.col("a"), "i").collect()), key=repr) == [("c", "f", 1, 3, 5), ("c", None, 1, 1, 2)]
    assert matching.zip_pairs(df, ["c", "f"], ["i"], F.col("a"), "i", "full").count() == 3


def test_every_transition(spark):
    rows, want = [], {}
    path = {"Acquired": [], "Retained": ["Retain"], "Released": ["Release"], "Borrowed": ["Borrow"], "Escaped": ["Escape"], "Transferred": ["Transfer"]}
    for state, before in path.items():
        for event, to in zip(D.EVENTS, D.TRANSITIONS[state]):
            key = f"{state}>{event}"
            rows += [(key, i, e) for i, e in enumerate([*before, event])]
            want[key] = (state, D.ERRORS[to]) if to in D.ERRORS else (to, None)
    got = lifecycle.fold(spark.createDataFrame(rows, "k string, i int, e string"), ["k"], ["i"], "e").collect()
    assert {r["k"]: (r["final_state"], r["first_error"]) for r in got} == want


def test_dedup_conserves_rows(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(int(rng.integers(0, 9)), int(rng.integers(0, 3)), i) for i in range(200)], "k int, s int, seq int")
    out = dedup.dedup_issues(df, ["k"], F.col("s"), F.lit(0), "seq").collect()
    assert len(out) + sum(r["dropped"] for r in out) == 200


def test_components_and_reachability(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(30, 5), (100, 101)], "src int, dst int")
    assert {r["component"] for r in graph.components(edges).collect()} == {1, 100}
    got = graph.reachable(edges, spark.createDataFrame([(1,)], "start int"), 16)
    assert got.count() == 17 and got.agg(F.max("depth")).first()[0] == 16


def test_fixpoint_keeps_boundary_values(spark):
    nodes = spark.createDataFrame([(i, float(i == 3)) for i in range(6)], "node int, value double")
    edges = spark.createDataFrame([(3, 4), (4, 5), (5, 4)], "src int, dst int")
    assert {r["node"]: r["value"] for r in graph.fixpoint(nodes, edges, lambda v: v, F.max, F.greatest).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}


def test_fixpoint_reaches_the_end_of_a_long_path(spark):
    nodes = spark.range(70).select(F.col("id").alias("node"), (F.col("id") == 0).alias("value")).coalesce(1)
    edges = spark.range(69).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).coalesce(1)
    assert graph.fixpoint(nodes, edges, lambda v: v, F.bool_or, lambda a, b: a | b).filter("value").count() == 70
    with pytest.raises(RuntimeError):
        graph.fixpoint(nodes, edges, lambda v: v, F.bool_or, lambda a, b: a | b, rounds=3)


def test_gate_and_reconcile(spark):
    issues = spark.createDataFrame([(1, "NullDereference", "f", "g"), (2, "DoubleFree", "Py", "x")], "issue_id int, issue_kind string, symbol string, caller string")
    facts = spark.createDataFrame([("g", "NullChecked"), ("Py", "Nothing")], "symbol string, kind string")
    assert {r["issue_id"]: r["gate_verdict"] for r in gate.gate(issues, facts, D.gate_rules(spark)).collect()} == {1: "SuppressNullChecked", 2: "Allow"}
    rows = spark.createDataFrame([(1, "r", "WrongRelease", 3), (2, "r", "Leak", 2), (3, "r", "WrongRelease", 3), (4, "q", "Leak", 1)], "i int, k string, f string, v int")
    assert {r["i"]: r["action"] for r in gate.reconcile(rows, ["k"], "f", "v", "i", D.subsumes(spark)).collect()} == {1: "Keep", 2: "Subsumed", 3: "Duplicate", 4: "Keep"}


@pytest.mark.parametrize("name,language", [("_ZN4core3ptrE", "Rust"), ("_ZN3foo3bar17h0123456789abcdefE", "Rust"), ("_ZN3fooE", "Cpp"), ("@\"_R1\"", "Rust"), ("PyList_New", "Python"), ("malloc", "Unknown"), ("", "Unknown")])
def test_language(spark, name, language):
    assert spark.createDataFrame([(name,)], "n string").select(S.language(F.col("n"))).first()[0] == language


def test_scores_stay_in_range(spark):
    df = spark.range(1).select(scoring.confidence(F.lit("x"), F.lit(False), F.lit(False), F.lit(10**9), F.lit(0), F.lit(0)).alias("a"), scoring.risk_add(F.lit(0.95), F.lit(1.0), F.lit(True), F.lit(False), F.lit(99), F.lit(False)).alias("b"))
    assert df.first()["a"] == pytest.approx(0.1) and df.first()["b"] == 1.0


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], timeout=120).returncode == 0
