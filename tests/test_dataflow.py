import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import dataflow, detectors, lifetime
from tidewater.operators.graph import Domain, flow
from tidewater.sources import ir

LOOP = """
define void @loop(ptr %p, i64 %n) {
entry:
  %s = alloca i64
  store i64 0, ptr %s
  br label %head
head:
  %i = phi i64 [ 0, %entry ], [ %j, %body ]
  %c = icmp ult i64 %i, %n
  br i1 %c, label %body, label %done
body:
  %j = add i64 %i, 1
  store i64 %j, ptr %s
  store ptr %p, ptr @g
  br label %head
done:
  ret void
dead:
  br label %done
}
"""


@pytest.fixture(scope="module")
def loop(spark):
    found = ir.parse(ir.from_text(spark.createDataFrame([("m", LOOP)], "module_id string, value string")))
    return found["instructions"], found["cfg_edges"]


def by_block(df, what):
    out = {}
    for r in df.collect():
        out.setdefault(r["block"], set()).add(r[what])
    return out


def test_liveness_and_definite_assignment(loop):
    assert by_block(dataflow.live_registers(*loop), "register") == {"entry": {"%p", "%n", "%j"}, "head": {"%p", "%n", "%s", "%j"}, "body": {"%p", "%n", "%s", "%i"}}
    assert by_block(dataflow.assigned_slots(*loop), "address") == {"head": {"%s"}, "body": {"%s"}, "done": {"%s"}, "dead": {"%s", "@g"}}


def test_reaching_stores(loop):
    rows = loop[0].filter("kind = 'Store'").collect()
    text = {r["inst_idx"]: r["raw_text"] for r in rows}
    got = {b: {text[i] for i in s} for b, s in by_block(dataflow.reaching_definitions(*loop), "inst_idx").items()}
    every = {"store i64 0, ptr %s", "store i64 %j, ptr %s", "store ptr %p, ptr @g"}
    assert got == {"head": every, "body": every, "done": every}


def test_short_functions_are_solved_as_long_ones(spark):
    """Functions as one row give what bitsets in rounds give, also where some are long and others short, on random flow."""
    rng = random.Random(5)
    text = []
    for m in range(5):
        n = 2 + m
        body = "".join(f"b{i}:\n" + "".join(rng.choice([f"store ptr %v{rng.randrange(4)}, ptr @g{rng.randrange(3)}\n", f"%v{rng.randrange(4)} = load ptr, ptr %v{rng.randrange(4)}\n"]) for _ in range(1 + rng.randrange(5))) + f"br i1 %c, label %b{rng.randrange(n + 1)}, label %b{rng.randrange(n)}\n" for i in range(n))
        text.append((f"m{m}", f"define void @f(ptr %p) {{\n{body}}}\n"))
    found = ir.parse(ir.from_text(spark.createDataFrame(text, "module_id string, value string")))
    rows, edges = found["instructions"].cache(), found["cfg_edges"].cache()
    inside = rows.withColumn("successors", ir.successors(F.col("opcode"), F.col("raw_text")))
    for solve in (dataflow.live_registers, dataflow.reaching_definitions, dataflow.assigned_slots):
        want = sorted(map(tuple, solve(rows, edges, most=0).collect()))
        assert len(want) > 20
        for got in (solve(rows, edges), solve(inside, None, True), solve(inside, None, most=18)):
            assert sorted(map(tuple, got.collect())) == want


def test_short_modules_are_not_shuffled_twice(spark):
    """Where every module is short, its text stays where its lines were numbered: one exchange, and no join with other stretches."""
    from tidewater.plans import behaviour

    df = behaviour.instructions(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_own_lattice(spark):
    """Longest distance from the beginning, capped at 9 as the greatest element: a join of maxima with a transfer of the user's."""
    nodes = spark.createDataFrame([("f", n, n == "a", w) for n, w in (("a", 1), ("b", 2), ("c", 3), ("d", 1))], "func string, node string, begins boolean, weight long")
    edges = spark.createDataFrame([("f", "a", "b"), ("f", "a", "c"), ("f", "b", "d"), ("f", "c", "c")], "func string, src string, dst string")
    longest = Domain(F.lit(0).cast("long"), F.lit(-1).cast("long"), F.max, F.greatest, lambda v: F.when(v < 0, v).otherwise(F.least(v + F.col("weight"), F.lit(9).cast("long"))))
    assert {r["node"]: (r["before"], r["after"]) for r in flow(longest, nodes, edges, ["func"]).collect()} == {"a": (0, 1), "b": (1, 3), "c": (9, 9), "d": (3, 4)}
    with pytest.raises(RuntimeError, match="no fixpoint after 2 rounds"):
        flow(longest, nodes, edges, ["func"], rounds=2)


def test_roots_equal_a_tracer_on_random_functions(spark):
    """Cyclic definitions and slots: the closure against a depth-first tracer."""
    rng, rows, want = random.Random(5), [], set()
    for f in range(60):
        names = [f"%v{i}" for i in range(8)]
        pool = [*names, "%p", "@g"]
        made, loads, stored = {}, {}, {}
        for i in range(14):
            kind, dest = rng.choice(["GetElementPtr", "Conversion", "Phi", "Select", "Load", "Store", "Alloca", "Call"]), None
            ops = {"GetElementPtr": [rng.choice(pool), "4"], "Conversion": [rng.choice(pool)], "Phi": rng.sample(pool, 2), "Select": ["%c", *rng.sample([*pool, "null"], 2)], "Load": [rng.choice(pool)], "Store": [rng.choice([*pool, "null"]), rng.choice(pool)], "Alloca": [], "Call": [rng.choice(pool)]}[kind]
            if kind != "Store":
                if not names:
                    continue
                dest = names.pop(rng.randrange(len(names)))
            rows.append(("m", f"f{f}", i, kind, dest, ops))
            if kind == "Store":
                stored.setdefault(ops[1], set()).add(ops[0])
            elif kind == "Load":
                loads[dest] = ops[0]
            elif kind in ("GetElementPtr", "Conversion", "Phi"):
                made[dest] = ops[:1] if kind == "GetElementPtr" else ops
            elif kind == "Select":
                made[dest] = [o for o in ops[1:] if o != "null"]
        mine = {x for r in rows if r[1] == f"f{f}" for x in [r[4], *r[5]] if x and x[0] in "%@"}
        for name in mine:
            seen, todo = set(), [name]
            while todo:
                x = todo.pop()
                if x in seen:
                    continue
                seen.add(x)
                if x in loads:
                    want.add((f"f{f}", name, loads[x]))
                    todo += [v for v in stored.get(loads[x], ()) if v != "null"]
                elif x in made:
                    todo += made[x]
                else:
                    want.add((f"f{f}", name, x))
    frame = spark.createDataFrame(rows, "module_id string, func string, inst_idx int, kind string, dest string, operands array<string>")
    assert {(r["func"], r["register"], r["root"]) for r in detectors.roots(frame).collect()} == want


def test_a_carried_stream_is_the_same_in_stretches(spark):
    from tidewater.spark import carried

    rows = [("a", i, i if i % 7 == 3 else None) for i in range(0, 60, 2)] + [("b", 5, None), (None, 1, 1), (None, 30, None)]
    frame = spark.createDataFrame(rows, "k string, at int, v int")
    for size in (4, 1000):
        got = {(r["k"], r["at"]): (r["last"], r["no"]) for r in carried(frame, ["k"], "at", {"last": F.col("v")}, "no", size).collect()}
        want = {}
        for key in ("a", "b", None):
            last = None
            for no, (_, at, v) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1]), 1):
                last = v if v is not None else last
                want[(key, at)] = (last, no)
        assert got == want


def test_lifetimes(spark):
    created = spark.createDataFrame([(1, "make"), (2, "make"), (3, "other")], "resource long, func string")
    events = spark.createDataFrame([(1, "make", 1, False), (1, "drop", 2, True), (1, "use", 3, False), (1, "drop", 4, False), (2, "make", 1, False), (9, "make", 1, True)], "resource long, func string, seq long, is_release boolean")
    calls = spark.createDataFrame([("make", "helper"), ("helper", "deep"), ("use", "lost"), ("deep", "make")], "caller string, callee string")
    assert {tuple(r) for r in lifetime.violations(created, events).collect()} == {(1, "UseAfterFree", "use", 3), (2, "ResourceLeak", "make", None), (3, "ResourceLeak", "other", None)}
    assert {tuple(r) for r in lifetime.accessible(created, events.drop("is_release"), calls).collect()} == {(1, f) for f in ("make", "drop", "use", "helper", "deep")} | {(2, f) for f in ("make", "helper", "deep")}
    kept = spark.createDataFrame([(3, "other")], "resource long, func string")
    assert {tuple(r) for r in lifetime.fates(created, events, calls, kept).collect()} == {(1, "Released", "drop", None), (2, "Escaped", None, 3), (3, "GlobalState", "other", None)}
