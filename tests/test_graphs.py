import random

import numpy as np

from tidewater.operators import graph
from tidewater.plans.catalogue import QUERIES


def reach(starts, out, depth):
    found = {}
    for s in starts:
        seen, now = {s: 0}, {s}
        for d in range(1, depth + 1):
            now = {y for x in now for y in out.get(x, ())} - seen.keys()
            seen |= dict.fromkeys(now, d)
        found |= {(s, x): d for x, d in seen.items()}
    return found


def test_whole_queries_equal_brute_force(spark, tmp_path):
    rng = np.random.default_rng(2)
    n = 60
    money = {i: float(rng.integers(-999, 9999)) for i in range(1, n + 1)}
    money |= {1: 9500.0, 2: 9600.0}
    orders = [(i, i, "5-LOW", "F") for i in range(1, n)]  # a path 1, 2, ... n
    orders += [(n + int(k), int(c), p, "O") for k, c, p in zip(rng.integers(1, 500, 12), rng.integers(1, n + 1, 12), ["1-URGENT", "3-MEDIUM"] * 6, strict=True)]
    spark.createDataFrame([(i, v, f"S{i % 7}") for i, v in money.items()], "c_custkey long, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    edges = {(c, k % n + 1) for k, c, *_ in orders}
    out, back = {}, {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        back.setdefault(b, set()).add(a)
    rich = [i for i, v in money.items() if v > 9000]
    rows = lambda name: [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]

    want = reach(rich, out, 16)
    assert max(want.values()) > 4
    assert {(s, x): d for s, x, d in rows("g6_reachable")} == want
    assert {x for x, v in rows("g2_backward_fixpoint") if v} == {x for _, x in reach(rich, back, n)}
    closure = reach(money, back, n)
    assert dict(rows("g1_forward_fixpoint")) == {i: max(money[y] for x, y in closure if x == i) for i in money}
    near = {}
    for (_, x), d in [*reach(rich, out, 2).items(), *reach(rich, back, 2).items()]:
        near[x] = min(d, near.get(x, d))
    assert {x: d for x, d, _ in rows("g5_slice")} == near
    known = {i for i, v in money.items() if v > 0}
    both = {(x, y) for a, b in edges for x, y in ((a, b), (b, a)) if {x, y} <= known} | {(x, x) for x in known}
    assert set(rows("g12_one_step")) == {(x, f"S{y % 7}") for x, y in both}


def test_sites_near_a_landmark_do_not_travel(spark, monkeypatch):
    """Sites that every node before the landmark surely reaches are counted without bits; what lies apart, too far or never comes to the
    landmark is followed, with the counts of a search from every node."""
    rng = random.Random(3)
    dense = {(a, rng.randrange(40)) for a in range(40) for _ in range(4)}
    apart = {(50, 51), (51, 3), (3, 60), (60, 61), (61, 60), (70, 71)}
    chain = {(39, 100), *((100 + i, 101 + i) for i in range(3))}
    sites = [(n % 3, n) for n in [*range(0, 40, 2), 51, 61, 71, 80, 102, 103]]
    followed = []
    travel = graph._travelled
    monkeypatch.setattr(graph, "_travelled", lambda e, s, d: followed.append(s.count()) or travel(e, s, d))
    for pairs, depth, all_followed in ((dense | apart | chain, 8, False), (dense | apart | chain, 6, True)):
        e = spark.createDataFrame(sorted(pairs), "src long, dst long")
        followed.clear()
        got = {(r["node"], r["family"]): r["n_sites"] for r in graph.reachable_sites(e, spark.createDataFrame(sites, "family long, node long"), depth).collect()}
        want: dict = {}
        for start in {x for p in pairs for x in p} | {n for _, n in sites}:
            seen = fresh = {start}
            for _ in range(depth):
                fresh = {b for a, b in pairs if a in fresh} - seen
                seen = seen | fresh
            for family, n in sites:
                if n in seen:
                    want[start, family] = want.get((start, family), 0) + 1
        assert got == want
        assert (sum(followed) == len(sites)) == all_followed
