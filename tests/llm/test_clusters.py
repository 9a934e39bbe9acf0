import hashlib

import numpy as np
import pytest

from tidewater.llm.clusters import Balls, cluster, squared

COLUMNS = "vec_id long, embedding array<double>, cluster string, distance double, v string, n int"


def brute(data, k=40, rounds=5, dim=64):
    rows = [(i, [int(np.floor(256 * x)) for x in v], v) for i, v in data if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    if not rows:
        return []
    key = lambda r: ((r[0] is None, "" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest()), r[2])
    centres = [r[1] for r in sorted(rows, key=key)[:k]]
    x = np.array([r[1] for r in rows], dtype=object)
    for n in range(rounds + 1):
        c = np.array(centres, dtype=object)
        d2 = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        at = [min(range(len(c)), key=lambda j: (row[j], j)) for row in d2]
        if n < rounds:
            for j in set(at):
                mine = [r[1] for r, a in zip(rows, at, strict=True) if a == j]
                centres[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    d = [d2[i, a] for i, a in enumerate(at)]
    within = {j: sum(e for e, a in zip(d, at, strict=True) if a == j) for j in set(at)}
    return sorted(((r[0], a, e, within[a], sum(d), hashlib.sha256(",".join(map(str, centres[a])).encode()).hexdigest()) for r, a, e in zip(rows, at, d, strict=True)), key=repr)


def run(spark, data, **how):
    frame = spark.createDataFrame([(i, v, "x", 0.5, "y", 1) for i, v in data], COLUMNS).repartition(3)
    return sorted((tuple(r) for r in cluster(frame, **how).collect()), key=repr)


def mixture(seed, n, dim=64, around=12, spread=0.3):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(around, dim))[rng.integers(0, around, n)] + spread * rng.normal(size=(n, dim))).tolist()


def test_equals_brute_force(spark):
    data = list(enumerate(mixture(1, 400)))
    assert run(spark, data) == brute(data)


def test_ties_copies_and_unusable_rows(spark):
    corner = [[float(a == i % 3) for a in range(64)] for i in range(9)]  # three places, many equal distances
    data = list(enumerate(corner * 12)) + [(5, corner[0]), (5, corner[0]), (None, corner[1]), (None, None), (7000, [1.0] * 63), (7001, [None] + [1.0] * 63), (7002, [float("nan")] * 64), (7003, [float("inf")] + [0.0] * 63), (7004, [])]
    assert run(spark, data) == brute(data)
    assert run(spark, data, k=3) == brute(data, 3)


def test_few_none_and_one_centroid(spark):
    data = list(enumerate(mixture(2, 7)))
    assert run(spark, data) == brute(data)  # fewer vectors than centroids
    assert run(spark, data, k=1) == brute(data, 1)
    assert run(spark, data, rounds=0) == brute(data, rounds=0)
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []


def test_large_components(spark):
    data = [(i, [x * 200_000 for x in v]) for i, v in enumerate(np.clip(mixture(3, 60), -2, 2).tolist())]
    assert run(spark, data, k=5) == brute(data, 5)
    with pytest.raises(Exception, match="vector 9: a component beyond"):
        run(spark, [(9, [1e9] * 64)])


@pytest.mark.parametrize("seed", range(20))
def test_balls_prune_and_lose_nothing(seed):
    """Bounds carried over moves: the search gives what looking at every centroid gives, ties included, from few distances."""
    rng = np.random.default_rng(seed)
    x = np.floor(8 * np.array(mixture(seed, 600, dim=6, around=30, spread=0.05))).astype(np.int64)
    centres = x[rng.permutation(len(x))[:40]]
    at, upper, lower = Balls(centres).all(x)
    looked = []
    for _ in range(5):
        moved = np.array([x[at == j].sum(axis=0) // max(1, (at == j).sum()) if (at == j).any() else centres[j] for j in range(40)])
        balls = Balls(moved, np.sqrt(((moved - centres) ** 2).sum(axis=1)) * (1 + 1e-9))
        at, upper, lower = balls.search(x, at, upper, lower)
        d2, centres = squared(x, moved), moved
        assert (at == d2.argmin(axis=1)).all()
        own = np.sqrt(d2[np.arange(len(x)), at])
        others = np.where(np.arange(40) == at[:, None], np.inf, np.sqrt(d2)).min(axis=1)
        assert (upper >= own).all() and (lower <= others).all()
        looked.append((2 * own + balls.gap[at])[:, None] >= balls.reach[at])
    assert np.mean(looked[-1]) < 0.6  # a ball holds part of the centroids only
