import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm.neighbours import BLOCK_ROWS, SHORTLIST, _assign, _split, fit, nearest


def exact(data, is_query, k):
    """Brute force over every usable row of the most frequent length."""
    rows = [(i, np.array(v, dtype=float)) for i, v in data if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    if not rows:
        return []
    lengths = [len(v) for _, v in rows]
    dim = max(set(lengths), key=lambda d: (lengths.count(d), d))
    rows = [(i, v) for i, v in rows if len(v) == dim]
    out = []
    for q, v in rows:
        if is_query(q):
            found = sorted((-float((w * v).sum()), i) for i, w in rows if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, data, k=20, shortlist=SHORTLIST):
    frame = spark.createDataFrame([(i, v, 1.0, 2, "x") for i, v in data], "vec_id long, embedding array<double>, score double, rank int, cell string").repartition(3)
    return sorted(map(tuple, nearest(frame, F.col("vec_id") % 20 == 0, k, shortlist).collect()))


def clustered(rng, n, dim=64, around=40):
    x = rng.normal(size=(around, dim))[rng.integers(0, around, n)] + 0.8 * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_few_rows_are_exact(spark):
    data = [(i, v.tolist()) for i, v in enumerate(clustered(np.random.default_rng(1), 300, 16))]
    got, want = run(spark, data), exact(data, lambda i: i % 20 == 0, 20)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-15)


def test_ties_copies_and_unusable_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-2, 3, (12, 5)).astype(float)
    data = [(i, base[i % 12].tolist()) for i in range(120)]  # many copies: the smaller vec_id comes first
    data += [(200, None), (201, []), (202, [0.0] * 5), (203, [1.0, None, 0.0, 0.0, 0.0]), (204, [float("nan")] * 5), (205, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (206, [1.0, 2.0]), (None, [1.0] * 5), (220, None)]
    assert run(spark, data) == exact(data, lambda i: i % 20 == 0, 20)


@pytest.mark.parametrize("data", [[], [(0, None)], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [-1.0, 0.0])]])
def test_small_tables(spark, data):
    assert run(spark, data) == exact(data, lambda i: i % 20 == 0, 20)


def test_recall_where_few_are_reranked(spark):
    rng, n = np.random.default_rng(3), 24_000
    x = clustered(rng, n)
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = nearest(frame, F.col("vec_id") % 400 == 0).select("query_id", "vec_id", "score").toPandas()
    assert SHORTLIST * -(-n // BLOCK_ROWS) < 0.05 * n
    hits = 0
    for q, mine in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(mine.vec_id) & set(np.argsort(-score)[:20].tolist()))
        assert np.allclose(mine.score, score[mine.vec_id], atol=1e-12)
    assert got.query_id.nunique() == n // 400 and hits / len(got) >= 0.9


def test_codes_weigh_errors_along_the_vector_more():
    x = clustered(np.random.default_rng(4), 3000, 32)
    index = fit(x)
    y, u, _ = _split(x, index.centres[index.cells(x)], len(index.books))
    at = np.arange(len(index.books))

    def loss(codes):
        e = y - index.books[at, codes]
        return ((e**2).sum(axis=(1, 2)) + (index.eta - 1) * (e * u).sum(axis=(1, 2)) ** 2).mean()

    assert index.eta > 1 and loss(_assign(y, u, index.books, index.eta)) < loss(_assign(y, u, index.books, 1.0))
