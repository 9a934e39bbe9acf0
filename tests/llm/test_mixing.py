import re

import numpy as np
import pytest

from tidewater.llm.mixing import mix, pivot, targets


def test_pivot_keeps_the_sum_and_closes_all_but_one():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 1001):
        size = rng.integers(1, 90, n).astype(float)
        mass = size * rng.random(n)
        out, left = pivot(size, mass, rng)
        assert abs(out.sum() - mass.sum()) < 1e-6 * mass.sum()
        assert all(k == left or out[k] in (0.0, size[k]) for k in range(n))


def test_pivot_keeps_each_probability():
    size, p = np.array([3.0, 7.0, 5.0, 11.0]), np.array([0.2, 0.7, 0.5, 0.9])
    got = np.zeros(4)
    for s in range(4000):
        got += pivot(size, size * p, np.random.default_rng(s))[0] / size
    assert np.abs(got / 4000 - p).max() < 0.03


def test_targets_stop_and_reshare():
    got = targets([100.0, 10.0, 1000.0], [5.0, 2.0, 1.0])
    assert got[0] == 300 and got[1] == 30 and abs(got[2] - 780) < 1e-9
    assert targets([0.0, 4.0], [5.0, 2.0]) == [0.0, 4.0]


def frame(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, source string, size string, target string")


def test_mix_meets_targets_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr("tidewater.llm.mixing.BUCKET_ROWS", 20)
    rng = np.random.default_rng(0)
    data = [(i, "w " * int(rng.integers(0, 60)), None if i % 11 == 0 else f"s{i % 3 if i % 2 else 0}", "", "") for i in range(2000)]
    a = mix(frame(spark, data).repartition(3)).toPandas().sort_values("doc_id").reset_index(drop=True)
    b = mix(frame(spark, data[::-1]).repartition(7)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert a.equals(b) and len(a) == 2000
    assert (a["size"] == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t, *_ in data]).all()
    assert (a.taken <= 3 * a["size"]).all() and a.target.notna().all()
    for _, g in a.groupby(a.source.fillna("-")):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 60


@pytest.mark.parametrize("data", [[], [(1, None, None, "", "")], [(None, "a b", None, None, None), (2, "x " * 30000, "s", "", ""), (2, "x " * 30000, "s", "", "")]])
def test_edges(spark, data):
    assert mix(frame(spark, data)).count() == len(data)
