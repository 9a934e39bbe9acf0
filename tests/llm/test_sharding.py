import zlib

import numpy as np
import pytest

from tidewater.llm.sharding import place, shard


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, shard string, slot string")


def test_groups_stay_together_and_sizes_are_even(spark):
    data = [(i, f"text {i % 150} " + "w " * (i % 150), "x", "y") for i in range(600)]
    got = shard(rows(spark, data), 4).toPandas()
    assert sorted(got.doc_id) == list(range(600))
    text = {i: t for i, t, *_ in data}
    assert (got.text_crc32 == got.doc_id.map(lambda i: zlib.crc32(text[i].encode()))).all()
    assert (got["size"] == got.doc_id.map(lambda i: len(text[i]) + 1)).all()
    assert got.groupby("group_key").shard.nunique().max() == 1
    by = got.groupby("shard")["size"].sum()
    assert by.max() < 1.03 * by.min()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_hot_group_is_split(spark):
    data = [(i, "the same text", "", "") for i in range(500)] + [(500 + i, f"other {i}", "", "") for i in range(500)]
    got = shard(rows(spark, data), 8).toPandas()
    by = got.groupby("shard")["size"].sum()
    assert len(got) == 1000 and len(by) == 8 and by.max() < 1.03 * by.min()


@pytest.mark.parametrize("data", [[], [(1, None, "", "")], [(None, "", "", ""), (None, None, None, None), (3, "é" * 5000, "", ""), (3, "é" * 5000, "", "")]])
def test_edges(spark, data):
    got = shard(rows(spark, data), 8).collect()
    assert len(got) == len(data)
    assert sorted(x["size"] for x in got) == sorted(len((t or "").encode()) + 1 for _, t, *_ in data)


def test_place_prefers_the_aligned_bin():
    where = place(np.array([[9.0, 1.0], [1.0, 9.0], [9.0, 1.0], [1.0, 9.0]]), 2)
    assert where[0] != where[2] or where[1] != where[3]
