import numpy as np
import pytest

import corpus_pipeline as cp
from tidewater.llm.text import table
from tidewater.spark import materialize

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLEAN = ["one", "two", "three", "near", "the", "river", "and", "town", "with", "large", "doors,", "people.", "walk", "here"]


def tables(spark, path, docs, labels):
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def corpus():
    rng = np.random.default_rng(0)
    docs, labels = [], []
    for i in range(160):
        words = list(rng.choice(CLEAN, 150))
        junk = i % 4 == 0
        docs.append((i, "WIN BIG!! CLICK!! " * 50 if junk else " ".join(words), None if i % 9 == 0 else f"s{i % 3}"))
        labels.append((i, int(not junk), 0))
        if i % 10 == 1:
            docs.append((1000 + i, docs[-1][1], "s0"))
            words[5] = "changed"
            docs.append((2000 + i, " ".join(words), "s1"))
    return docs, labels


def test_every_stage_takes_effect(spark, tmp_path):
    docs, labels = corpus()
    sf = tables(spark, tmp_path, docs, labels)
    now, ids = table(spark, sf, "documents"), []
    for _, stage in cp.STAGES[:3]:
        now = materialize(stage(spark, now, sf))
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids.append([x["doc_id"] for x in now.select("doc_id").collect()])
    assert sorted(ids[0]) == sorted(i for i, t, _ in docs if "CLICK" not in t)
    assert sorted(ids[1]) == sorted(i for i, t, _ in docs if "CLICK" not in t and i < 1000)
    assert set(ids[2]) <= set(ids[1]) and max(ids[2].count(i) for i in set(ids[2])) <= 3
    packed = cp.pack_sequences(spark, now, sf).toPandas()
    assert sorted(packed[packed.start == 0].doc_id) == sorted(ids[2])
    assert packed.length.sum() == packed[packed.start == 0].doc_tokens.sum()


@pytest.mark.parametrize("docs", [[], [(None, None, None), (None, "", "a"), (1, "same words here", "a"), (1, "same words here", "a"), (2, "", None), (2, "other text", None)]])
def test_edges(spark, tmp_path, docs):
    sf = tables(spark, tmp_path, docs, [])
    got = table(spark, sf, "documents")
    for _, stage in cp.STAGES[:3]:
        got = materialize(stage(spark, got, sf))
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    cp.pack_sequences(spark, got, sf).collect()
    if docs:
        assert [x["doc_id"] for x in got.collect()].count(1) <= 3


def test_columns_of_any_name_pass_through(spark, tmp_path):
    docs, labels = corpus()
    sf = tables(spark, tmp_path, docs, labels)
    names = ["_id", "_row", "row", "score", "_n", "_size", "size", "copies", "alike", "copy", "place", "_t", "_c", "_k_doc_id", "_doc_id", "count", "component_id", "a.b"]
    # a long text, null ids and repeated rows besides
    more = [(None, "one two three", "s0"), (5000, "walk here near the river " * 30_000, "s1"), (1, docs[1][1], docs[1][2])]
    rows = [(i, t, "en", s, len(t), *[f"{n}{i}" for n in names]) for i, t, s in docs + more]
    now = spark.createDataFrame(rows, f"{COLUMNS}, " + ", ".join(f"`{n}` string" for n in names))
    plain = table(spark, sf, "documents").unionByName(spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in more], COLUMNS))
    for _, stage in cp.STAGES[:3]:
        now, plain = materialize(stage(spark, now, sf)), materialize(stage(spark, plain, sf))
        got = [tuple(x) for x in now.collect()]
        assert now.columns == COLUMNS.replace(" long", "").replace(" string", "").split(", ") + names
        assert all(x[5:] == tuple(f"{n}{x[0]}" for n in names) for x in got)
        assert sorted(map(repr, (x[:5] for x in got))) == sorted(map(repr, map(tuple, plain.collect())))
    assert cp.pack_sequences(spark, now, sf).count() >= now.count()
