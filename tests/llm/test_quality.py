import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm.quality import FEATURES, PASSAGE, _forward, fit, held_out, op9_quality, passages, score, train

GOOD = "Anderwhed thor erea the thth, and the reonan was near. Hendly which read, then down and other ones. "
JUNK = ["BUY NOW!! CLICK HERE!! WIN BIG!! ", "spam spam spam spam spam ", "Der&&& und%%% ist### zu$$$ "]


def corpus(spark, n=240):
    rng = np.random.default_rng(0)
    words = GOOD.split()
    docs, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        body = " ".join(rng.permutation(words)) + ". "
        docs.append((i, body * 8 if good else body * 6 + JUNK[i % len(JUNK)] * 60, "src", "en", 0.5))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    got = score(docs, train(docs, labels)).toPandas()
    held = got[[zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]]
    assert len(held) > 20 and ((held.score >= 0.3) == (held.doc_id % 3 != 0)).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_the_passage_bound_is_filled_in_the_order_of_the_hash(spark, monkeypatch):
    ids = spark.range(120).withColumnRenamed("id", "doc_id").coalesce(1)
    order = [r[0] for r in ids.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64(F.lit(3), "doc_id")).collect()]
    first = set(order[:20])
    labels = spark.createDataFrame([(i, int(i in first), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr("tidewater.llm.quality.fit", lambda x, start, y: seen.append(y.tolist()))
    train(ids.withColumn("text", F.lit(GOOD)), labels, max_passages=20)
    assert seen == [[1.0] * 20]


def test_gradient_matches_finite_differences(monkeypatch):
    rng = np.random.default_rng(1)
    x, start, y = rng.normal(size=(40, len(FEATURES))), np.array([0, 3, 4, 20]), np.array([1.0, 0, 1, 0])
    before = fit(x, start, y)
    loss = lambda m: -np.log(np.where(y == 1, m.bags(x, start), 1 - m.bags(x, start)) + 1e-12).mean()
    monkeypatch.setattr("tidewater.llm.quality.ROUNDS", 1)
    assert loss(before) < 0.1 < loss(fit(x, start, y))
    h = _forward(before.w, x, start)[4]
    assert np.allclose(np.add.reduceat(h, start), 1)  # attention sums to one in each bag


def test_passages_cover_the_whole_text():
    assert passages(None).shape == passages(" \n").shape == (1, len(FEATURES))
    assert len(passages("a b " * 5000)) == -(-10000 // PASSAGE)
    assert not np.allclose(passages(GOOD * 200 + JUNK[0] * 30)[-1], passages(GOOD * 230)[-1])


@pytest.mark.parametrize("data", [[], [(None, None), (1, ""), (1, ""), (2, "x" * 200000), (3, "日本 " * 40000)]])
def test_edges(spark, tmp_path, data):
    docs = spark.createDataFrame(data, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op9_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(data) and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.3) for x in got)
