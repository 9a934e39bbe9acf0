import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm.packing import Encoder, Plan, joined_crc, pack, parts_of, tokenizer_path, combinations, solve


def ids_of(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.sampled_from(["<|endoftext|>", " can't", "́", "\x1c", " x", "É", "\n\n", "İ", "Σ", "don't'll"])), max_size=6))
def test_chunks_give_the_ids_of_whole_texts(bits):
    text = "".join(bits).encode("utf-8", "replace").decode()
    got = np.frombuffer(next(iter(Encoder(tokenizer_path())([text]))), dtype="<u4").tolist()
    assert [*got, 2] == ids_of(text)


def test_crc_of_joined_blocks():
    rng = np.random.default_rng(0)
    for n in (1, 63, 64, 65, 128, 200, 1000):
        raw = rng.integers(0, 50000, n).astype("<u4").tobytes()
        blocks = np.array([zlib.crc32(raw[i : i + 256]) for i in range(0, len(raw), 256)])
        assert joined_crc(blocks, 4 * ((n - 1) % 64 + 1)) == zlib.crc32(raw)


def padding(histogram):
    total = int((histogram * np.arange(len(histogram))).sum())
    return Plan(histogram).sequences * 4096 / max(1, total) - 1


def test_padding_is_little_for_any_histogram():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 4096, 20000), np.full(9000, 3000), np.full(5000, 2049), rng.geometric(1 / 300, 20000).clip(1, 4096), np.array([4095] * 3000), rng.lognormal(6.5, 0.9, 60000).astype(int).clip(1, 4096)):
        assert padding(np.bincount(lengths, minlength=4097)) < 0.01
    assert all(sum(parts_of(n)) == n for n in range(1, 4096))


def test_most_pieces_come_from_the_least_squares():
    rng = np.random.default_rng(5)
    for n in (10_000, 100_000):
        lengths = rng.lognormal(6, 1, n).astype(int) % 4095 + 1
        plan = Plan(np.bincount(lengths, minlength=4097))
        assert plan.residual == n and plan.solved >= 0.7 * n


def test_counts_fit_the_histogram():
    rng = np.random.default_rng(6)
    columns, times = combinations(np.arange(1, 400) * 10, 4000)
    assert ((columns * times).sum(axis=1) == 4000).all() and len(columns) > 1000
    histogram = np.bincount(rng.integers(1, 400, 30_000) * 10, minlength=4001)
    x = solve(columns, times, histogram.astype(float))
    used = np.bincount(columns.ravel(), weights=(x[:, None] * times).ravel(), minlength=4001)
    assert (x >= 0).all() and (used[1:] <= histogram[1:] + 1e-6).all() and used[1:].sum() > 0.6 * histogram.sum() and (x > 0).sum() < 1000


def frame(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, length string, start string, rank string")


def check(spark, data):
    got = pack(frame(spark, data).repartition(3)).toPandas()
    by_doc = {}
    for i, t, *_ in data:
        by_doc.setdefault(i, []).append(ids_of(t))
    for i, docs in by_doc.items():
        mine = got[got.doc_id.isna()] if i is None else got[got.doc_id == i]
        assert mine.length.sum() == sum(map(len, docs))
        if len(docs) == 1:
            mine, at = mine.sort_values("start"), 0
            for x in mine.itertuples():
                assert x.start == at and x.doc_tokens == len(docs[0])
                assert x.ids_crc32 == zlib.crc32(np.array(docs[0][at : at + x.length], dtype="<u4").tobytes())
                at += x.length
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 4096 and (g.offset.to_numpy() == np.concatenate([[0], g.length.cumsum()[:-1]])).all()
    if len(got):
        assert sorted(got.sequence_id.unique()) == list(range(got.sequence_id.max() + 1))
    return got


def test_round_trip(spark):
    rng = np.random.default_rng(5)
    words = ["Alpha", "beta-gamma", "l'été", "straße", "12345", "x" * 70, "日本語"]
    data = [(i, " ".join(rng.choice(words, int(rng.lognormal(5, 1.2)))), "a", "b", "c") for i in range(300)]
    got = check(spark, data)
    assert got.sequence_id.nunique() * 4096 < 1.04 * got.length.sum() + 4096


@pytest.mark.parametrize("data", [[], [(1, None, "", "", "")], [(None, "a", None, None, None), (7, "", "", "", ""), (8, "word " * 20000, "", "", ""), (9, "same", "", "", ""), (9, "same", "", "", "")]])
def test_edges(spark, data):
    assert len(check(spark, data)) >= len(data)
