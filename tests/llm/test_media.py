import numpy as np
import pytest

from tidewater.llm.media import FAR_BITS, Gallery, _blur, describe, draw, link_images, meeting, op7_media


def picture(seed, h=120, w=140):
    rng = np.random.default_rng(seed)
    x = _blur(rng.random((h, w)) * 255, 2)
    return np.rint((x - x.min()) / (x.max() - x.min()) * 255).astype(np.uint8)


SCHEMA = "image_id long, pixels binary, height int, width int, class_id string"


def row(i, x):
    return (i, x.tobytes(), *x.shape, "c")


def test_crops_and_edits_are_linked_and_others_not(spark):
    data = []
    for i in range(6):
        x = picture(i)
        edited = x.copy()
        edited[:30, :30] = 128
        data += [row(10 * i, x), row(10 * i + 1, x[12:110, 20:130].copy()), row(10 * i + 2, np.clip(x * 0.8 + 20, 0, 255).astype(np.uint8)), row(10 * i + 3, edited), row(10 * i + 4, x)]
        data.append(row(10 * i + 5, np.rot90(x).copy()))
    for block in (None, 300):
        got = {x["image_id"]: x["class_id"] for x in link_images(spark.createDataFrame(data, SCHEMA).repartition(3), block).collect()}
        assert len(got) == len(data)
        assert all(got[i] // 10 == i // 10 for i in got)
        assert all(got[10 * i + j] == 10 * i for i in range(6) for j in range(5))


def test_block_search_equals_all_pairs():
    pictures = [picture(0), picture(0)[5:100, 5:100], picture(1), picture(2), picture(2)[10:, 10:]]
    corners, keys = zip(*map(describe, pictures))
    g = Gallery(list(corners), list(keys))
    none = np.zeros(5, dtype=bool)
    assert [g.search(i, none) for i in range(5)] == [[1], [0], [], [4], [3]]
    assert g.forest().tolist() == [0, 0, 2, 3, 3]


@pytest.mark.parametrize("data", [[], [(None, b"x", 1, 1, ""), (1, None, 3, 3, ""), (2, b"", 0, 0, ""), (3, b"abc", 2, 2, ""), (4, bytes(10000), 100, 100, ""), (5, bytes(10000), 100, 100, ""), (5, bytes(10000), 100, 100, ""), (6, b"a", None, None, None)]])
def test_edges(spark, data):
    got = link_images(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted(((x["image_id"], x["class_id"]) for x in got), key=repr) == sorted(((i, 4 if i == 5 else i) for i, *_ in data), key=repr)


def test_query_on_vectors(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(12)]
    data += [(20, data[0][1]), (24, [9.0, *data[1][1][1:]]), (21, None), (22, [float("nan")] * 4), (23, [])]
    spark.createDataFrame(data, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {x["vec_id"]: x["class_id"] for x in op7_media(spark, str(tmp_path)).collect()}
    assert got == {i: {20: 0, 24: 1}.get(i, i) for i, _ in data}


def test_changed_vectors_stay_copies(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = [(10 * i, rng.normal(size=64)) for i in range(40)]
    data += [x for i, v in data for x in ((i + 1, v * 1.01 + rng.normal(size=64) * 0.005), (i + 2, v * 7))]
    spark.createDataFrame([(i, v.tolist()) for i, v in data], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {x["vec_id"]: x["class_id"] for x in op7_media(spark, str(tmp_path)).collect()} == {i: i // 10 * 10 for i, _ in data}
    a, b = draw(data[0][1]).astype(int), draw(data[40][1]).astype(int)
    assert a.std() > 20 and np.abs(a - b).max() <= 4


def test_crops_and_edits_of_drawn_images_are_linked(spark):
    data = []
    for i in range(30):
        x = draw(np.random.default_rng(i).normal(size=196))
        edited = x.copy()
        edited[:40, :40] = 128
        data += [row(10 * i, x), row(10 * i + 1, x[10:100, 16:].copy()), row(10 * i + 2, edited)]
    assert {x["image_id"]: x["class_id"] for x in link_images(spark.createDataFrame(data, SCHEMA)).collect()} == {i: i // 10 * 10 for i, *_ in data}


def test_meeting_connects_all_close_descriptors():
    rng = np.random.default_rng(4)
    key = np.sort(rng.integers(0, 40, 600) ** 2 // 100)
    bits = rng.integers(0, 2**63, (9, 2)).astype(np.uint64)[rng.integers(0, 9, 600)] ^ (np.uint64(1) << rng.integers(0, 60, (600, 2)).astype(np.uint64))
    image = rng.integers(0, 300, 600)

    def classes(pairs):
        label = np.arange(300)
        for a, b in pairs:
            label[label == label[a]] = label[b]
        return {frozenset(np.flatnonzero(label == x).tolist()) for x in label}

    for k in np.unique(key):
        m = np.flatnonzero(key == k)
        close = [(image[i], image[j]) for i in m for j in m if np.bitwise_count(bits[i] ^ bits[j]).sum() <= FAR_BITS]
        assert classes(meeting(key[m], image[m], bits[m])) == classes(close)
    assert len(meeting(key[:0], image[:0], bits[:0])) == 0


def test_images_of_one_id_are_all_kept(spark):
    """Two images have the id 1; the second one has an edited copy, 3, and a third, 5, hangs on nothing."""
    one, two, other = picture(50), picture(51), picture(52)
    edited = two.copy()
    edited[:30, :30] = 9
    data = [row(1, one), row(1, two), row(3, edited), row(5, other), row(7, one), (1, None, 3, 3, ""), (9, None, 3, 3, "")]
    got = sorted((r["image_id"], r["class_id"], r["n_corners"] > 0) for r in link_images(spark.createDataFrame(data, SCHEMA)).collect())
    assert got == [(1, 1, False), (1, 1, True), (1, 1, True), (3, 1, True), (5, 5, True), (7, 1, True), (9, 9, False)]
