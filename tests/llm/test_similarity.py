import numpy as np
import pandas as pd
import pytest

from tidewater.llm.similarity import WIDER, Block, Order, Shingler, Threshold, bits_apart, close_pairs, components, parity, similarity_join


def words_of(text):
    return (text or "").encode().lower().split()


def shingles(text, n):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(data, n, a, b):
    sets = [shingles(t, n) for _, t in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            same_id = data[i][0] is not None and data[i][0] == data[j][0]
            if data[i][0] is None or data[j][0] is None:
                continue
            if same_id or (sets[i] and b * len(sets[i] & sets[j]) >= a * len(sets[i] | sets[j])):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(data):
        least[find(i)] = min(least.get(find(i), k), k) if k is not None else None
    return sorted(((k, len(s), least[find(i)]) for i, ((k, _), s) in enumerate(zip(data, sets))), key=repr)


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choice(vocabulary, 60))
    base, out = [], []
    for i in range(n):
        kind = rng.integers(0, 6)
        if kind < 2 or not base:
            t = list(rng.choice(vocabulary, int(rng.lognormal(3.5, 1.0)) + 1))
            base.append(t)
        else:
            t = list(base[rng.integers(0, min(len(base), 6))])
            for _ in range(rng.integers(0, 1 + max(1, len(t) // 25))):
                t[rng.integers(0, len(t))] = str(rng.choice(vocabulary))
        out.append((int(i), (" ".join(t) + (" " + shared if kind == 1 else "")).title() if i % 5 else " ".join(t)))
    return out


@pytest.mark.parametrize("n,a,b", [(3, 9, 10), (5, 4, 5)])
def test_same_components_as_brute_force(spark, n, a, b):
    data = corpus(np.random.default_rng(n), 500) + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "One"), (905, "one two"), (None, "one"), (906, "x y z " * 9000), (907, "x y z " * 9001), (5, "quite another text here now"), (907, "x y z " * 9001)]
    frame = spark.createDataFrame([(i, t, "a", 1) for i, t in data], "doc_id long, text string, component_id string, n int").repartition(3)
    # as it is; chunks of few shingles and stars in groups of over two; groups of frequent shingles that never meet in a task
    for small in ({}, {"block": 600, "few": 2}, {"block": 600, "few": 2, "frequent": 2, "busy": 3}):
        got = similarity_join(frame, n, Threshold(a, b), **small)
        assert sorted(map(tuple, got.collect()), key=repr) == brute(data, n, a, b)


def near_sets(rng, t, size):
    x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
    cut, k = rng.permutation(len(x)), int(rng.integers(0, max(1, size * (t.b - t.a) // t.b) + 1))
    return x, np.unique(np.concatenate([x[cut[k:]], rng.integers(0, 2**63, int(rng.integers(0, k + 1))).astype(np.uint64)]))


@pytest.mark.parametrize("t", [Threshold(9, 10), Threshold(4, 5)])
def test_prefixes_and_bitmaps_lose_no_link(t):
    rng, linked = np.random.default_rng(4), 0
    for size in (1, 2, 5, 9, 10, 11, 19, 20, 40, 100, 500):
        for _ in range(60):
            x, y = sorted(near_sets(rng, t, size), key=len)
            o = len(np.intersect1d(x, y))
            if len(x) and t.linked(o, len(x), len(y)):
                linked += 1
                often = np.unique(rng.choice(np.concatenate([x, y]), size // 2 + 1))
                order = Order(often, rng.integers(30, 9000, len(often)))
                assert len(np.intersect1d(order.first(x, t.prefix(len(x))[1])[0], order.first(y, t.prefix(len(y))[0])[0]))
                assert bits_apart(parity(x), parity(y)) <= len(x) + len(y) - 2 * o <= t.apart(len(x), len(y))
    assert linked > 200


@pytest.mark.parametrize("wider", [1, WIDER])
def test_close_pairs_equal_all_pairs(wider):
    rng, t = np.random.default_rng(6), Threshold(4, 5)
    sets = [s for size in (60, 64, 66, 70, 130) for _ in range(12) for s in near_sets(rng, t, size)]
    frame = pd.DataFrame({"doc_id": np.arange(len(sets)), "n": [len(s) for s in sets], "component": np.arange(len(sets)) // 3, "bitmap": [parity(s, 0, wider) for s in sets]})
    got = set(map(tuple, close_pairs(frame[:50], frame, t, False).to_numpy()))
    want = {(i, j, len(sets[j])) for i in range(50) for j in range(i + 1, len(sets)) if i // 3 != j // 3 and t.a * max(len(sets[i]), len(sets[j])) <= t.b * min(len(sets[i]), len(sets[j])) and bits_apart(parity(sets[i], 0, wider), parity(sets[j], 0, wider)) <= t.apart(len(sets[i]), len(sets[j]))}
    linked = {(i, j, len(sets[j])) for i in range(50) for j in range(i + 1, len(sets)) if i // 3 != j // 3 and t.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
    assert linked <= got == want and len(want) > 3
    # a forest connects the same components with fewer pairs
    few = set(map(tuple, close_pairs(frame[:50], frame, t, True).to_numpy()))
    assert few <= want and joined(few, len(sets)) == joined(want, len(sets))


def joined(pairs, n):
    root = [i // 3 for i in range(n)]
    for a, b, _ in pairs:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    return root


def test_words_are_cut_and_hashed_as_bytes():
    s, rng = Shingler(1), np.random.default_rng(1)
    s.PART = 40
    text = "".join(rng.choice(list("abAB é\n\t\x0b\x1c\u00a0"), 3000))
    words = text.encode().lower().split()
    hashes = s.hashes(text.encode())
    assert len(hashes) == len(words) and len(set(hashes.tolist())) == len(set(words)) == len(set(zip(words, hashes.tolist())))


def test_search_equals_counting():
    rng = np.random.default_rng(2)
    t = Threshold(4, 5)
    common = rng.integers(0, 2**63, 70).astype(np.uint64)
    sets = [np.unique(np.concatenate([common[: rng.integers(30, 70)], rng.integers(0, 60, rng.integers(1, 12)).astype(np.uint64)])) for _ in range(200)]
    block = Block(sets, t)
    for q in range(0, 200, 7):
        want = [j for j in range(200) if j != q and t.linked(len(np.intersect1d(sets[q], sets[j])), len(sets[q]), len(sets[j]))]
        assert sorted(block.search(q).tolist()) == want


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 102), (101, 102), (7, 7)], "a long, b long")
    got = {x["node"]: x["component"] for x in components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100}


def test_empty_table(spark):
    assert similarity_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingler_counts_whole_short_texts():
    s = Shingler(3)
    assert len(s("a b")) == 1 and len(s("a b c")) == 1 and len(s("a b c d")) == 2 and not len(s("")) and (s("A b") == s("a B")).all() and s("a")[0] != s("a a")[0]


def test_short_bitmaps_lose_no_link_where_sets_meet():
    import numpy as np

    from tidewater.llm.similarity import SKETCH, Threshold, meeting, mixed, parity

    t, rng = Threshold(9, 10), np.random.default_rng(5)
    base = [mixed(rng.integers(1, 1 << 60, 200).astype(np.uint64)) for _ in range(30)]
    sets = sorted([np.unique(np.concatenate([b[k:], mixed(rng.integers(1, 1 << 60, k).astype(np.uint64))])) for b in base for k in (0, 4, 9)], key=len)
    n, doc = np.array([len(s) for s in sets]), np.arange(len(sets))
    sketch = np.frombuffer(b"".join(parity(s, SKETCH) for s in sets), np.uint64).reshape(len(sets), -1)
    linked = {(i, j) for i in doc for j in doc[i + 1 :] if t.linked(len(np.intersect1d(sets[i], sets[j])), n[i], n[j])}
    pairs, large = meeting(np.zeros(len(sets), int), n, doc, np.ones(len(sets), bool), sketch, t, few=1000)
    assert linked <= set(map(tuple, pairs[:, :2])) and len(pairs) < 2 * len(linked) and not len(large)
    some = np.arange(0, len(sets), 2)
    _, large = meeting(np.zeros(len(some), int), n[some], some, np.ones(len(some), bool), sketch[some], t, few=5)
    assert {x for p in linked if set(p) <= set(some) for x in p} <= set(some[large])


def late_chain(seed, first, around=44, words=300):
    """A group above the default size whose last text hangs on one other alone: a base without its first word, ``around`` texts with
    three words changed, the base without its last word, and that with five words changed."""
    rng = np.random.default_rng(seed)
    fresh = iter(range(10**6))
    base = [f"s{seed}b{i}" for i in range(words)]

    def changed(text, k):
        text = list(text)
        for at in np.sort(rng.choice(len(text) // 8, k, replace=False)) * 8 + int(rng.integers(0, 3)):
            text[at] = f"s{seed}n{next(fresh)}"
        return text

    texts = [base[1:], *(changed(base, 3) for _ in range(around)), base[:-1]]
    texts.append(changed(texts[-1], 5))
    return [(first + i, " ".join(t)) for i, t in enumerate(texts)]


def misled(data):
    """Whether the last text is linked with the one before alone, and looks by its bitmap as near to the first, which is refuted."""
    sets = [Shingler(3)(data[i][1]) for i in (0, -2, -1)]
    first, before, last = (parity(s) for s in sets)
    linked = lambda x, y: Threshold().linked(len(np.intersect1d(x, y)), len(x), len(y))
    return linked(sets[1], sets[2]) and not linked(sets[0], sets[2]) and bits_apart(first, last) <= bits_apart(before, last)


def test_a_refuted_pair_may_be_a_groups_only_edge(spark):
    data = next(d for seed in range(400) for d in [late_chain(seed, 0)] if misled(d))
    got = {r[0]: r[2] for r in similarity_join(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[45] == got[46] == 0


def test_no_link_is_lost_over_many_seeds(spark):
    groups = [late_chain(seed, 1000 * seed, around=39 + seed % 12) for seed in range(500)]
    frame = spark.createDataFrame([r for g in groups for r in g], "doc_id long, text string").repartition(8)
    sets = [[(i, shingles(t, 3)) for i, t in g] for g in groups]
    want = []
    for group in sets:
        root = {i: i for i, _ in group}
        for n, (i, x) in enumerate(group):
            for j, y in group[:n]:
                both = len(x & y)
                if 10 * both >= 9 * (len(x) + len(y) - both):
                    low, high = sorted((root[i], root[j]))
                    root = {k: low if v == high else v for k, v in root.items()}
        want += [(i, len(x), root[i]) for i, x in group]
    assert sorted(map(tuple, similarity_join(frame).collect())) == sorted(want)


def test_shingles_that_stand_once_in_each_partition_are_counted(spark):
    from tidewater.llm.similarity import _LOW, _PACKED, _frequent, _summed

    texts = spark.createDataFrame([(f"the same three x{i} y{i} z{i}",) for i in range(40)], "text string").repartition(40)
    assert texts.rdd.getNumPartitions() == 40
    counted = texts.mapInPandas(_frequent(3, Threshold(0, 1), 8), _PACKED).repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_summed(32), "shingle long, n long")
    assert [tuple(r) for r in counted.collect()] == [(int(Shingler(3)("the same three")[0] & _LOW), 40)]


def test_packed_shingles_come_back_in_few_bytes():
    from tidewater.llm.similarity import mixed, packed, unpacked

    shingle = mixed(np.arange(1, 200_001, dtype=np.uint64))
    doc, number = np.arange(200_000) // 46 + 10**12, np.arange(200_000) % 46 + (300 << 32)
    frame = packed(shingle, 8, number, doc)
    assert sum(frame[c].str.len().sum() for c in ("keys", "numbers", "docs")) < 9 * len(shingle)
    back = [np.concatenate(x) for x in zip(*unpacked(iter([frame[:3], frame[3:]])))]
    low, bucket = shingle & np.uint64((1 << 40) - 1), (shingle >> np.uint64(40)) % np.uint64(8)
    want = zip((low | bucket << np.uint64(40)).tolist(), number.tolist(), doc.tolist())
    assert sorted(zip(*(x.tolist() for x in back))) == sorted(want)


def test_places_leave_out_pairs_but_no_link():
    from tidewater.llm.similarity import meeting, mixed

    t, rng = Threshold(9, 10), np.random.default_rng(8)
    base = [mixed(rng.integers(1, 1 << 60, 200).astype(np.uint64)) for _ in range(8)]
    everywhere = np.array([0.052 * 2**64]).astype(np.uint64)
    sets = [np.unique(np.concatenate([b[k:], everywhere, mixed(rng.integers(1, 1 << 60, k).astype(np.uint64))])) for b in base for k in (0, 4, 9, 18)]
    rows = sorted((int(k), len(s), d, i) for d, s in enumerate(sets) for i, k in enumerate(s[: t.prefix(len(s))[0]] >> np.uint64(1)))
    key, n, doc, place = (np.array(x) for x in zip(*rows))
    linked = {(i, j) for j in range(len(sets)) for i in range(j) if t.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
    plain, placed = (set(map(tuple, meeting(key, n, doc, place < t.prefix(n)[1], None, t, 40, p)[0][:, :2])) for p in (None, place))
    assert linked <= placed <= plain and len(placed) < len(plain)


def test_rows_of_a_group_grow_with_its_sets_not_with_their_pairs(spark, monkeypatch):
    from tidewater.llm import similarity

    made, written = [], similarity.materialize

    def counting(df, *by):
        out = written(df, *by)
        if "pair" in out.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(similarity, "materialize", counting)
    passage = " ".join(f"p{i}" for i in range(12))
    for sets in (10, 30):  # 30: still fewer than make a shingle frequent, or a group large
        data = [(i, " ".join([*(f"o{i}w{k}" for k in range(30)), passage])) for i in range(sets)] + [(900, "o3w1 " + " ".join([*(f"o3w{k}" for k in range(30)), passage]))]
        got = similarity_join(spark.createDataFrame(data, "doc_id long, text string"), 3, Threshold(1, 2)).collect()
        assert sorted(map(tuple, got), key=repr) == brute(data, 3, 1, 2)
    assert made[1] < 4 * made[0]  # their pairs are nine times as many


@pytest.mark.parametrize("at_once", [1, 7, 1000])
def test_components_of_forests_of_several_tasks(spark, at_once):
    rng = np.random.default_rng(at_once)
    pairs = [tuple(map(int, p)) for p in rng.integers(-40, 40, (30, 2)) * 3]
    root = {x: x for p in pairs for x in p}
    for a, b in pairs:
        low, high = sorted((root[a], root[b]))
        root = {k: low if v == high else v for k, v in root.items()}
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(pairs, "a long, b long").repartition(5), at_once).collect()}
    assert got == {x: root[x] for p in pairs if p[0] != p[1] for x in p}


def test_shingles_of_the_same_sets_make_one_group():
    from tidewater.llm.similarity import members

    key, doc, n = (np.array(x) for x in ([3, 3, 3, 5, 5, 8, 8, 8], [1, 2, -9, 1, 2, -9, 1, 2], [7, 7, 8, 7, 7, 8, 7, 7]))
    groups = members(key, doc, n)
    assert sorted(len(groups[groups[:, 0] == k]) for k in set(groups[:, 0])) == [2, 3] and (groups[:, 0] >= 0).all()
    assert {tuple(r[1:]) for r in groups.tolist()} == {(1, 7), (2, 7), (-9, 8)} and members(key[:0], doc[:0], n[:0]).shape == (0, 3)


def test_few_pairs_of_a_cell_come_all():
    rng, t = np.random.default_rng(6), Threshold(4, 5)
    sets = [s for size in (60, 66, 130) for _ in range(6) for s in near_sets(rng, t, size)]
    frame = pd.DataFrame({"doc_id": np.arange(len(sets)), "n": [len(s) for s in sets], "component": np.arange(len(sets)), "bitmap": [parity(s) for s in sets]})
    every, some = close_pairs(frame, frame, t, False), close_pairs(frame, frame, t, True, 1)
    assert close_pairs(frame, frame, t, True, 2 * len(every)).equals(every) and close_pairs(frame, frame, t, True, 2 * len(every)).attrs["all"]
    assert not some.attrs["all"] and len(some) <= len(every) and set(map(tuple, some.to_numpy())) <= set(map(tuple, every.to_numpy()))


def test_texts_are_handed_out_in_small_batches(spark, monkeypatch):
    from tidewater.llm import similarity

    name, seen, written = "spark.sql.execution.arrow.maxRecordsPerBatch", set(), similarity.materialize
    was = spark.conf.get(name)
    monkeypatch.setattr(similarity, "materialize", lambda df, *by: seen.add(int(spark.conf.get(name))) or written(df, *by))
    data = [(1, "a b c d"), (2, "a b c d"), (3, "e f g h")]
    assert sorted(map(tuple, similarity_join(spark.createDataFrame(data, "doc_id long, text string")).collect())) == brute(data, 3, 9, 10)
    assert max(seen) <= 1000 and spark.conf.get(name) == was
