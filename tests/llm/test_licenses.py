import random

import pytest

from tidewater.llm.licenses import CONTAINMENT, TEMPLATES, WIDTH, _grams, _groups, _words, scan


def brute(text):
    out, words = set(), _words(text or "")
    for (width, size), group in _groups(TEMPLATES).items():
        for name, w in group:
            grams = set(_grams(w, width))
            if any(len(grams & set(_grams(words[at : at + 2 * size], width))) >= CONTAINMENT * len(grams) for at in range(0, max(1, len(words)), size)):
                out.add(name)
    return out


def corpus():
    filler = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod".split()
    texts = [None, "", "all rights", "ALL   rights\nreserved", "word " * 60000 + "Released under the MIT License."]
    for i, (_, t) in enumerate(TEMPLATES):
        words = t.split()
        for pad in (0, 3, 7, 31, 100):
            texts.append(" ".join((filler * 20)[:pad]) + " " + t.upper() + " " + " ".join(filler[:i]))
        texts.append(" ".join(words[:-1]))
        if len(words) > 20:
            texts.append(" ".join(filler + [*words[:2], "changed", *words[3:]]))
            texts.append(" ".join(filler + [x if j % 4 else "changed" for j, x in enumerate(words)]))
    return texts


def test_equals_brute_force(spark):
    texts = corpus()
    frame = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, license string, windows int").repartition(3)
    got = {}
    for x in scan(frame).collect():
        got.setdefault(x["doc_id"], set()).add(x["license"])
        assert CONTAINMENT <= x["containment"] <= 1 and x["windows"] >= 1
    assert {i: got.get(i, set()) for i in range(len(texts))} == {i: brute(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("data", [[], [(None, "All rights reserved."), (1, None), (1, "All rights reserved."), (1, "All rights reserved.")]])
def test_edges(spark, data):
    got = scan(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"] or -1) for x in got) == sorted({i or -1 for i, t in data if t})
    assert WIDTH == 5


def test_no_notice_in_the_middle_of_a_text_is_missed(spark):
    rng = random.Random(5)
    filler = lambda n: " ".join("".join(rng.choices("aeioulnrst", k=rng.randint(2, 9))) for _ in range(n))
    notices = {n: t for n, t in TEMPLATES if n in ("MIT", "All-Rights-Reserved", "CC-BY-4.0", "MPL-2.0")}
    docs = [(i, f"{filler(rng.randint(8, 60))} {t} {filler(40)}", n) for i, (n, t) in enumerate(list(notices.items()) * 1000)]
    crowd = "Licensed under CC BY 4.0. Released under the MIT License. All rights reserved. Licensed under CC BY-NC 4.0."
    docs += [(4000 + i, f"{filler(i)} {crowd} {filler(40)}", "MIT") for i in range(60)]
    got = {(x["doc_id"], x["license"]) for x in scan(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").repartition(4)).collect()}
    assert {(i, n) for i, _, n in docs} - got == set()
    assert {(4000 + i, n) for i in range(60) for n in ("CC-BY-4.0", "CC-BY-NC-4.0", "All-Rights-Reserved")} <= got
