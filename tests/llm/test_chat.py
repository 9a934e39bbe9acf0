import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import chat
from tidewater.llm.chat import Formatter, aligned, default_path, escape, format_chat, op4_chat, parse, read_back, render, unescape

BITS = st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["<|", "|>", "\\", "<|turn|>", "<\\|done|>", "\n\n", " ", "<", "😀é", "<|endoftext|>"])), max_size=6).map(lambda x: "".join(x).encode("utf-8", "replace").decode())
MAKE = Formatter(default_path())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), BITS), BITS), min_size=1, max_size=5))
def test_round_trip_and_mask(turns):
    whole, spans = "", []
    for role, text in turns:
        t, a, b = render(role, text)
        if role == "assistant":
            spans.append((len(whole) + a, len(whole) + b))
        whole += t
    assert parse(whole) == turns
    ids, under, merged = MAKE.encode(whole, spans)
    assert "".join(unescape(whole[a:b]) for a, b in merged) == "".join(t for r, t in turns if r == "assistant")
    assert len(ids) == len(under) and (under.any() == any(r == "assistant" and t for r, t in turns))


def test_escape_hides_marks():
    assert "<|" not in escape("a<|turn|>\\<|") and unescape(escape("a<|turn|>\\<|")) == "a<|turn|>\\<|"


def test_aligned_equals_brute_force():
    rng = np.random.default_rng(0)
    cuts = np.sort(rng.choice(1000, 40, replace=False))
    spans, edges = cuts.reshape(-1, 2), np.unique(np.concatenate([[0, 1000], cuts, rng.choice(1000, 200)]))
    tokens = np.column_stack([edges[:-1], edges[1:]])
    start, end = aligned(spans, tokens)
    for (a, b), s, e in zip(tokens, start, end):
        want = [(max(a, x), min(b, y)) for x, y in spans if min(b, y) > max(a, x)]
        assert want == ([(s, e)] if e > s else [])


def expect(turns):
    turns = [(r or "", t or "") for r, t in turns]
    said = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_conversations(spark, monkeypatch, limit):
    monkeypatch.setattr(chat, "SEGMENT_CHARS", limit)
    data = [(1, 1, "assistant", "hi <|done|>"), (1, 0, "user", "x\\"), (2, 0, "assistant", None), (2, 1, None, "é" * 5000), (None, 0, "assistant", "alone"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (4, None, "user", ""), (4, 2, "assistant", "  \n")]
    frame = spark.createDataFrame([(*x, "f") for x in data], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    got = {x["conv_id"]: tuple(x)[1:5] for x in read_back(format_chat(frame)).collect()}
    by = {}
    for c, t, r, x in sorted(data, key=lambda d: (d[0] or -1, -1 if d[1] is None else d[1], d[2] or "", d[3] or "")):
        by.setdefault(c, []).append((r, x))
    assert got == {c: expect(t) for c, t in by.items()}


def test_empty_table_still_has_the_trap(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = op4_chat(spark, str(tmp_path)).collect()
    text = "\\### Assistant: </turn> ok"
    assert tuple(row)[:5] == (-7, *expect([("user", text), ("assistant", text)]))
