import hashlib
import os

import numpy as np
import pytest

from tidewater.llm import repair
from tidewater.llm.repair import damage, digests, op11_repair, report, solve

DATA = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\f\r"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """Forward search over the grammar's states; rows are (role initial, fault). Least (cost, edits, roles)."""
    best = {0: (0, "", ())}

    def put(into, state, cost, edits, made):
        if state is not None and (state not in into or (cost, edits) < into[state][:2]):
            into[state] = (cost, edits, made)

    def insert(now):
        for _ in range(2):
            for state, (c, e, m) in list(now.items()):
                for who in "ua":
                    put(now, NEXT.get((state, who)), c + 3, e + "I", m + ((who, None),))
        return now

    for i, (who, fault) in enumerate(rows):
        after = {}
        for state, (c, e, m) in insert(best).items():
            put(after, state, c + 4, e + "D", m)
            if fault not in (1, 2):
                more = 3 if fault == 3 else 0
                put(after, NEXT.get((state, who)), c + more, e + "K", m + (("k", i),))
                for to in "ua":
                    put(after, NEXT.get((state, to)), c + more + 3, e + "R", m + ((to, i),))
        best = after
    return min(v for s, v in insert(best).items() if s in (0, 3))


def brute(data):
    """data: (conv_id, turn, role, text) without rows that are gone."""
    out = []
    for conv in {r[0] for r in data}:
        rows = [(r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in data if r[0] == conv]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.strip(SPACE)
            faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        who = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(who, who[1:], strict=False))
        cost, edits, made = cheapest(list(zip(who, faults, strict=True)))
        names = {"u": "user", "a": "assistant"}
        lines = [f"{names.get(n) or rows[i][1]}:{'' if i is None else rows[i][2]}" for n, i in made]
        out.append((conv, gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, data):
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in data], "conv_id long, turn long, role string, text string, cost string, position int, audit string").repartition(3)
    reports, rows = repair.repair(frame)
    hashes = {r[0]: r[1] for r in digests(rows).collect()}
    return sorted(((*r, hashes.get(r[0], hashlib.sha256(b"").hexdigest())) for r in map(tuple, reports.collect())), key=repr)


@pytest.mark.parametrize("seed", range(8))
def test_solver_against_forward_search(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(repair, "PIECE", int(rng.integers(1, 9)))  # most conversations then span several pieces
    monkeypatch.setattr(repair, "CELLS", int(rng.integers(1, 200)))
    count = rng.integers(0, 30, 120)
    who, fault = rng.integers(0, 4, count.sum()), rng.choice(4, count.sum(), p=[0.6, 0.1, 0.1, 0.2])
    cost, audit = solve((who + 4 * fault).astype(np.int8), count)
    at = np.cumsum(count) - count
    for i, n in enumerate(count):
        rows = [("suax"[w], f) for w, f in zip(who[at[i] : at[i] + n], fault[at[i] : at[i] + n], strict=True)]
        assert (cost[i], audit[i].decode()) == cheapest(rows)[:2]


def test_long_conversation_beside_short_ones(spark):
    rng = np.random.default_rng(3)
    roles, texts = ["user", "assistant", "system", "tool"], ["Yes.", "No!", "Why", "", " \n", "a.b", "c?"]
    data = [(1, int(t), roles[rng.choice(4, p=[0.45, 0.45, 0.05, 0.05])], f"{t // 3}{texts[rng.integers(0, 7)]}") for t in range(2500)]
    data += [(c, int(t), roles[rng.integers(0, 4)], texts[rng.integers(0, 7)]) for c in range(2, 60) for t in rng.integers(-3, 9, 5)]
    assert run(spark, data) == brute(data)


def test_nulls_ties_and_empty(spark):
    long = "word " * 200_000 + "."
    data = [(None, None, None, None), (None, 1, "user", "x."), (5, None, "user", "a."), (5, None, "user", "a."), (5, None, None, "b."), (6, 1, "", "x."), (6, 1, "assistant", "y."), (6, 1, "assistant", "z."), (6, -(2**40), "user", "q"), (7, 3, "system", "only."), (8, 0, "user", long), (8, 4, "assistant", long), (9, 0, "USER", "Hi."), (9, 1, "unknown", "x. ")]
    assert run(spark, data) == brute(data)
    assert run(spark, []) == []


def test_damage(spark):
    import zlib

    data = [(c, t, "assistant", "Is it. so! then?") for c in range(12) for t in range(6)] + [(None, 3, None, None), (4, None, "user", "x.")]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in data:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = {0: (c, None, None, None, True), 1: (c, t, role, "", False), 2: (c, t, role, text.translate({ord(x): None for x in ".!?"}), False), 4: (c, t, "user", text, False)}.get(k, (c, t, role, text, False))
        want += [row] * (2 if k == 3 else 1)
    assert sorted(map(tuple, damage(frame).collect()), key=repr) == sorted(want, key=repr)


def test_conversations_of_dropped_rows_are_reported(spark):
    frame = spark.createDataFrame([(1, None, None, None, True), (1, None, None, None, True), (2, 0, "user", "Hi.", False), (2, None, None, None, True)], "conv_id long, turn long, role string, text string, gone boolean")
    assert sorted(map(tuple, report(frame).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 3, "KI")]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_query_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{DATA}/conversations.parquet')")
    result = con.execute(repair.ORACLE)
    df = op11_repair(spark, DATA)
    assert [d[0] for d in result.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(result.fetchall())
