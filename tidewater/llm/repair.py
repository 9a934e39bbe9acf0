"""Repair of conversation structure by least edits: conversations of like length share time-major tensors, in which a dynamic
programme takes all of them back turn by turn, and the cheapest edits are traced forward again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.text import table
from tidewater.spark import materialize, ship

#: White space of the contracts: the ASCII kind.
SPACE = " \t\n\x0b\f\r"
#: Roles by their initial; the fourth stands for all others.
INITIALS = "sua"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a. What a kept row of each initial leads to (-1: not allowed).
NEXT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
#: What an inserted or re-roled row leads to: a user row anywhere but after a user row, where it is the assistant's.
FORCED = np.array([2, 2, 3, 2])
ROLE_AFTER = ("user", "user", "assistant", "user")
#: Conversations are solved in pieces of so many turns; costs compose over pieces, so a long one takes no longer path than a short one.
PIECE = 512
#: Turns (with padding) that one tensor holds, and turns that are read before the finished conversations among them are solved.
CELLS, HELD = 1 << 19, 1 << 16
FAR = np.int64(1) << 40

REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
ROWS = "conv_id long, position long, role string, text string, edit string"


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with faults by crc32 of "conv_id:turn" modulo 20: 0 drops a row, 1 empties its text, 2
    removes full stops, exclamation and question marks, 3 repeats it, 4 makes it a user's. A null anywhere counts as one space.
    Dropped rows stay as rows with ``gone`` set and nothing else, so that their conversation is still known."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), fault.alias("fault"))
    gone = F.col("fault") == 0
    role = F.when(~gone, F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")))
    text = F.when(~gone, F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"), gone.alias("gone"), times.alias("_n")).drop("_n")


def _mark() -> Column:
    """Equal for rows of equal role and text; it also orders the rows of one turn."""
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))


def report(turns: DataFrame) -> DataFrame:
    """One row a conversation of ``turns`` (conv_id, turn, role, text, gone): its faults, the cost of the cheapest repair and its
    edits, as D(elete), I(nsert), K(eep) and R(erole) in order, the ASCII-least of the cheapest.

    Rows travel without their texts: a digest, the turn, the role's initial and the fault, in one shuffle by conversation that also
    serves the search for repeats. A task reads its conversations as a sorted stream and holds nine bytes a turn of those that it
    solves together.
    """
    ship(turns.sparkSession)
    end = F.rtrim("text", F.lit(SPACE))
    cut = ~F.substring(end, -1, 1).isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    who = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    light = turns.select("conv_id", "turn", "gone", _mark().alias("mark"), who.alias("who"), F.when(end == "", BLANK).when(cut, TRUNCATED).otherwise(0).alias("fault")).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "mark").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(F.col("fault") == BLANK, BLANK).when(again, DUPLICATE).otherwise(F.col("fault"))
    code = F.when(F.col("gone"), -1).otherwise(F.col("who") + 4 * fault)
    rows = light.withColumn("code", code.cast("int")).sortWithinPartitions("conv_id", "gone", F.col("turn").asc_nulls_first(), "mark").select("conv_id", "turn", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
                if n >= HELD:
                    conv, turn, known, code = _columns(held)
                    last = _starts(conv)[-1]
                    if last:
                        yield _solve(conv[:last], turn[:last], known[:last], code[:last])
                        held = [pa.RecordBatch.from_arrays([pa.array(conv[last:]), pa.array(turn[last:], mask=~known[last:]), pa.array(code[last:])], names=["conv_id", "turn", "code"])]
                        n = held[0].num_rows
        if held:
            yield _solve(*_columns(held))

    return rows.mapInArrow(run, REPORT)


def _columns(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """conv_id (objects, as it may be null), turn, whether the turn is known, code."""
    conv = np.concatenate([np.array(b.column("conv_id").to_pylist(), dtype=object) for b in held])
    turn = np.concatenate([b.column("turn").fill_null(0).to_numpy() for b in held])
    known = np.concatenate([b.column("turn").is_valid().to_numpy(zero_copy_only=False) for b in held])
    return conv, turn, known, np.concatenate([b.column("code").to_numpy() for b in held]).astype(np.int8)


def _starts(conv: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1])


def _solve(conv: np.ndarray, turn: np.ndarray, known: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
    """Reports of whole conversations, whose rows follow each other in order (rows that are gone last, code -1)."""
    first = _starts(conv)
    sums = lambda x: np.add.reduceat(x.astype(np.int64), first)
    there = code >= 0
    count = sums(there)
    who, fault = np.where(there, code % 4, 3), np.where(there, code // 4, 0)
    inner = np.ones(len(code), dtype=bool)
    inner[first] = False
    pair = inner & there
    before = np.concatenate([[3], who[:-1]])
    legal = (before == 0) & (who == 1) | (before == 1) & (who == 2) | (before == 2) & (who == 1)
    known = known & there
    low, high = np.minimum.reduceat(np.where(known, turn, np.iinfo(np.int64).max), first), np.maximum.reduceat(np.where(known, turn, np.iinfo(np.int64).min), first)
    new = known.copy()  # nulls come first, so equal turns are neighbours
    new[1:] &= ~(known[:-1] & (turn[1:] == turn[:-1]) & inner[1:])
    distinct = sums(new)
    gaps = np.where(distinct > 0, high - low + 1 - distinct, 0)
    cost, audit = solve(code[there], count)
    data = [pa.array(conv[first], pa.int64()), pa.array(gaps), *(pa.array(sums(there & (fault == f))) for f in (BLANK, DUPLICATE, TRUNCATED)), pa.array(sums(pair & ~legal)), pa.array(cost), pa.array([a.decode() for a in audit], pa.string())]
    return pa.RecordBatch.from_arrays(data, names=[c.split()[0] for c in REPORT.split(", ")])


def solve(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Least cost and its ASCII-least edits for each conversation of ``count`` rows; ``code`` is initial + 4 * fault of all rows."""
    pieces = np.maximum(1, -(-count // PIECE))
    of = np.repeat(np.arange(len(count)), pieces)
    number = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.minimum(PIECE, count[of] - number * PIECE)
    start = (np.cumsum(count) - count)[of] + number * PIECE
    last = number == pieces[of] - 1
    ends = np.where(last[:, None], _relax(np.array([[0, FAR, FAR, 0]])), FAR)
    begin = np.zeros(len(of), dtype=np.int64)
    long = np.flatnonzero(pieces[of] > 1)
    if len(long):  # what a piece costs from each state to each, then the costs to go at every piece's end
        unit = np.where(np.eye(4, dtype=bool), 0, FAR)
        through = np.empty((len(of), 4, 4), dtype=np.int64)
        for at, rows in _tensors(code, start, size, long):
            for e in range(4):
                through[at, :, e] = _back(rows, np.tile(unit[e], (len(at), 1)))[0]
        for i in reversed(long):
            if not last[i]:
                ends[i] = np.minimum((through[i + 1] + ends[i + 1]).min(axis=1), FAR)
        to = np.empty((len(of), 4), dtype=np.int64)
        for at, rows in _tensors(code, start, size, long):
            costs = _back(rows, ends[at])
            for s in range(4):
                to[at, s] = _trace(rows, costs, np.full(len(at), s), False)[0]
        for i in long:
            if not last[i]:
                begin[i + 1] = to[i, begin[i]]
    cost, edits = np.zeros(len(of), dtype=np.int64), [b""] * len(of)
    for at, rows in _tensors(code, start, size, np.arange(len(of))):
        costs = _back(rows, ends[at])
        _, made = _trace(rows, costs, begin[at], True)
        ending = _ending(made[1], last[at])
        cost[at] = costs[0][np.arange(len(at)), begin[at]]
        for i, row, tail in zip(at, made[0], ending, strict=True):
            edits[i] = row[row > 0].tobytes() + tail
    first = np.flatnonzero(number == 0)
    return cost[first], [b"".join(edits[i : i + n]) for i, n in zip(first, pieces, strict=True)]


def _tensors(code: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces in order of their length, as tensors of turns by pieces; short ones are padded with -1 behind."""
    which = which[np.argsort(size[which], kind="stable")]
    at = 0
    while at < len(which):
        longest = np.maximum(1, size[which[at:]])
        upto = int(np.searchsorted(longest * np.arange(1, len(longest) + 1), CELLS, side="right"))
        upto = max(1, min(upto, int(np.searchsorted(longest, 2 * longest[0], side="right"))))
        mine = which[at : at + upto]
        turns = np.arange(size[mine].max(initial=0))[:, None]
        inside = turns < size[mine]
        yield mine, np.where(inside, code[np.where(inside, start[mine] + turns, 0)] if len(code) else -1, -1)
        at += upto


def _relax(costs: np.ndarray) -> np.ndarray:
    """Costs to go with up to two insertions first; more can't help, as two lead back to the same state."""
    for _ in range(2):
        costs = np.minimum(costs, INSERT + costs[:, FORCED])
    return costs


def _moves(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one turn of all pieces: whether there is a row, its extra cost unless deleted, where keeping it leads (-1: nowhere), and
    whether it may be anything but deleted."""
    real, fault = code >= 0, code // 4
    free = real & (fault != BLANK) & (fault != DUPLICATE)
    to = np.where(free[:, None], NEXT[np.where(real, code % 4, 3)], -1)
    return real, np.where(fault == TRUNCATED, CUT, 0), to, free


def _options(code: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs to go of deleting, keeping and re-roling the row, from each state."""
    _, extra, to, free = _moves(code)
    keep = np.where(to >= 0, extra[:, None] + KEEP + np.take_along_axis(after, np.maximum(to, 0), axis=1), FAR)
    rerole = np.where(free[:, None], extra[:, None] + REROLE + after[:, FORCED], FAR)
    return DELETE + after, keep, rerole


def _back(rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Costs to go before each turn and at the end: turns + 1, pieces, states."""
    costs = np.empty((len(rows) + 1, *ends.shape), dtype=np.int64)
    costs[-1] = ends
    for t in range(len(rows) - 1, -1, -1):
        after = costs[t + 1]
        best = _relax(np.minimum.reduce(_options(rows[t], after)))
        costs[t] = np.where((rows[t] >= 0)[:, None], np.minimum(best, FAR), after)
    return costs


def _trace(rows: np.ndarray, costs: np.ndarray, state: np.ndarray, record: bool) -> tuple[np.ndarray, tuple | None]:
    """The state that each piece ends in; with ``record``, its edits too: up to two insertions and one other edit a turn."""
    each, state = np.arange(rows.shape[1]), state.copy()
    made = np.zeros((rows.shape[1], 3 * len(rows)), dtype=np.uint8) if record else None
    for t in range(len(rows)):
        real, _, to, _ = _moves(rows[t])
        delete, keep, rerole = _options(rows[t], costs[t + 1])
        for n in range(2):
            now = costs[t][each, state]
            insert = real & (delete[each, state] != now) & (INSERT + costs[t][each, FORCED[state]] == now)
            state = np.where(insert, FORCED[state], state)
            if record:
                made[insert, 3 * t + n] = ord("I")
        now = costs[t][each, state]
        drop = real & (delete[each, state] == now)
        held = real & ~drop & (keep[each, state] == now)
        changed = real & ~drop & ~held
        if record:
            for which, name in ((drop, "D"), (held, "K"), (changed, "R")):
                made[which, 3 * t + 2] = ord(name)
        state = np.where(held, to[each, state], np.where(changed, FORCED[state], state))
    return state, (made, state) if record else None


def _ending(state: np.ndarray, last: np.ndarray) -> list[bytes]:
    """Insertions behind the last row: an assistant row after a user's, both after a system's."""
    return [(b"", b"II", b"I", b"")[s] if l else b"" for s, l in zip(state, last, strict=True)]


def apply(turns: DataFrame, reports: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (gapless from 0), role, text, edit (the edit's initial), in order and with each
    conversation in one partition. A conversation of which nothing is left has no rows.

    Texts are shuffled once, with each conversation's edits in front of its rows; a task streams through them.
    """
    ship(turns.sparkSession)
    rows = turns.filter(~F.col("gone")).select("conv_id", F.lit(1).alias("kind"), "turn", _mark().alias("mark"), "role", "text", F.lit(None).cast("string").alias("audit"))
    heads = reports.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("mark"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    ordered = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        conv, edits, at, state, position = None, "", 0, 0, 0
        out: list[tuple] = []

        def insert() -> None:
            nonlocal at, state, position
            while at < len(edits) and edits[at] == "I":
                out.append((conv, position, ROLE_AFTER[state], "", "I"))
                state, at, position = int(FORCED[state]), at + 1, position + 1

        for batch in batches:
            for key, kind, role, text, audit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "audit")), strict=True):
                if kind == 0:
                    insert()  # behind the last row of the conversation before
                    conv, edits, at, state, position = key, audit, 0, 0, 0
                    continue
                insert()
                edit, at = edits[at], at + 1
                if edit != "D":
                    kept = edit == "K"
                    out.append((conv, position, role if kept else ROLE_AFTER[state], text, edit))
                    state = int(NEXT[INITIALS.index(role[0]), state]) if kept else int(FORCED[state])
                    position += 1
            if out:
                yield _frame(out)
                out = []
        insert()
        if out:
            yield _frame(out)

    return ordered.select("conv_id", "kind", "role", "text", "audit").mapInArrow(run, ROWS)


def _frame(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in ROWS.split(", ")])


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the hash of its ``role:text`` lines, streaming over ``apply``'s rows as they come, without another shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, out = None, None, []
        for batch in batches:
            for key, position, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")), strict=True):
                if position == 0:
                    if sha is not None:
                        out.append((conv, sha.hexdigest()))
                    conv, sha = key, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if len(out) > 5000:
                yield _pairs(out)
                out = []
        if sha is not None:
            out.append((conv, sha.hexdigest()))
        if out:
            yield _pairs(out)

    return repaired.select("conv_id", "position", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def _pairs(out: list[tuple]) -> pa.RecordBatch:
    keys, names = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names)], names=["conv_id", "repaired_sha256"])


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports and repaired rows (see ``report`` and ``apply``) of ``turns``: conv_id, turn, role, text, and optionally gone.

    A row is blank if its text has no character but ASCII white space, else a duplicate if its role and text came earlier in the
    conversation, else truncated if its last such character is none of . ! ?. Keeping costs 0, a new role 3, deleting 4 (the only
    way for blank rows and duplicates), inserting an empty user or assistant row 3; a truncated row that stays costs 3 more. What
    remains has role initials (s?(ua)+)?. Other roles than s..., u..., a..., the empty one included, can't be kept.

    Rows go by turn, null turns first; rows of one turn by a digest of role and text, so repeats are neighbours. Nulls in role and
    text count as one space. Rows of a null conv_id are one conversation. An empty table gives no rows; other columns are ignored.
    One conversation is one task's: its edits take a byte a row there, its texts stream through (a hash of them all is sequential).
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), gone.alias("gone"))
    reports = materialize(report(rows))  # a row a conversation, read twice
    return reports, apply(rows, reports)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of ``conversations``, damaged and repaired."""
    reports, rows = repair(damage(table(spark, sf_dir, "conversations")))
    hashes = digests(rows).withColumnRenamed("conv_id", "_conv")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return reports.join(hashes, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(*[c.split()[0] for c in REPORT.split(", ")], F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def _oracle() -> str:
    """The damage by a bitwise crc32, then a fold over each conversation's rows with the best (cost, edits, text) of each state."""
    code = "list_reduce(list_transform(string_split({}, ''), lambda e: CAST(ascii(e) AS BIGINT)), lambda crc, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(crc, b)), CAST(4294967295 AS BIGINT))"
    state = "STRUCT(c BIGINT, a VARCHAR, o VARCHAR)"
    step = lambda v, cost, edit, out: f"CASE WHEN {v} IS NOT NULL THEN struct_pack(c := {v}.c + {cost}, a := {v}.a || '{edit}', o := {v}.o || {out}) END"
    best = lambda *options: f"list_min([{', '.join(options)}])"
    line = lambda who: f"'{who}:' || chr(10)"

    def inserted(v: list[str], names: str) -> str:
        user, reply = [step(x, INSERT, "I", line("user")) for x in (v[0], v[1], v[3])], step(v[2], INSERT, "I", line("assistant"))
        return f"struct_pack(s0 := {v[0]}, s1 := {v[1]}, s2 := {best(v[2], *user)}, s3 := {best(v[3], reply)})"

    of = lambda name: [f"{name}.s{i}" for i in range(4)]
    said, free = "|| r.text || chr(10)", "r.fault NOT IN (1, 2)"
    own, extra = f"r.role || ':' {said}", "CASE WHEN r.fault = 3 THEN 3 ELSE 0 END"
    kept = lambda v, who: f"CASE WHEN {free} AND r.who = '{who}' THEN {step(v, extra, 'K', own)} END"
    changed = lambda v, who: f"CASE WHEN {free} THEN {step(v, '3 + ' + extra, 'R', f"'{who}:' {said}")} END"
    w = of("w2")
    after = [
        step(w[0], DELETE, "D", "''"),
        best(step(w[1], DELETE, "D", "''"), kept(w[0], "s")),
        best(step(w[2], DELETE, "D", "''"), *(kept(w[i], "u") for i in (0, 1, 3)), *(changed(w[i], "user") for i in (0, 1, 3))),
        best(step(w[3], DELETE, "D", "''"), kept(w[2], "a"), changed(w[2], "assistant")),
    ]
    fault = code.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    return f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({fault}, 4294967295) % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS n FROM k WHERE k <> 0),
f AS (SELECT *, substr(role, 1, 1) AS who, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, n) AS p, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, n) AS copy, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e FROM d),
g AS (SELECT *, CASE WHEN e = '' THEN 1 WHEN copy > 1 THEN 2 WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(who) OVER (PARTITION BY conv_id ORDER BY p) AS prior FROM f),
b AS MATERIALIZED (SELECT k.conv_id, coalesce(max(g.rows), 0) AS n FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN (SELECT conv_id, count(*) AS rows FROM g GROUP BY conv_id) g ON k.conv_id IS NOT DISTINCT FROM g.conv_id GROUP BY k.conv_id),
walk AS (SELECT conv_id, n, CAST(0 AS BIGINT) AS p, CAST(struct_pack(c := 0, a := '', o := '') AS {state}) AS s0, CAST(NULL AS {state}) AS s1, CAST(NULL AS {state}) AS s2, CAST(NULL AS {state}) AS s3 FROM b
  UNION ALL SELECT conv_id, n, p, {", ".join(f"CAST({a} AS {state})" for a in after)} FROM (SELECT conv_id, n, p, r, {inserted(of("w1"), "")} AS w2 FROM (SELECT w.conv_id, w.n, r.p, r, {inserted(["w.s0", "w.s1", "w.s2", "w.s3"], "")} AS w1 FROM walk w JOIN g r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.p = w.p + 1))),
last AS (SELECT conv_id, {best("s0", "w2.s3")} AS r FROM (SELECT conv_id, s0, {inserted(of("w1"), "")} AS w2 FROM (SELECT conv_id, s0, {inserted(["s0", "s1", "s2", "s3"], "")} AS w1 FROM walk WHERE p = n))),
c AS (SELECT conv_id, CASE WHEN count(turn) > 0 THEN max(turn) - min(turn) + 1 - count(DISTINCT turn) ELSE 0 END AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE p > 1 AND prior || who NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT last.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, r.c AS cost, r.a AS audit, sha256(left(r.o, greatest(length(r.o) - 1, 0))) AS repaired_sha256
FROM last LEFT JOIN c ON last.conv_id IS NOT DISTINCT FROM c.conv_id"""


#: The same in SQL.
ORACLE = _oracle()
