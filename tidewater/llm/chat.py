"""Chat formatting with offset-aligned loss masks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.text import table
from tidewater.spark import ship

#: Fixed marks of the template. OPEN + role + NEXT + text + CLOSE is one turn. Roles and texts never hold an unescaped OPEN,
#: NEXT or CLOSE, since each of them starts with "<|" and that is escaped.
OPEN, NEXT, CLOSE = "<|turn|>", "<|says|>", "<|done|>"
_TURN = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|done\|>", re.S)
#: Characters that one call encodes at most, in whole turns; a longer turn is encoded alone. Marks are units of their own to the
#: tokenizer, so the cut between turns changes no token.
SEGMENT_CHARS = 1 << 20
LEARNT_ROLE = "assistant"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its escaped text begins and ends in it."""
    head = f"{OPEN}{escape(role)}{NEXT}"
    body = escape(text)
    return f"{head}{body}{CLOSE}", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back from a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def aligned(spans: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intersects sorted disjoint spans with sorted token spans: for each token the characters under the mask, as (start, end),
    empty if start = end. Binary search finds the first span that ends after a token's start; tokens are shorter than any
    gap between learnt texts, so no token meets two spans."""
    if not len(spans) or not len(tokens):
        return np.zeros(len(tokens), dtype=np.int64), np.zeros(len(tokens), dtype=np.int64)
    i = np.minimum(np.searchsorted(spans[:, 1], tokens[:, 0], side="right"), len(spans) - 1)
    start = np.maximum(tokens[:, 0], spans[i, 0])
    end = np.minimum(tokens[:, 1], spans[i, 1])
    return np.where(end > start, start, 0), np.where(end > start, end, 0)


class Formatter:
    """Encodes rendered turns once, with offsets; the tokenizer knows the template's marks as special."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.pre_tokenizer = ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
        self.tokenizer.add_special_tokens([OPEN, NEXT, CLOSE])

    def encode(self, text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """Ids, whether each is under the loss, and the masked character spans, merged."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        tokens = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
        start, end = aligned(np.array([s for s in spans if s[1] > s[0]], dtype=np.int64).reshape(-1, 2), tokens)
        under = end > start
        merged: list[tuple[int, int]] = []
        for a, b in zip(start[under].tolist(), end[under].tolist(), strict=True):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return np.array(e.ids, dtype="<u4"), under, merged


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


SEGMENT_SCHEMA = "conv_id long, segment long, formatted string, ids binary, loss binary, loss_spans array<long>"


def format_chat(turns: DataFrame, path: str | None = None) -> DataFrame:
    """Formats conversations: rows (conv_id, turn, role, text) by turn become (conv_id, segment, formatted, ids, loss, loss_spans).

    A conversation is one segment unless it is longer than SEGMENT_CHARS; longer ones go on in further segments of whole turns,
    so a task holds a bounded part of any conversation and streams through it. ids are little-endian unsigned 32-bit, loss has
    one byte a token, loss_spans are start, end, start, end ... in ``formatted``: the characters of assistant texts, each once.
    Ties of turn are ordered by role and text. Null texts and roles count as empty; rows of a null conv_id are one conversation;
    a null turn comes first; repeated rows are turns of their own. Other columns are ignored; an empty table gives no rows.
    """
    path = path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make, now, number, held, text, spans, out = Formatter(path), object(), 0, 0, [], [], []

        def close() -> None:
            nonlocal number, held, text, spans
            if text:
                whole = "".join(text)
                ids, under, merged = make.encode(whole, spans)
                out.append((None if now == "none" else now, number, whole, ids.tobytes(), under.astype(np.uint8).tobytes(), [x for s in merged for x in s]))
                number, held, text, spans = number + 1, 0, [], []

        for pdf in batches:
            for conv, role, said in zip(pdf.conv_id.tolist(), pdf.role, pdf.text, strict=True):
                conv = "none" if conv is None or conv != conv or conv is pd.NA else int(conv)
                if conv != now:
                    close()
                    now, number = conv, 0
                role, said = role if isinstance(role, str) else "", said if isinstance(said, str) else ""
                if held and held + len(said) > SEGMENT_CHARS:
                    close()
                turn, a, b = render(role, said)
                if role == LEARNT_ROLE:
                    spans.append((held + a, held + b))
                text.append(turn)
                held += len(turn)
            if sum(len(x[2]) for x in out) > SEGMENT_CHARS:
                yield pd.DataFrame(out, columns=_COLUMNS).astype({"conv_id": "Int64"})
                out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS).astype({"conv_id": "Int64"})

    ship(turns.sparkSession)
    lean = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    ordered = lean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInPandas(run, SEGMENT_SCHEMA)


_COLUMNS = [c.split()[0] for c in SEGMENT_SCHEMA.split(", ")]


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from ``formatted`` and ``loss_spans`` alone, streaming over their segments."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out = object(), []
        n = loss = chars = 0
        turns, learnt = hashlib.sha256(), hashlib.sha256()

        def close() -> None:
            if n:
                out.append((None if now == "none" else now, n, turns.hexdigest(), loss, learnt.hexdigest(), chars))

        for pdf in batches:
            for conv, formatted, spans in zip(pdf.conv_id.tolist(), pdf.formatted, pdf.loss_spans, strict=True):
                conv = "none" if conv is None or conv != conv or conv is pd.NA else int(conv)
                if conv != now:
                    close()
                    now, n, loss, chars, turns, learnt = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, said in parse(formatted):
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for a, b in zip(spans[::2], spans[1::2], strict=True):
                    said = unescape(formatted[a:b])
                    learnt.update(said.encode("utf-8", "surrogatepass"))
                    loss += len(said)
                chars += len(formatted)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
                out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [c.split()[0] for c in schema.split(", ")]
    ship(segments.sparkSession)
    return segments.select("conv_id", "formatted", "loss_spans").mapInPandas(run, schema)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, and conversation -7 whose texts look like control strings."""
    columns = "conv_id long, turn long, role string, text string"
    trap = spark.createDataFrame([(-7, i, r, "\\### Assistant: </turn> ok") for i, r in enumerate(("user", "assistant"))], columns)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_chat(turns.unionByName(trap)))


#: The same in SQL; 24 characters a turn are the marks.
ORACLE = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) AS v(conv_id, turn, role, text)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
  sum(24 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g"""
