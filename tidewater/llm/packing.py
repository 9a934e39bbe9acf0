"""Packing documents into training sequences: non-negative least squares on the length histogram, then greedy residuals."""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.text import table
from tidewater.spark import materialize, salted_rank, ship

WINDOW, END_ID = 4096, 2
#: Documents of the residual are cut at multiples of this many tokens only; each such block carries its own CRC.
BLOCK = 64
#: A greedy pattern is taken as it is when it leaves at most this many tokens open; what remains is cut.
OPEN_TOKENS = 8
#: At most so many length combinations enter the least squares; other lengths that each one meets in them.
MAX_COLUMNS, SPREAD = 60_000, 16


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Letters whose case, composition and class are the same in every Unicode version; a word of them is one unit to the tokenizer.
#: ASCII signs after it, other than an apostrophe, are one more unit.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+)([!-&(-/:-@\\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The published byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """Ids of whole texts, as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never looks across it, so the ids of a text are those of its chunks between ASCII
    white space. Chunks are kept from text to text, up to a bound in bytes. A chunk of plain letters goes to the merge model
    at once, signs that follow it go through the tokenizer on their own; any other chunk takes the tokenizer's whole way.
    """

    def __init__(self, path: str, most_bytes: int = 96 << 20):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.held = Tokenizer.from_file(path), most_bytes, 0
        self.merge, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.tails: dict[str, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        word = chunk.decode()
        parts = _PLAIN.fullmatch(word)
        if parts is None:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        elif parts[2]:
            if parts[2] not in self.tails:
                self.tails[parts[2]] = array("I", self.tokenizer.encode(parts[2], add_special_tokens=False).ids).tobytes()
            out = self[parts[1].encode()] + self.tails[parts[2]] if len(self.tails) < 10_000 else array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
            return self._keep(chunk, out)
        else:
            low = word.lower()
            ids = [t.id for t in self.merge(low if low.isascii() else low.encode().decode("latin-1").translate(self.letters))]
        return self._keep(chunk, array("I", ids).tobytes())

    def _keep(self, chunk: bytes, out: bytes) -> bytes:
        self.held += 180 + len(chunk) + len(out)
        self[chunk] = out
        return out

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            yield b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split()))
            if self.held > self.most:
                self.clear()
                self.held = 0


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder in each worker process, for all its tasks."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Every document's ids and ``end_id``, cut into full windows and one rest; null text counts as empty.

    ``blocks`` has the CRC of each BLOCK tokens of the rest, so that a later cut at a block needs no second encoding.
    """

    def run(batches):
        encode = encoder(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for pdf in batches:
            out = []
            for doc_id, ids in zip(pdf.doc_id, encode([t if isinstance(t, str) else "" for t in pdf.text]), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * min(n, start + window)]
                    blocks = b"" if len(part) == 4 * window else np.array([zlib.crc32(part[i : i + 4 * BLOCK]) for i in range(0, len(part), 4 * BLOCK)], dtype="<u4").tobytes()
                    out.append((doc_id, start, len(part) // 4, zlib.crc32(part), n, blocks))
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "blocks"])
            yield frame.assign(doc_id=frame.doc_id.astype("Int64"))

    ship(docs.sparkSession)
    lean = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return lean.mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, blocks binary")


def combinations(present: np.ndarray, window: int, most: int = MAX_COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """Shallow combinations of present lengths that fill the window exactly, as lengths and how often each occurs: all pairs, and
    one or two of any length, some of another that changes from length to length, and whatever one length fills the rest. Unused
    places hold 0."""
    has = np.zeros(window + 1, dtype=bool)
    has[present] = True
    pair = present[2 * present < window]
    pair, half = pair[has[window - pair]], present[2 * present == window]
    lengths, times = [np.column_stack([window - pair, pair, 0 * pair])], [np.tile([1, 1, 0], (len(pair), 1))]
    lengths.append(np.column_stack([half, 0 * half, 0 * half]))
    times.append(np.tile([2, 0, 0], (len(half), 1)))
    n = len(present)
    for k in range(min(SPREAD, n)):
        a, b = present, present[(np.arange(n) * 7919 + k * n // SPREAD) % n]
        for p in (1, 2):
            for q in (1, 2, 4, 8):
                c = window - p * a - q * b
                fit = (c > 0) & (a != b) & (c != a) & (c != b)
                fit[fit] = has[c[fit]]
                lengths.append(np.column_stack([a, b, c])[fit])
                times.append(np.tile([p, q, 1], (int(fit.sum()), 1)))
    every, often = np.vstack(lengths), np.vstack(times)
    step = -(-len(every) // most) or 1
    return every[::step], often[::step]


def solve(columns: np.ndarray, times: np.ndarray, histogram: np.ndarray, rounds: int = 8000) -> np.ndarray:
    """Non-negative least squares: repeat counts x >= 0 that bring the used lengths nearest to the histogram, of which no length is
    used more often than it occurs, so that counts survive rounding.

    Coordinate descent from zero: the count that lowers the squares most moves to its own optimum, or to where a length runs out.
    Few columns become active, about one a length. Ends when no count can move by a half. Longer pieces weigh more, as they are
    harder to place later.
    """
    if not len(columns):
        return np.zeros(0)
    window = len(histogram) - 1
    weight = 0.5 + np.arange(window + 1) / window
    rest = histogram.astype(float)
    order = np.argsort(columns.ravel(), kind="stable")
    holder, first = order // columns.shape[1], np.searchsorted(columns.ravel()[order], np.arange(window + 2))
    curve = (times**2 * weight[columns]).sum(axis=1)
    x = np.zeros(len(columns))

    def gains(c: np.ndarray, m: np.ndarray, bend: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far each count can go, and by how much that lowers the squares."""
        optimum = (m * weight[c] * rest[c]).sum(axis=1) / bend
        step = np.minimum(optimum, np.where(m > 0, rest[c] / np.maximum(m, 1), np.inf).min(axis=1))
        return step, np.where(step < 0.5, 0.0, step * (2 * optimum - step) * bend)

    step, gain = gains(columns, times, curve)
    for _ in range(rounds):
        j = int(np.argmax(gain))
        if gain[j] <= 0:
            break
        x[j] += step[j]
        used = columns[j][times[j] > 0]
        rest[used] -= step[j] * times[j][times[j] > 0]
        touched = np.concatenate([holder[first[k] : first[k + 1]] for k in used])
        step[touched], gain[touched] = gains(columns[touched], times[touched], curve[touched])
    return x


def greedy(left: np.ndarray, window: int, most_open: int | None) -> list[tuple[dict[int, int], int]]:
    """Packs what the histogram ``left`` still holds: the longest piece, then again and again the longest that fits; the
    pattern repeats as long as its pieces last. Patterns that leave over ``most_open`` tokens are not taken. ``left`` is
    reduced by what was packed."""
    out, keys = [], [int(x) for x in np.flatnonzero(left)]
    skip: set[int] = set()
    while True:
        heads = [k for k in keys if k not in skip] if skip else keys
        if not heads:
            return out
        pattern, gap = {heads[-1]: 1}, window - heads[-1]
        while gap > 0:
            i = bisect.bisect_right(keys, gap) - 1
            while i >= 0 and left[keys[i]] <= pattern.get(keys[i], 0):
                i -= 1
            if i < 0:
                break
            k = keys[i]
            take = min(gap // k, int(left[k]) - pattern.get(k, 0))
            pattern[k] = pattern.get(k, 0) + take
            gap -= take * k
        if most_open is not None and gap > most_open:
            skip.add(heads[-1])
            continue
        repeats = min(int(left[k]) // m for k, m in pattern.items())
        for k, m in pattern.items():
            left[k] -= m * repeats
            if left[k] == 0:
                keys.remove(k)
                skip.discard(k)
        out.append((pattern, repeats))


def parts_of(length: int) -> list[int]:
    """How a residual piece is cut: blocks in powers of two, longest first, then the odd tokens. Such parts tile windows."""
    q, odd = divmod(length, BLOCK)
    return [BLOCK << i for i in reversed(range(q.bit_length())) if q >> i & 1] + [odd] * (odd > 0)


class Plan:
    """Where the r-th piece of each length goes, in closed form: a few numbers for each pattern and length."""

    def __init__(self, histogram: np.ndarray, window: int = WINDOW):
        self.window, self.sequences = window, 0
        left = histogram.astype(np.int64).copy()
        first: list[tuple[dict[int, int], int]] = []
        if left[window]:
            first.append(({window: 1}, int(left[window])))
            left[window] = 0
        self.residual = int(left.sum())
        # solve, round, and solve again for what is left, while that still places pieces
        while True:
            (columns, times), before = combinations(np.flatnonzero(left), window), int(left.sum())
            x = solve(columns, times, left.astype(float))
            for i in np.argsort(-x, kind="stable"):
                if x[i] < 0.5:
                    break
                pattern = {int(k): int(m) for k, m in zip(columns[i], times[i], strict=True) if m}
                repeats = min(max(1, int(round(x[i]))), *(int(left[k]) // m for k, m in pattern.items()))
                if repeats > 0:
                    first.append((pattern, repeats))
                    for k, m in pattern.items():
                        left[k] -= m * repeats
            if before - int(left.sum()) <= before // 10:
                break
        self.solved = self.residual - int(left.sum())  # pieces that the least squares place
        first += greedy(left, window, OPEN_TOKENS)
        self.used = histogram - left  # ranks from here on are cut
        self.first = self._table(first)
        cut = np.zeros(window + 1, dtype=np.int64)
        self.base: dict[tuple[int, int], int] = {}
        for length in np.flatnonzero(left):
            for j, p in enumerate(parts_of(int(length))):
                self.base[int(length), j] = int(cut[p])
                cut[p] += left[length]
        self.second = self._table(greedy(cut, window, None))

    def _table(self, patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
        """Rows sorted by (length, first rank): sequence of the first repeat, offset there, pieces per repeat."""
        rows, taken = [], np.zeros(self.window + 1, dtype=np.int64)
        for pattern, repeats in patterns:
            offset = 0
            for k in sorted(pattern, reverse=True):
                m = pattern[k]
                rows.append((k, int(taken[k]), self.sequences, offset, m))
                taken[k] += m * repeats
                offset += m * k
            self.sequences += repeats
        rows.sort()
        a = np.array(rows, dtype=np.int64).reshape(-1, 5)
        return {"key": (a[:, 0] << 44) + a[:, 1], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3], "m": a[:, 4]}

    @staticmethod
    def find(t: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(t["key"], (length.astype(np.int64) << 44) + rank, side="right") - 1
        q, k = np.divmod(rank - t["rank"][i], t["m"][i])
        return t["sequence"][i] + q, t["offset"][i] + k * length


_SHIFT: np.ndarray | None = None


def joined_crc(blocks: np.ndarray, tail_bytes: int) -> int:
    """CRC of consecutive full blocks, the last of ``tail_bytes``, from the CRC of each."""
    global _SHIFT
    if _SHIFT is None:  # how a CRC changes when BLOCK tokens of zero bytes follow; it is linear over bits
        zero, plain = bytes(4 * BLOCK), zlib.crc32(bytes(4 * BLOCK))
        _SHIFT = np.array([zlib.crc32(zero, 1 << b) ^ plain for b in range(32)], dtype=np.uint32)
    crc = int(blocks[0])
    for i in range(1, len(blocks)):
        if i == len(blocks) - 1 and tail_bytes != 4 * BLOCK:
            crc = zlib.crc32(bytes(tail_bytes), crc) ^ zlib.crc32(bytes(tail_bytes)) ^ int(blocks[i])
            break
        moved = 0
        for b in range(32):
            if crc >> b & 1:
                moved ^= int(_SHIFT[b])
        crc = moved ^ int(blocks[i])
    return crc


_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Sequences of at most ``window`` tokens with little padding: one row for each piece of each document.

    One pass encodes and cuts (full windows and a rest); only the histogram of at most ``window`` lengths comes to the
    driver. There, least squares fit the repeats of shallow combinations that fill the window, they are rounded, and a
    greedy pass packs the residual; what would leave gaps is cut at blocks and packed again. A piece finds its place from its
    rank among pieces of its length, by arithmetic, so no group of rows meets in a task.

    Null text counts as empty: one piece, the end id. Repeated rows are packed separately. Other columns are ignored; an
    empty table gives an empty result. The result depends on row contents only, up to the order of identical rows.
    """
    cut = materialize(pieces(docs, path or tokenizer_path(), window, end_id))
    histogram = np.zeros(window + 1, dtype=np.int64)
    for x in cut.groupBy("length").count().collect():
        histogram[x["length"]] = x["count"]
    plan = Plan(histogram, window)
    ranked = salted_rank(cut, ["length"], ["doc_id", "start", "ids_crc32"], "rank")

    def run(batches):
        for pdf in batches:
            length, rank = pdf.length.to_numpy(), pdf["rank"].to_numpy()
            whole = rank < plan.used[length]
            head = pdf[whole].drop(columns=["blocks", "rank"])
            if len(head):
                seq, off = Plan.find(plan.first, length[whole], rank[whole])
                yield head.assign(sequence_id=seq, offset=off)[[c.split()[0] for c in _PLACED.split(", ")]]
            rows, at = [], []
            for x in pdf[~whole].itertuples():
                blocks, start = np.frombuffer(x.blocks, dtype="<u4"), 0
                for j, p in enumerate(parts_of(x.length)):
                    b = blocks[start // BLOCK : -(-(start + p) // BLOCK)]
                    rows.append((x.doc_id, x.start + start, p, joined_crc(b, 4 * ((p - 1) % BLOCK + 1)), x.doc_tokens))
                    at.append(plan.base[x.length, j] + x.rank - int(plan.used[x.length]))
                    start += p
            if rows:
                frame = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
                seq, off = Plan.find(plan.second, frame.length.to_numpy(), np.array(at, dtype=np.int64))
                yield frame.assign(sequence_id=seq, offset=off)

    return ranked.mapInPandas(run, _PLACED)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))
