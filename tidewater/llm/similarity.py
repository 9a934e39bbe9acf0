"""N-gram Jaccard join: exact links between shingle sets, by T-occurrence search with DivideSkip.

1. Every whole text becomes a set of 64-bit shingle hashes; identical sets collapse to one representative.
2. All sets are ordered alike: rare shingles first, then by hash. Linked sets share one of their first shingles (prefix filter),
   so sets meet by those. Which shingles are frequent is counted over all texts, those at the head of the sets exactly; a wrong
   count costs time, never a link.
3. Prefix shingles travel as five bytes each, packed by the bucket where they meet, without bitmaps: most meet no other set.
   Sets that share one are paired with each other where that makes no more rows than a few a set; else each is first paired with
   one of its size, and the group is kept, once for all shingles with the same sets, so rows grow with the sets of a group, not
   with their pairs. Pairs whose parity bitmaps differ in more bits than linked sets can differ in shingles are no links.
4. What is left is searched: one set against the inverted lists of its partners. Short lists are merged and counted, the longest
   are only probed by binary search for what the short ones left (DivideSkip). A merge here is one sort or count of the
   concatenated lists, as numpy does that faster than a heap.
5. Links become components by alternating large-star and small-star steps, after each task has made a forest of a bounded number
   of them. Only pairs that still lie in different components are looked at again, those of large groups too, so every pair that
   shares a prefix shingle is decided.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.text import table
from tidewater.spark import BROADCAST_ROWS, bounded_broadcast, materialize, release, ship, shuffle_partitions, split_join

#: Shingles of one task's search: the partners of a set are dealt into chunks of about this many.
BLOCK_SHINGLES = 500_000
#: Sets with a common prefix shingle that are all paired with each other; of more, each is paired with one of its size first. So it is
#: with fewer, where more pairs than these a set are left.
FEW, PAIRS_A_SET = 40, 2
#: Rows of a cell in which sets of a large group are compared by their bitmaps: undecided ones, and all.
OPEN_ROWS, ALL_ROWS = 512, 8192
#: Bits of a short bitmap of a set; a multiple of 64 and a power of two.
SKETCH = 256
#: How many times longer the bitmaps are by which whatever large groups still leave open is compared in the end.
WIDER = 8
#: Groups of up to so many sets are searched for sets without a near one; those of larger groups all stay.
LONELY = 4096
#: A shingle counts as frequent from so many texts on; so many frequent ones are kept (they only order the sets), and the group
#: of one of over BUSY texts never meets in one task.
FREQUENT, MOST_FREQUENT, BUSY = 32, 200_000, 4096
#: Weight of the probes in DivideSkip's choice of how many lists are long.
MU = 0.02
#: Prefix shingles that a task packs at once.
PACKED = 250_000
#: Texts that a Python worker is handed at once: whole texts in Arrow batches are what a task needs memory for, on both sides.
TEXTS = 1000
#: Links of which a task makes a forest at once.
FOREST = 200_000

_U = np.uint64
#: What of a shingle is counted and packed: its low bits; the others choose the bucket.
_LOW = _U((1 << 40) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(33))


def ascending(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Shingler:
    """Sorted distinct hashes of a text's word n-grams. A-Z are lower-cased; words stand between ASCII white space; a text of
    fewer words than n has the whole sequence as its one shingle; without words the set is empty.

    A word's hash is a polynomial over its bytes, for all words of a text at once: each byte is weighed by its place in the
    text, and the sum over a word by the inverse of where it begins."""

    BASE = 0x9E3779B97F4A7C17
    #: Longer texts are cut at white space into parts of about so many bytes, so that arrays stay small.
    PART = 1 << 20

    def __init__(self, n: int = 3):
        self.n = n
        letter = mixed(np.arange(1, 257, dtype=_U)) | _U(1)
        letter[65:91] = letter[97:123]
        self.blank = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
        letter[self.blank] = 0
        self.letter, self.weight = letter, mixed(np.arange(1000, 1000 + n, dtype=_U)) | _U(1)
        self.power, self.inverse = np.ones(1, dtype=_U), np.ones(1, dtype=_U)

    def _grow(self, size: int) -> None:
        if len(self.power) < size:
            size = max(size, 1 << 14)
            with np.errstate(over="ignore"):
                self.power = np.concatenate([[_U(1)], np.cumprod(np.full(size, self.BASE, dtype=_U), dtype=_U)])
                self.inverse = np.concatenate([[_U(1)], np.cumprod(np.full(size, pow(self.BASE, -1, 1 << 64), dtype=_U), dtype=_U)])

    def _parts(self, raw: bytes) -> Iterator[np.ndarray]:
        every, at = np.frombuffer(raw, dtype=np.uint8), 0
        while at < len(every):
            stop = at + self.PART
            while stop < len(every) and not self.blank[every[stop]]:
                stop += 1
            yield every[at:stop]
            at = stop

    def hashes(self, raw: bytes) -> np.ndarray:
        """One hash for each word."""
        out = [np.zeros(0, dtype=_U)]
        for part in self._parts(raw):
            self._grow(len(part))
            blank = self.blank[part]
            first = np.flatnonzero(np.concatenate([[True], blank[:-1]]) & ~blank)
            if len(first):
                with np.errstate(over="ignore"):
                    sums = np.add.reduceat(self.letter[part] * self.power[: len(part)], first)
                    out.append(mixed(sums * self.inverse[first]))
        return np.concatenate(out)

    def __call__(self, text: str | bytes | None) -> np.ndarray:
        h = self.hashes(text.encode("utf-8", "replace") if isinstance(text, str) else text or b"")
        if not len(h):
            return h
        width = min(self.n, len(h))
        m = len(h) - width + 1
        with np.errstate(over="ignore"):
            out = np.full(m, width, dtype=_U)
            for i in range(width):
                out += h[i : m + i] * self.weight[i]
        return ascending(mixed(out))


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least ``a / b``, in whole numbers."""

    a: int = 9
    b: int = 10

    def linked(self, overlap, x, y):
        return (self.a + self.b) * overlap >= self.a * (x + y)

    def apart(self, x, y):
        """How many shingles linked sets of these sizes may differ in, at most."""
        return (self.b - self.a) * (x + y) // (self.a + self.b)

    def prefix(self, n: int) -> tuple[int, int]:
        """Of a set of n in the common order: how many first shingles hold the least one that it shares with any linked set, and
        with a linked set that is no smaller."""
        return n - -(-self.a * n // self.b) + 1, n - -(-2 * self.a * n // (self.a + self.b)) + 1


class Order:
    """The order that all sets share: frequent shingles last, those by the logarithm of their count, and all by hash. Frequent ones
    may be given by some of their bits, as ``mask`` says."""

    def __init__(self, shingle: np.ndarray, count: np.ndarray, busy: int = BUSY, mask: np.uint64 = _U((1 << 64) - 1)):
        order, self.mask = np.argsort(shingle), mask
        self.shingle, self.level = shingle[order], np.where(count[order] > busy, 64, np.log2(count[order]).astype(np.int64) + 1)

    def levels(self, s: np.ndarray) -> np.ndarray:
        if not len(self.shingle):
            return np.zeros(len(s), dtype=np.int64)
        s = s & self.mask
        at = np.searchsorted(self.shingle, s)
        at[at == len(self.shingle)] = 0
        return np.where(self.shingle[at] == s, self.level[at], 0)

    def first(self, s: np.ndarray, k: int) -> tuple[np.ndarray, int]:
        """The first k of a sorted set, and how many of them, at the end, are busy shingles."""
        level = self.levels(s)
        if not level.any():
            return s[:k], 0
        order = np.lexsort((s, level))[:k]
        return s[order], int((level[order] == 64).sum())


def parity(s: np.ndarray, slots: int = 0, wider: int = 1) -> bytes:
    """A bit for each of a power of two of slots, one to two a shingle, or ``wider`` times as many: whether an odd number of
    shingles falls into it. Two sets differ in as many shingles, at least, as their bitmaps differ in bits; sets that are alike
    differ in hardly more."""
    slots = slots or wider << max(6, int(len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & _U(slots - 1)).astype(np.int64), minlength=slots) & 1).astype(np.uint8), bitorder="little").tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """Bits that differ in two bitmaps; the longer one is folded to the other's length."""
    p, q, n = int.from_bytes(x, "little"), int.from_bytes(y, "little"), min(len(x), len(y))
    while len(x) > n:
        x = x[: len(x) // 2]
        p = (p >> 8 * len(x)) ^ (p & ((1 << 8 * len(x)) - 1))
    while len(y) > n:
        y = y[: len(y) // 2]
        q = (q >> 8 * len(y)) ^ (q & ((1 << 8 * len(y)) - 1))
    return (p ^ q).bit_count()


def folded(rows: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps as rows of bytes, folded to ``width`` bytes and seen as 64-bit words."""
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return np.ascontiguousarray(rows).view(_U)


def _root(root: dict[int, int], x: int) -> int:
    while root.get(x, x) != x:
        root[x] = x = root.get(root[x], root[x])
    return x


def _join(root: dict[int, int], x: int, y: int) -> bool:
    """Whether two components were apart; now they aren't."""
    x, y = _root(root, x), _root(root, y)
    root[max(x, y)] = min(x, y)
    return x != y


def close_pairs(open_: pd.DataFrame, every: pd.DataFrame, threshold: Threshold, forest: bool, most: int = 0) -> pd.DataFrame:
    """Rows (a, b, nb) of an open set and another of a different component that sizes and bitmaps don't tell apart: all of them, or
    only such that connect as much as all would, the nearest for each. Both frames have doc_id, n, component and bitmap. Of up to
    ``most`` pairs all come also where a forest would do; ``attrs["all"]`` says so."""
    out, mine, comp = [], open_.component.to_numpy().copy(), every.component.to_numpy().copy()
    own, others, whole, held = mine.copy(), comp.copy(), [], 0
    n, ids, size, docs = every.n.to_numpy(), every.doc_id.to_numpy(), open_.n.to_numpy(), open_.doc_id.to_numpy()
    bitmap, bitmaps = open_.bitmap.to_numpy(), every.bitmap.to_numpy()
    width, widths = np.array([len(b) for b in bitmap]), np.array([len(b) for b in bitmaps])
    for one in np.unique(width):
        rows = np.flatnonzero(width == one)
        for other in np.unique(widths):
            at, least = np.flatnonzero(widths == other), int(min(one, other))
            x = folded(np.frombuffer(b"".join(bitmap[rows]), np.uint8).reshape(len(rows), -1), least)
            y = folded(np.frombuffer(b"".join(bitmaps[at]), np.uint8).reshape(len(at), -1), least)
            step = max(1, 1_000_000 // y.size)
            for low in range(0, len(rows), step):
                r = rows[low : low + step]
                i, j = np.nonzero(((own[r, None] != others[at]) if held <= most else (mine[r, None] != comp[at])) & (threshold.a * np.maximum(n[at], size[r, None]) <= threshold.b * np.minimum(n[at], size[r, None])))
                far = np.bitwise_count(y[j] ^ x[low + i]).sum(axis=1, dtype=np.int64)
                i, j = r[i], at[j]
                fit = far <= threshold.apart(n[j], size[i])
                i, j, far = i[fit], j[fit], far[fit]
                if forest and len(i):
                    if held <= most:
                        held += len(i)
                        whole.append((i, j))
                        apart = mine[i] != comp[j]
                        i, j, far = i[apart], j[apart], far[apart]
                    near = np.argsort(far, kind="stable")
                    i, j = i[near], j[near]
                    edges = np.unique(np.column_stack([mine[i], comp[j]]), axis=0, return_index=True)[1]
                    edges.sort()
                    root: dict[int, int] = {}
                    keep = [k for k in edges if _join(root, int(mine[i[k]]), int(comp[j[k]]))]
                    for label in (mine, comp):
                        value, where = np.unique(label, return_inverse=True)
                        label[:] = np.array([_root(root, int(v)) for v in value])[where]
                    i, j = i[keep], j[keep]
                if len(i):
                    out.append((i, j))
    every_one = not forest or held <= most
    i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in ([p[k] for p in (whole if forest and every_one else out)] for k in (0, 1)))
    rows = np.column_stack([np.minimum(docs[i], ids[j]), np.maximum(docs[i], ids[j]), np.where(ids[j] > docs[i], n[j], size[i])])
    pairs = pd.DataFrame(np.unique(rows, axis=0), columns=["a", "b", "nb"])
    pairs.attrs["all"] = every_one
    return pairs


def near_rows(left: np.ndarray, right: np.ndarray, n: np.ndarray, sketch: np.ndarray | None, threshold: Threshold) -> np.ndarray:
    """Which pairs of rows the short bitmaps don't tell apart; without bitmaps, all."""
    out = np.ones(len(left), dtype=bool)
    if sketch is None:
        return out
    for at in range(0, len(left), 100_000):
        i, j = left[at : at + 100_000], right[at : at + 100_000]
        out[at : at + 100_000] = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64) <= threshold.apart(n[i], n[j])
    return out


def accompanied(rows: np.ndarray, n: np.ndarray, sketch: np.ndarray, threshold: Threshold) -> np.ndarray:
    """Which of some rows of a group have another row of it that sizes and short bitmaps don't tell apart from them."""
    out, step = np.zeros(len(rows), dtype=bool), max(1, 200_000 // len(n))
    for at in range(0, len(rows), step):
        r = rows[at : at + step]
        i, j = np.nonzero((r[:, None] != np.arange(len(n))) & (threshold.a * np.maximum(n, n[r, None]) <= threshold.b * np.minimum(n, n[r, None])))
        out[at + i[near_rows(r[i], j, n, sketch, threshold)]] = True
    return out


def meeting(key: np.ndarray, n: np.ndarray, doc: np.ndarray, head: np.ndarray, sketch: np.ndarray | None, threshold: Threshold, few: int = FEW, place: np.ndarray | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What sets with a common prefix shingle lead to: pairs (a, b, size of b), and the rows of large groups.

    Rows are sorted by key, then by size and id, and hold whole groups; ``head`` says that the shingle is among those that
    the set shares with a linked set that is no smaller. In a large group a set is paired with the smallest one of its size class.
    ``place`` is where the shingle stands in the set: a pair of a small group is left out where too few shingles follow for it to be
    the first one that linked sets share, as it meets at that one too. A small group with more than ``most`` pairs a row left, if
    given, counts as a large one.
    Pairs, and rows of large groups, that short bitmaps (if given) show to be no links, or to have none there, are left out."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(edge)
    large = np.repeat(size > few, size)
    rest = np.repeat(edge[1:], size) - np.arange(len(key)) - 1
    rest[large | ~head] = 0
    left = np.repeat(np.arange(len(key)), rest)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(rest) - rest, rest)
    fit = (threshold.a * n[right] <= threshold.b * n[left]) & (doc[left] != doc[right])
    left, right = left[fit], right[fit]
    if place is not None:
        fit = threshold.linked(np.minimum(n[left] - place[left], n[right] - place[right]), n[left], n[right])
        left, right = left[fit], right[fit]
    fit = near_rows(left, right, n, sketch, threshold)
    left, right = left[fit], right[fit]
    many = size > few
    if most is not None:
        group = np.searchsorted(edge, left, side="right") - 1
        many |= np.bincount(group, minlength=len(size)) > most * size
        large = np.repeat(many, size)
        left, right = left[~many[group]], right[~many[group]]
    pairs = [np.column_stack([left, right])]
    for k in np.flatnonzero(many):
        start, stop = edge[k], edge[k + 1]
        at, met = start, np.zeros(size[k], dtype=bool)
        while at < stop:
            end = at + int(np.searchsorted(n[at:stop], threshold.b * n[at] // threshold.a, side="right"))
            others = np.arange(at + 1, end)
            others = others[near_rows(np.full(len(others), at), others, n, sketch, threshold)]
            pairs.append(np.column_stack([np.full(len(others), at), others]))
            met[others - start] = True
            met[at - start] = len(others) > 0
            at = end
        if sketch is not None and size[k] <= LONELY:
            alone = np.flatnonzero(~met)
            alone = alone[~accompanied(alone, n[start:stop], sketch[start:stop], threshold)]
            large[start + alone] = False
    x, y = np.concatenate(pairs).T
    low = doc[x] < doc[y]
    found = np.column_stack([np.where(low, doc[x], doc[y]), np.where(low, doc[y], doc[x]), np.where(low, n[y], n[x])])
    return np.unique(found[found[:, 0] != found[:, 1]], axis=0), np.flatnonzero(large)


def members(key: np.ndarray, doc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Distinct rows (group, doc, n) of groups, given by sorted keys: shingles that hold the same sets make one group, as its number, of
    63 bits, depends on the sets alone. Should two groups get one number, they are one larger group."""
    if not len(key):
        return np.zeros((0, 3), dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    with np.errstate(over="ignore"):
        number = mixed(np.add.reduceat(mixed(doc.astype(_U)) ^ n.astype(_U), first)) >> _U(1)
    return np.unique(np.column_stack([np.repeat(number.astype(np.int64), np.diff(np.append(first, len(key)))), doc, n]), axis=0)


def fits(df: DataFrame) -> bool:
    """Whether a table is small enough to be broadcast."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def gathered(df: DataFrame) -> tuple[DataFrame, bool]:
    """A written table, and whether it is small enough to be broadcast; then it comes as one partition, so that grouping it or joining
    it with broadcasts takes no shuffle."""
    small = fits(df)
    return (df.coalesce(1) if small else df), small


class Block:
    """Inverted lists over some sets, and T-occurrence search in them."""

    def __init__(self, sets: list[np.ndarray], threshold: Threshold):
        self.t, self.size = threshold, np.array([len(s) for s in sets])
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        flat = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        first = np.flatnonzero(new)
        self.first, self.last = first, np.append(first[1:], len(flat))
        self.postings = doc[order]
        self.list_of = np.empty(len(flat), dtype=np.int64)
        self.list_of[order] = np.cumsum(new) - 1

    def search(self, q: int) -> np.ndarray:
        """Every set linked with set ``q``, without ``q``: those that share at least T shingles, T by the two sizes."""
        n, a, b = int(self.size[q]), self.t.a, self.t.b
        least = -(-a * n // b)
        need = -(-a * (n + least) // (a + b))
        lists = self.list_of[self.start[q] : self.start[q + 1]]
        length = self.last[lists] - self.first[lists]
        order = np.argsort(length, kind="stable")
        longest = int(length[order[-1]])
        skip = min(need - 1, int(need / (MU * np.log2(max(2, longest)) + 1))) if longest > 8 else 0
        short, long = lists[order[: n - skip]], lists[order[n - skip :]]
        runs = length[order[: n - skip]]
        at = np.repeat(self.first[short] - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
        merged = self.postings[at]
        if len(merged) > len(self.size):
            count = np.bincount(merged, minlength=len(self.size))
            found = np.flatnonzero(count >= max(1, need - skip))
            count = count[found]
        else:  # the short lists merge into one sorted run
            merged = np.sort(merged, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1], [True]]))
            found, count = merged[edge[:-1]], np.diff(edge)
            keep = count >= need - skip
            found, count = found[keep], count[keep]
        keep = (found != q) & (self.size[found] >= least) & (a * self.size[found] <= b * n)
        found, count = found[keep], count[keep]
        for k, i in enumerate(long):
            if not len(found):
                break
            posting = self.postings[self.first[i] : self.last[i]]
            hit = np.searchsorted(posting, found)
            count = count + ((hit < len(posting)) & (posting[np.minimum(hit, len(posting) - 1)] == found))
            keep = (self.a_plus_b * (count + len(long) - 1 - k)) >= a * (n + self.size[found])
            found, count = found[keep], count[keep]
        return found[self.t.linked(count, n, self.size[found])]

    @property
    def a_plus_b(self) -> int:
        return self.t.a + self.t.b


def _forests(at_once: int):
    """Of up to so many links at a time, the same components as stars: (a, b) for each node a but the smallest one, b."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0

        def stars() -> pd.DataFrame:
            nodes, ends = np.unique(np.concatenate(held), return_inverse=True)
            root: dict[int, int] = {}
            for x, y in ends.reshape(-1, 2).tolist():
                _join(root, x, y)
            child = np.array(list(root), dtype=np.int64)
            least = np.array([_root(root, x) for x in root], dtype=np.int64)
            below = child != least
            return pd.DataFrame({"a": nodes[child[below]], "b": nodes[least[below]]})

        for pdf in batches:
            held.append(pdf[["a", "b"]].to_numpy())
            rows += len(pdf)
            if rows >= at_once:
                yield stars()
                held, rows = [], 0
        if rows:
            yield stars()

    return run


def components(edges: DataFrame, at_once: int = FOREST) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node reachable. Tasks first make forests of up to
    ``at_once`` edges. Where that takes more than one, large-star and small-star steps alternate until nothing changes; every step
    is a partial minimum by node and a join, written to the shared folder. A step's table goes when the next one is written."""
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def star(e: DataFrame, small: bool) -> DataFrame:
        e = e.filter("v <= u") if small else e
        least = e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = e.join(least, "u")
        if small:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        else:
            out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.filter("a != b").distinct()

    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b"))
    tasks = -(-edges.count() // at_once)
    before, edges = edges, materialize(edges.coalesce(max(1, tasks)).mapInPandas(_forests(at_once), "a long, b long"))
    release(before)
    digest = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    was = digest(edges) if tasks > 1 else (0,)
    while was[0]:
        before, edges = edges, materialize(star(both(star(both(edges), False)), True))
        now = digest(edges)
        release(before)
        if now == was:
            break
        was = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _short(x: np.ndarray) -> bytes:
    """Whole numbers as bytes, compressed; like bytes of neighbours stand side by side."""
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def _long(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def packed(shingle: np.ndarray, buckets: int, number: np.ndarray, doc: np.ndarray | None = None) -> pd.DataFrame:
    """Shingles dealt by bucket, a row each: five bytes of every shingle, and with each a whole number and a doc_id, if given."""
    bucket = ((shingle >> _U(40)) % _U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, number = bucket[order], number[order].astype("<i8")
    low = np.ascontiguousarray(shingle[order].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, int)
    at = list(zip(edge[:-1], edge[1:], strict=True))
    docs = [b""] * len(at) if doc is None else [_short(np.diff(doc[order[i:j]].astype("<i8"), prepend=0)) for i, j in at]
    return pd.DataFrame({"bucket": bucket[edge[:-1]], "keys": [low[i:j].tobytes() for i, j in at], "numbers": [_short(number[i:j]) for i, j in at], "docs": docs})


def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each bucket of rows sorted by bucket: keys (the five bytes, and the bucket), numbers and doc_ids."""
    for pdf in _whole_runs(batches, "bucket", 1):
        bucket = pdf.bucket.to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            some = pdf[i:j]
            low = np.frombuffer(b"".join(some["keys"]), np.uint8).reshape(-1, 5)
            key = np.zeros((len(low), 8), np.uint8)
            key[:, :5] = low
            key = key.view("<u8").reshape(-1).astype(np.int64) | (int(bucket[i]) << 40)
            doc = np.concatenate([np.cumsum(_long(d, "<i8")) if d else np.zeros(0, np.int64) for d in some["docs"]])
            yield key, np.concatenate([_long(x, "<i8") for x in some["numbers"]]), doc


_PACKED = "bucket int, keys binary, numbers binary, docs binary"


def _counts(shingle: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their summed counts."""
    order = np.argsort(shingle)
    shingle, n = shingle[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]])) if len(shingle) else np.zeros(0, int)
    return shingle[first], np.add.reduceat(n, first) if len(first) else n


def _frequent(words: int, threshold: Threshold, buckets: int, most: int = 1_000_000):
    """Packed shingles of a partition, each with how many of its texts hold it, as two kinds of rows: the first ones of each text in
    the order of their hashes, counted exactly, as sets meet by those; and, with negative counts, any that several texts hold, from
    a summary of bounded size: when it is full, each count goes down by the least there is, so counts are never too high."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, held, waiting, size = Shingler(words), (np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)), [], 0
        heads, ahead = [], 0

        def merge(summary):
            flat, n = _counts(np.concatenate([summary[0], *waiting]), np.concatenate([summary[1], np.ones(size, dtype=np.int64)]))
            while len(flat) > most:
                n = n - n.min()
                flat, n = flat[n > 0], n[n > 0]
            return flat, n

        def counted_heads() -> pd.DataFrame:
            flat = np.concatenate([np.zeros(0, dtype=_U), *heads])
            flat, n = _counts(flat, np.ones(len(flat), dtype=np.int64))
            return packed(flat, buckets, n)

        for pdf in batches:
            for text in pdf.text:
                s = shingles(text)
                waiting.append(s)
                size += len(s)
                heads.append(s[: threshold.prefix(len(s))[0]].copy() if len(s) else s)
                ahead += len(heads[-1])
                if size > most // 2:
                    held, waiting, size = merge(held), [], 0
                if ahead > PACKED:
                    yield counted_heads()
                    heads, ahead = [], 0
        yield counted_heads()
        flat, n = merge(held)
        several = n > 1
        yield packed(flat[several], buckets, -n[several])

    return run


def _summed(frequent: int):
    """Which packed shingles at least so many texts hold, by what is counted exactly or by the summaries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, n, _ in unpacked(batches):
            exact, some = _counts(key[n > 0], n[n > 0]), _counts(key[n < 0], -n[n < 0])
            shingle, n = np.concatenate([exact[0], some[0]]), np.concatenate([exact[1], some[1]])
            order = np.lexsort((-n, shingle))
            shingle, n = shingle[order], n[order]
            keep = np.concatenate([[True], shingle[1:] != shingle[:-1]]) & (n >= frequent)
            yield pd.DataFrame({"shingle": shingle[keep] & int(_LOW), "n": n[keep]})

    return run


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _whole_runs(batches: Iterator[pd.DataFrame], column: str, least: int = 100_000) -> Iterator[pd.DataFrame]:
    """Frames that hold whole runs of ``column``, of at least ``least`` rows but for the last one."""
    held, rows = [], 0
    for pdf in batches:
        held.append(pdf)
        rows += len(pdf)
        if rows < least:
            continue
        all_ = pd.concat(held, ignore_index=True)
        value = all_[column].to_numpy()
        last = int(np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))[-1])
        if last:
            yield all_[:last]
        held, rows = [all_[last:]], len(all_) - last
        least = max(least, 2 * rows)
    if rows:
        yield pd.concat(held, ignore_index=True)


def similarity_join(docs: DataFrame, words: int = 3, threshold: Threshold = Threshold(9, 10), block: int = BLOCK_SHINGLES, few: int = FEW, frequent: int = FREQUENT, busy: int = BUSY) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    component_id is the smallest doc_id reachable by links, itself included; links are pairs of sets with a Jaccard similarity
    of at least ``threshold``. Null and empty texts have no shingles and no links. Rows with one doc_id count as linked. Rows
    with a null doc_id take no part and get a null component. Very long texts are read whole. Other columns are ignored.
    Sets are held as 64-bit hashes: two texts could only be linked wrongly by a collision within that pair.
    """
    spark, batch = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(batch)
    spark.conf.set(batch, str(min(TEXTS, int(was)) if int(was) > 0 else TEXTS))
    try:
        return _joined(docs, words, threshold, block, few, frequent, busy)
    finally:
        spark.conf.set(batch, was)


def _joined(docs: DataFrame, words: int, threshold: Threshold, block: int, few: int, frequent: int, busy: int) -> DataFrame:
    ship(docs.sparkSession)
    lean = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    named = lean.filter(F.col("doc_id").isNotNull())
    buckets = 2 * shuffle_partitions(docs.sparkSession)
    counted = named.select("text").mapInPandas(_frequent(words, threshold, buckets), _PACKED).repartition("bucket").sortWithinPartitions("bucket")
    top = counted.mapInPandas(_summed(frequent), "shingle long, n long").orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).toPandas()
    common = Order(top.shingle.to_numpy("int64").view(_U), top.n.to_numpy("int64"), busy, _LOW)

    def signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(words)
        for pdf in batches:
            rows = []
            with np.errstate(over="ignore"):
                for doc_id, text in zip(pdf.doc_id, pdf.text, strict=True):
                    s = shingles(text)
                    if not len(s):
                        rows.append((doc_id, 0, 0, 0, 0, b"", b""))
                        continue
                    both = np.array([mixed(s).sum(dtype=_U), mixed(s ^ _U(0x5BD1E995)).sum(dtype=_U)])
                    keys, often = common.first(s, threshold.prefix(len(s))[0])
                    rows.append((doc_id, len(s), *map(int, _signed(both)), often, keys.tobytes(), parity(s)))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "h1", "h2", "busy", "keys", "bitmap"]).astype({"doc_id": "Int64"})

    made = "doc_id long, n long, h1 long, h2 long, busy int, keys binary, bitmap binary"
    signed = materialize(named.mapInPandas(signatures, made))
    same = ["n", "h1", "h2"]
    # a set stands for its copies; far fewer sets have copies than have none, so those are what is handed out
    rep = materialize(signed.filter("n > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_m")).filter("_m > 1").drop("_m"))
    few_reps = fits(rep)
    with_rep = lambda df: df.join(F.broadcast(rep), same, "left") if few_reps else split_join(df, rep, same, "left")
    copies = materialize(with_rep(signed.select("doc_id", *same)).select("doc_id", *same, F.coalesce("rep", "doc_id").alias("rep")))
    if few_reps:
        own = with_rep(signed.filter("n > 0")).filter("rep is null or rep = doc_id").drop("rep")
    else:
        rest = materialize(copies.filter("n > 0 and doc_id != rep").select("doc_id", *same).distinct())
        own = signed.filter("n > 0").join(bounded_broadcast(rest), ["doc_id", *same], "left_anti")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, held = [], 0

        def dealt_out() -> pd.DataFrame:
            length = np.array([len(k[0]) for k in keys])
            place = np.arange(held) - np.repeat(np.cumsum(length) - length, length)
            doc, n = (np.repeat(np.array([k[i] for k in keys], dtype=np.int64), length) for i in (1, 2))
            return packed(np.concatenate([k[0] for k in keys]), buckets, (n << 32) + place, doc)

        for pdf in batches:
            for doc_id, n, often, raw in zip(pdf.doc_id, pdf.n, pdf.busy, pdf["keys"], strict=True):
                one = np.frombuffer(raw, dtype=_U)
                keys.append((one[: len(one) - often], doc_id, n))
                held += len(keys[-1][0])
                if held > PACKED:
                    yield dealt_out()
                    keys, held = [], 0
        if held:
            yield dealt_out()

    def emit_busy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            often = pdf.busy.to_numpy("int64")
            yield pd.DataFrame({"key": np.frombuffer(b"".join(k[len(k) - 8 * o :] for k, o in zip(pdf["keys"], often, strict=True)), dtype=np.int64), "n": np.repeat(pdf.n.to_numpy(), often), "doc_id": np.repeat(pdf.doc_id.to_numpy("int64"), often)})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, number, doc in unpacked(batches):
            order = np.lexsort((doc, number >> 32, key))
            key = key[order]
            alike = key[1:] == key[:-1]
            several = np.concatenate([[False], alike]) | np.concatenate([alike, [False]])  # most shingles are of one set alone
            order, key = order[several], key[several]
            doc, n, place = doc[order], number[order] >> 32, number[order] & 0xFFFFFFFF
            if len(key):
                pairs, large = meeting(key, n, doc, place < threshold.prefix(n)[1], None, threshold, few, place, PAIRS_A_SET)
                yield pd.DataFrame({"key": np.zeros(len(pairs), dtype=np.int64), "a": pairs[:, 0], "b": pairs[:, 1], "n": pairs[:, 2], "pair": True})
                groups = members(key[large], doc[large], n[large])
                yield pd.DataFrame({"key": groups[:, 0], "a": groups[:, 1], "b": np.zeros(len(groups), dtype=np.int64), "n": groups[:, 2], "pair": False})

    rows = own.select("doc_id", "n", "busy", "keys").mapInPandas(emit, _PACKED)
    met = materialize(rows.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(meet, "key long, a long, b long, n long, pair boolean"))
    large = met.filter("not pair").select("key", F.col("a").alias("doc_id"), "n")
    pairs = met.filter("pair").select("a", "b", F.col("n").alias("nb"))
    if not signed.filter("busy > 0").isEmpty():
        # busy groups: the smallest set of each size class comes from a partial aggregation, and its partners stay where they are
        often = own.filter("busy > 0").select("doc_id", "n", "busy", "keys").mapInPandas(emit_busy, "key long, n long, doc_id long")
        often = often.select("key", "n", "doc_id", F.floor(F.log(F.col("n")) / float(np.log(threshold.b / threshold.a))).alias("size"))
        firsts = often.groupBy("key", "size").agg(F.min("doc_id").alias("a"))
        star = split_join(often, firsts, ["key", "size"]).filter("a != doc_id").select("a", F.col("doc_id").alias("b"), F.col("n").alias("nb"))
        # the other groups' keys are never negative
        large, pairs = large.unionByName(often.select(F.col("key").bitwiseOR(F.lit(-(1 << 63))).alias("key"), "doc_id", "n")), pairs.unionByName(star)
    bitmaps = signed.filter("n > 0").select("doc_id", "n", "bitmap")

    def near(candidates: DataFrame) -> DataFrame:
        """The pairs that bitmaps don't tell apart."""

        @F.pandas_udf("boolean")
        def far(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
            return pd.Series([bits_apart(p, q) > threshold.apart(i, j) for p, q, i, j in zip(x, y, n, m, strict=True)], dtype=bool)

        one = bitmaps.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("x"))
        two = bitmaps.select(F.col("doc_id").alias("b"), F.col("n").alias("_nb"), F.col("bitmap").alias("y"))
        if fits(candidates):
            firsts = candidates.select("a").distinct()
            both = two.join(F.broadcast(candidates), "b").join(one.join(F.broadcast(firsts), "a", "left_semi"), "a")
        else:
            both = split_join(candidates, one, ["a"]).join(two, "b")
        return materialize(both.filter(~far("x", "y", "na", "_nb")).select("a", "b", "nb").distinct())

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(words)
        for pdf in batches:
            out, held = [], 0
            for doc_id, blocks, text in zip(pdf.doc_id, pdf.blocks, pdf.text, strict=True):
                raw = shingles(text).tobytes()
                for name in blocks:
                    out.append((name["hub"], name["chunk"], name["hub"] == doc_id, doc_id, raw))
                    held += len(raw)
                    if held > 4_000_000:
                        yield pd.DataFrame(out, columns=["hub", "chunk", "is_hub", "doc_id", "shingles"])
                        out, held = [], 0
            yield pd.DataFrame(out, columns=["hub", "chunk", "is_hub", "doc_id", "shingles"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids_, sets, links = None, [], [], []

        def close() -> None:
            hubs = [i for i, d in enumerate(ids_) if d == now[0]]
            if hubs and len(sets) > len(hubs):
                lists = Block(sets, threshold)
                links.extend((now[0], ids_[j]) for i in hubs for j in lists.search(i) if ids_[j] != now[0])

        for pdf in batches:
            for hub, chunk, doc_id, raw in zip(pdf.hub, pdf.chunk, pdf.doc_id, pdf.shingles, strict=True):
                if (hub, chunk) != now:
                    if now:
                        close()
                    now, ids_, sets = (hub, chunk), [], []
                if raw:
                    ids_.append(doc_id)
                    sets.append(np.frombuffer(raw, dtype=_U))
            if len(links) > 10_000:
                yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")
                links = []
        if now:
            close()
        yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    def verified(candidates: DataFrame) -> DataFrame:
        """The linked ones of distinct pairs: each first set is searched in the lists of its partners, chunk by chunk."""
        candidates, small = gathered(candidates)
        hubs = materialize(candidates.groupBy("a").agg(F.greatest(F.lit(1), F.ceil(F.sum("nb") / block)).cast("int").alias("chunks")))
        many = hubs.filter("chunks > 1").select("a", F.col("chunks").alias("_k"))
        partners = candidates.join(bounded_broadcast(many), "a", "left")
        chunk = F.pmod(F.xxhash64("b"), F.coalesce("_k", F.lit(1))).cast("int")
        places = partners.select(F.col("b").alias("_node"), F.struct(F.col("a").alias("hub"), chunk.alias("chunk")).alias("at"))
        places = places.unionByName(hubs.select(F.col("a").alias("_node"), F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.col("a").alias("hub"), c.alias("chunk")))).alias("at")))
        placed = materialize((places.coalesce(1) if small else places).groupBy("_node").agg(F.collect_list("at").alias("blocks")))
        texts = named.join(bounded_broadcast(placed), F.col("doc_id") == F.col("_node")).select("doc_id", "blocks", "text")
        sets = texts.mapInPandas(sets_of, "hub long, chunk int, is_hub boolean, doc_id long, shingles binary")
        found = materialize(sets.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", F.desc("is_hub"), "doc_id").mapInPandas(search, "a long, b long"))
        release(hubs)
        release(placed)
        return found

    alike = near(materialize(pairs.distinct()))
    one_each = materialize(gathered(alike)[0].groupBy("b").agg(F.min("a").alias("a"), F.first("nb").alias("nb")).select("a", "b", "nb"))
    # rows of one doc_id count as linked, whatever their texts
    by_id = copies.groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least != most")
    again = copies.join(by_id, "doc_id").filter("rep != least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct()
    links = materialize(verified(one_each).select("a", "b").unionByName(again))
    found = components(links)
    few_linked = fits(found)

    def with_component(df: DataFrame, node: str, name: str) -> DataFrame:
        side = found.select(F.col("node").alias(node), F.col("component").alias("_c"))
        return df.join(F.broadcast(side) if few_linked else side, node, "left").withColumn(name, F.coalesce("_c", node)).drop("_c")

    def widened(which: DataFrame) -> DataFrame:
        """doc_id, n and a long bitmap of some sets, from their texts."""

        def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shingles = Shingler(words)
            for pdf in batches:
                sets = [shingles(text) for text in pdf.text]
                yield pd.DataFrame({"doc_id": pdf.doc_id, "n": [len(s) for s in sets], "bitmap": [parity(s, 0, WIDER) for s in sets]})

        return named.join(bounded_broadcast(which.select("doc_id").distinct()), "doc_id", "left_semi").mapInPandas(again, "doc_id long, n long, bitmap binary")

    def in_cells(large: DataFrame, forest: bool) -> DataFrame | None:
        """Near pairs in large groups: sets outside a group's main component against all of the group, dealt into cells. What no
        forest has connected is compared by long bitmaps, as the short ones leave too many pairs of such sets to be searched.
        Groups of which a forest hides pairs are named in rows of their own, by their key."""
        placed, small = gathered(materialize(with_component(large, "doc_id", "component")))
        per = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
        groups = per.groupBy("key").agg(F.sum("m").alias("rows"), F.max(F.struct("m", "component")).alias("top"), F.count(F.lit(1)).alias("c")).filter("c > 1")
        groups = materialize(groups.select("key", "rows", F.col("top.component").alias("main"), (F.col("rows") - F.col("top.m")).alias("open")))
        if groups.isEmpty():
            return None
        spread = placed.join(F.broadcast(groups), "key") if small or fits(groups) else split_join(placed, groups, ["key"])
        bits = bitmaps.select("doc_id", "bitmap", "n") if forest else materialize(widened(spread)).distinct()
        spread = bits.join(F.broadcast(spread), ["doc_id", "n"]) if small else spread.join(bits, ["doc_id", "n"])
        mine = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
        spread = spread.withColumn("i", F.ceil(F.col("open") / OPEN_ROWS).cast("int")).withColumn("j", F.ceil(F.col("rows") / ALL_ROWS).cast("int"))
        # the open sets of a group of one cell are in it once, for both sides
        spread = spread.withColumn("alone", (F.col("i") == 1) & (F.col("j") == 1))
        open_ = spread.filter("component != main").withColumn("i", F.pmod(mine, F.col("i"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("j") - 1)))
        every = spread.filter("not alone or component = main").withColumn("j", F.pmod(mine, F.col("j"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("i") - 1)))
        columns = ["key", "i", "j", "doc_id", "n", "component", "bitmap", "alone"]
        rows = open_.withColumn("open", F.lit(True)).select(*columns, "open").unionByName(every.withColumn("open", F.lit(False)).select(*columns, "open"))
        cell = F.xxhash64("key", "i", "j").alias("cell")

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in _whole_runs(batches, "cell", 1):
                edge = np.flatnonzero(np.diff(pdf.cell.to_numpy(), prepend=pdf.cell.iloc[0] - 1, append=pdf.cell.iloc[-1] + 1))
                is_open, alone, key = pdf.open.to_numpy(), pdf.alone.to_numpy(), pdf.key.to_numpy()
                for at, stop in zip(edge[:-1], edge[1:], strict=True):
                    k = at + int(is_open[at:stop].sum())
                    if at < k < stop:
                        found = close_pairs(pdf[at:k], pdf[at if alone[at:stop].any() else k : stop], threshold, forest, PAIRS_A_SET * (stop - at))
                        yield found.assign(key=pd.Series(pd.NA, index=found.index, dtype="Int64"))
                        if not found.attrs["all"]:
                            yield pd.DataFrame({"a": [-1], "b": [-1], "nb": [-1], "key": pd.array([key[at]], dtype="Int64")})

        return materialize(rows.select(cell, "key", *columns[3:], "open").repartition("cell").sortWithinPartitions("cell", F.desc("open"), "doc_id").mapInPandas(compare, "a long, b long, nb long, key long"))

    # what is still open: other pairs of different components, and in large groups first what would connect them, as nearly all of
    # it will; then whatever is still apart in those of which the first did not give all pairs
    large = materialize(large.distinct())
    known = one_each
    for forest in (True, False):
        cells = None if large is None else in_cells(large, forest)
        pairs = alike if cells is None else alike.unionByName(cells.filter("key is null").drop("key"))
        pairs = gathered(pairs)[0]
        if forest and cells is not None:
            large = large.join(bounded_broadcast(cells.filter("key is not null").select("key").distinct()), "key", "left_semi")
        elif forest:
            large = None
        pairs = (pairs if cells is None else pairs.distinct()).join(bounded_broadcast(known.select("a", "b")), ["a", "b"], "left_anti")
        pairs = materialize(with_component(with_component(pairs, "a", "_ca"), "b", "_cb").filter("_ca != _cb").select("a", "b", "nb"))
        if pairs.isEmpty():  # a pair refuted before may be all that would connect a group: then the next round looks at every pair
            release(pairs)
            continue
        late = verified(pairs)
        known = known.unionByName(pairs)
        if not late.isEmpty():
            links = links.unionByName(late)
            found = components(links)
            few_linked = fits(found)
    sides = found.select(F.col("node").alias("rep"), "component")
    joined = copies.join(F.broadcast(sides), "rep", "left") if few_linked else split_join(copies, sides, ["rep"], "left")
    out = joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    nameless = lean.filter(F.col("doc_id").isNull()).mapInPandas(signatures, made)
    return out.unionByName(nameless.select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` under links of 3-word shingle sets with a Jaccard similarity of at least 0.9."""
    return similarity_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The same in SQL, by all pairs that share a shingle.
ORACLE = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
i AS (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 2, 1))) AS k FROM w WHERE len(words) > 0), s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, k, k + 2), ' ') AS g FROM i),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p JOIN c u ON a = u.doc_id JOIN c v ON b = v.doc_id WHERE 100 * o >= 90 * (u.n + v.n - o)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a)
SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(m.root, w.doc_id) AS component_id FROM w LEFT JOIN c ON w.doc_id = c.doc_id LEFT JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m ON w.doc_id = m.doc_id"""
