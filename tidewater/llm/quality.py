"""Quality classifier: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.text import table
from tidewater.spark import ship

#: Words of a passage; documents are cut into consecutive passages, the last one shorter.
PASSAGE = 80
#: Bound on the labelled documents and on the passages that the fit collects to the driver.
MAX_DOCS, MAX_PASSAGES = 2000, 16_000
HIDDEN, ATTENTION, ROUNDS = 24, 12, 200
THRESHOLD = 0.3

FEATURES = (
    "letters", "upper", "digits", "punctuation", "symbols", "pipes", "exclamations", "non_ascii", "mean_word", "log_words", "distinct", "same_as_last", "capital_words", "ends_mid", "ends_stop", "one_char", "long_words", "newlines", "periods", "doubled"
)

#: Class of each of the first 256 code points; the rest count as letters outside ASCII.
_UPPER, _LOWER, _DIGIT, _STOP, _SYMBOL, _SPACE = 1, 2, 3, 4, 5, 0


def _classes() -> np.ndarray:
    out = np.full(256, _SYMBOL, dtype=np.uint8)
    for i in range(256):
        c = chr(i)
        if c.isspace():
            out[i] = _SPACE
        elif c.isupper():
            out[i] = _UPPER
        elif c.isalpha():
            out[i] = _LOWER
        elif c.isdigit():
            out[i] = _DIGIT
        elif c in ".,;:?'\"()-":
            out[i] = _STOP
    return out


_CLASS = _classes()
_SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def passages(text: str | None) -> np.ndarray:
    """Features of every passage of the whole text, one row a passage; an empty text has one passage of zeros."""
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), dtype="<u4")
    small = np.minimum(points, 255).astype(np.uint8)
    blank = _SPACES[small] & (points < 256)
    solid = ~blank
    edges = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).view(np.int8)))
    first, stop = edges[::2], edges[1::2]
    if not len(first):
        return np.zeros((1, len(FEATURES)))
    kind = np.where(points < 256, _CLASS[small], np.where((points >= 0x2000) & (points < 0x3000), _SYMBOL, _LOWER)).astype(np.uint8)
    at = np.arange(0, len(first), PASSAGE)
    cuts = first[at]
    chars = np.diff(np.append(cuts, stop[-1])).astype(float)
    solid_n = np.maximum(1, np.add.reduceat(solid.astype(np.int32), cuts)).astype(float)
    share = lambda flag: np.add.reduceat(flag.astype(np.int32), cuts) / solid_n
    n_words = np.diff(np.append(at, len(first))).astype(float)
    by_word = lambda flag: np.add.reduceat(flag.astype(np.int32), at) / n_words
    length, last, initial = stop - first, kind[stop - 1], kind[first]
    # a word's hash, to tell repeats: its sum, its length and its first and last code points
    sums = np.add.reduceat(points.astype(np.uint64) * (np.arange(len(points), dtype=np.uint64) * np.uint64(0) + np.uint64(2654435761)), first)
    word = sums * np.uint64(1099511628211) + length.astype(np.uint64) * np.uint64(97) + points[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + points[stop - 1].astype(np.uint64) * np.uint64(31)
    same = np.concatenate([[False], word[1:] == word[:-1]])
    group = np.repeat(np.arange(len(at)), n_words.astype(int))
    order = np.lexsort((word, group))
    w, g = word[order], group[order]
    fresh = np.concatenate([[True], (w[1:] != w[:-1]) | (g[1:] != g[:-1])])
    distinct = np.bincount(g[fresh], minlength=len(at)) / n_words
    pair = np.concatenate([points[1:] == points[:-1], [False]]) & solid & (kind == _SYMBOL)
    return np.column_stack([
        share((kind == _UPPER) | (kind == _LOWER)), share(kind == _UPPER), share(kind == _DIGIT), share(kind == _STOP), share(kind == _SYMBOL), share(points == 124), share(points == 33), share(points > 127), np.add.reduceat(length, at) / n_words / 10, np.log(n_words) / np.log(PASSAGE), distinct, by_word(same), by_word((initial == _UPPER) & (length > 1)), by_word(last == _SYMBOL), by_word((last == _STOP)), by_word(length == 1), by_word(length > 18), np.add.reduceat((points == 10).astype(np.int32), cuts) / np.maximum(1, chars) * 20, share(points == 46), share(pair)
    ])


@dataclass
class Model:
    """tanh encoder, gated attention, logistic head. All weights are small arrays."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale).clip(-3, 3) @ self.w["E"] + self.w["e"])

    def bags(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Score of each document; ``start`` has the first passage of each."""
        return _forward(self.w, ((x - self.mean) / self.scale).clip(-3, 3), start)[0]


def _forward(w, x, start):
    h = np.tanh(x @ w["E"] + w["e"])
    t, s = np.tanh(h @ w["V"] + w["v"]), 1 / (1 + np.exp(-(h @ w["U"] + w["u"])))
    a = (t * s) @ w["a"]
    n = np.diff(np.append(start, len(x)))
    bag = np.repeat(np.arange(len(start)), n)
    p = np.exp(a - np.maximum.reduceat(a, start)[bag])
    p /= np.add.reduceat(p, start)[bag]
    z = np.add.reduceat(h * p[:, None], start)
    y = 1 / (1 + np.exp(-(z @ w["c"] + w["b"])))
    return y, h, t, s, p, z, bag


def fit(x: np.ndarray, start: np.ndarray, y: np.ndarray, seed: int = 11) -> Model:
    """Full-batch Adam on the logistic loss with both classes weighing the same; no labels at all: every score is 0.5."""
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    f, init = x.shape[1], lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    w = {"E": init(f, HIDDEN), "e": np.zeros(HIDDEN), "V": init(HIDDEN, ATTENTION), "v": np.zeros(ATTENTION), "U": init(HIDDEN, ATTENTION), "u": np.zeros(ATTENTION), "a": init(ATTENTION), "c": np.zeros(HIDDEN), "b": np.zeros(1)}
    if not len(y):
        return Model(mean, scale, w)
    xs = ((x - mean) / scale).clip(-3, 3)
    weigh = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    m, v = ({k: np.zeros_like(q) for k, q in w.items()} for _ in range(2))
    for i in range(1, ROUNDS + 1):
        out, h, t, s, p, z, bag = _forward(w, xs, start)
        d = (out - y) * weigh
        dz = d[:, None] * w["c"]
        dh = p[:, None] * dz[bag]
        dp = (h * dz[bag]).sum(axis=1)
        da = p * (dp - np.add.reduceat(p * dp, start)[bag])
        dt, ds = da[:, None] * w["a"] * s * (1 - t * t), da[:, None] * w["a"] * t * s * (1 - s)
        dh = (dh + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
        grad = {"E": xs.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "v": dt.sum(0), "U": h.T @ ds, "u": ds.sum(0), "a": (da[:, None] * t * s).sum(0), "c": z.T @ d, "b": d.sum(keepdims=True)}
        for k in w:
            g = grad[k] + 1e-5 * w[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - 0.03 * (0.5 * (1 + np.cos(np.pi * i / ROUNDS))) * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-10)
    return Model(mean, scale, w)


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_passages: int = MAX_PASSAGES) -> Model:
    """Fits on a bounded sample: the ``max_docs`` labelled documents outside the held-out fold that come first by a hash of
    their id, whole texts, and of those, in the hash's order, the ones whose passages number at most ``max_passages`` together."""
    ship(docs.sparkSession)
    ids = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("_y"))
    order = F.xxhash64(F.lit(3), "doc_id")
    few = F.broadcast(ids.orderBy(order, "doc_id").limit(max_docs).withColumnRenamed("doc_id", "_id"))
    texts = docs.select("doc_id", "text").join(few, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_y")

    def run(batches):
        for pdf in batches:
            bags = [passages(t if isinstance(t, str) else None) for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "y": pdf["_y"], "n": [len(b) for b in bags], "x": [b.astype("<f4").tobytes() for b in bags]})

    made = texts.mapInPandas(run, "doc_id long, y int, n long, x binary")
    # whole texts, but a document of more passages than a sixteenth of the bound would crowd out the others
    rows = made.filter(F.col("n") * 16 <= max_passages).orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id", "x").limit(max_docs).collect()
    kept, total = [], 0
    for r in rows:
        if total + r["n"] <= max_passages:
            kept.append(r)
            total += r["n"]
    kept.sort(key=lambda r: (r["doc_id"], r["x"]))  # the fit's sums don't depend on the hash
    x = np.concatenate([np.zeros((0, len(FEATURES))), *[np.frombuffer(r["x"], "<f4").reshape(r["n"], -1) for r in kept]])
    start = np.cumsum([0, *[r["n"] for r in kept]])[:-1].astype(int)
    return fit(x, start, np.array([r["y"] for r in kept], dtype=float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``: the chance of label 1, from every passage of the whole text. Null texts count as empty.

    Long texts are read whole, passage by passage arrays of a few numbers a word. All columns of ``docs`` stay, but one
    named score is replaced."""

    def run(batches):
        for text in batches:
            out = np.zeros(len(text))
            bags, held, first = [], 0, 0
            for i, t in enumerate(text):
                bags.append(passages(t if isinstance(t, str) else None))
                held += len(bags[-1])
                if held > 4000 or i == len(text) - 1:
                    start = np.cumsum([0, *map(len, bags)])[:-1]
                    out[first : i + 1] = model.bags(np.concatenate(bags), start)
                    bags, held, first = [], 0, i + 1
            yield pd.Series(out)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return run(batches)

    ship(docs.sparkSession)
    return docs.withColumn("score", scored(F.col("text").cast("string")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every one of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
