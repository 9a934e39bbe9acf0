"""Mixing sources to target weights by pivotal dependent rounding, reduced over a tree."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.text import table, word_count
from tidewater.spark import bounded_broadcast, materialize, ship

#: Weights by rank of the source, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No document is taken more often than this.
MOST = 3
#: Rows of a bucket on the tree's lowest level, and residuals of the buckets that one node above joins.
BUCKET_ROWS, FAN_IN = 32_768, 16


def targets(sizes: list[float], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the total by weight; what is above ``most`` times a source's size goes to the others by weight, again and
    again until none is above. A source of size 0 gets 0."""
    got, free = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    rest = float(sum(sizes))
    while free:
        each = rest / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * each >= most * sizes[i]]
        for i in full:
            got[i] = float(most * sizes[i])
            rest -= got[i]
        if not full:
            for i in free:
                got[i] = weights[i] * each
            break
        free = [i for i in free if i not in set(full)]
    return got


def pivot(size: np.ndarray, mass: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Pivotal rounding of ``mass`` (size times a fractional copy probability) to 0 or ``size``.

    Two open rows meet at a time. Mass moves from one to the other, by so much that one of them becomes integral, in a
    random direction that leaves each one's expectation as it was. The sum of all mass never changes. At most one row
    stays open; its index is returned, or -1.
    """
    mass, open_row = mass.copy(), -1
    draws = rng.random(len(mass))
    for j in range(len(mass)):
        s, m = size[j], mass[j]
        if m <= 1e-9 * s or m >= s * (1 - 1e-9):
            mass[j] = s if m > s / 2 else 0.0
            continue
        if open_row < 0:
            open_row = j
            continue
        i = open_row
        up, down = min(size[i] - mass[i], m), min(mass[i], s - m)
        a = up if draws[j] * (up + down) < down else -down
        mass[i] += a
        mass[j] -= a
        closed = [k for k in (i, j) if mass[k] <= 1e-9 * size[k] or mass[k] >= size[k] * (1 - 1e-9)]
        for k in closed:
            mass[k] = size[k] if mass[k] > size[k] / 2 else 0.0
        left = [k for k in (i, j) if k not in closed]
        open_row = left[0] if left else -1
    return mass, open_row


_NODE = "row_key long, doc_id long, source string, size long, base long, mass double, bucket long, open boolean"


def _node(seed: int, level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row_key", "doc_id", "size"], na_position="first", kind="stable").reset_index(drop=True)
        name = f"{pdf.source.iloc[0]!r} {int(pdf.bucket.iloc[0])} {level} {seed}"
        rng = np.random.default_rng(zlib.crc32(name.encode("utf-8", "surrogatepass")))
        size = pdf["size"].to_numpy(float)
        mass, i = pivot(size, pdf.mass.to_numpy(float), rng)
        is_open = np.zeros(len(pdf), dtype=bool)
        if i >= 0 and last:
            mass[i] = size[i] if rng.random() * size[i] < mass[i] else 0.0
        elif i >= 0:
            is_open[i] = True
        return pdf.assign(mass=mass, open=is_open)[["row_key", "doc_id", "source", "size", "base", "mass", "bucket", "open"]]

    return run


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """Copies of every row of ``docs`` (doc_id, text, source) so that each source's words come near its target.

    Size is the number of words (null text: 0). Sources rank by code point, null last; only one row per source (a
    dimension: name, size) comes to the driver. A row of a source with rate r = target / size is taken floor(r) times and
    once more with probability r - floor(r); those probabilities are rounded by word-weighted pivotal rounding, in buckets
    of a few thousand rows whose one open row each goes up a tree of fan-in 16, to one node a source. So each source
    misses its target by less than one document, a source of any size is spread over all tasks, and the result depends
    on row contents and the seed only.

    Returns doc_id, source, size, source_size, target, copies, taken. Rows without words are taken 0 times in words, with
    copies 1. An empty table gives an empty result. Repeated rows are drawn separately. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    lean = materialize(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size")))
    by_source = sorted(((x["source"], x["s"], x["n"]) for x in lean.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [s for _, s, _ in by_source]
    got = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))])
    dims = spark.createDataFrame([(k, int(s), float(t), float(t / s) if s else 0.0) for (k, s, _), t in zip(by_source, got, strict=True)], "_source string, source_size long, target double, rate double")
    buckets = 1
    while buckets * BUCKET_ROWS < sum(n for *_, n in by_source):
        buckets *= 2
    row_key = F.xxhash64(F.lit(seed), "doc_id", "size")
    joined = lean.join(bounded_broadcast(dims), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source_size", "target")
    base = F.least(F.floor("rate"), F.lit(MOST)).cast("long")
    rows = joined.select(row_key.alias("row_key"), "doc_id", "source", "size", base.alias("base"), (F.col("size") * (F.col("rate") - base)).alias("mass"), F.pmod("row_key", F.lit(buckets)).cast("long").alias("bucket"))
    empty = rows.filter("size = 0").select("doc_id", "source", "size", F.lit(1).cast("long").alias("copies"))
    level, frontier, done = 0, rows.filter("size > 0"), [empty]
    while True:
        out = materialize(frontier.groupBy("source", "bucket").applyInPandas(_node(seed, level, buckets == 1), _NODE))
        done.append(out.filter("not open").select("doc_id", "source", "size", (F.col("base") + (F.col("mass") > 0).cast("long")).alias("copies")))
        if buckets == 1:
            break
        frontier = out.filter("open").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long")).drop("open")
        buckets, level = math.ceil(buckets / FAN_IN), level + 1
    whole = done[0]
    for x in done[1:]:
        whole = whole.unionByName(x)
    whole = whole.join(bounded_broadcast(dims.drop("rate")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return whole.withColumn("taken", F.col("size") * F.col("copies"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``, one row a document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
