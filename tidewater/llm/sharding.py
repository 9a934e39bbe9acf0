"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.text import table, utf8, word_count
from tidewater.spark import materialize, salted_rank

#: Groups smaller than 1/GRAIN of every total are packed together in at most this many lots; the rest, at most 3 * GRAIN
#: groups by the pigeonhole principle, are packed one by one. So at most 4 * GRAIN items reach the driver at any scale.
GRAIN = 8192


def place(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Vector bin packing of the rows of ``sizes`` (items x dimensions) into ``shards`` bins of equal capacity.

    Items go largest first; each goes where the dot product of its size with the residual capacity is highest, among the
    bins that it overfills the least. Dimensions are scaled to a capacity of 1. Ties go to the lower bin.
    """
    total = sizes.sum(axis=0)
    scaled = sizes / np.where(total > 0, total, 1) * shards
    residual = np.ones((shards, sizes.shape[1]))
    out = np.zeros(len(sizes), dtype=np.int64)
    for i in np.lexsort((np.arange(len(sizes)), -scaled.sum(axis=1), -scaled.max(axis=1))):
        over = np.maximum(scaled[i] - residual, 0).max(axis=1)
        fits = over <= over.min() + 1e-12
        out[i] = np.argmax(np.where(fits, residual @ scaled[i], -np.inf))
        residual[out[i]] -= scaled[i]
    return even_out(scaled[:, 0], out, shards)


def even_out(weight: np.ndarray, where: np.ndarray, shards: int, moves: int = 256) -> np.ndarray:
    """Levels the first dimension: moves the item nearest to half the gap from the fullest to the emptiest bin."""
    load = np.bincount(where, weights=weight, minlength=shards)
    for _ in range(moves if len(where) else 0):
        full, empty = int(load.argmax()), int(load.argmin())
        gap = load[full] - load[empty]
        mine = np.flatnonzero((where == full) & (weight < gap) & (weight > 0))
        if not len(mine):
            break
        i = mine[np.abs(weight[mine] - gap / 2).argmin()]
        where[i] = empty
        load[full] -= weight[i]
        load[empty] += weight[i]
    return where


def shard(docs: DataFrame, shards: int = 8, grain: int = GRAIN) -> DataFrame:
    """Deal every row of ``docs`` (doc_id, text, ...) into ``shards`` shards whose bytes, tokens and rows are near equal.

    Size is the UTF-8 bytes of the text plus 1 (null text: 1). Rows with equal texts form a group and stay together,
    unless a group alone exceeds half a shard in one dimension: it is then cut into the fewest even parts of at most half
    a shard. Null and empty texts are one group. Returns doc_id, size, tokens, text_crc32, group_key, shard, slot (gapless from
    0 within a shard). An empty table gives an empty result; columns other than doc_id and text are ignored; repeated rows
    are each placed.
    """
    raw = utf8(F.col("text"))
    lean = docs.select(
        "doc_id",
        (F.length(raw) + 1).cast("long").alias("size"),
        word_count(F.col("text")).alias("tokens"),
        F.crc32(raw).alias("text_crc32"),
        F.md5(raw).alias("group_key"),
    )
    lean = materialize(lean)
    spark = docs.sparkSession
    groups = lean.groupBy("group_key").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r"))
    totals = groups.agg(*[F.sum(c).alias(c) for c in "btr"]).first()
    total = {c: max(1, totals[c] or 0) for c in "btr"}
    # A group of more than half a shard in some dimension is cut; the parts are dealt round robin by a salted rank.
    share = F.greatest(*[F.col(c) * F.lit(2.0 * shards / total[c]) for c in "btr"])
    groups = groups.withColumn("parts", F.when(F.col("r") > 1, F.least(F.ceil(share), F.col("r"))).otherwise(1).cast("long"))
    heavy = F.greatest(*[F.col(c) / F.lit(float(total[c])) for c in "btr"]) >= 1.0 / grain
    lots = groups.withColumn("item", F.when(heavy, F.col("group_key")).otherwise(F.pmod(F.xxhash64("group_key"), F.lit(grain)).cast("string")))
    items = lots.groupBy("item").agg(*[F.sum(c).alias(c) for c in "btr"], F.max("parts").alias("parts")).orderBy("item").collect()
    cut = [(x["item"], p, x["parts"]) for x in items for p in range(x["parts"])]
    sizes = np.array([[x[c] / x["parts"] for c in "btr"] for x in items for _ in range(x["parts"])], dtype=float).reshape(len(cut), 3)
    where = place(sizes, shards)
    plan = spark.createDataFrame(
        [(i, p, n, int(s)) for (i, p, n), s in zip(cut, where, strict=True)],
        T.StructType([T.StructField("item", T.StringType()), T.StructField("part", T.LongType()), T.StructField("parts", T.LongType()), T.StructField("shard", T.IntegerType())]),
    )
    whole = plan.filter("parts = 1").select(F.col("item").alias("_i"), "shard")
    large = {x["item"] for x in items if x["r"] * grain >= total["r"] or x["b"] * grain >= total["b"] or x["t"] * grain >= total["t"]}
    split = sorted({i for i, _, n in cut if n > 1})
    named = F.col("group_key").isin(sorted(large)) if 0 < len(large) <= 200 else None
    key = F.pmod(F.xxhash64("group_key"), F.lit(grain)).cast("string")
    if named is None:
        big = spark.createDataFrame([(x,) for x in sorted(large)], "_big string")
        lean = lean.join(F.broadcast(big), F.col("group_key") == F.col("_big"), "left")
        lean = lean.withColumn("item", F.when(F.col("_big").isNotNull(), F.col("group_key")).otherwise(key)).drop("_big")
    else:
        lean = lean.withColumn("item", F.when(named, F.col("group_key")).otherwise(key))
    is_split = F.col("item").isin(split) if split else F.lit(False)
    placed = lean.filter(~is_split).join(F.broadcast(whole), F.col("item") == F.col("_i")).drop("_i")
    if split:
        ranked = salted_rank(lean.filter(is_split), ["item"], ["doc_id"], "_rank")
        parts = plan.filter("parts > 1").select(F.col("item").alias("_i"), F.col("part").alias("_p"), "parts", "shard")
        counts = F.broadcast(parts.select(F.col("_i").alias("_ci"), F.col("parts").alias("_cn")).distinct())
        ranked = ranked.join(counts, F.col("item") == F.col("_ci")).withColumn("_part", F.col("_rank") % F.col("_cn"))
        placed = placed.unionByName(ranked.join(F.broadcast(parts), (F.col("item") == F.col("_i")) & (F.col("_part") == F.col("_p"))).select(*placed.columns))
    return salted_rank(placed, ["shard"], ["doc_id", "group_key"], "slot").drop("item")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 7 under the law ``bytes``: the shards' sizes are near equal."""
    out = shard(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
