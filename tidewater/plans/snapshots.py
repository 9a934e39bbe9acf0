"""Queries of incremental re-analysis: an order is a module whose text are its lines, two snapshots of it are what was shipped by two
dates, and an order whose line has a large quantity uses an order near it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.plans.tables import read
from tidewater.sources import snapshot

QUERIES, ORACLE = {}, {}


def texts(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").filter(where)
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("call void @f"), "l_partkey", F.lit("()")).alias("text"))
    return lines.groupBy(F.concat(F.lit("m"), "l_orderkey").alias("module_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["text"]), "\n").alias("value"))


def s20_stale_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two snapshots and what depends on it (S-20, G-8)."""
    now, before = (snapshot.fingerprints(texts(spark, sf_dir, w)) for w in ("l_shipdate >= DATE '1992-06-01'", "l_shipdate < DATE '1998-06-01'"))
    order = F.col("l_orderkey")
    used = read(spark, sf_dir, "lineitem").filter("l_quantity > 46").select(F.concat(F.lit("m"), order).alias("module_id"), F.concat(F.lit("m"), order + F.col("l_partkey") % 9 - 4).alias("used"))
    return snapshot.stale(snapshot.changes(now, before), used.filter("module_id != used"))


QUERIES["s20_stale_modules"] = s20_stale_modules
_TEXT = "SELECT 'm' || l_orderkey AS module_id, sha256(string_agg('call void @f' || l_partkey || '()', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey)) AS digest FROM lineitem WHERE {} GROUP BY l_orderkey"
ORACLE["s20_stale_modules"] = f"""WITH RECURSIVE now_ AS ({_TEXT.format("l_shipdate >= DATE '1992-06-01'")}), old AS ({_TEXT.format("l_shipdate < DATE '1998-06-01'")}),
ch AS (SELECT coalesce(n.module_id, o.module_id) AS module_id, n.digest, CASE WHEN o.digest IS NULL THEN 'added' WHEN n.digest IS NULL THEN 'removed' WHEN n.digest <> o.digest THEN 'changed' ELSE 'same' END AS state FROM now_ n FULL JOIN old o ON n.module_id = o.module_id),
used AS (SELECT DISTINCT 'm' || l_orderkey AS a, 'm' || (l_orderkey + l_partkey % 9 - 4) AS b FROM lineitem WHERE l_quantity > 46),
hit(m) AS (SELECT module_id FROM ch WHERE state <> 'same' UNION SELECT a FROM hit JOIN used ON m = b)
SELECT module_id, digest, CASE WHEN state = 'same' AND module_id IN (SELECT m FROM hit) THEN 'affected' ELSE state END AS state FROM ch"""
