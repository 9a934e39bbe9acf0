"""Queries of the matching family: events as raw facts, one caller a user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import matching
from tidewater.plans.tables import FACTS_SQL, facts, read

QUERIES, ORACLE = {}, {}


def w1_fifo_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matching.fifo_match(facts(spark, sf_dir), ["caller", "family"], ["ts", "ord"], F.col("event") == "Acquire", F.col("event") == "Release")
    return out.filter(F.col("role") != "other").select("caller", "family", "ord", "role", "match_no")


_FIFO = f"""{FACTS_SQL}, s AS (SELECT *, CASE event WHEN 'Acquire' THEN 1 WHEN 'Release' THEN -1 ELSE 0 END AS step FROM facts),
r AS (SELECT *, sum(step) OVER (PARTITION BY caller, family ORDER BY ts, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM s),
m AS (SELECT *, least(0, min(run) OVER (PARTITION BY caller, family ORDER BY ts, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS low FROM r),
l AS (SELECT *, coalesce(lag(low) OVER (PARTITION BY caller, family ORDER BY ts, ord), 0) AS was FROM m),
o AS (SELECT *, CASE WHEN step = 1 THEN 'acquire' WHEN step = -1 AND low < was THEN 'orphan' WHEN step = -1 THEN 'release' ELSE 'other' END AS role FROM l),
c AS (SELECT *, sum(CASE WHEN role = 'acquire' THEN 1 ELSE 0 END) OVER (PARTITION BY caller, family ORDER BY ts, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
  sum(CASE WHEN role = 'release' THEN 1 ELSE 0 END) OVER (PARTITION BY caller, family ORDER BY ts, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
  sum(CASE WHEN role = 'release' THEN 1 ELSE 0 END) OVER (PARTITION BY caller, family) AS t FROM o)"""
QUERIES["w1_fifo_match"] = w1_fifo_match
ORACLE["w1_fifo_match"] = f"""WITH {_FIFO} SELECT caller, family, ord, role,
  CAST(CASE WHEN role = 'acquire' AND a <= t THEN a WHEN role = 'release' THEN b END AS BIGINT) AS match_no FROM c WHERE role <> 'other'"""


def j4_fifo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each matched release with the acquire it takes, from one matching pass."""
    out = matching.fifo_match(facts(spark, sf_dir), ["caller", "family"], ["ts", "ord"], F.col("event") == "Acquire", F.col("event") == "Release").filter("match_no is not null")
    pick = lambda role: F.max(F.when(F.col("role") == role, F.col("ord")))
    return out.groupBy("caller", "family", "match_no").agg(pick("acquire").alias("acquire_ord"), pick("release").alias("release_ord"))


QUERIES["j4_fifo_pairs"] = j4_fifo_pairs
ORACLE["j4_fifo_pairs"] = f"""WITH {_FIFO}, n AS (SELECT caller, family, ord, role, CAST(CASE WHEN role = 'acquire' AND a <= t THEN a WHEN role = 'release' THEN b END AS BIGINT) AS match_no FROM c)
SELECT x.caller, x.family, x.match_no, x.ord AS acquire_ord, y.ord AS release_ord FROM n x JOIN n y
  ON x.caller = y.caller AND x.family = y.family AND x.match_no = y.match_no AND x.role = 'acquire' AND y.role = 'release'"""

_PAIR = "event IN ('Acquire', 'Release')"


def j7_zip_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).filter(_PAIR).withColumn("family", F.when(F.col("family") > 0, F.col("family")))
    out = matching.zip_pairs(rows, ["caller", "family"], ["ts", "ord"], F.col("event") == "Acquire", "ord")
    return out.select("caller", "family", "pair_no", F.col("left_value").alias("acquire_ord"), F.col("right_value").alias("release_ord"))


_NUMBERED = """z AS (SELECT *, CASE WHEN family > 0 THEN family END AS fam FROM facts WHERE event IN ('Acquire', 'Release')),
n AS (SELECT *, row_number() OVER (PARTITION BY caller, fam, event ORDER BY ts, ord) AS k, row_number() OVER (PARTITION BY caller, event ORDER BY ts, ord) AS kc FROM z),
a AS (SELECT * FROM n WHERE event = 'Acquire'), r AS (SELECT * FROM n WHERE event = 'Release')"""
QUERIES["j7_zip_pairs"] = j7_zip_pairs
ORACLE["j7_zip_pairs"] = f"""WITH {FACTS_SQL}, {_NUMBERED} SELECT a.caller, a.fam AS family, CAST(a.k AS BIGINT) AS pair_no, a.ord AS acquire_ord, r.ord AS release_ord
FROM a JOIN r ON a.caller = r.caller AND a.fam IS NOT DISTINCT FROM r.fam AND a.k = r.k"""


def j8_zip_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matching.zip_pairs(facts(spark, sf_dir).filter(_PAIR), ["caller"], ["ts", "ord"], F.col("event") == "Acquire", "ord", "full")
    return out.select("caller", "pair_no", F.col("left_value").alias("acquire_ord"), F.col("right_value").alias("release_ord"))


QUERIES["j8_zip_full"] = j8_zip_full
ORACLE["j8_zip_full"] = f"""WITH {FACTS_SQL}, {_NUMBERED} SELECT coalesce(a.caller, r.caller) AS caller, CAST(coalesce(a.kc, r.kc) AS BIGINT) AS pair_no, a.ord AS acquire_ord, r.ord AS release_ord
FROM a FULL OUTER JOIN r ON a.caller = r.caller AND a.kc = r.kc"""


def j5_cross_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = matching.fifo_match(facts(spark, sf_dir), ["caller", "family"], ["ts", "ord"], F.col("event") == "Acquire", F.col("event") == "Release")
    rest = left.filter("(role = 'acquire' and match_no is null) or role = 'orphan'")
    compat = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (0, 1)], "acquire_family long, release_family long")
    return matching.cross_family_fallback(rest, ["caller"], "family", "ord", F.col("role") == "acquire", compat)


QUERIES["j5_cross_family"] = j5_cross_family
ORACLE["j5_cross_family"] = f"""WITH {_FIFO}, ac AS (SELECT caller, min(ord) AS acquire_value, min(family) AS acquire_family FROM c WHERE role = 'acquire' AND a > t GROUP BY caller HAVING count(*) = 1)
SELECT ac.caller, ac.acquire_value, ac.acquire_family, o.ord AS release_value, o.family AS release_family FROM ac JOIN c o ON ac.caller = o.caller AND o.role = 'orphan'
WHERE ac.acquire_family <> o.family AND NOT (ac.acquire_family = 0 AND o.family = 1)"""


def w3_repeated_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matching.repeated_release(facts(spark, sf_dir), ["caller", "family"], ["ts", "ord"], F.col("event") == "Release", "ord")
    return out.select("caller", "family", "ord", "release_no", F.col("first_caller").alias("first_ord"))


QUERIES["w3_repeated_release"] = w3_repeated_release
ORACLE["w3_repeated_release"] = f"""WITH {FACTS_SQL}, n AS (SELECT caller, family, ord, row_number() OVER (PARTITION BY caller, family ORDER BY ts, ord) AS release_no,
  first_value(ord) OVER (PARTITION BY caller, family ORDER BY ts, ord) AS first_ord FROM facts WHERE event = 'Release')
SELECT caller, family, ord, CAST(release_no AS BIGINT) AS release_no, first_ord FROM n WHERE release_no > 1"""


def w2_use_after_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matching.use_after_release(facts(spark, sf_dir), ["caller", "family"], "ord", F.col("event") == "Release", F.col("event").isin("Retain", "Borrow"))
    return out.select("caller", "family", "ord", "event", "last_release")


QUERIES["w2_use_after_release"] = w2_use_after_release
ORACLE["w2_use_after_release"] = f"""WITH {FACTS_SQL}, n AS (SELECT *, max(CASE WHEN event = 'Release' THEN ord END) OVER (PARTITION BY caller, family) AS last_release FROM facts)
SELECT caller, family, ord, event, last_release FROM n WHERE event IN ('Retain', 'Borrow') AND ord > last_release"""


def w4_after_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.after_first(facts(spark, sf_dir), ["caller"], "ord", F.col("event") == "Release").filter("event = 'Borrow'").select("caller", "ord", "first_mark")


QUERIES["w4_after_first"] = w4_after_first
ORACLE["w4_after_first"] = f"""WITH {FACTS_SQL}, n AS (SELECT *, min(CASE WHEN event = 'Release' THEN ord END) OVER (PARTITION BY caller) AS first_mark FROM facts)
SELECT caller, ord, first_mark FROM n WHERE ord > first_mark AND event = 'Borrow'"""


def w5_unchecked_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.unchecked_use(facts(spark, sf_dir), ["caller", "family"], "ord", F.col("kind") == "view", F.col("kind") == "purchase")


QUERIES["w5_unchecked_use"] = w5_unchecked_use
ORACLE["w5_unchecked_use"] = f"""WITH {FACTS_SQL}, n AS (SELECT caller, family, min(CASE WHEN kind = 'purchase' THEN ord END) AS first_use, min(CASE WHEN kind = 'view' THEN ord END) AS first_check FROM facts GROUP BY caller, family)
SELECT * FROM n WHERE first_use IS NOT NULL AND (first_check IS NULL OR first_use < first_check)"""


def w7_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    out = matching.proximity(turns, ["conv_id"], ["turn", "role"], "turn", F.col("role") == "assistant")
    return out.select("conv_id", "turn", "role", "distance")


QUERIES["w7_proximity"] = w7_proximity
ORACLE["w7_proximity"] = """WITH n AS (SELECT conv_id, turn, role, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
  min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM conversations)
SELECT conv_id, turn, role, CASE WHEN a IS NULL THEN turn - b WHEN b IS NULL THEN a - turn ELSE least(turn - b, a - turn) END AS distance FROM n"""
