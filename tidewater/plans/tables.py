"""Projections of the driver's tables into the fact schema that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The life-cycle step that each event type stands for.
EVENT_STEPS = {"signup": "Acquire", "purchase": "Release", "error": "ConditionalRelease", "view": "Retain", "click": "Borrow"}


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as raw facts: one caller per user, three families, order by (ts, event_id)."""
    step = F.create_map(*[F.lit(x) for kv in EVENT_STEPS.items() for x in kv])
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("caller"), (F.col("event_id") % 3).alias("family"), "ts", F.col("event_id").alias("ord"), step[F.col("event_type")].alias("event"), F.col("event_type").alias("kind"), "value"
    )


#: The same in SQL, as a common table expression.
FACTS_SQL = """facts AS (SELECT user_id AS caller, event_id % 3 AS family, ts, event_id AS ord,
  CASE event_type WHEN 'signup' THEN 'Acquire' WHEN 'purchase' THEN 'Release' WHEN 'error' THEN 'ConditionalRelease'
    WHEN 'view' THEN 'Retain' WHEN 'click' THEN 'Borrow' END AS event, event_type AS kind, value FROM events)"""
