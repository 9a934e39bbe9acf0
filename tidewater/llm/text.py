"""What several operators here share: word counting, text fingerprints, reading tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the ASCII white space characters. Fixed by the operators' contracts.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null: each word shrinks to one character, then white space goes."""
    shrunk = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(shrunk, " \t\n\x0b\f\r", "")).cast("long")


def utf8(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")
