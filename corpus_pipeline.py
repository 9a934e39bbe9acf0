"""A training corpus from ``documents``: reject junk, drop near copies, mix sources to their weights, pack sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. A stage keeps
each row in one struct beside what it works with, so further columns of ``docs`` may have any names and types and come out as
they went in. Empty tables give empty results. Rows may repeat; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm import mixing, packing, quality, similarity
from tidewater.llm.text import table, word_count
from tidewater.spark import bounded_broadcast, materialize


def _nested(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns, and the whole row as ``row``."""
    return docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold; the classifier is fitted on ``labels`` of these documents.

    Null texts count as empty and are scored like any other; a null doc_id has no label and is scored too. Repeated rows get the
    same score, so all of them stay or go. Without any label every score is 0.5, and all stay."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(_nested(docs, "text"), model).filter(F.col("score") >= quality.THRESHOLD).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, Jaccard similarity of at least 0.8), that of the smallest
    doc_id. Texts without words, and rows with a null doc_id, are in no group and stay. Of rows that share a doc_id the one of the
    least text stays, ties by the row's other columns as JSON."""
    found = materialize(similarity.similarity_join(docs.select("doc_id", "text"), 5, similarity.Threshold(4, 5)).filter("doc_id is not null"))
    keep = found.filter("doc_id = component_id").groupBy("doc_id").count()
    again = keep.filter("count > 1").select("doc_id")
    rows = _nested(docs, "doc_id", "text")
    kept = rows.join(bounded_broadcast(keep.select("doc_id")), "doc_id", "left_semi")
    if not again.isEmpty():  # ids on several rows: one of them stays
        twice = materialize(again)
        one = Window.partitionBy("doc_id").orderBy("text", F.to_json("row"))
        first = kept.join(twice, "doc_id", "left_semi").withColumn("place", F.row_number().over(one)).filter("place = 1").drop("place")
        kept = kept.join(twice, "doc_id", "left_anti").unionByName(first)
    return kept.unionByName(rows.filter("doc_id is null")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a document that it doesn't take goes, and one without words (a null text too)
    stays once. Null sources are one source, the last. Rows that agree in doc_id, source and number of words share their copies
    evenly, those of the least text first."""
    keys = ["doc_id", "source", "size"]
    taken = materialize(mixing.mix(docs.select("doc_id", "source", "text")).groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("alike")))
    side = taken.select(*[F.col(k).alias(f"_{k}") for k in keys], "copies", "alike")
    rows = _nested(docs, "doc_id", "source", "text").withColumn("size", word_count(F.col("text")))
    on = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    joined = rows.join(bounded_broadcast(side), on)
    out = joined.filter("alike = 1").select("row", "copies")
    if not taken.filter("alike > 1").isEmpty():
        order = Window.partitionBy(*keys).orderBy("text", F.to_json("row"))
        several = joined.filter("alike > 1").withColumn("place", F.row_number().over(order) - 1)
        share = F.floor(F.col("copies") / F.col("alike")) + (F.col("place") < F.col("copies") % F.col("alike")).cast("long")
        out = out.unionByName(several.select("row", share.alias("copies")))
    return out.filter("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens. A null text is packed as an empty one, by its end id alone; repeated
    rows are packed each for itself; a text of more tokens than a sequence is cut and loses none."""
    return packing.pack(docs)


STAGES = [("quality classifier", keep_quality), ("n-gram jaccard join", drop_near_copies), ("mixing sources", mix_sources), ("packing", pack_sequences)]

#: Learned scores, random rounding and greedy packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
