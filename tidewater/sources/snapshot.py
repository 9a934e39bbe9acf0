"""Incremental re-analysis: fingerprints of modules, what changed since the last snapshot, what depends on it, and tables that are
renewed for those modules alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import graph
from tidewater.spark import materialize, release

#: Folders that a renewed table is kept in: a module's rows all lie in one, so a change rewrites only its folder.
PARTS = 256


def fingerprints(modules: DataFrame) -> DataFrame:
    """(module_id, digest) of texts (module_id, value); a null text counts as empty."""
    return modules.select("module_id", F.sha2(F.coalesce("value", F.lit("")), 256).alias("digest"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(module_id, digest) of files by path, size and time of change: the contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("module_id"), F.sha2(F.concat_ws("|", "path", "length", F.unix_micros("modificationTime")), 256).alias("digest"))


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(module_id, digest, state): added, changed, removed or same; the digest is that of now, null if removed. One full join."""
    old = before.select("module_id", F.col("digest").alias("_was"))
    state = F.when(F.col("_was").isNull(), "added").when(F.col("digest").isNull(), "removed").when(F.col("digest") != F.col("_was"), "changed").otherwise("same")
    return now.join(old, "module_id", "full").select("module_id", "digest", state.alias("state"))


def uses(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(module_id, used): modules that call what another module defines."""
    made = functions.filter("not is_declaration").select(F.col("module_id").alias("used"), F.col("name").alias("callee")).distinct()
    return calls.select("module_id", "callee").distinct().join(made, "callee").filter("module_id != used").select("module_id", "used").distinct()


def stale(changed: DataFrame, used: DataFrame) -> DataFrame:
    """``changed`` with the state affected for modules that are the same but use, through any number of others, one that isn't."""
    changed = materialize(changed)
    first = changed.filter("state != 'same'").select(F.col("module_id").alias("node"), F.lit(0).alias("root"))
    reached = graph.closure(used.select(F.col("used").alias("src"), F.col("module_id").alias("dst")), first, []).select(F.col("node").alias("module_id"), "root")
    state = F.when((F.col("state") == "same") & F.col("root").isNotNull(), "affected").otherwise(F.col("state"))
    return changed.join(reached, "module_id", "left").select("module_id", "digest", state.alias("state"))


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("module_id"), F.lit(parts)).cast("int").alias("part")


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _path(spark, path)
    return fs.exists(where)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


def upsert(spark: SparkSession, path: str, rows: DataFrame, old: DataFrame, parts: int = PARTS) -> None:
    """Replace the rows of the modules in ``old`` (module_id) by ``rows``. Only the folders of modules in either are read and
    overwritten; at most ``parts`` folder numbers reach the driver. A run that is lost midway is made good by the next one."""
    if not exists(spark, path):
        rows.withColumn("part", _part(parts)).repartition("part").write.partitionBy("part").parquet(path)
        return
    gone = materialize(old.select("module_id").unionByName(rows.select("module_id")).distinct())
    touched = sorted(r["part"] for r in gone.select(_part(parts)).distinct().collect())
    if touched:
        kept = spark.read.parquet(path).filter(F.col("part").isin(touched)).join(gone, "module_id", "left_anti")
        new = materialize(kept.unionByName(rows.withColumn("part", _part(parts))))
        new.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
        full = {r["part"] for r in new.select("part").distinct().collect()}
        for part in touched:
            if part not in full:
                where, fs = _path(spark, f"{path}/part={part}")
                fs.delete(where, True)
        release(new)
        spark.catalog.refreshByPath(path)
    release(gone)


def update(spark: SparkSession, path: str, modules: DataFrame, parse: Callable[[DataFrame], dict[str, DataFrame]], analyse: Callable[[dict[str, DataFrame]], DataFrame] | None = None, parts: int = PARTS) -> DataFrame:
    """Bring the tables under ``path`` up to date with ``modules`` (module_id, value) and return (module_id, digest, state).

    ``parse`` makes tables with a module_id, ``functions`` and ``calls`` among them, from the texts of new and changed modules alone.
    ``analyse`` makes one table from them; it is given the stale modules' rows and those of the modules they use, and its rows
    of stale modules are renewed. The snapshot's digests are written last: a lost run is repeated by the next.
    """
    manifest = f"{path}/snapshot"
    now = materialize(fingerprints(modules))
    before = read(spark, manifest) if exists(spark, manifest) else now.limit(0)
    changed = materialize(changes(now, before))
    reparse = changed.filter("state in ('added', 'changed')").select("module_id")
    old = changed.filter("state in ('changed', 'removed')").select("module_id")
    tables = {name: materialize(df) for name, df in parse(modules.join(reparse, "module_id", "left_semi")).items()}
    names = [f"{path}/{name}" for name in ("functions", "calls")]
    was = [read(spark, n).select(*c) if exists(spark, n) else tables[n.rsplit("/", 1)[1]].select(*c).limit(0) for n, c in zip(names, (["module_id", "name", "is_declaration"], ["module_id", "callee"]), strict=True)]
    defined = was[0].unionByName(tables["functions"].select(*was[0].columns))
    state = materialize(stale(changed, uses(defined, was[1].unionByName(tables["calls"].select(*was[1].columns)))))
    for name, df in tables.items():
        upsert(spark, f"{path}/{name}", df, old, parts)
    if analyse is not None:
        due = state.filter("state in ('added', 'changed', 'affected')").select("module_id")
        full = {name: read(spark, f"{path}/{name}") for name in tables}
        needed = uses(full["functions"], full["calls"]).join(due, "module_id", "left_semi").select(F.col("used").alias("module_id")).unionByName(due).distinct()
        needed = materialize(needed)
        found = analyse({name: df.join(needed, "module_id", "left_semi") for name, df in full.items()}).join(due, "module_id", "left_semi")
        upsert(spark, f"{path}/analysis", materialize(found), state.filter("state != 'same'").select("module_id"), parts)
    upsert(spark, manifest, now.join(reparse, "module_id", "left_semi"), old, parts)
    return state
