"""Session helpers shared by every operator: shared scratch tables, size-checked broadcasts, distributed ranks."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A side is broadcast only when it has at most this many rows; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

#: A join key with more rows than this on one side is joined by broadcast of the other side's rows for it.
BUSY_ROWS = 1000

#: Values of an order that one window of ``carried`` spans.
CHUNK = 65_536

_made: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir``. Where it is unset, a local one in local mode (tests), which is
    the executor too; a cluster without it is an error, as no other folder is known to be shared."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(spark, "_tidewater_scratch", None) or "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark._tidewater_scratch = found
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once a context: Python code of an operator then runs wherever a worker is
    started. The archive is only what the driver serves; nobody reads the driver's folder."""
    sc = spark.sparkContext
    if not getattr(sc, "_tidewater_shipped", False):
        home = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="tidewater-"), "tidewater.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f"tidewater/{f.relative_to(home)}")
        sc.addPyFile(path)
        sc._tidewater_shipped = True


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a lineage cut that survives lost executors.

    The schema is handed to the reader, so reading back starts no inference job. Tables are removed at exit.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tidewater-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewater_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(df: DataFrame) -> None:
    """Delete the table behind what ``materialize`` returned, once everything that reads it has been written itself."""
    path = getattr(df, "_tidewater_path", None)
    if path:
        _delete(df.sparkSession, path)
        _made.remove((df.sparkSession, path))
        df._tidewater_path = None


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's own measure of how wide a shuffle is; salts follow it, so they grow with the cluster."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` when a count proves that it has at most ``limit`` rows, else ``df`` itself."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def split_join(rows: DataFrame, side: DataFrame, on: list[str], how: str = "inner", busy_rows: int = BUSY_ROWS) -> DataFrame:
    """``rows`` joined with ``side`` on equal columns, where one key may hold a large share of ``rows``.

    Keys of more than ``busy_rows`` rows are counted first; there are at most rows / ``busy_rows`` of them. Their rows stay where
    they are and meet a broadcast of ``side``'s few rows for these keys (its count is checked); all others shuffle as usual.
    ``side`` should hold few rows a key, and ``how`` is inner or left.
    """
    busy = materialize(rows.groupBy(*on).count().filter(F.col("count") > busy_rows).select(*on, F.lit(True).alias("_busy")))
    if busy.isEmpty():
        release(busy)
        return rows.join(side, on, how)
    dealt = rows.join(bounded_broadcast(busy), on, "left")
    few = materialize(side.join(bounded_broadcast(busy.drop("_busy")), on, "left_semi"))
    hot = dealt.filter("_busy").drop("_busy").join(bounded_broadcast(few), on, how)
    return hot.unionByName(dealt.filter("_busy is null").drop("_busy").join(side, on, how))


def carried(rows: DataFrame, keys: list[str], at: str, values: dict[str, Column], ordinal: str | None = None, size: int = CHUNK, short: bool = False) -> DataFrame:
    """``rows`` with, for each of ``values``, its last non-null value up to the row, in the order of the integer ``at`` within
    ``keys``; and with the row's number from 1 as ``ordinal``, if named.

    Stretches of ``size`` of ``at`` are windows of their own; what each leaves behind, a row a stretch, is carried over to the next
    ones and joined back by the same keys. So no key has to fit a task, and the rows are shuffled once. Where the caller knows that no
    key has more rows than a stretch may (``short``), a key is one window, and rows already dealt by ``keys`` stay where they are.
    """
    if short:
        whole = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumns({n: F.last(v, ignorenulls=True).over(whole) for n, v in values.items()} | ({ordinal: F.row_number().over(whole).cast("long")} if ordinal else {}))
    rows = rows.withColumns({f"_v_{n}": v for n, v in values.items()} | {"_stretch": F.floor(F.col(at) / size).cast("long")})
    inner = Window.partitionBy(*keys, "_stretch").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({n: F.last(f"_v_{n}", ignorenulls=True).over(inner) for n in values} | {"_n": F.row_number().over(inner).cast("long")})
    left = rows.groupBy(*keys, "_stretch").agg(F.max("_n").alias("_count"), *[F.max_by(n, "_n").alias(f"_l_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    left = left.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_stretch").alias("_s"), F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"), *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_b_{n}") for n in values])
    on: Column = F.col("_stretch") == F.col("_s")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = rows.join(left, on).withColumns({n: F.coalesce(n, f"_b_{n}") for n in values} | ({ordinal: F.col("_n") + F.col("_before")} if ordinal else {}))
    return out.drop("_stretch", "_s", "_n", "_before", *[f"_k_{k}" for k in keys], *[f"_{x}_{n}" for n in values for x in "vb"])


def salted_rank(df: DataFrame, keys: list[str], order: list[str], name: str, salts: int | None = None) -> DataFrame:
    """A gapless rank from 0 within ``keys`` without ever holding one key in one task.

    Rows are dealt by (keys, salt); each salt is ranked by itself and shifted by the rows of the salts before it. The
    rank is a function of the row contents alone. Null keys form a key of their own.
    """
    n = salts or shuffle_partitions(df.sparkSession)
    salt = F.pmod(F.xxhash64(*order), F.lit(n)).cast("int")
    df = df.withColumn("_salt", salt)
    counts = df.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    counts = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_salt").alias("_s"), "_before")
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    ranked = df.withColumn("_in", F.row_number().over(inner) - 1)
    on: Column = F.col("_salt") == F.col("_s")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = ranked.join(bounded_broadcast(counts), on)
    return out.withColumn(name, (F.col("_in") + F.col("_before")).cast("long")).drop("_salt", "_s", "_before", "_in", *[f"_k_{k}" for k in keys])
