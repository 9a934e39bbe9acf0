"""Order-aware pairing of acquires and releases, as window arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fifo_match(df: DataFrame, keys: list[str], order: list[str], is_acquire: Column, is_release: Column) -> DataFrame:
    """Queue-exact pairing: the i-th release that finds the queue non-empty takes the i-th acquire of its key.

    A release on an empty queue is an orphan and takes no later acquire. With S the running sum of +1/-1 and M its running
    minimum (0 at most), a release is an orphan exactly when it lowers M. Adds ``role`` (acquire, release, orphan, other)
    and ``match_no`` (null for orphans, others and unmatched acquires).
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(is_acquire, 1).when(is_release, -1).otherwise(0)
    out = df.withColumn("_step", step).withColumn("_s", F.sum("_step").over(w))
    out = out.withColumn("_m", F.least(F.lit(0), F.min("_s").over(w)))
    before = F.coalesce(F.lag("_m").over(Window.partitionBy(*keys).orderBy(*order)), F.lit(0))
    out = out.withColumn("_orphan", (F.col("_step") == -1) & (F.col("_m") < before))
    out = out.withColumn("role", F.when(F.col("_step") == 1, "acquire").when(F.col("_orphan"), "orphan").when(F.col("_step") == -1, "release").otherwise("other"))
    acquires, releases = F.sum((F.col("role") == "acquire").cast("long")).over(w), F.sum((F.col("role") == "release").cast("long")).over(w)
    total = F.sum((F.col("role") == "release").cast("long")).over(Window.partitionBy(*keys))
    out = out.withColumn("_a", acquires).withColumn("_r", releases).withColumn("_t", total)
    number = F.when((F.col("role") == "acquire") & (F.col("_a") <= F.col("_t")), F.col("_a")).when(F.col("role") == "release", F.col("_r"))
    return out.withColumn("match_no", number.cast("long")).drop("_step", "_s", "_m", "_orphan", "_a", "_r", "_t")


def zip_pairs(df: DataFrame, keys: list[str], order: list[str], is_left: Column, value: str, how: str = "inner") -> DataFrame:
    """Positional pairing: the k-th left row of a key with its k-th right row. Null keys pair with null keys.

    ``how`` is inner (the shorter side decides) or full (unmatched tails stay). Both sides come from one pass: rows are numbered
    by side and pivoted by (key, number), so there is one shuffle and no self-join.
    """
    side = df.withColumn("_left", is_left)
    n = F.row_number().over(Window.partitionBy(*keys, "_left").orderBy(*order))
    out = side.withColumn("pair_no", n.cast("long")).groupBy(*keys, "pair_no").agg(F.max(F.when(F.col("_left"), F.col(value))).alias("left_value"), F.max(F.when(~F.col("_left"), F.col(value))).alias("right_value"))
    return out.filter(F.col("left_value").isNotNull() & F.col("right_value").isNotNull()) if how == "inner" else out


def cross_family_fallback(df: DataFrame, scope: list[str], family: str, value: str, is_acquire: Column, compat: DataFrame) -> DataFrame:
    """Residual releases paired with the one residual acquire of their scope, where both families are known and don't go
    together. A scope with several residual acquires gives no pair."""
    acquires = df.filter(is_acquire & F.col(family).isNotNull()).groupBy(*scope).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("acquire_value"), F.min(family).alias("acquire_family")).filter("_n = 1").drop("_n")
    releases = df.filter(~is_acquire & F.col(family).isNotNull()).select(*scope, F.col(value).alias("release_value"), F.col(family).alias("release_family"))
    return acquires.join(releases, scope).join(F.broadcast(compat), ["acquire_family", "release_family"], "left_anti")


def repeated_release(df: DataFrame, keys: list[str], order: list[str], is_release: Column, caller: str) -> DataFrame:
    """All releases of an instance but the first, with the first one's caller."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.filter(is_release).withColumn("release_no", F.row_number().over(w).cast("long")).withColumn("first_caller", F.first(caller).over(w))
    return rows.filter("release_no > 1")


def use_after_release(df: DataFrame, keys: list[str], order: str, is_release: Column, is_use: Column) -> DataFrame:
    """Uses of an instance that come after its last release."""
    last = F.max(F.when(is_release, F.col(order))).over(Window.partitionBy(*keys))
    return df.withColumn("last_release", last).filter(is_use & (F.col(order) > F.col("last_release")))


def after_first(df: DataFrame, keys: list[str], order: str, marks: Column) -> DataFrame:
    """Rows of a key that come after the first marked row."""
    first = F.min(F.when(marks, F.col(order))).over(Window.partitionBy(*keys))
    return df.withColumn("first_mark", first).filter(F.col(order) > F.col("first_mark"))


def unchecked_use(df: DataFrame, keys: list[str], order: str, is_check: Column, is_use: Column) -> DataFrame:
    """Keys whose first use comes before any check: (keys, first_use, first_check)."""
    out = df.groupBy(*keys).agg(F.min(F.when(is_use, F.col(order))).alias("first_use"), F.min(F.when(is_check, F.col(order))).alias("first_check"))
    return out.filter(F.col("first_use").isNotNull() & (F.col("first_check").isNull() | (F.col("first_use") < F.col("first_check"))))


def proximity(df: DataFrame, keys: list[str], order: list[str], number: str, is_anchor: Column) -> DataFrame:
    """Distance in rows to the nearest anchor before or after, null if the key has none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.last(F.when(is_anchor, F.col(number)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(F.when(is_anchor, F.col(number)), ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return df.withColumn("distance", F.least(F.col(number) - before, after - F.col(number)))
