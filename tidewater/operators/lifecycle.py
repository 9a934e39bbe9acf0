"""The ownership state machine as a fold over ordered events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.dimensions import ERRORS, EVENTS, TRANSITIONS


def _table() -> Column:
    return F.create_map(*[F.lit(x) for state, row in TRANSITIONS.items() for event, to in zip(EVENTS, row, strict=True) for x in (f"{state}>{event}", to)])


def fold(df: DataFrame, keys: list[str], order: list[str], event: str, start: str = "Acquired") -> DataFrame:
    """(keys, n_events, final_state, first_error, n_errors, leak): every instance's events run through the transition table.

    Acquire events open the instance and change nothing; on an error the state stays. One shuffle: events are collected by
    instance, sorted and folded by a higher-order function, inside the JVM.
    """
    events = F.array_sort(F.collect_list(F.struct(*order, F.col(event).alias("_e"))))
    got = df.filter(F.col(event) != "Acquire").groupBy(*keys).agg(events.alias("_events"))
    error = F.create_map(*[F.lit(x) for kv in ERRORS.items() for x in kv])
    zero = F.struct(F.lit(start).alias("s"), F.lit(None).cast("string").alias("e"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        to = F.element_at(_table(), F.concat(acc["s"], F.lit(">"), x["_e"]))
        bad = to.isin(*ERRORS)
        return F.struct(F.when(bad, acc["s"]).otherwise(to).alias("s"), F.coalesce(acc["e"], F.when(bad, F.element_at(error, to))).alias("e"), (acc["n"] + bad.cast("long")).alias("n"))

    out = got.withColumn("_f", F.aggregate("_events", zero, step))
    return out.select(*keys, F.size("_events").cast("long").alias("n_events"), F.col("_f.s").alias("final_state"), F.col("_f.e").alias("first_error"), F.col("_f.n").alias("n_errors"), F.col("_f.s").isin("Acquired", "Retained").alias("leak"))
