"""Many patterns in many names at once: every occurrence, by a join on leading characters instead of one scan a pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.spark import bounded_broadcast

#: Characters by which names and patterns meet; shorter patterns meet by all of theirs.
LEAD = 4


def find_all(names: DataFrame, patterns: DataFrame, lead: int = LEAD) -> DataFrame:
    """(name, pattern, position): every place, from 1, where a pattern stands in a name; overlapping ones too. ``names`` has ``name``,
    ``patterns`` has ``pattern``; both count once. Empty patterns and nulls match nothing.

    Each position of a name gives one row for each length of lead that some pattern has (at most ``lead`` of them); these meet the
    patterns by an equi join on the lead, and what is left of a pattern is compared in place. So work follows the names' characters and
    the occurrences of leads, not names times patterns. Patterns are broadcast only if a count shows that they are few.
    """
    size = F.least(F.length("pattern"), F.lit(lead))
    known = patterns.select("pattern").filter("length(pattern) > 0").distinct().select("pattern", size.alias("n"), F.substring("pattern", F.lit(1), size).alias("lead"))
    lengths = known.agg(F.collect_set("n").alias("lengths"))  # one row
    own = names.select("name").filter("length(name) > 0").distinct().join(F.broadcast(lengths))
    at = own.select("name", F.posexplode(F.sequence(F.lit(1), F.length("name"))).alias("_p", "position"), "lengths").select("name", "position", F.explode("lengths").alias("n"))
    leads = at.filter("position + n - 1 <= length(name)").withColumn("lead", F.expr("substring(name, position, n)"))
    met = leads.join(bounded_broadcast(known), ["n", "lead"])
    return met.filter(F.expr("substring(name, position, length(pattern)) = pattern")).select("name", "pattern", F.col("position").cast("long").alias("position"))


def categorised(names: DataFrame, rules: DataFrame, default: str = "none") -> DataFrame:
    """(name, category, n_matches): the category of the longest pattern in each name (ties: the one further left), and
    how many places match; ``rules`` has (pattern, category)."""
    found = find_all(names, rules.select("pattern")).join(rules.groupBy("pattern").agg(F.min("category").alias("category")), "pattern")
    best = found.groupBy("name").agg(F.max_by("category", F.struct(F.length("pattern"), -F.col("position"))).alias("category"), F.count(F.lit(1)).alias("n_matches"))
    return names.select("name").filter("name is not null").distinct().join(best, "name", "left").select("name", F.coalesce("category", F.lit(default)).alias("category"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"))
