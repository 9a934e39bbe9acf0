"""URL filters: listed rules first, then gradient-boosted trees on lexical features. DataFrame and SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.text import table
from tidewater.spark import bounded_broadcast, materialize

#: (verdict, rule); a rule is a host and the start of a path. Fixed by the operator's contract.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Bound on the labelled URLs that the trees are fitted on; they come first by a hash of the URL.
SAMPLE = 20_000
BINS, TREES, DEPTH, RATE, RIDGE = 16, 8, 3, 0.4, 1.0
FEATURES = ("length", "depth", "digits", "entropy", "parameters", "host_labels", "suffix")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or
    the end. Null urls and urls without ``://`` have neither."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the url's or a parent domain of it and whose path starts the url's, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(f"/{p}"))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features but the suffix statistics. Entropy is that of the characters, in bits, from their counts."""
    url = F.coalesce(url, F.lit(""))
    n = F.length(url)
    signs = F.array_distinct(F.split(url, ""))
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(signs, lambda c: c != ""), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return {
        "length": n.cast("double"),
        "depth": (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("double"),
        "digits": F.when(n > 0, F.length(F.regexp_replace(url, "[^0-9]", "")) / n).otherwise(0.0),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "parameters": F.when(query != "", F.length(query) - F.length(F.replace(query, F.lit("&"), F.lit(""))) + 1).otherwise(0).cast("double"),
        "host_labels": F.when(host != "", F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1).otherwise(0).cast("double"),
    }


def _binned(edges: dict[str, list[float]]) -> dict[str, Column]:
    """Bin of each feature: how many of its edges lie below it."""
    return {f: sum(((F.col(f) > e).cast("int") for e in edges[f]), F.lit(0)) for f in FEATURES}


def _gain(g: Column, h: Column) -> Column:
    return g * g / (h + RIDGE)


def boost(train: DataFrame) -> Column:
    """Gradient-boosted trees on the binned features of ``train`` (bin columns, y, n): the log odds of y = 1, as a column.

    Second-order boosting of the logistic loss. Each level of each tree is one aggregation over the rows: sums of gradients
    by (node, feature, bin), prefix sums over bins, and the best split of every node; only those few rows reach the driver.
    """
    base = train.agg(F.sum(F.col("y") * F.col("n")).alias("p"), F.sum("n").alias("n")).first()
    if not base["n"]:
        return F.lit(0.0)
    margin = F.lit(math.log((base["p"] + 0.5) / (base["n"] - base["p"] + 0.5)))
    for t in range(TREES):
        # the listed hosts' suffixes tell their labels apart alone, so two trees of three go without, for hosts of other suffixes
        names = [f for f in FEATURES if f != "suffix" or t % 3 == 2]
        leaf, tree = F.lit(1), None
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
        scored = train.withColumn("_g", (F.col("y") - p) * F.col("n")).withColumn("_h", p * (1 - p) * F.col("n"))
        value: dict[int, float] = {}
        splits: dict[int, tuple[str, int]] = {}
        for level in range(DEPTH):
            stack = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in names]))
            sums = scored.select(leaf.alias("node"), "_g", "_h", stack.alias("s")).filter(F.col("node").isNotNull()).groupBy("node", "s.f", "s.b").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"))
            w = Window.partitionBy("node", "f")
            run = w.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            cut = sums.select("node", "f", "b", F.sum("g").over(run).alias("gl"), F.sum("h").over(run).alias("hl"), F.sum("g").over(w).alias("g"), F.sum("h").over(w).alias("h"))
            gain = _gain(F.col("gl"), F.col("hl")) + _gain(F.col("g") - F.col("gl"), F.col("h") - F.col("hl")) - _gain(F.col("g"), F.col("h"))
            best = cut.groupBy("node").agg(F.max(F.struct(F.round(gain, 9).alias("gain"), F.col("f"), F.col("b"), "gl", "hl", "g", "h")).alias("x")).collect()
            for r in best:
                x, node = r["x"], r["node"]
                if x["gain"] > 1e-6 and x["h"] - x["hl"] > 0:
                    splits[node] = (x["f"], x["b"])
                    value[2 * node], value[2 * node + 1] = x["gl"] / (x["hl"] + RIDGE), (x["g"] - x["gl"]) / (x["h"] - x["hl"] + RIDGE)
            made = [n for n in splits if n.bit_length() == level + 1]
            if not made:
                break
            step = F.lit(None).cast("int")
            for n in made:
                f, b = splits[n]
                step = F.when(leaf == n, F.when(F.col(f) <= b, 2 * n).otherwise(2 * n + 1)).otherwise(step)
            leaf = step

        def grown(n: int) -> Column:
            if n not in splits:
                return F.lit(float(RATE * value.get(n, 0.0)))
            f, b = splits[n]
            return F.when(F.col(f) <= b, grown(2 * n)).otherwise(grown(2 * n + 1))

        if not splits:
            break
        tree = grown(1)
        margin = margin + tree
    return margin


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict and score for every row of ``pages`` (page_id, url).

    The longest fitting rule decides. URLs that no rule fits get the verdict of trees that were fitted on at most ``sample``
    of the URLs that a rule does fit, with the rule's verdict as label; score is their chance of ``block``. Suffix
    statistics are the smoothed share of blocked URLs by last label of the host, over all labelled URLs. Without labelled
    URLs every unlisted one is allowed. Null and malformed URLs have empty host and path and are judged like others. Repeated
    rows are judged alike; very long URLs are read whole; other columns are ignored; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    blocked = F.lit(None).cast("int")
    for verdict, name in rules:
        blocked = F.when(F.col("rule") == name, int(verdict == "block")).otherwise(blocked)
    rows = rows.withColumn("rule", rule).withColumn("y", blocked)
    features = lexical(F.col("url"), F.col("host"), F.col("path"))
    rows = materialize(rows.select("page_id", "host", "path", "rule", "y", F.xxhash64("url").alias("_h"), F.substring_index("host", ".", -1).alias("_last"), *[c.alias(k) for k, c in features.items()]))
    share = rows.filter("y is not null").groupBy("_last").agg(((F.sum("y") + 0.5) / (F.count(F.lit(1)) + 1.0)).alias("suffix"))
    share = share.withColumnRenamed("_last", "_suffix")
    full = rows.join(bounded_broadcast(share), F.col("_last") == F.col("_suffix"), "left").drop("_suffix").withColumn("suffix", F.coalesce("suffix", F.lit(0.5)))
    few = materialize(full.filter("y is not null").orderBy("_h", "page_id").limit(sample).select(*FEATURES, "y"))
    cuts = [i / BINS for i in range(1, BINS)]
    quantiles = few.agg(*[F.percentile_approx(f, cuts, 2000).alias(f) for f in FEATURES]).first()
    edges = {f: sorted(set(quantiles[f] or [])) for f in FEATURES}
    train = materialize(few.select("y", *[c.alias(f) for f, c in _binned(edges).items()]).groupBy("y", *FEATURES).agg(F.count(F.lit(1)).alias("n")).coalesce(2))
    margin = boost(train)
    out = full.select("page_id", "host", "path", "rule", "y", *[c.alias(f) for f, c in _binned(edges).items()]).withColumn("score", 1 / (1 + F.exp(-margin)))
    verdict = F.when(F.coalesce(F.col("y"), (F.col("score") > 0.5).cast("int")) == 1, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the url of every one of ``pages``."""
    return judge(table(spark, sf_dir, "pages"))
