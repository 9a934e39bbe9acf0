"""Graph operators: bounded reachability, fixpoints, components, inverted indexes. Edge tables, never adjacency lists."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.spark import materialize, release


def reachable(edges: DataFrame, starts: DataFrame, depth: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(start, node, depth): every node within ``depth`` hops of a start, at its least depth; a start is at 0.

    Frontier expansion: each round joins the newest pairs only, drops those already known and is written to the shared folder, so
    no lineage grows and a lost executor costs one round. Ends early when nothing is new.
    """
    e = edges.select(F.col(src).alias("_s"), F.col(dst).alias("node")).distinct()
    known = frontier = starts.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("depth")).distinct()
    for d in range(1, depth + 1):
        step = frontier.join(e, frontier["node"] == e["_s"]).select("start", e["node"], F.lit(d).alias("depth")).distinct()
        frontier = materialize(step.join(known, ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def closure(edges: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, root): facts passed along ``edges`` (keys, src, dst) within each key until none is new, by semi-naive rounds: a
    round joins the newest facts only. Cycles end as their facts are known already. A round is written to the shared folder."""
    e = edges.select(*keys, F.col("src").alias("node"), F.col("dst").alias("_to")).distinct()
    known = new = materialize(facts.select(*keys, "node", "root").distinct())
    e = materialize(e.join(new.select(*keys).distinct(), keys, "left_semi") if keys else e)
    while True:
        step = new.join(e, [*keys, "node"]).select(*keys, F.col("_to").alias("node"), "root").distinct()
        new = materialize(step.join(known, [*keys, "node", "root"], "left_anti"))
        if new.isEmpty():
            return known
        known = known.unionByName(new)


def _distances(edges: DataFrame, node: object, depth: int, src: str, dst: str) -> tuple[DataFrame, bool]:
    """(node, hops) within ``depth`` hops of one node, and whether that is all that it reaches at any depth."""
    known = fresh = materialize(edges.select(F.col(src).alias("node")).filter(F.col("node") == F.lit(node)).limit(1).withColumn("hops", F.lit(0)))
    for d in range(1, depth + 2):
        fresh = materialize(edges.join(fresh.select(F.col("node").alias("_n")), F.col(src) == F.col("_n")).select(F.col(dst).alias("node")).distinct().join(known, "node", "left_anti").withColumn("hops", F.lit(d)))
        if fresh.isEmpty():
            return known, True
        if d <= depth:
            known = known.unionByName(fresh)
    return known, False


def reachable_sites(edges: DataFrame, sites: DataFrame, depth: int) -> DataFrame:
    """(node, family, n_sites): how many sites of each family a node reaches within ``depth`` hops, itself included; ``sites`` has
    (family, node). Answers whether and how often for every node at once, without a row for each pair of node and site.

    A node b hops before a landmark reaches every site that is at most ``depth`` - b hops behind it, so sites near enough for all nodes
    that come to the landmark are one number a family for these. Only the rest is followed (``_travelled``): sites further behind, along
    all edges; sites that the landmark doesn't reach, which only nodes reach that it doesn't reach either; and what is reached by nodes
    that never come to the landmark, which only lead to such nodes. The landmark has many edges both in and out. Where it reaches, or is
    reached by, nodes more than ``depth`` hops away, every site is followed.
    """
    edges = materialize(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    sites = materialize(sites.select("family", "node").distinct())
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    top = ends.groupBy("node").agg(F.least(F.sum("o"), F.sum("i")).alias("m")).filter("m > 0").orderBy(F.desc("m"), "node").limit(1).collect()
    if not top:
        return _travelled(edges, sites, depth)
    before, back_ends = _distances(edges, top[0]["node"], depth, "dst", "src")
    behind, ends_too = _distances(edges, top[0]["node"], depth, "src", "dst")
    if not (back_ends and ends_too):
        return _travelled(edges, sites, depth)
    before, behind = materialize(before), materialize(behind)
    furthest = before.agg(F.max("hops")).first()[0]
    placed = materialize(sites.join(behind, "node", "left"))
    near = placed.filter(F.col("hops") <= depth - furthest).select("family", "node")
    out = before.select("node").crossJoin(F.broadcast(near.groupBy("family").agg(F.count(F.lit(1)).alias("n_sites"))))  # a row a family
    far = placed.filter(F.col("hops") > depth - furthest).select("family", "node")
    apart = placed.filter("hops is null").select("family", "node")
    lost = near.join(before, "node", "left_anti")
    off = lambda known, end: edges.join(known.select(F.col("node").alias(end)), end, "left_anti")
    parts = [out.select("node", "family", "n_sites")]
    for some, along in ((far, lambda: edges), (apart, lambda: off(behind, "dst")), (lost, lambda: off(before, "src"))):
        if not some.isEmpty():
            parts.append(_travelled(along(), some, depth))
    if len(parts) == 1:
        return parts[0]
    return functools.reduce(DataFrame.unionByName, parts).groupBy("node", "family").agg(F.sum("n_sites").alias("n_sites"))


def _travelled(edges: DataFrame, sites: DataFrame, depth: int) -> DataFrame:
    """The same by the sites themselves. The sites of a family are numbered; a node's sites are bits in rows of 64. They travel backward
    along the edges: each round joins only what changed in the last one, or-s it by node in a partial aggregation and is written to the
    shared folder, so rows stay linear in nodes and words, and after k rounds the bits are exactly the sites within k hops.
    """
    order = Window.partitionBy("family").orderBy("node")
    numbered = sites.select("family", "node").distinct().withColumn("_n", F.row_number().over(order) - 1)
    first = numbered.select("node", "family", F.floor(F.col("_n") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, CAST(_n % 64 AS INT))").alias("bits"))
    known = materialize(first.groupBy("node", "family", "word").agg(F.bit_or("bits").alias("bits")))
    back = materialize(edges.select(F.col("dst").alias("node"), F.col("src").alias("_to")).distinct())
    fresh = known
    for _ in range(depth):
        came = fresh.join(back, "node").groupBy(F.col("_to").alias("node"), "family", "word").agg(F.bit_or("bits").alias("_in"))
        met = known.join(came, ["node", "family", "word"], "full")
        both = F.coalesce("bits", F.lit(0).cast("long")).bitwiseOR(F.coalesce("_in", F.lit(0).cast("long")))
        state = materialize(met.select("node", "family", "word", both.alias("bits"), both.bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0).cast("long")))).alias("_new")))
        known, fresh = state.select("node", "family", "word", "bits"), state.filter("_new != 0").select("node", "family", "word", F.col("_new").alias("bits"))
        if fresh.isEmpty():
            break
    return known.groupBy("node", "family").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_sites"))


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node of each connected component, by minimum labels with pointer jumping."""
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    both = materialize(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")))
    while True:
        near = both.join(label, both["v"] == label["node"]).groupBy("u").agg(F.min("component").alias("m"))
        step = label.join(near, label["node"] == near["u"]).select("node", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        hop = step.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        new = materialize(step.join(hop, step["component"] == hop["_n"], "left").select("node", F.least("component", F.coalesce("_c", "component")).alias("component"), "was"))
        if new.filter("component != was").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")


def fixpoint(nodes: DataFrame, edges: DataFrame, transfer: Callable[[Column], Column], join: Callable[[Column], Column], merge: Callable[[Column, Column], Column], rounds: int | None = None, backward: bool = False) -> DataFrame:
    """Dataflow fixpoint over (node, value): every node's value joins the transferred values of its predecessors (successors
    if ``backward``) until nothing changes. Nodes without any keep their value. ``join`` aggregates, ``merge`` joins two.
    A state that still changes after ``rounds``, if given, is an error, never a result."""
    src, dst = ("dst", "src") if backward else ("src", "dst")
    state = materialize(nodes.select("node", "value"))
    for done in itertools.count(1):
        incoming = edges.join(state, edges[src] == state["node"]).groupBy(edges[dst].alias("_d")).agg(join(transfer(F.col("value"))).alias("_in"))
        new = materialize(state.join(incoming, state["node"] == incoming["_d"], "left").select("node", F.when(F.col("_in").isNull(), F.col("value")).otherwise(merge(F.col("value"), F.col("_in"))).alias("value"), F.col("value").alias("was")))
        if new.filter(~F.col("value").eqNullSafe(F.col("was"))).isEmpty():
            return new.select("node", "value")
        if done == rounds:
            raise RuntimeError(f"no fixpoint after {rounds} rounds")
        state = new.select("node", "value")


@dataclass(frozen=True)
class Domain:
    """A lattice for ``flow``. ``boundary`` is the value where flow begins, ``start`` that of everything else before any came: the least
    one if values are joined, the greatest if they meet. ``combine`` aggregates what comes in, ``both`` combines two values,
    ``transfer`` is what a node makes of what comes in; all are column expressions, and ``transfer`` may use the node's own columns."""

    boundary: Column
    start: Column
    combine: Callable[[Column], Column]
    both: Callable[[Column, Column], Column]
    transfer: Callable[[Column], Column]
    backward: bool = False


def bitsets(every: bool = False, backward: bool = False) -> Domain:
    """Sets as 64-bit words of nodes with ``gen`` and ``kill`` words: what may come (union) or what comes on every path (intersection)."""
    zero, ones = F.lit(0).cast("long"), F.lit(-1).cast("long")
    both = (lambda a, b: a.bitwiseAND(b)) if every else (lambda a, b: a.bitwiseOR(b))
    return Domain(zero, ones if every else zero, F.bit_and if every else F.bit_or, both, lambda v: v.bitwiseAND(F.bitwise_not("kill")).bitwiseOR(F.col("gen")), backward)


def flow(domain: Domain, nodes: DataFrame, edges: DataFrame, scope: list[str], parts: list[str] | None = None, rounds: int | None = None) -> DataFrame:
    """Dataflow to its fixpoint: ``nodes`` (scope, node, parts, begins, own columns) with ``before`` and ``after``, what comes in and what
    goes out in the direction of flow. ``edges`` has (scope, src, dst); ``parts`` name what flows separately, such as the word of a
    bitset, so a value of any width is rows of fixed size. Each round is one join, one partial aggregation and one table in the
    shared folder; a state that still changes after ``rounds``, if given, is an error."""
    parts = parts or []
    src, dst = ("dst", "src") if domain.backward else ("src", "dst")
    e = materialize(edges.select(*scope, F.col(src).alias("node"), F.col(dst).alias("_to")).distinct())
    own = [c for c in nodes.columns if c not in ("before", "after")]
    first = F.when(F.col("begins"), domain.boundary).otherwise(domain.start)
    state = materialize(nodes.withColumn("before", first).withColumn("after", domain.transfer(F.col("before"))))
    for done in itertools.count(1):
        sent = e.join(state.select(*scope, "node", *parts, "after"), [*scope, "node"]).groupBy(*scope, F.col("_to").alias("node"), *parts).agg(domain.combine(F.col("after")).alias("_in"))
        met = state.withColumnRenamed("after", "_was").join(sent, [*scope, "node", *parts], "left")
        came = F.when(F.col("_in").isNull(), F.col("before")).when(F.col("begins"), domain.both(F.col("_in"), domain.boundary)).otherwise(F.col("_in"))
        new = materialize(met.withColumn("before", came).withColumn("after", domain.transfer(F.col("before"))).select(*own, "before", "after", "_was"))
        release(state)
        state = new
        if state.filter(~F.col("after").eqNullSafe(F.col("_was"))).isEmpty():
            return state.drop("_was")
        if done == rounds:
            raise RuntimeError(f"no fixpoint after {rounds} rounds")
        state = _without(state, "_was")


def _without(df: DataFrame, column: str) -> DataFrame:
    out = df.drop(column)
    out._tidewater_path = getattr(df, "_tidewater_path", None)
    return out


def cross_module(defs: DataFrame, decls: DataFrame, symbol: str, module: str) -> DataFrame:
    """Symbols that one module declares and another defines."""
    d = defs.select(F.col(symbol), F.col(module).alias("defined_in")).distinct()
    return d.join(decls.select(F.col(symbol), F.col(module).alias("declared_in")).distinct(), symbol).filter("defined_in != declared_in")


def inverted_index(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's distinct values, sorted and joined, their number, and whether there are several."""
    out = rows.select(key, value).distinct().groupBy(key).agg(F.array_sort(F.collect_list(F.col(value))).alias("_v"))
    return out.select(key, F.array_join(F.transform("_v", lambda x: x.cast("string")), ",").alias("members"), F.size("_v").cast("long").alias("n"), (F.size("_v") > 1).alias("ambiguous"))


def one_step(srt: DataFrame, edges: DataFrame) -> DataFrame:
    """Facts (symbol, kind) passed one step along call edges, both ways, only onto symbols that already have a fact."""
    known = srt.select("symbol").distinct()
    up = edges.join(srt, edges["dst"] == srt["symbol"]).select(edges["src"].alias("symbol"), "kind")
    down = edges.join(srt, edges["src"] == srt["symbol"]).select(edges["dst"].alias("symbol"), "kind")
    return srt.unionByName(up.unionByName(down).join(known, "symbol", "left_semi")).distinct()
