"""Queries of verdicts: an order is a candidate, its lines are its evidence (large quantities) and its semantic facts (small ones)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import verification as V
from tidewater.operators.evidence import BASE_VERDICT
from tidewater.plans.tables import read

QUERIES, ORACLE = {}, {}
CANDIDATES = ["DefiniteLeak", "ConditionalLeak", "BorrowEscape", "OwnershipEscapeLeak", "UseAfterFree", "NeedsModel", "CrossFamily"]
EVIDENCE = ["OwnershipEscapeLeak", "PathStateRefinement", "BridgeHelper", "OwnershipTransfer", "GlobalStore", "IrPattern", *V.SAFE_LEAK_EVIDENCE, *(["Other"] * 8)]
FACTS = [*V.SAFE_KINDS, *V.SAFE_LEAK_KINDS, *(["Other"] * 12)]
ISSUES = ["DoubleFree", "UseAfterFree", "DefiniteLeak", "ConditionalLeak", "FfiUnsafeCall", "NullDereference"]
FUNCTIONS = ["c_open", "rust_drop", "main", "py_call", "work", "free"]


def _nth(names: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (at % len(names) + 1).cast("int"))


def _nth_sql(names: list[str], at: str) -> str:
    return f"[{', '.join(repr(n) for n in names)}][{at} % {len(names)} + 1]"


def v6_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by evidence and by facts of each confidence (V-4, V-5, V-6)."""
    c, lines = F.col, read(spark, sf_dir, "lineitem")
    made = read(spark, sf_dir, "orders").select(c("o_orderkey").alias("idx"), _nth(CANDIDATES, c("o_custkey")).alias("kind"), (c("o_orderstatus") == "F").alias("same_resource"), (c("o_custkey") % 3 == 0).alias("reachable_release"))
    what = F.when(c("l_suppkey") % 3 == 0, "heap to global").when(c("l_suppkey") % 3 == 1, "pure")
    evidence = lines.filter("l_quantity > 30").select(c("l_orderkey").alias("idx"), _nth(EVIDENCE, c("l_partkey")).alias("kind"), what.alias("description"))
    sure = F.when(c("l_returnflag") == "R", "High").when(c("l_returnflag") == "A", "Medium").otherwise("Low")
    facts = lines.filter("l_quantity <= 30").select(c("l_orderkey").alias("idx"), _nth(FACTS, c("l_partkey")).alias("kind"), sure.alias("confidence"))
    return V.verified(made, evidence, facts).select("idx", "kind", "verdict")


QUERIES["v6_verified"] = v6_verified
_SAFE, _LEAK, _EV = (", ".join(f"'{x}'" for x in names) for names in (V.SAFE_KINDS, V.SAFE_KINDS + V.SAFE_LEAK_KINDS, V.SAFE_LEAK_EVIDENCE))
_HAS = lambda kind: f"bool_or(t = 'e' AND kind = '{kind}')"
ORACLE["v6_verified"] = f"""WITH c AS (SELECT o_orderkey AS idx, {_nth_sql(CANDIDATES, "o_custkey")} AS kind, o_orderstatus = 'F' AND o_custkey % 3 = 0 AS strong FROM orders),
r AS (SELECT l_orderkey AS idx, 'e' AS t, {_nth_sql(EVIDENCE, "l_partkey")} AS kind, 0 AS sure, l_suppkey % 3 = 0 AS esc FROM lineitem WHERE l_quantity > 30
  UNION ALL SELECT l_orderkey, 'f', {_nth_sql(FACTS, "l_partkey")}, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END, FALSE FROM lineitem WHERE l_quantity <= 30),
g AS (SELECT idx, {_HAS("OwnershipEscapeLeak")} AS own, {_HAS("PathStateRefinement")} AS path, {_HAS("BridgeHelper")} OR {_HAS("OwnershipTransfer")} AS moved, {_HAS("GlobalStore")} AS stored, {_HAS("IrPattern")} AS pat, bool_or(t = 'e' AND kind = 'IrPattern' AND esc) AS pesc,
  bool_or(t = 'e' AND kind IN ({_EV})) AS ev, max(CASE WHEN t = 'f' AND kind IN ({_SAFE}) THEN sure ELSE 0 END) AS s, max(CASE WHEN t = 'f' AND kind IN ({_LEAK}) THEN sure ELSE 0 END) AS l FROM r GROUP BY idx),
x AS (SELECT c.*, coalesce(own, FALSE) AS own, coalesce(path, FALSE) AS path, coalesce(moved, FALSE) AS moved, coalesce(stored, FALSE) AS stored, coalesce(pat, FALSE) AS pat, coalesce(pesc, FALSE) AS pesc, coalesce(ev, FALSE) AS ev, coalesce(s, 0) AS s, coalesce(l, 0) AS l FROM c LEFT JOIN g USING (idx)),
y AS (SELECT *, CASE WHEN kind LIKE '%Leak' THEN l = 3 OR ev ELSE s = 3 END AS high, CASE WHEN kind LIKE '%Leak' THEN l >= 2 ELSE s >= 2 END AS med,
  CASE kind WHEN 'DefiniteLeak' THEN CASE WHEN own OR path THEN 'Confirmed' WHEN l = 3 OR ev THEN 'ExplainedSafe' WHEN l = 2 THEN 'Probable' ELSE 'Confirmed' END
    WHEN 'ConditionalLeak' THEN CASE WHEN own THEN 'Probable' WHEN l = 3 OR ev THEN 'ExplainedSafe' WHEN l = 2 THEN 'Probable' WHEN l = 1 THEN 'ExplainedSafe' ELSE 'Probable' END
    WHEN 'BorrowEscape' THEN CASE WHEN moved THEN 'ExplainedSafe' WHEN stored OR pesc THEN 'Probable' WHEN pat THEN 'ExplainedSafe' ELSE 'Probable' END
    {" ".join(f"WHEN '{k}' THEN '{BASE_VERDICT.get(k, 'Probable')}'" for k in CANDIDATES[3:])} END AS base FROM x)
SELECT idx, kind, CASE WHEN high AND NOT strong AND NOT (kind = 'BorrowEscape' AND (stored OR pesc)) THEN 'ExplainedSafe' WHEN med AND NOT high AND NOT strong AND base = 'Confirmed' THEN 'Probable' ELSE base END AS verdict FROM y"""


def v9_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that are held back after every gate, with the reason (V-9); null functions where the line is open and its number 1."""
    c = F.col
    function = F.when((c("l_linestatus") != "O") | (c("l_linenumber") != 1), _nth(FUNCTIONS, c("l_suppkey")))
    symbol = _nth(["free", "malloc", "own_free", "rt_alloc"], c("l_partkey"))
    kind = _nth(ISSUES, c("l_partkey") + c("l_suppkey"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", kind.alias("kind"), symbol.alias("symbol"), function.alias("function"))
    reason = V.suppressed(c("kind"), c("symbol"), c("function"), F.startswith("symbol", F.lit("rt_")), c("function").isin("main", "work"), c("symbol").isin("free", "malloc"))
    return rows.withColumn("reason", reason)


QUERIES["v9_suppressed"] = v9_suppressed
ORACLE["v9_suppressed"] = f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_nth_sql(ISSUES, "(l_partkey + l_suppkey)")} AS kind, {_nth_sql(["free", "malloc", "own_free", "rt_alloc"], "l_partkey")} AS symbol,
  CASE WHEN l_linestatus <> 'O' OR l_linenumber <> 1 THEN {_nth_sql(FUNCTIONS, "l_suppkey")} END AS function FROM lineitem), u AS (SELECT *, coalesce(function IN ('main', 'work'), FALSE) AS usr, coalesce(function, '') AS fn, kind IN ('DoubleFree', 'UseAfterFree') AS twice FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, kind, symbol, function, CASE WHEN symbol = 'rt_alloc' AND NOT usr AND kind IN ({", ".join(f"'{k}'" for k in V.NOT_OF_RUNTIME)}) THEN 'RuntimeSymbol' WHEN NOT usr AND kind IN ('DefiniteLeak', 'ConditionalLeak') THEN 'RuntimeCallerLeak'
  WHEN symbol IN ('free', 'malloc') AND twice AND (fn = symbol OR NOT usr) THEN 'LibcSymbol' WHEN NOT usr AND twice AND regexp_matches(fn, '^(c|rust|py|java|go)_') THEN 'BridgeFunction' END AS reason FROM u"""
