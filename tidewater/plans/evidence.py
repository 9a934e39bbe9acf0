"""Queries of the evidence family, on calls and candidates drawn from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import symbols as S
from tidewater.operators import dimensions as D
from tidewater.operators import evidence as E
from tidewater.plans.symbols import CALLS_SQL, calls
from tidewater.plans.tables import FACTS_SQL, facts, read
from tidewater.plans.verdicts import CANDIDATES_SQL, candidates, scored

QUERIES, ORACLE = {}, {}
_FAM = D.sql_values("fam", "symbol, family, effect", D.symbol_rows())


def p3_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both boundary predicates over calls: with mangling and fallbacks, and the plain one that leaves libc out."""
    c = calls(spark, sf_dir).withColumn("lc", S.language(F.col("caller"))).withColumn("le", S.language(F.col("callee")))
    cross = (F.col("lc") != "Unknown") & (F.col("le") != "Unknown") & (F.col("lc") != F.col("le"))
    quiet = S.is_intrinsic(F.col("callee")) | F.contains("callee", F.lit("drop_in_place")) | F.contains("callee", F.lit("panic"))
    wide = (cross | (~F.col("lc").isin("Unknown", "C") & (F.col("le") == "Unknown"))) & ~quiet
    plain = cross & ~S.is_libc(F.col("callee"))
    return c.groupBy("lc", "le").agg(F.count(F.lit(1)).alias("n"), F.count_if(wide).alias("wide"), F.count_if(plain).alias("plain"))


QUERIES["p3_boundary"] = p3_boundary
ORACLE["p3_boundary"] = f"""WITH {CALLS_SQL}, x AS (SELECT callee, {S.SQL['language']('caller')} AS lc, {S.SQL['language']('callee')} AS le FROM calls),
y AS (SELECT *, lc <> 'Unknown' AND le <> 'Unknown' AND lc <> le AS crossing, starts_with(callee, 'llvm.') OR contains(callee, 'drop_in_place') OR contains(callee, 'panic') AS quiet FROM x)
SELECT lc, le, count(*) AS n, count(*) FILTER (WHERE (crossing OR (lc NOT IN ('Unknown', 'C') AND le = 'Unknown')) AND NOT quiet) AS wide, count(*) FILTER (WHERE crossing AND NOT {S.SQL['is_libc']('callee')}) AS plain FROM y GROUP BY lc, le"""


def v1_base_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).groupBy("kind", F.coalesce(E.base_verdict(F.col("kind")), F.col("verdict")).alias("final")).agg(F.count(F.lit(1)).alias("n"))


QUERIES["v1_base_verdict"] = v1_base_verdict
_BASE = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.BASE_VERDICT.items()) + " ELSE verdict END"
ORACLE["v1_base_verdict"] = f"WITH {CANDIDATES_SQL} SELECT kind, {_BASE} AS final, count(*) AS n FROM cand GROUP BY 1, 2"


def v2_cross_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "lineitem")
    bit = lambda k: (F.floor(F.col("l_partkey") / k) % 2) == 1
    return c.groupBy(E.cross_family_verdict(bit(1), bit(2), ~bit(4), bit(8), bit(16), bit(32)).alias("verdict"), E.double_release_verdict(bit(1), bit(2), bit(4), bit(8), ~bit(16), bit(32)).alias("double_verdict")).agg(F.count(F.lit(1)).alias("n"))


QUERIES["v2_v3_verdicts"] = v2_cross_family
_BITS = ", ".join(f"CAST(floor(l_partkey / CAST({1 << i} AS DOUBLE)) AS BIGINT) % 2 = 1 AS b{i}" for i in range(6))
ORACLE["v2_v3_verdicts"] = f"""WITH x AS (SELECT {_BITS} FROM lineitem) SELECT CASE WHEN NOT b0 THEN 'Probable' WHEN b1 THEN 'ExplainedSafe' WHEN b2 THEN 'Probable' WHEN b3 THEN 'ExplainedSafe' WHEN b4 OR b5 THEN 'Probable' ELSE 'Confirmed' END AS verdict,
CASE WHEN b0 THEN 'ExplainedSafe' WHEN b2 AND NOT b1 AND NOT b3 THEN 'ExplainedSafe' WHEN b4 OR NOT b3 THEN 'Probable' WHEN b5 THEN 'Diagnostic' ELSE 'Confirmed' END AS double_verdict, count(*) AS n FROM x GROUP BY 1, 2"""


def f22_language_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    fam = F.broadcast(D.family_symbols(spark))
    rows = calls(spark, sf_dir)
    two = rows.join(fam.select(F.col("symbol").alias("caller"), F.col("family").alias("fa")), "caller").join(fam.select(F.col("symbol").alias("callee"), F.col("family").alias("fr")), "callee")
    a, r = E.language_group(F.col("fa")), E.language_group(F.col("fr"))
    return two.groupBy("fa", "fr").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(a != r, F.lit(False))).alias("mismatch"))


QUERIES["f22_language_mismatch"] = f22_language_mismatch
_GROUP = lambda c: "CASE " + " ".join(f"WHEN starts_with({c}, '{p}') THEN '{g}'" for p, g in reversed(E.LANGUAGE_GROUP.items())) + " END"
ORACLE["f22_language_mismatch"] = f"""WITH {CALLS_SQL}, {_FAM}, x AS (SELECT a.family AS fa, r.family AS fr FROM calls JOIN fam a ON caller = a.symbol JOIN fam r ON callee = r.symbol)
SELECT fa, fr, count(*) AS n, bool_or(coalesce({_GROUP('fa')} <> {_GROUP('fr')}, false)) AS mismatch FROM x GROUP BY fa, fr"""


def j6_boundary_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir).withColumn("id", F.struct("l_orderkey", "l_linenumber"))
    branches = [F.col("callee") == "malloc", S.glob_match(F.col("callee"), F.lit("Py*")), (S.language(F.col("caller")) == "Rust") & (S.language(F.col("callee")) == "Unknown")]
    out = E.prioritized(rows, "id", branches, ["function", "pattern", "languages"], "none")
    return out.groupBy("rule", F.col("priority").cast("long").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


QUERIES["j6_boundary_rules"] = j6_boundary_rules
ORACLE["j6_boundary_rules"] = f"""WITH {CALLS_SQL}, x AS (SELECT CASE WHEN callee = 'malloc' THEN 'function' WHEN starts_with(callee, 'Py') THEN 'pattern' WHEN {S.SQL['language']('caller')} = 'Rust' AND {S.SQL['language']('callee')} = 'Unknown' THEN 'languages' ELSE 'none' END AS rule FROM calls)
SELECT rule, CAST(CASE rule WHEN 'function' THEN 1 WHEN 'pattern' THEN 2 WHEN 'languages' THEN 3 ELSE 4 END AS BIGINT) AS priority, count(*) AS n FROM x GROUP BY 1, 2"""


def j11_evidence_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir).groupBy("l_orderkey").agg(F.min("caller").alias("a"), F.max("callee").alias("b"))
    known = spark.createDataFrame([(s, f) for s, f, _ in D.symbol_rows()], "symbol string, kind string")
    return E.bundle(rows, F.broadcast(known), "l_orderkey", ["a", "b"])


QUERIES["j11_evidence_bundle"] = j11_evidence_bundle
ORACLE["j11_evidence_bundle"] = f"""WITH {CALLS_SQL}, {_FAM}, r AS (SELECT l_orderkey, min(caller) AS a, max(callee) AS b FROM calls GROUP BY l_orderkey), p AS (SELECT l_orderkey, a AS s FROM r UNION SELECT l_orderkey, b FROM r),
m AS (SELECT DISTINCT l_orderkey, family FROM p JOIN fam ON s = symbol) SELECT l_orderkey, string_agg(family, ',' ORDER BY family) AS evidence, count(*) AS n_evidence FROM m GROUP BY l_orderkey"""


def a10_edge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("s"), (F.col("o_orderkey") % 50).alias("t"))
    return E.edge_groups(e, "s", "t", "o_orderkey")


QUERIES["a10_edge_groups"] = a10_edge_groups
ORACLE["a10_edge_groups"] = "WITH x AS (SELECT o_orderkey, o_custkey % 50 AS i FROM orders UNION SELECT o_orderkey, o_orderkey % 50 FROM orders) SELECT i AS instance, count(*) AS n_edges, min(o_orderkey) AS first_idx, max(o_orderkey) AS last_idx FROM x WHERE i <> 0 GROUP BY i"


def a12_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("role")
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(*[F.count_if(r == k).alias(f"n_{k}") for k in ("system", "user", "assistant")])


QUERIES["a12_kind_counts"] = a12_kind_counts
ORACLE["a12_kind_counts"] = "SELECT conv_id, count(*) FILTER (WHERE role = 'system') AS n_system, count(*) FILTER (WHERE role = 'user') AS n_user, count(*) FILTER (WHERE role = 'assistant') AS n_assistant FROM conversations GROUP BY conv_id"


def a21_span_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return facts(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(v), 4).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.avg(v), 6).alias("mean"))


QUERIES["a21_span_stats"] = a21_span_stats
ORACLE["a21_span_stats"] = f"WITH {FACTS_SQL} SELECT kind, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM facts GROUP BY kind"


def a26_candidate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return scored(spark, sf_dir).agg(F.count_if(c("is_ffi")).alias("ffi_count"), F.count_if(c("kind") == "NeedsModel").alias("needs_model"), F.count_if(~c("is_ffi") & (c("verdict_rank") >= 2)).alias("resource_only"), F.count_if(c("verdict") == "ExplainedSafe").alias("suppressed"))


QUERIES["a26_candidate_metrics"] = a26_candidate_metrics
ORACLE["a26_candidate_metrics"] = f"""WITH {CANDIDATES_SQL} SELECT count(*) FILTER (WHERE is_ffi) AS ffi_count, count(*) FILTER (WHERE kind = 'NeedsModel') AS needs_model, count(*) FILTER (WHERE NOT is_ffi AND vrank >= 2) AS resource_only,
count(*) FILTER (WHERE verdict = 'ExplainedSafe') AS suppressed FROM cand JOIN kinds ON kind = candidate_kind JOIN vd ON verdict = vname"""


def t4_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.evict(facts(spark, sf_dir).withColumn("size", F.floor("value")), ["caller"], ["ts", "ord"], "size", 200.0).select("caller", "ord")


QUERIES["t4_evict"] = t4_evict
ORACLE["t4_evict"] = f"""WITH {FACTS_SQL}, x AS (SELECT caller, ord, coalesce(sum(floor(value)) OVER (PARTITION BY caller ORDER BY ts, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM facts) SELECT caller, ord FROM x WHERE b < 200"""

_TYPES = list(E.SCALARS)


def w8_struct_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-field structs from part keys: size, padding, alignment, and the padding that ordering by size would leave."""
    pick = lambda k: F.element_at(F.array(*map(F.lit, _TYPES)), (F.floor(F.col("p_partkey") / k) % len(_TYPES) + 1).cast("int"))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.array(pick(1), pick(9), pick(81)).alias("fields"))
    rows = rows.withColumn("l", E.struct_layout(F.col("fields"))).withColumn("best", E.struct_layout(E.packed_order(F.col("fields"))))
    return rows.select("p_partkey", F.col("l.size").cast("long").alias("size"), F.col("l.padding").cast("long").alias("padding"), F.col("l.align").cast("long").alias("align"), F.col("best.size").cast("long").alias("best_size"))


QUERIES["w8_struct_layout"] = w8_struct_layout
_SIZE = lambda k: "(CASE CAST(floor(p_partkey / CAST(" + str(k) + f" AS DOUBLE)) AS BIGINT) % {len(_TYPES)} " + " ".join(f"WHEN {i} THEN {E.SCALARS[t]}" for i, t in enumerate(_TYPES)) + " END)"
_UP = lambda at, n: f"(({at} + {n} - 1) // {n} * {n})"
ORACLE["w8_struct_layout"] = f"""WITH x AS (SELECT p_partkey, {_SIZE(1)} AS a, {_SIZE(9)} AS b, {_SIZE(81)} AS c FROM part), y AS (SELECT *, {_UP('a', 'b')} + b AS ab, greatest(a, b, c) AS g FROM x), z AS (SELECT *, {_UP('ab', 'c')} + c AS abc FROM y)
SELECT p_partkey, CAST({_UP('abc', 'g')} AS BIGINT) AS size, CAST({_UP('abc', 'g')} - a - b - c AS BIGINT) AS padding, CAST(g AS BIGINT) AS align, CAST({_UP('(a + b + c)', 'g')} AS BIGINT) AS best_size FROM z"""


def u9_distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select("caller", "callee").distinct()


QUERIES["u9_distinct_pairs"] = u9_distinct_pairs
ORACLE["u9_distinct_pairs"] = f"WITH {CALLS_SQL} SELECT DISTINCT caller, callee FROM calls"


def a11_release_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release sites of each family in order of first encounter."""
    rows = calls(spark, sf_dir).join(F.broadcast(D.family_symbols(spark)), F.col("callee") == F.col("symbol")).filter("effect = 'Release'")
    first = rows.groupBy("family", "callee").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first"))
    return first.groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "callee"))), lambda x: x["callee"]), ",").alias("sites"))


QUERIES["a11_release_sites"] = a11_release_sites
ORACLE["a11_release_sites"] = f"""WITH {CALLS_SQL}, {_FAM}, f AS (SELECT family, callee, min(l_orderkey * 10 + l_linenumber) AS first FROM calls JOIN fam ON callee = symbol WHERE effect = 'Release' GROUP BY family, callee)
SELECT family, string_agg(callee, ',' ORDER BY first, callee) AS sites FROM f GROUP BY family"""
