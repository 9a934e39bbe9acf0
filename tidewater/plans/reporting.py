"""Queries of issue predicates, merges, leak decisions, overlaps and report counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import reporting as R
from tidewater.operators.dedup import LEAK_RANK
from tidewater.plans.tables import FACTS_SQL, facts, read
from tidewater.plans.verdicts import CANDIDATES_SQL, candidates, scored

QUERIES, ORACLE = {}, {}


def _sql_list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def p10_kind_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = R.kind_flags(F.col("issue_kind"))
    return scored(spark, sf_dir).select("seq", "issue_kind", *[c.alias(n) for n, c in flags.items()])


QUERIES["p10_kind_predicates"] = p10_kind_predicates
ORACLE["p10_kind_predicates"] = f"""WITH {CANDIDATES_SQL} SELECT seq, issue_kind, issue_kind IN {_sql_list(R.FFI_BOUNDARY)} AS is_ffi_boundary, issue_kind IN {_sql_list(R.LOCAL_MEMORY)} AS is_local_memory, issue_kind IN {_sql_list(R.RESOURCE_CONTRACT)} AS is_resource_contract,
issue_kind = 'UseAfterFree' AS is_uaf, issue_kind IN {_sql_list(R.DIAGNOSTIC_ONLY)} AS is_diagnostic_only FROM cand JOIN kinds ON kind = candidate_kind JOIN vd ON verdict = vname"""


def p7_boundary_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.boundary_only(scored(spark, sf_dir), "issue_kind").groupBy("issue_kind").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


QUERIES["p7_boundary_only"] = p7_boundary_only
ORACLE["p7_boundary_only"] = f"WITH {CANDIDATES_SQL} SELECT issue_kind, count(*) AS n, min(seq) AS first_seq FROM cand JOIN kinds ON kind = candidate_kind JOIN vd ON verdict = vname WHERE issue_kind IN {_sql_list(R.FFI_BOUNDARY)} GROUP BY issue_kind"


def p8_severity_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure = F.when(F.col("l_discount") >= 0.07, "High").when(F.col("l_discount") >= 0.03, "Medium").otherwise("Low")
    rows = scored(spark, sf_dir)
    return rows.select("seq", *[c.alias(n) for n, c in R.severity_flags(F.col("severity"), sure).items()])


QUERIES["p8_severity_filters"] = p8_severity_filters
ORACLE["p8_severity_filters"] = f"WITH {CANDIDATES_SQL} SELECT seq, severity IN ('Error', 'Warning') AS is_high, severity NOT IN ('Error', 'Warning') AS is_low, l_discount >= 0.03 AS is_actionable FROM cand JOIN kinds ON kind = candidate_kind JOIN vd ON verdict = vname"


def a15_leak_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases, errors and views of a user are exit states in family 0; sign-ups and clicks are allocations and releases."""
    kind = F.col("kind")
    state = F.when(kind == "purchase", "Released").when(kind == "error", "Unknown").when(kind == "view", F.when(F.col("ord") % 2 == 0, "Owned").otherwise("Null"))
    rows = facts(spark, sf_dir).withColumn("state", state)
    return R.leak_type(rows, ["caller", "family"], "state", F.col("family") != 2, kind == "signup", kind == "click")


QUERIES["a15_leak_type"] = a15_leak_type
ORACLE["a15_leak_type"] = f"""WITH {FACTS_SQL}, s AS (SELECT caller, family, kind, CASE WHEN family <> 2 THEN CASE WHEN kind = 'purchase' THEN 'Released' WHEN kind = 'error' THEN 'Unknown' WHEN kind = 'view' THEN CASE WHEN ord % 2 = 0 THEN 'Owned' ELSE 'Null' END END END AS state FROM facts),
g AS (SELECT caller, family, count(state) AS exits, count(*) FILTER (WHERE state = 'Owned') AS owned, count(*) FILTER (WHERE state IN ('Released', 'Null', 'Escaped')) AS safe, count(*) FILTER (WHERE state = 'Unknown') AS unknown, count(*) FILTER (WHERE kind = 'signup') AS allocs, count(*) FILTER (WHERE kind = 'click') AS releases FROM s GROUP BY caller, family)
SELECT caller, family, exits, allocs, releases, CASE WHEN exits > 0 AND safe = exits THEN 'Safe' WHEN exits > 0 AND owned = exits THEN 'Definite' WHEN owned > 0 THEN 'Conditional' WHEN exits > 0 AND unknown = 0 THEN 'Safe'
  WHEN allocs > 0 AND releases = 0 THEN 'Definite' WHEN allocs > 0 AND releases < allocs THEN 'Conditional' WHEN allocs > 0 THEN 'Safe' ELSE 'NeedsModel' END AS leak_type FROM g"""


def v7_adjust_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines are the paths of each of its candidates: shipped ones leak, returned ones are safe."""
    paths = candidates(spark, sf_dir).groupBy("resource").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_linestatus") == "O").alias("owned"), F.count_if(F.col("l_linestatus") == "F").alias("safe"))
    rows = candidates(spark, sf_dir).join(paths, "resource")
    return rows.select("seq", "verdict", R.adjusted(F.col("verdict"), F.col("evidence") > 1, F.col("total"), F.col("owned"), F.col("safe")).alias("adjusted"))


QUERIES["v7_adjust_verdict"] = v7_adjust_verdict
ORACLE["v7_adjust_verdict"] = f"""WITH {CANDIDATES_SQL}, p AS (SELECT resource, count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'O') AS owned, count(*) FILTER (WHERE l_linestatus = 'F') AS safe FROM cand GROUP BY resource)
SELECT seq, verdict, CASE WHEN evidence > 1 AND safe = total THEN 'ExplainedSafe' WHEN evidence > 1 AND owned = total THEN 'Confirmed' ELSE verdict END AS adjusted FROM cand JOIN p USING (resource)"""


def v4_definite_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = candidates(spark, sf_dir).filter("kind = 'DefiniteLeak'")
    return rows.select("seq", R.definite_leak(c("evidence") == 4, c("evidence") == 3, c("l_discount") >= 0.07, c("l_discount") >= 0.04).alias("decided"))


QUERIES["v4_definite_leak"] = v4_definite_leak
ORACLE["v4_definite_leak"] = f"WITH {CANDIDATES_SQL} SELECT seq, CASE WHEN evidence >= 3 THEN 'Confirmed' WHEN l_discount >= 0.07 THEN 'ExplainedSafe' WHEN l_discount >= 0.04 THEN 'Probable' ELSE 'Confirmed' END AS decided FROM cand WHERE kind = 'DefiniteLeak'"

#: The surface that each event type hints at, and its priority where hints are equally sure.
SURFACES = [("view", "Boundary", 3), ("click", "Unknown", 2), ("purchase", "Runtime", 1), ("signup", "Internal", 0), ("error", "Internal", 0)]


def a17_merge_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = F.broadcast(spark.createDataFrame(SURFACES, "kind string, surface string, priority int"))
    return R.strongest(facts(spark, sf_dir).join(dim, "kind"), ["caller"], "surface", [F.col("ord") % 3, F.col("priority")])


QUERIES["a17_merge_hints"] = a17_merge_hints
ORACLE["a17_merge_hints"] = f"""WITH {FACTS_SQL}, d(kind, surface, priority) AS (VALUES {", ".join(map(str, SURFACES))}), r AS (SELECT caller, surface, row_number() OVER (PARTITION BY caller ORDER BY ord % 3 DESC, priority DESC) AS k FROM facts JOIN d USING (kind)) SELECT caller, surface FROM r WHERE k = 1"""


def a18_best_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a symbol's resolutions of one kind the surest one; of equally sure ones the last."""
    return R.strongest(facts(spark, sf_dir).withColumnRenamed("ord", "resolution"), ["caller", "kind"], "resolution", [F.col("value"), F.col("resolution")])


QUERIES["a18_best_resolution"] = a18_best_resolution
ORACLE["a18_best_resolution"] = f"WITH {FACTS_SQL}, r AS (SELECT caller, kind, ord AS resolution, row_number() OVER (PARTITION BY caller, kind ORDER BY value DESC NULLS LAST, ord DESC) AS k FROM facts) SELECT caller, kind, resolution FROM r WHERE k = 1"


def a16_evidence_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.evidence_multiplier(candidates(spark, sf_dir).withColumn("sure", F.col("l_discount").cast("double")), ["resource"], "sure")


QUERIES["a16_evidence_multiplier"] = a16_evidence_multiplier
ORACLE["a16_evidence_multiplier"] = "SELECT l_orderkey AS resource, count(l_discount) AS n_evidence, round(avg(CAST(l_discount AS DOUBLE)), 6) AS mean_confidence, round(0.7 + 0.3 * avg(CAST(l_discount AS DOUBLE)), 6) AS multiplier FROM lineitem GROUP BY l_orderkey"


def a20_pass_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes as pass durations; two brands stand for the foundation passes."""
    name = F.when(F.col("p_brand") == "Brand#11", "CFG").when(F.col("p_brand") == "Brand#12", "DFG").otherwise(F.col("p_brand"))
    return R.pass_stats(read(spark, sf_dir, "part").select(name.alias("name"), F.col("p_size").cast("long").alias("ms")), "name", "ms")


QUERIES["a20_pass_stats"] = a20_pass_stats
ORACLE["a20_pass_stats"] = "SELECT count(*) FILTER (WHERE p_brand IN ('Brand#11', 'Brand#12')) AS foundation_passes, count(*) FILTER (WHERE p_brand NOT IN ('Brand#11', 'Brand#12')) AS analysis_passes, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS total_ms, round(coalesce(avg(p_size), 0), 6) AS avg_ms, CAST(coalesce(max(p_size), 0) AS BIGINT) AS max_ms, CAST(coalesce(min(p_size), 0) AS BIGINT) AS min_ms FROM part"


def a22_fact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy("kind", "family").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("caller").alias("callers"))


QUERIES["a22_fact_counts"] = a22_fact_counts
ORACLE["a22_fact_counts"] = f"WITH {FACTS_SQL} SELECT kind, family, count(*) AS n, count(DISTINCT caller) AS callers FROM facts GROUP BY kind, family"


def a23_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("severity")
    return scored(spark, sf_dir).groupBy("l_returnflag").agg(F.count_if(s == "Error").alias("errors"), F.count_if(s == "Warning").alias("warnings"), F.count_if(s == "Note").alias("notes"), F.count(F.lit(1)).alias("n"))


QUERIES["a23_severity_counts"] = a23_severity_counts
ORACLE["a23_severity_counts"] = f"WITH {CANDIDATES_SQL} SELECT l_returnflag, count(*) FILTER (WHERE severity = 'Error') AS errors, count(*) FILTER (WHERE severity = 'Warning') AS warnings, count(*) FILTER (WHERE severity = 'Note') AS notes, count(*) AS n FROM cand JOIN kinds ON kind = candidate_kind JOIN vd ON verdict = vname GROUP BY l_returnflag"


def a27_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's views of what it clicked on count as hits; bytes by event."""
    return R.hit_rate(facts(spark, sf_dir), ["family"], F.col("kind") == "view", F.col("ord") % 100)


QUERIES["a27_hit_rate"] = a27_hit_rate
ORACLE["a27_hit_rate"] = f"WITH {FACTS_SQL} SELECT family, count(*) AS lookups, count(*) FILTER (WHERE kind = 'view') AS hits, round(count(*) FILTER (WHERE kind = 'view') / count(*), 6) AS hit_rate, CAST(sum(ord % 100) AS BIGINT) AS bytes FROM facts GROUP BY family"


def t3_distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "part").select(F.col("p_type").alias("name"))
    return R.distinct_names(names.unionByName(names.select(F.lower("name").alias("name"))), "name")


QUERIES["t3_distinct_names"] = t3_distinct_names
ORACLE["t3_distinct_names"] = "WITH n AS (SELECT p_type AS name FROM part UNION ALL SELECT lower(p_type) FROM part), d AS (SELECT lower(name) AS folded, min(name) AS name FROM n WHERE name IS NOT NULL GROUP BY lower(name)) SELECT name, row_number() OVER (ORDER BY folded) AS place FROM d"


def j2_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's part: its declaration (parts of size over 25) before its definition (all of even key), before none."""
    part = read(spark, sf_dir, "part")
    decl = part.filter("p_size > 25").select(F.col("p_partkey").alias("callee"), F.col("p_type").alias("declared"))
    defn = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("callee"), F.col("p_brand").alias("defined"))
    calls = candidates(spark, sf_dir).select("seq", F.floor(F.col("idx") / 10).alias("callee"))
    return calls.join(decl, "callee", "left").join(defn, "callee", "left").select("seq", F.coalesce("declared", "defined").alias("signature"))


QUERIES["j2_signature"] = j2_signature
ORACLE["j2_signature"] = "SELECT l_orderkey * 10 + l_linenumber AS seq, CASE WHEN p_size > 25 THEN p_type WHEN p_partkey % 2 = 0 THEN p_brand END AS signature FROM lineitem LEFT JOIN part ON l_partkey = p_partkey"


def j12_with_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's facts: those of its customer, of its clerk's number, of its own number, and of its date's day if it is shipped at once."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("alloc_caller"), (F.col("o_orderkey") % 1000).alias("release_caller"), (F.col("o_orderkey") % 77).alias("alloc_function"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") % 500).alias("release_function"))
    return R.with_facts(orders, facts(spark, sf_dir).filter("kind = 'error'").select(F.col("caller").alias("symbol")), ["alloc_caller", "release_caller", "alloc_function", "release_function"])


QUERIES["j12_with_facts"] = j12_with_facts
ORACLE["j12_with_facts"] = f"""WITH {FACTS_SQL}, f AS (SELECT caller AS symbol, count(*) AS n FROM facts WHERE kind = 'error' GROUP BY caller),
k AS (SELECT o_orderkey AS idx, o_custkey AS s FROM orders UNION ALL SELECT o_orderkey, o_orderkey % 1000 FROM orders UNION ALL SELECT o_orderkey, o_orderkey % 77 FROM orders UNION ALL SELECT o_orderkey, o_custkey % 500 FROM orders WHERE o_orderstatus = 'F')
SELECT idx, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_facts FROM k LEFT JOIN f ON s = symbol GROUP BY idx"""


def j14_declaration_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without double releases (pending orders) that only touch declarations: parts are functions, declared if their key
    is no multiple of 3, defined if it is even; callers are suppliers' numbers among them."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"))
    lines = read(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("idx"), F.when(F.col("l_linestatus") == "O", "DoubleRelease").otherwise("DefiniteLeak").alias("kind"), F.col("l_partkey").alias("alloc_function"), F.when(F.col("l_returnflag") != "A", F.col("l_partkey") % 97 + 1).alias("release_function"), F.when(F.col("l_linenumber") > 1, F.col("l_suppkey")).alias("alloc_caller"), F.when(F.col("l_linenumber") > 2, F.col("l_suppkey") % 7 + 1).alias("release_caller"))
    return R.without_declarations(lines, part.filter("symbol % 3 != 0"), part.filter("symbol % 2 = 0")).select("idx", "kind")


QUERIES["j14_declaration_only"] = j14_declaration_only
ORACLE["j14_declaration_only"] = """WITH dec AS (SELECT p_partkey AS s FROM part WHERE p_partkey % 3 <> 0), def AS (SELECT p_partkey AS s FROM part WHERE p_partkey % 2 = 0),
c AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS idx, CASE WHEN l_linestatus = 'O' THEN 'DoubleRelease' ELSE 'DefiniteLeak' END AS kind, l_partkey AS a, CASE WHEN l_returnflag <> 'A' THEN l_partkey % 97 + 1 END AS r, CASE WHEN l_linenumber > 1 THEN l_suppkey END AS ac, CASE WHEN l_linenumber > 2 THEN l_suppkey % 7 + 1 END AS rc FROM lineitem)
SELECT idx, kind FROM c WHERE NOT (kind = 'DoubleRelease' AND ((a IN (SELECT s FROM dec) AND a NOT IN (SELECT s FROM def)) OR (r IS NOT NULL AND r IN (SELECT s FROM dec) AND r NOT IN (SELECT s FROM def)))
  AND (ac IS NULL OR ac NOT IN (SELECT s FROM def)) AND (rc IS NULL OR rc NOT IN (SELECT s FROM def)))"""


def j15_runtime_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = candidates(spark, sf_dir).filter(F.col("kind").isin(*LEAK_RANK))
    rows = leaks.select(F.col("seq").alias("idx"), "kind", F.col("resource").alias("alloc_function"), (F.floor(F.col("idx") / 10) % 5000).alias("alloc_caller"), F.col("l_returnflag").alias("family"), "l_linestatus")
    return R.without_overlaps(rows, F.col("l_linestatus") == "F").select("idx", "kind")


QUERIES["j15_runtime_overlap"] = j15_runtime_overlap
ORACLE["j15_runtime_overlap"] = f"""WITH {CANDIDATES_SQL}, l AS (SELECT seq AS idx, kind, resource AS f, (idx // 10) % 5000 AS caller, l_returnflag AS family, l_linestatus = 'F' AS runtime, CASE kind WHEN 'DefiniteLeak' THEN 3 WHEN 'ConditionalLeak' THEN 2 ELSE 1 END AS p FROM cand WHERE kind IN ('DefiniteLeak', 'OwnershipEscapeLeak', 'ConditionalLeak'))
SELECT idx, kind FROM l a WHERE NOT (runtime AND EXISTS (SELECT 1 FROM l b WHERE NOT b.runtime AND b.f = a.caller AND b.family = a.family AND a.p <= b.p))"""


def u3_merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 7).alias("source"), F.col("o_custkey").alias("target"), F.col("o_orderstatus").alias("s"))
    return R.merged_edges(edges.filter("s = 'F'"), edges.filter("s != 'F'"), 1_000_000).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


QUERIES["u3_merged_edges"] = u3_merged_edges
ORACLE["u3_merged_edges"] = "WITH e AS (SELECT CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 7 > 0 THEN o_orderkey % 7 + 1000000 ELSE o_orderkey % 7 END AS source, CASE WHEN o_orderstatus <> 'F' AND o_custkey > 0 THEN o_custkey + 1000000 ELSE o_custkey END AS target FROM orders WHERE o_orderstatus IS NOT NULL) SELECT source, target, count(*) AS n FROM e GROUP BY source, target"


def u8_extend_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's kinds of family 0, then those of family 1 that it doesn't have yet."""
    of = lambda f: F.array_sort(F.collect_set(F.when(F.col("family") == f, F.col("kind"))))
    return facts(spark, sf_dir).groupBy("caller").agg(F.array_join(F.array_union(of(0), of(1)), ",").alias("kinds"))


QUERIES["u8_extend_unique"] = u8_extend_unique
ORACLE["u8_extend_unique"] = f"""WITH {FACTS_SQL}, k AS (SELECT caller, kind, min(family) AS first FROM facts WHERE family < 2 GROUP BY caller, kind), c AS (SELECT DISTINCT caller FROM facts)
SELECT c.caller, coalesce(string_agg(kind, ',' ORDER BY first, kind), '') AS kinds FROM c LEFT JOIN k ON c.caller = k.caller GROUP BY c.caller"""
