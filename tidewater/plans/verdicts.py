"""Queries of the dedup, scoring, life-cycle, gate and reconciliation families. ``lineitem`` rows stand for issue candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import dedup, gate, lifecycle, scoring
from tidewater.operators import dimensions as D
from tidewater.plans.tables import FACTS_SQL, facts, read

QUERIES, ORACLE = {}, {}

_KINDS = [k for k, *_ in D.CANDIDATE_KINDS]
_VERDICTS = [v for v, *_ in D.VERDICTS]


def _pick(values: list[str], key) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _pick_sql(values: list[str], key: str) -> str:
    return "list_extract([" + ", ".join(f"'{v}'" for v in values) + f"], CAST({key} % {len(values)} AS INTEGER) + 1)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as candidates: kind by part, verdict by supplier, evidence by quantity, resource by order."""
    k = F.col
    return read(spark, sf_dir, "lineitem").select(
        (k("l_orderkey") * 10 + k("l_linenumber")).alias("seq"), k("l_orderkey").alias("resource"), (k("l_partkey") * 10 + k("l_linenumber")).alias("idx"), _pick(_KINDS, k("l_partkey")).alias("kind"), _pick(_VERDICTS, k("l_suppkey")).alias("verdict"),
        (k("l_quantity").cast("long") % 5).alias("evidence"), k("l_discount").alias("mean_confidence"), (k("l_returnflag") == "R").alias("is_ffi"), (k("l_linestatus") == "F").alias("family_unknown"), "l_returnflag", "l_linestatus", "l_discount",
    )


CANDIDATES_SQL = f"""cand AS (SELECT l_orderkey * 10 + l_linenumber AS seq, l_orderkey AS resource, l_partkey * 10 + l_linenumber AS idx, {_pick_sql(_KINDS, 'l_partkey')} AS kind, {_pick_sql(_VERDICTS, 'l_suppkey')} AS verdict,
  CAST(l_quantity AS BIGINT) % 5 AS evidence, l_discount AS mean_confidence, l_returnflag = 'R' AS is_ffi, l_linestatus = 'F' AS family_unknown, l_returnflag, l_linestatus, l_discount FROM lineitem),
{D.sql_values('kinds', 'candidate_kind, base_mult, base_add, issue_kind, cwe, fault_class', D.CANDIDATE_KINDS)}, {D.sql_values('vd', 'vname, wm, wa, severity, vrank', D.VERDICTS)}"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir)
    return rows.join(F.broadcast(D.candidate_kinds(spark)), F.col("kind") == F.col("candidate_kind")).join(F.broadcast(D.verdicts(spark)), "verdict")


def f23_risk_mult(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    score = scoring.risk_mult(c("base_mult"), c("weight_mult"), F.when(c("evidence") > 0, c("mean_confidence")), c("verdict") == "Confirmed")
    return scored(spark, sf_dir).select("seq", F.round(score, 6).alias("risk"))


QUERIES["f23_risk_mult"] = f23_risk_mult
ORACLE["f23_risk_mult"] = f"""WITH {CANDIDATES_SQL} SELECT seq, round(least(greatest(base_mult * wm * CASE WHEN evidence > 0 THEN 0.7 + 0.3 * mean_confidence WHEN verdict = 'Confirmed' THEN 0.85 ELSE 0.7 END, 0.0), 1.0), 6) AS risk
FROM cand JOIN kinds ON kind = candidate_kind JOIN vd ON verdict = vname"""


def f24_risk_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    score = scoring.risk_add(c("base_add"), c("weight_add"), c("is_ffi"), c("family_unknown"), c("evidence"), c("verdict") == "ExplainedSafe")
    return scored(spark, sf_dir).select("seq", F.round(score, 6).alias("risk"))


QUERIES["f24_risk_add"] = f24_risk_add
ORACLE["f24_risk_add"] = f"""WITH {CANDIDATES_SQL} SELECT seq, round(CASE WHEN verdict = 'ExplainedSafe' THEN CAST(0 AS DOUBLE) ELSE CAST( least(greatest(base_add * wa + CASE WHEN is_ffi THEN 0.15 ELSE 0.0 END - CASE WHEN family_unknown THEN 0.1 ELSE 0.0 END + least(0.02 * evidence, 0.1), 0.0), 1.0) AS DOUBLE) END, 6) AS risk
FROM cand JOIN kinds ON kind = candidate_kind JOIN vd ON verdict = vname"""


def f26_issue_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("issue_kind", "cwe", "severity").agg(F.count(F.lit(1)).alias("n"), F.max("verdict_rank").cast("long").alias("best"))


QUERIES["f26_issue_kinds"] = f26_issue_kinds
ORACLE["f26_issue_kinds"] = f"WITH {CANDIDATES_SQL} SELECT issue_kind, cwe, severity, count(*) AS n, CAST(max(vrank) AS BIGINT) AS best FROM cand JOIN kinds ON kind = candidate_kind JOIN vd ON verdict = vname GROUP BY issue_kind, cwe, severity"

_ISSUES = list(scoring.BASE_SEVERITY) + ["other"]


def f25_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _pick(_ISSUES, c("l_partkey")).alias("kind"), (c("l_returnflag") == "R").alias("di"), (c("l_linestatus") == "F").alias("ud"), (c("l_suppkey") % 40).alias("freq"), c("l_linenumber").alias("dist"), (c("l_quantity").cast("long") % 4).alias("det"))
    s = scoring.confidence(c("kind"), c("di"), c("ud"), c("freq"), c("dist"), c("det"))
    return rows.withColumn("s", F.round(s, 6)).groupBy(scoring.tier(c("s")).alias("tier"), "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("s"), 6).alias("low"), F.round(F.max("s"), 6).alias("high"))


QUERIES["f25_confidence"] = f25_confidence
_BASE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scoring.BASE_SEVERITY.items()) + " ELSE 0.5 END"
ORACLE["f25_confidence"] = f"""WITH x AS (SELECT {_pick_sql(_ISSUES, 'l_partkey')} AS kind, l_returnflag = 'R' AS di, l_linestatus = 'F' AS ud, l_suppkey % 40 AS freq, l_linenumber AS dist, CAST(l_quantity AS BIGINT) % 4 AS det FROM lineitem),
y AS (SELECT kind, round(least(greatest(CAST({_BASE} AS DOUBLE) + CASE WHEN di THEN 0.2 WHEN ud THEN 0.1 ELSE -0.1 END - CASE WHEN freq > 0 THEN least(0.03 * ln(CAST(freq AS DOUBLE) + 1.0), 0.3) ELSE 0.0 END
  + CASE WHEN dist > 0 THEN least(0.15 / CAST(dist AS DOUBLE), 0.15) ELSE 0.0 END + CASE WHEN det >= 2 THEN 0.15 ELSE 0.0 END, 0.0), 1.0), 6) AS s FROM x)
SELECT CASE WHEN s >= 0.85 THEN 'Critical' WHEN s >= 0.7 THEN 'High' WHEN s >= 0.5 THEN 'Medium' ELSE 'Low' END AS tier, kind, count(*) AS n, round(min(s), 6) AS low, round(max(s), 6) AS high FROM y GROUP BY 1, 2"""


def a6_dedup_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir)
    severity, sure = F.when(F.col("l_linestatus") == "F", 3).otherwise(1), F.floor(F.col("l_discount") * 100 / 4)
    out = dedup.dedup_issues(rows, ["resource", "l_returnflag"], severity, sure, "seq")
    return out.select("resource", "l_returnflag", "seq", "dropped", "first_seq")


QUERIES["a6_dedup_issues"] = a6_dedup_issues
ORACLE["a6_dedup_issues"] = f"""WITH {CANDIDATES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY resource, l_returnflag ORDER BY CASE WHEN l_linestatus = 'F' THEN 3 ELSE 1 END DESC, floor(l_discount * 100 / 4) DESC, seq) AS k,
  count(*) OVER (PARTITION BY resource, l_returnflag) - 1 AS dropped, min(seq) OVER (PARTITION BY resource, l_returnflag) AS first_seq FROM cand)
SELECT resource, l_returnflag, seq, dropped, first_seq FROM r WHERE k = 1"""


def a7_dedup_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir).filter(F.col("kind").isin(*dedup.LEAK_RANK)).withColumn("resource", F.when(F.col("l_returnflag") != "N", F.col("resource")))
    return dedup.dedup_leaks(rows, "resource", "kind", "seq").select("resource", "kind", "seq")


QUERIES["a7_dedup_leaks"] = a7_dedup_leaks
ORACLE["a7_dedup_leaks"] = f"""WITH {CANDIDATES_SQL}, x AS (SELECT CASE WHEN l_returnflag <> 'N' THEN resource END AS resource, kind, seq FROM cand WHERE kind IN ('DefiniteLeak', 'ConditionalLeak', 'OwnershipEscapeLeak')),
r AS (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY CASE kind WHEN 'DefiniteLeak' THEN 3 WHEN 'ConditionalLeak' THEN 2 ELSE 1 END DESC, seq) AS k FROM x) SELECT resource, kind, seq FROM r WHERE k = 1 OR resource IS NULL"""


def a9_best_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.arg_max(scored(spark, sf_dir), ["resource", "fault_class"], [F.col("verdict_rank").desc(), F.col("idx")], "idx").select("resource", "fault_class", "idx", "verdict", "dropped")


QUERIES["a9_best_by_class"] = a9_best_by_class
ORACLE["a9_best_by_class"] = f"""WITH {CANDIDATES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY resource, fault_class ORDER BY vrank DESC, idx) AS k, count(*) OVER (PARTITION BY resource, fault_class) - 1 AS dropped FROM cand JOIN kinds ON kind = candidate_kind JOIN vd ON verdict = vname)
SELECT resource, fault_class, idx, verdict, dropped FROM r WHERE k = 1"""


def a13_state_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.histogram_text(facts(spark, sf_dir), ["caller"], "kind")


QUERIES["a13_state_summary"] = a13_state_summary
ORACLE["a13_state_summary"] = f"WITH {FACTS_SQL}, c AS (SELECT caller, kind, count(*) AS n FROM facts GROUP BY caller, kind) SELECT caller, string_agg(kind || ': ' || n, ', ' ORDER BY n DESC, kind) AS summary FROM c GROUP BY caller"

#: The exit state that each event type stands for.
STATES = {"signup": "Owned", "purchase": "Released", "error": "Unknown", "view": "Null", "click": "Owned"}


def a14_path_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])[F.col("kind")]
    return scoring.path_states(facts(spark, sf_dir).withColumn("state", state), ["caller", "family"], "state")


QUERIES["a14_path_states"] = a14_path_states
_PATHS = f"""{FACTS_SQL}, st AS (SELECT caller, family, CASE kind WHEN 'signup' THEN 'Owned' WHEN 'click' THEN 'Owned' WHEN 'purchase' THEN 'Released' WHEN 'view' THEN 'Null' ELSE 'Unknown' END AS state FROM facts),
ps AS (SELECT caller, family, count(*) AS total, count(*) FILTER (WHERE state = 'Owned') AS owned, count(*) FILTER (WHERE state IN ('Released', 'Null')) AS safe, count(*) FILTER (WHERE state = 'Unknown') AS unknown FROM st GROUP BY caller, family),
pt AS (SELECT *, round(owned / CAST(total AS DOUBLE), 6) AS leak_ratio, CASE WHEN 1 - unknown / CAST(total AS DOUBLE) >= 0.9 THEN 'High' WHEN 1 - unknown / CAST(total AS DOUBLE) >= 0.65 THEN 'Medium' ELSE 'Low' END AS confidence,
  CASE WHEN owned = total THEN 'Definite' WHEN owned > 0 THEN 'Conditional' WHEN unknown > 0 THEN 'NeedsModel' ELSE 'Safe' END AS leak_type FROM ps)"""
ORACLE["a14_path_states"] = f"WITH {_PATHS} SELECT * FROM pt"


def v13_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leak verdicts by counting acquires against releases, by exit states, and by both."""
    rows = facts(spark, sf_dir)
    counted = rows.groupBy("caller", "family").agg(F.count_if(F.col("event") == "Acquire").alias("a"), F.count_if(F.col("event") == "Release").alias("r"))
    counting = F.when(F.col("a") == 0, "NeedsModel").when(F.col("r") >= F.col("a"), "Safe").when(F.col("r") == 0, "Definite").otherwise("Conditional")
    both = counted.withColumn("counting", counting).join(a14_path_states(spark, sf_dir), ["caller", "family"])
    return both.groupBy("counting", F.col("leak_type").alias("path"), scoring.cross_validated(F.col("counting"), F.col("leak_type")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


QUERIES["v13_cross_validation"] = v13_cross_validation
ORACLE["v13_cross_validation"] = f"""WITH {_PATHS}, ct AS (SELECT caller, family, count(*) FILTER (WHERE event = 'Acquire') AS a, count(*) FILTER (WHERE event = 'Release') AS r FROM facts GROUP BY caller, family),
x AS (SELECT CASE WHEN a = 0 THEN 'NeedsModel' WHEN r >= a THEN 'Safe' WHEN r = 0 THEN 'Definite' ELSE 'Conditional' END AS counting, leak_type AS path FROM ct JOIN pt ON ct.caller = pt.caller AND ct.family = pt.family)
SELECT counting, path, CASE WHEN counting = path THEN counting WHEN counting = 'NeedsModel' THEN path WHEN path = 'NeedsModel' THEN counting WHEN counting = 'Safe' AND path IN ('Definite', 'Conditional') THEN 'Safe'
  WHEN counting IN ('Definite', 'Conditional') AND path = 'Safe' THEN counting ELSE 'Conditional' END AS verdict, count(*) AS n FROM x GROUP BY 1, 2, 3"""


def a5_count_by_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acquires of an allocation's kind in the whole module or its caller, and releases in its caller: inclusion-exclusion over two
    grouped counts instead of a theta-join."""
    rows = facts(spark, sf_dir)
    by_family = rows.filter("event = 'Acquire'").groupBy("family").agg(F.count(F.lit(1)).alias("everywhere"))
    by_caller = rows.groupBy("caller", "family").agg(F.count_if(F.col("event") == "Acquire").alias("here"), F.count_if(F.col("event") == "Release").alias("releases"))
    return by_caller.filter("here > 0").join(F.broadcast(by_family), "family").select("caller", "family", F.col("everywhere").alias("alloc_count"), "releases")


QUERIES["a5_count_by_fact"] = a5_count_by_fact
ORACLE["a5_count_by_fact"] = f"""WITH {FACTS_SQL}, a AS (SELECT DISTINCT caller, family FROM facts WHERE event = 'Acquire') SELECT caller, family,
  (SELECT count(*) FROM facts f WHERE f.event = 'Acquire' AND f.family = a.family) AS alloc_count, (SELECT count(*) FROM facts f WHERE f.event = 'Release' AND f.family = a.family AND f.caller = a.caller) AS releases FROM a"""


def a24_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return scoring.precision_metrics(rows, F.col("quality") == 1, F.col("n_chars") < 2000)


QUERIES["a24_precision"] = a24_precision
ORACLE["a24_precision"] = """WITH x AS (SELECT l.quality = 1 AS e, d.n_chars < 2000 AS f FROM labels l JOIN documents d ON l.doc_id = d.doc_id), c AS (SELECT count(*) FILTER (WHERE f AND e) AS tp, count(*) FILTER (WHERE f AND NOT e) AS fp, count(*) FILTER (WHERE NOT f AND e) AS fn, count(*) FILTER (WHERE NOT f AND NOT e) AS tn FROM x),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 1.0 END AS r, CASE WHEN tp + fp > 0 THEN fp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS q FROM c)
SELECT tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1, round(q, 6) AS fp_rate, p >= 0.88 AND q <= 0.12 AS gate_passed FROM m"""


def f17_ffi_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("s"), _pick(list(scoring.PROVENANCE), F.col("p_partkey")).alias("provenance"), (F.col("p_size") > 25).alias("interior"))
    return rows.select("p_partkey", "provenance", F.round(scoring.ffi_safety(F.col("s"), F.col("provenance"), F.col("interior")), 6).alias("score"))


QUERIES["f17_ffi_safety"] = f17_ffi_safety
ORACLE["f17_ffi_safety"] = f"""WITH x AS (SELECT p_partkey, p_size / 50.0 AS s, {_pick_sql(list(scoring.PROVENANCE), 'p_partkey')} AS provenance, p_size > 25 AS interior FROM part)
SELECT p_partkey, provenance, round(least(0.6 * s + 0.4 * CASE provenance WHEN 'Heap' THEN 0.9 WHEN 'Global' THEN 0.8 WHEN 'Stack' THEN 0.2 ELSE 0.5 END + CASE WHEN interior THEN 0.1 ELSE 0.0 END, 1.0), 6) AS score FROM x"""


def w9_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.fold(facts(spark, sf_dir), ["caller", "family"], ["ts", "ord"], "event")


QUERIES["w9_state_machine"] = w9_state_machine
_STEP = "CASE state || '>' || event " + " ".join(f"WHEN '{s}>{e}' THEN '{to}'" for s, row in D.TRANSITIONS.items() for e, to in zip(D.EVENTS, row, strict=True)) + " END"
_TO = f"({_STEP})"
ORACLE["w9_state_machine"] = f"""WITH RECURSIVE {FACTS_SQL}, q AS (SELECT caller, family, event, row_number() OVER (PARTITION BY caller, family ORDER BY ts, ord) AS k FROM facts WHERE event <> 'Acquire'),
w(caller, family, k, state, first_error, n_errors) AS (SELECT caller, family, CAST(0 AS BIGINT), 'Acquired', CAST(NULL AS VARCHAR), CAST(0 AS BIGINT) FROM q WHERE k = 1
UNION ALL SELECT caller, family, k, CASE WHEN nxt IN ('DR', 'RB', 'IT') THEN state ELSE nxt END, coalesce(first_error, CASE nxt WHEN 'DR' THEN 'DoubleRelease' WHEN 'RB' THEN 'ReleaseBorrowed' WHEN 'IT' THEN 'InvalidTransition' END),
  n_errors + CASE WHEN nxt IN ('DR', 'RB', 'IT') THEN 1 ELSE 0 END FROM (SELECT w.caller, w.family, q.k, w.state, w.first_error, w.n_errors, {_TO} AS nxt FROM w JOIN q ON w.caller = q.caller AND w.family = q.family AND q.k = w.k + 1) z)
SELECT caller, family, k AS n_events, state AS final_state, first_error, n_errors, state IN ('Acquired', 'Retained') AS leak FROM (SELECT *, row_number() OVER (PARTITION BY caller, family ORDER BY k DESC) AS r FROM w) y WHERE r = 1"""

_GATED = sorted({k for k, *_ in D.gate_rows()})
_FACTS = sorted({s for _, s, *_ in D.gate_rows()})


def v8_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by supplier and part; every fifth part and supplier carries semantic facts."""
    c = F.col
    issues = read(spark, sf_dir, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("issue_id"), _pick(_GATED, c("l_orderkey")).alias("issue_kind"), F.concat(F.lit("p"), c("l_partkey")).alias("symbol"), F.concat(F.lit("s"), c("l_suppkey")).alias("caller"))
    parts = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), c("p_partkey")).alias("symbol"), _pick(_FACTS, c("p_partkey")).alias("kind"))
    suppliers = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), c("s_suppkey")).alias("symbol"), _pick(_FACTS, c("s_suppkey")).alias("kind"))
    return gate.gate(issues, parts.unionByName(suppliers), D.gate_rules(spark)).groupBy("issue_kind", "gate_verdict").agg(F.count(F.lit(1)).alias("n"))


QUERIES["v8_gate"] = v8_gate
_RULES = D.sql_values("rules", "ik, sk, probe, verdict, priority", D.gate_rows())
ORACLE["v8_gate"] = f"""WITH {_RULES}, i AS (SELECT l_orderkey * 10 + l_linenumber AS issue_id, {_pick_sql(_GATED, 'l_orderkey')} AS issue_kind, {_pick_sql(_FACTS, 'l_partkey')} AS sym_kind, {_pick_sql(_FACTS, 'l_suppkey')} AS caller_kind FROM lineitem),
m AS (SELECT issue_id, verdict, row_number() OVER (PARTITION BY issue_id ORDER BY priority) AS k FROM i JOIN rules ON ik = issue_kind AND ((probe = 'symbol' AND sk = sym_kind) OR (probe = 'caller' AND sk = caller_kind)))
SELECT issue_kind, coalesce(verdict, 'Allow') AS gate_verdict, count(*) AS n FROM i LEFT JOIN (SELECT * FROM m WHERE k = 1) f ON i.issue_id = f.issue_id GROUP BY 1, 2"""


def v11_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gate.reconcile(scored(spark, sf_dir).select("resource", "idx", "fault_class", "verdict_rank"), ["resource"], "fault_class", "verdict_rank", "idx", D.subsumes(spark))
    return out.select("resource", "idx", "fault_class", "action", "cause_idx")


QUERIES["v11_reconcile"] = v11_reconcile
_SUB = D.sql_values("sub", "cause, effect", D.SUBSUMES)
ORACLE["v11_reconcile"] = f"""WITH {CANDIDATES_SQL}, {_SUB}, r AS (SELECT resource, idx, fault_class, vrank FROM cand JOIN kinds ON kind = candidate_kind JOIN vd ON verdict = vname),
h AS (SELECT b.resource, b.idx, min(a.idx) AS cause_idx FROM r a JOIN sub ON a.fault_class = cause AND a.vrank >= 2 JOIN r b ON b.resource = a.resource AND b.fault_class = effect AND a.idx <> b.idx GROUP BY b.resource, b.idx),
x AS (SELECT r.*, h.cause_idx FROM r LEFT JOIN h ON r.resource = h.resource AND r.idx = h.idx), n AS (SELECT *, row_number() OVER (PARTITION BY resource, fault_class, cause_idx IS NULL ORDER BY vrank DESC, idx) AS k FROM x)
SELECT resource, idx, fault_class, CASE WHEN cause_idx IS NOT NULL THEN 'Subsumed' WHEN k > 1 THEN 'Duplicate' ELSE 'Keep' END AS action, cause_idx FROM n"""
