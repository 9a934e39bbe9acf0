"""Queries of function behaviour. Each order is a module with one function; each of its lines gives two instructions, whose forms and
registers its numbers choose, so that chains, cycles and undefined registers all occur. The text is parsed for the operators; the
oracle has the same instructions as rows, from the forms, and states each pattern by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators import behaviour, detectors
from tidewater.plans.tables import read
from tidewater.sources import ir
from tidewater.spark import CHUNK

QUERIES, ORACLE = {}, {}

#: Text with %0 for the instruction's number, %1 and %2 for two numbers from 1 to 8 and 1 to 7; then kind, opcode, register made,
#: callee, operands, comparison or atomic operation that the parser must find.
FORMS = [
    ("%v%0 = call ptr @malloc(i64 8)", "Call", "call", "%v%0", "malloc", ["8"], None),
    ("call void @free(ptr noundef %v%1) ; of ;", "Call", "call", None, "free", ["%v%1"], None),
    ("call void @free(ptr %p)", "Call", "call", None, "free", ["%p"], None),
    ("store ptr null, ptr %s, align 8", "Store", "store", None, None, ["null", "%s"], None),
    ("store ptr %v%1, ptr %s", "Store", "store", None, None, ["%v%1", "%s"], None),
    ("store ptr %v%1, ptr @g%2", "Store", "store", None, None, ["%v%1", "@g%2"], None),
    ("store ptr %p, ptr @g%2", "Store", "store", None, None, ["%p", "@g%2"], None),
    ("%v%0 = icmp eq ptr %p, null", "ICmp", "icmp", "%v%0", None, ["%p", "null"], "eq"),
    ("%v%0 = icmp eq i32 %v%1, %2", "ICmp", "icmp", "%v%0", None, ["%v%1", "%2"], "eq"),
    ("br i1 %v%1, label %x, label %y", "Br", "br", None, None, ["%v%1"], None),
    ("%v%0 = alloca [8 x i8], align 8", "Alloca", "alloca", "%v%0", None, [], None),
    ("%v%0 = getelementptr inbounds %struct.t, ptr %v%1, i64 4", "GetElementPtr", "getelementptr", "%v%0", None, ["%v%1", "4"], None),
    ("%v%0 = getelementptr i8, ptr %p, i64 %2", "GetElementPtr", "getelementptr", "%v%0", None, ["%p", "%2"], None),
    ("%v%0 = load ptr, ptr %v%1, align 8, !tbaa !4", "Load", "load", "%v%0", None, ["%v%1"], None),
    ("%v%0 = load ptr, ptr @g%2", "Load", "load", "%v%0", None, ["@g%2"], None),
    ("%v%0 = phi ptr [ %v%1, %x ], [ %p, %y ]", "Phi", "phi", "%v%0", None, ["%v%1", "%p"], None),
    ("%v%0 = atomicrmw volatile sub ptr %p, i32 1 seq_cst", "AtomicRmw", "atomicrmw", "%v%0", None, ["%p", "1"], "sub"),
    ("call void %fp(ptr %v%1)", "IndirectCall", "call", None, "%fp", ["%v%1"], None),
    ("%v%0 = add nsw i64 %n, 1%2", "BinaryOp", "add", "%v%0", None, ["%n", "1%2"], None),
    ("ret ptr %v%1", "Ret", "ret", None, None, ["%v%1"], None),
    ("ret void", "Ret", "ret", None, None, [], None),
    ("%v%0 = call i32 @Bun__init(ptr %s, ptr %p)", "Call", "call", "%v%0", "Bun__init", ["%s", "%p"], None),
    ("store ptr %v%1, ptr %v%2", "Store", "store", None, None, ["%v%1", "%v%2"], None),
    ("%v%0 = bitcast ptr %v%1 to ptr", "Conversion", "bitcast", "%v%0", None, ["%v%1"], None),
    ("%v%0 = select i1 %c, ptr %v%1, ptr %v%2", "Select", "select", "%v%0", None, ["%c", "%v%1", "%v%2"], None),
    ("call ptr @memset(ptr %p, i8 0, i64 %v%1)", "Call", "call", None, "memset", ["%p", "0", "%v%1"], None),
    ("call void %fp(ptr %p, i32 %2)", "IndirectCall", "call", None, "%fp", ["%p", "%2"], None),
    ("%v%0 = load ptr, ptr %s", "Load", "load", "%v%0", None, ["%s"], None),
    ("store ptr %p, ptr %s", "Store", "store", None, None, ["%p", "%s"], None),
]


def longest(spark: SparkSession, sf_dir: str) -> int:
    """How many lines the largest order has."""
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").count().agg(F.max("count")).first()[0] or 0


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module_id, r, c, a, b): an order's lines in turn with how many there are. They are dealt by module once, by their numbers; the
    text made from them stays where it is."""
    module = Window.partitionBy("module_id")
    own = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("m"), "l_orderkey").alias("module_id"), "l_linenumber", F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return own.select("module_id", F.row_number().over(module.orderBy("l_linenumber", "a", "b")).alias("r"), F.count(F.lit(1)).over(module).alias("c"), "a", "b")


def lines(spark: SparkSession, sf_dir: str, forms: list[tuple] = FORMS, blocks: bool = False) -> DataFrame:
    """The modules' text, line by line, as the IR source reads it; with ``blocks`` each order line's instructions are a block that
    branches to two of the function."""
    k, r, c, a, b = len(forms), *map(F.col, "rcab")
    each = 4 if blocks else 2
    none = F.lit(None)

    def line(at, n=none, form=none, x=none, y=none, raw=none):
        return F.struct(at.cast("int").alias("line_no"), n.cast("int").alias("n"), form.cast("int").alias("k"), x.cast("int").alias("x"), y.cast("int").alias("y"), raw.cast("string").alias("raw"))

    first = each * r - (2 if blocks else 1)
    made = [line(first, 2 * r - 1, a % k, b % 8 + 1, a % 7 + 1), line(first + 1, 2 * r, (F.floor(a / k) + b) % k, a % 8 + 1, b % 7 + 1)]
    if blocks:
        made += [line(4 * r - 3, raw=F.concat(F.lit("b"), "r", F.lit(":  ; preds"))), line(4 * r, raw=F.concat(F.lit("br i1 %c, label %b"), b % c + 1, F.lit(", label %b"), a % c + 1))]
    head = F.when(r == 1, line(F.lit(0), raw=F.concat(F.lit("define ptr @fn"), F.substring("module_id", 2, 20), F.lit("(ptr %p, i64 %n) {"))))
    foot = F.when(r == c, line(each * c + 1, raw=F.lit("}")))
    every = owned(spark, sf_dir).select("module_id", F.explode(F.array(head, *made, foot)).alias("i")).filter("i is not null").select("module_id", "i.*")
    text = F.element_at(F.array(*[F.lit(t) for t, *_ in forms]), F.col("k") + 1)
    for mark, value in (("%0", "n"), ("%1", "x"), ("%2", "y")):
        text = F.replace(text, F.lit(mark), F.col(value).cast("string"))
    return every.select("module_id", "line_no", F.coalesce("raw", text).alias("raw")).select("module_id", "line_no", ir.without_comment("raw").alias("line"), "raw")


def fits(spark: SparkSession, sf_dir: str) -> bool:
    """Whether every module's lines are few enough for one window."""
    return 2 * longest(spark, sf_dir) + 2 <= CHUNK


def instructions(spark: SparkSession, sf_dir: str, short: bool | None = None) -> DataFrame:
    return ir.parse(lines(spark, sf_dir), fits(spark, sf_dir) if short is None else short)["instructions"]


def _sql(v) -> str:
    return "NULL" if v is None else "[" + ", ".join(map(_sql, v)) + "]::VARCHAR[]" if isinstance(v, list) else f"'{v}'"


def _filled(x: str) -> str:
    return f"replace(replace(replace({x}, '%0', CAST(n AS VARCHAR)), '%1', CAST(x AS VARCHAR)), '%2', CAST(y AS VARCHAR))"


def rows_sql(forms: list[tuple]) -> str:
    """The same instructions as rows; h is a function's number."""
    k = len(forms)
    return f"""form(k, kind, opcode, dest, callee, ops, how) AS (VALUES {", ".join(f"({i}, " + ", ".join(_sql(v) for v in f[1:]) + ")" for i, f in enumerate(forms))}),
own AS (SELECT l_orderkey AS h, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r, l_partkey AS a, l_suppkey AS b FROM lineitem),
two AS (SELECT h, 2 * r - 1 AS n, a % {k} AS k, b % 8 + 1 AS x, a % 7 + 1 AS y FROM own UNION ALL SELECT h, 2 * r, (a // {k} + b) % {k}, a % 8 + 1, b % 7 + 1 FROM own),
i AS MATERIALIZED (SELECT h, n, kind, opcode, {_filled("dest")} AS dest, callee, list_transform(ops, lambda o: {_filled("o")}) AS ops, how, kind = 'Call' AND callee = 'free' AS rel, kind = 'Call' AND callee IN ('free', 'malloc') AS mem FROM two JOIN form USING (k)),
j AS MATERIALIZED (SELECT *, ops[1] AS o0, ops[2] AS o1, kind = 'Store' AND ops[1] = 'null' AS nul FROM i)"""


SQL = rows_sql(FORMS)
_NAME = "'m' || h AS module_id, 'fn' || h AS func"


def s8_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every parsed instruction (S-8): quotes, comments, globals, constants, types and labels in the way."""
    return instructions(spark, sf_dir).select("module_id", "func", F.col("inst_idx").cast("long").alias("inst_idx"), "kind", "opcode", "dest", "callee", F.array_join("operands", ",").alias("operands"), F.coalesce("icmp_pred", "atomic_op").alias("how"))


QUERIES["s8_forms"] = s8_forms
ORACLE["s8_forms"] = f"WITH {SQL} SELECT {_NAME}, n + 1 AS inst_idx, kind, opcode, dest, callee, array_to_string(ops, ',') AS operands, how FROM i"


def d1_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behaviour patterns of every function (D-1a to D-1j, D-2)."""
    return behaviour.patterns(instructions(spark, sf_dir))


_NEW = "(SELECT h, dest FROM j WHERE kind IN ('Call', 'Alloca') AND dest IS NOT NULL)"
_TESTED = """EXISTS (SELECT 1 FROM j c WHERE c.h = s.h AND c.kind = 'ICmp' AND c.n + 2 <= s.n AND EXISTS (SELECT 1 FROM j b WHERE b.h = c.h AND b.opcode = 'br' AND b.n BETWEEN c.n + 1 AND c.n + 3)
    AND NOT EXISTS (SELECT 1 FROM j t WHERE t.h = c.h AND t.kind IN ('ICmp', 'Ret') AND t.n BETWEEN c.n + 2 AND s.n - 1))"""
#: Each pattern by its definition; ``first`` tables have a place, of which the least counts.
PATTERNS_SQL = f"""made AS (SELECT h, dest, min(n) AS n FROM j WHERE dest IS NOT NULL GROUP BY h, dest),
param AS (SELECT DISTINCT h, o FROM (SELECT h, unnest(ops) AS o FROM j WHERE kind NOT IN ('Call', 'Select')) u WHERE o LIKE '$%%' ESCAPE '$' AND NOT EXISTS (SELECT 1 FROM made WHERE made.h = u.h AND made.dest = u.o)),
flow AS MATERIALIZED (SELECT DISTINCT h, unnest(ops) AS src, dest AS dst FROM j WHERE dest IS NOT NULL AND kind NOT IN ('Call', 'Select')),
stack(h, root, slot, node) AS (SELECT h, n, dest, dest FROM j WHERE kind = 'Alloca' UNION SELECT s.h, s.root, s.slot, f.dst FROM stack s JOIN flow f ON f.h = s.h AND f.src = s.node),
back AS MATERIALIZED (SELECT DISTINCT h, dest AS src, unnest(list_append(ops, callee)) AS dst FROM j WHERE dest IS NOT NULL AND kind IN ('GetElementPtr', 'Conversion', 'Load', 'Select', 'Phi', 'Call', 'IndirectCall')),
ret AS (SELECT h, min(n) AS n, arg_min(coalesce(o0, ''), n) AS o0 FROM j WHERE kind = 'Ret' GROUP BY h),
origin(h, node) AS (SELECT h, o0 FROM ret WHERE o0 LIKE '$%%' ESCAPE '$' UNION SELECT o.h, b.dst FROM origin o JOIN back b ON b.h = o.h AND b.src = o.node WHERE b.dst LIKE '$%%' ESCAPE '$'),
escaped AS (SELECT h, n, o0, o1, (SELECT arg_min(slot, root) FROM stack WHERE stack.h = j.h AND stack.node = j.o0) AS slot FROM j WHERE kind = 'Store' AND o1 LIKE '@%'),
first AS (
  SELECT a.h, 'ConditionalRelease' AS pattern, c.ops[-1] AS detail, a.n * 1000 + c.n AS place FROM j a JOIN j c ON a.h = c.h AND c.kind = 'ICmp' AND list_contains(c.ops, a.dest) WHERE a.how = 'sub'
  UNION ALL SELECT c.h, 'NullGuardedRelease', c.o0, c.n FROM j c JOIN j f ON f.h = c.h AND f.rel AND list_contains(f.ops, c.o0) WHERE c.kind = 'ICmp' AND c.o1 = 'null'
  UNION ALL SELECT h, 'FallibleOutParamInit', t, n FROM (SELECT c.h, c.n, arg_min(s.o1, s.n) AS t FROM j c JOIN j s ON s.h = c.h AND s.nul AND list_contains(c.ops, s.o1) WHERE c.kind = 'Call' GROUP BY c.h, c.n) q
    WHERE EXISTS (SELECT 1 FROM j x WHERE x.h = q.h AND x.kind = 'ICmp' AND x.n > q.n) AND EXISTS (SELECT 1 FROM j x WHERE x.h = q.h AND x.nul AND x.o1 = q.t AND x.n > q.n)
  UNION ALL SELECT f.h, 'FreeThenCallbackUse', f.o0, f.n FROM j f JOIN j u ON u.h = f.h AND u.kind = 'IndirectCall' AND u.n > f.n AND list_contains(u.ops, f.o0) WHERE f.rel
  UNION ALL SELECT c.h, 'BufferOverflow', 'memset add ' || a.ops[2], c.n * 1000 + CAST(a.ops[2] AS INTEGER) FROM j c JOIN j a ON a.h = c.h AND a.opcode = 'add' AND a.dest = c.ops[3] WHERE c.callee = 'memset'
  UNION ALL SELECT h, 'StackToGlobalEscape', o1 || ' ' || slot, n FROM escaped WHERE slot IS NOT NULL
  UNION ALL SELECT h, 'HeapToGlobalEscape', o1 || ' ' || o0, n FROM escaped g WHERE slot IS NULL AND EXISTS (SELECT 1 FROM param p WHERE p.h = g.h AND p.o = g.o0)),
one AS (SELECT h, pattern, arg_min(detail, place) AS detail FROM first GROUP BY h, pattern UNION ALL SELECT o.h, 'ReturnAlias', min(o.node) FROM origin o JOIN param p ON p.h = o.h AND p.o = o.node GROUP BY o.h),
e AS (SELECT h, bool_or(nul AND EXISTS (SELECT 1 FROM j r WHERE r.h = s.h AND r.rel AND r.n < s.n AND NOT EXISTS (SELECT 1 FROM j b WHERE b.h = s.h AND (b.kind IN ('Call', 'Ret') OR b.opcode = 'br') AND b.n > r.n AND b.n < s.n))) AS after,
    bool_or(nul AND {_TESTED}) AS error, bool_or(kind = 'Store' AND EXISTS (SELECT 1 FROM {_NEW} d WHERE d.h = s.h AND d.dest = s.o0) AND {_TESTED}) AS owned,
    bool_or(kind = 'Store' AND ((EXISTS (SELECT 1 FROM j d WHERE d.h = s.h AND d.dest = s.o0 AND d.kind IN ('Call', 'IndirectCall')) AND NOT EXISTS (SELECT 1 FROM j d WHERE d.h = s.h AND d.dest = s.o1 AND d.kind = 'Alloca'))
      OR EXISTS (SELECT 1 FROM j d WHERE d.h = s.h AND d.dest = s.o1 AND d.kind IN ('Call', 'IndirectCall')))) AS leaves,
    count(*) AS n, count(*) FILTER (WHERE kind = 'Store') AS stores, count(*) FILTER (WHERE kind = 'Call') AS direct, count(*) FILTER (WHERE kind IN ('Call', 'IndirectCall')) AS calls, count(*) FILTER (WHERE kind = 'AtomicRmw') AS atomics, count(*) FILTER (WHERE kind = 'BinaryOp') AS sums,
    count(*) FILTER (WHERE kind = 'GetElementPtr') AS fields, count(*) FILTER (WHERE kind IN ('GetElementPtr', 'Conversion', 'Ret', 'Phi', 'Load')) AS views, arg_min(callee, n) FILTER (WHERE mem) AS mem, bool_and(callee = 'Bun__init') FILTER (WHERE kind IN ('Call', 'IndirectCall')) AS bridge FROM j s GROUP BY h),
c AS (SELECT e.*, EXISTS (SELECT 1 FROM one WHERE one.h = e.h AND pattern = 'NullGuardedRelease') AS guarded, EXISTS (SELECT 1 FROM one WHERE one.h = e.h AND pattern = 'ConditionalRelease') AS counted, EXISTS (SELECT 1 FROM one WHERE one.h = e.h AND pattern = 'FallibleOutParamInit') AS fallible, coalesce(ret.o0, '') = '' AS nothing FROM e LEFT JOIN ret ON e.h = ret.h),
t AS (SELECT *, mem IS NOT NULL AND NOT guarded AS transfer FROM c), p AS (SELECT *, NOT transfer AND NOT counted AND CASE WHEN calls = 0 THEN stores + atomics = 0 AND sums > 0 ELSE mem IS NULL AND NOT leaves END AS pure FROM t),
q AS (SELECT *, NOT (transfer OR pure OR after OR error OR owned OR guarded OR counted OR fallible) AS none FROM p), v AS (SELECT *, none AND fields > 0 AND views * 10 >= n * 8 AND stores + direct + atomics = 0 AS projection FROM q),
every AS (SELECT * FROM one UNION ALL SELECT h, 'NullStoreAfterRelease', NULL FROM v WHERE after UNION ALL SELECT h, 'OutParamNullOnError', NULL FROM v WHERE error UNION ALL SELECT h, 'OutParamOwnedOnSuccess', NULL FROM v WHERE owned
  UNION ALL SELECT h, 'OwnershipTransfer', CASE mem WHEN 'malloc' THEN 'acquire' ELSE 'release' END FROM v WHERE transfer UNION ALL SELECT h, 'PureComputation', NULL FROM v WHERE pure UNION ALL SELECT h, 'PointerProjection', NULL FROM v WHERE projection
  UNION ALL SELECT h, 'Initialization', NULL FROM v WHERE none AND NOT projection AND stores >= 2 AND nothing AND mem IS NULL UNION ALL SELECT h, 'InternalBridge', NULL FROM v WHERE bridge)"""

QUERIES["d1_patterns"] = d1_patterns
ORACLE["d1_patterns"] = f"WITH RECURSIVE {SQL}, {PATTERNS_SQL} SELECT {_NAME}, pattern, detail FROM every"


def d1l_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.returns(instructions(spark, sf_dir))


QUERIES["d1l_returns"] = d1l_returns
ORACLE["d1l_returns"] = f"""WITH {SQL}, r AS (SELECT h, arg_min(coalesce(o0, ''), n) AS o FROM j WHERE kind = 'Ret' GROUP BY h), d AS (SELECT h, dest, arg_min(kind, n) AS kind, arg_min(coalesce(callee, ''), n) AS callee FROM j WHERE kind IN ('Call', 'Load', 'GetElementPtr', 'BinaryOp') AND dest IS NOT NULL GROUP BY h, dest)
SELECT 'm' || r.h AS module_id, 'fn' || r.h AS func, CASE WHEN o = '' THEN 'Void' WHEN kind = 'Call' THEN 'CallResult' WHEN kind = 'Load' THEN 'LoadedValue' WHEN kind = 'GetElementPtr' THEN 'GepResult' WHEN kind = 'BinaryOp' THEN 'Computed' ELSE 'Unknown' END AS source, CASE WHEN kind = 'Call' THEN callee END AS callee
FROM r LEFT JOIN d ON r.h = d.h AND r.o = d.dest"""


def d1k_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.transfers(instructions(spark, sf_dir))


QUERIES["d1k_transfers"] = d1k_transfers
ORACLE["d1k_transfers"] = f"""WITH {SQL}, new AS {_NEW}, s AS (SELECT j.* FROM j SEMI JOIN new ON j.h = new.h AND j.o0 = new.dest WHERE j.kind IN ('Store', 'Ret')), of AS (SELECT DISTINCT h, dest, kind FROM j WHERE kind IN ('GetElementPtr', 'Alloca')),
a AS (SELECT s.h, 'StoreToOwner' AS pattern, arg_min(o1, n) AS detail FROM s JOIN of ON s.h = of.h AND s.o1 = of.dest AND of.kind = 'GetElementPtr' WHERE s.kind = 'Store' GROUP BY s.h
  UNION ALL SELECT h, 'StoreToRuntime', arg_min(o1, n) FROM s WHERE kind = 'Store' AND o1 LIKE '@%' GROUP BY h
  UNION ALL SELECT h, 'ResourceEscape', max(w) FROM (SELECT h, 'ReturnValue' AS w FROM s WHERE kind = 'Ret' UNION ALL SELECT s.h, 'OutParameter' FROM s JOIN of ON s.h = of.h AND s.o1 = of.dest AND of.kind = 'Alloca' WHERE s.kind = 'Store') GROUP BY h
  UNION ALL SELECT h, 'ReleaseOnAllExitPaths', 'free' FROM j GROUP BY h HAVING bool_or(rel) AND coalesce(min(n) FILTER (WHERE rel) < min(n) FILTER (WHERE kind = 'Ret'), TRUE)) SELECT {_NAME}, pattern, detail FROM a"""


def j18_last_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each load with the stores to what it reads, and the last one before it with its value (J-18)."""
    short = fits(spark, sf_dir)
    found = detectors.reaching_stores(instructions(spark, sf_dir, short), short)
    return found.select("module_id", "func", F.col("inst_idx").cast("long").alias("inst_idx"), "address", "n_stores", "last_store", "value")


_STORED = "(SELECT {what} FROM j s WHERE s.h = l.h AND s.kind = 'Store' AND s.o1 = l.o0 AND s.n < l.n)"
QUERIES["j18_last_stores"] = j18_last_stores
ORACLE["j18_last_stores"] = f"""WITH {SQL} SELECT {_NAME}, n + 1 AS inst_idx, o0 AS address, (SELECT count(*) FROM j s WHERE s.h = l.h AND s.kind = 'Store' AND s.o1 = l.o0) AS n_stores, {_STORED.format(what="max(s.n)")} + 1 AS last_store, {_STORED.format(what="arg_max(s.o0, s.n)")} AS value FROM j l WHERE kind = 'Load'"""


def g11_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root sets of all registers and globals (G-11, G-14)."""
    return detectors.roots(instructions(spark, sf_dir))


_IS_NAME = "regexp_matches({0}, '^[%@]')"
_CHAINS = f"""edge AS MATERIALIZED (SELECT h, src, dst FROM (SELECT h, unnest(CASE WHEN kind IN ('Conversion', 'GetElementPtr') THEN ops[1:1] WHEN kind = 'Phi' THEN ops WHEN kind = 'Select' THEN ops[2:3] ELSE [] END) AS src, dest AS dst FROM j WHERE dest IS NOT NULL) WHERE {_IS_NAME.format("src")} UNION ALL {{through}}),
slot AS MATERIALIZED ({{slots}}), name AS (SELECT DISTINCT h, o FROM (SELECT h, unnest(list_append(ops, dest)) AS o FROM j) WHERE {_IS_NAME.format("o")}),
r(h, register, root) AS (SELECT h, o, o FROM name WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.h = name.h AND e.dst = name.o) AND NOT EXISTS (SELECT 1 FROM slot s WHERE s.h = name.h AND s.node = name.o)
  UNION SELECT h, node, root FROM slot UNION SELECT r.h, e.dst, r.root FROM r JOIN edge e ON r.h = e.h AND r.register = e.src)"""
_ROOTS = _CHAINS.format(through="SELECT l.h, s.o0, l.dest FROM j l JOIN j s ON l.h = s.h AND s.kind = 'Store' AND s.o1 = l.o0 WHERE l.kind = 'Load' AND " + _IS_NAME.format("s.o0"), slots="SELECT h, dest AS node, o0 AS root FROM j WHERE kind = 'Load'")
QUERIES["g11_roots"] = g11_roots
ORACLE["g11_roots"] = f"WITH RECURSIVE {SQL}, {_ROOTS} SELECT {_NAME}, register, root FROM r"


def d21_may_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pointers of any two releases of a function may be one (D-21, U-7)."""
    rows = instructions(spark, sf_dir)
    sites = rows.filter("callee = 'free'").select("module_id", "func", "inst_idx", F.try_element_at("operands", F.lit(1)).alias("r"))
    one, two = (sites.select("module_id", "func", F.col("inst_idx").alias(f"{s}_at"), F.col("r").alias(s)) for s in "ab")
    pairs = one.join(two, ["module_id", "func"]).filter("a_at < b_at").select("module_id", "func", "a", "b").distinct()
    return detectors.may_alias(detectors.roots(rows), pairs)


QUERIES["d21_may_alias"] = d21_may_alias
ORACLE["d21_may_alias"] = f"""WITH RECURSIVE {SQL}, {_ROOTS}, p AS (SELECT DISTINCT a.h, a.o0 AS a, b.o0 AS b FROM j a JOIN j b ON a.h = b.h AND a.n < b.n WHERE a.rel AND b.rel)
SELECT {_NAME}, a, b, EXISTS (SELECT 1 FROM r x JOIN r y ON x.h = y.h AND x.root = y.root WHERE x.h = p.h AND x.register = p.a AND y.register = p.b) AS aliased FROM p"""


def w6_poisoned_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of freed memory through registers and slots, in program order (W-6)."""
    short = fits(spark, sf_dir)
    found = detectors.poisoned_uses(instructions(spark, sf_dir, short), behaviour.RELEASES, short)
    return found.select("module_id", "func", F.col("inst_idx").cast("long").alias("inst_idx"), "register", "use")


_VERSIONS = _CHAINS.format(
    through=f"SELECT h, v, dest FROM (SELECT l.h, l.dest, {_STORED.format(what='arg_max(s.o0, s.n)')} AS v FROM j l WHERE l.kind = 'Load') WHERE {_IS_NAME.format('v')}",
    slots=f"SELECT h, dest AS node, '*' || o0 AS root FROM j l WHERE kind = 'Load' AND {_STORED.format(what='max(s.n)')} IS NULL",
)
_USES = f"""WITH RECURSIVE {SQL}, {_VERSIONS}, freed AS (SELECT j.h, root, min(n) AS at_ FROM j JOIN r ON j.h = r.h AND j.o0 = r.register WHERE rel GROUP BY j.h, root),
used AS (SELECT h, n, CASE WHEN rel THEN 'release' WHEN kind IN ('Call', 'IndirectCall') THEN 'call' ELSE lower(kind) END AS use, unnest(CASE WHEN kind = 'Store' THEN ops[2:2] WHEN kind = 'Load' THEN ops[1:1] ELSE ops END) AS register FROM j WHERE kind IN ('Store', 'Load', 'Call', 'IndirectCall')),
hit AS (SELECT DISTINCT u.h, u.n, u.register, u.use FROM used u JOIN r ON r.h = u.h AND r.register = u.register JOIN freed f ON f.h = u.h AND f.root = r.root WHERE u.n > f.at_)"""
QUERIES["w6_poisoned_uses"] = w6_poisoned_uses
ORACLE["w6_poisoned_uses"] = f"{_USES} SELECT {_NAME}, n + 1 AS inst_idx, register, use FROM hit"


def d18_post_free_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freed memory that is handed to calls (D-18)."""
    short = fits(spark, sf_dir)
    return detectors.post_free_calls(instructions(spark, sf_dir, short), behaviour.RELEASES, short).withColumn("inst_idx", F.col("inst_idx").cast("long"))


QUERIES["d18_post_free_calls"] = d18_post_free_calls
ORACLE["d18_post_free_calls"] = f"{_USES} SELECT {_NAME}, n + 1 AS inst_idx, register FROM hit WHERE use = 'call'"


def d2_constant_overflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies whose size is a parameter and a constant more (D-2)."""
    return detectors.constant_overflows(instructions(spark, sf_dir)).withColumn("inst_idx", F.col("inst_idx").cast("long"))


QUERIES["d2_constant_overflows"] = d2_constant_overflows
ORACLE["d2_constant_overflows"] = f"WITH {SQL} SELECT DISTINCT 'm' || c.h AS module_id, 'fn' || c.h AS func, c.n + 1 AS inst_idx, 'memset' AS callee, 'add' AS opcode, CAST(a.ops[2] AS BIGINT) AS amount FROM j c JOIN j a ON a.h = c.h AND a.opcode = 'add' AND a.dest = c.ops[3] WHERE c.callee = 'memset'"
