"""Queries of nested type layouts: every part is a struct of one of six forms whose text is parsed; it holds the struct of another part, nested a few deep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import layouts
from tidewater.plans.tables import read

QUERIES, ORACLE = {}, {}
_TYPES = list(layouts.SIZES)
#: By the remainder of the part's key: the struct's text; {a}, {b}, {c} are scalars, {q} the named struct within it.
_FORMS = ["{{ {a}, {q}, {b} }}", "<{{ {a}, {q}, {b} }}>", "{{ [3 x {q}], {a}, {b} }}", "{{ {a}, {b}, <4 x {c}> }}", "{{ {{ {a}, {q} }}, {b} }}", "{{ {a}, {q}*, {b}, [2 x [5 x {c}]] }}"]


def structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    pick = lambda k: F.element_at(F.array(*map(F.lit, _TYPES)), (F.floor(p / k) % len(_TYPES) + 1).cast("int"))
    inner = F.when(p % 97 == 0, p).otherwise(F.floor(F.floor(p / 5) / 3) * 5 + p % 5)
    values = {"{a}": pick(1), "{b}": pick(11), "{c}": pick(121), "{q}": F.concat(F.lit("%struct.T"), inner)}
    text = lambda form: F.concat(*[values.get(x, F.lit(x.replace("{{", "{").replace("}}", "}"))) for x in _pieces(form)])
    body = text(_FORMS[5])
    for k in range(5):
        body = F.when(p % 6 == k, text(_FORMS[k])).otherwise(body)
    line = F.concat(F.lit("%struct.T"), p, F.lit(" = type "), body)
    return layouts.definitions(read(spark, sf_dir, "part").select(F.concat(F.lit("m"), p % 5).alias("module_id"), line.alias("line")))


def _pieces(form: str) -> list[str]:
    out = [form]
    for mark in ("{a}", "{b}", "{c}", "{q}"):
        out = [y for x in out for y in ([x] if x in ("{a}", "{b}", "{c}", "{q}") else sum([[piece, mark] for piece in x.split(mark)], [])[:-1])]
    return [x for x in out if x]


_UP = lambda at, n: f"(({at} + {n} - 1) // {n} * {n})"
_PICK = lambda k: f"(CASE CAST(floor(p_partkey / {k}.0) AS BIGINT) % {len(_TYPES)} " + " ".join(f"WHEN {i} THEN {layouts.SIZES[t]}" for i, t in enumerate(_TYPES)) + " END)"
_ISNUM = lambda k: f"(CAST(floor(p_partkey / {k}.0) AS BIGINT) % {len(_TYPES)} IN ({', '.join(str(i) for i, t in enumerate(_TYPES) if t[0] == 'i' or t in ('float', 'double'))}))"
_ISINT = lambda k: f"(CAST(floor(p_partkey / {k}.0) AS BIGINT) % {len(_TYPES)} IN ({', '.join(str(i) for i, t in enumerate(_TYPES) if t[0] == 'i')}))"
#: The struct's fields as (size, align) pairs, at most four; the missing are (0, 1).
_PAIRS = {0: ["a, a", "rs, ra", "b, b", "0, 1"], 1: ["a, a", "rs, ra", "b, b", "0, 1"], 2: ["3 * rs, ra", "a, a", "b, b", "0, 1"], 3: ["a, a", "b, b", "4 * c, least(4 * c, 16)", "0, 1"], 4: [_UP(_UP("a", "ra") + " + rs", "greatest(a, ra)") + ", greatest(a, ra)", "b, b", "0, 1", "0, 1"], 5: ["a, a", "8, 8", "b, b", "10 * c, c"]}
_CASE = lambda i, j: "CASE f " + " ".join(f"WHEN {k} THEN {_split(v[i])[j]}" for k, v in _PAIRS.items()) + " END"


def _split(pair: str) -> tuple[str, str]:
    depth = 0
    for i, ch in enumerate(pair):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            return pair[:i].strip(), pair[i + 1 :].strip()
    raise ValueError(pair)


def _sized(source: str) -> str:
    """From rows with f, a, b, c, rs, ra: sizes and alignments of the fields, then the ends of each and the size."""
    pairs = ", ".join(f"CAST({_CASE(i, 0)} AS BIGINT) AS s{i}, CAST({_CASE(i, 1)} AS BIGINT) AS a{i}" for i in range(4))
    e1 = f"SELECT *, s0 AS e0 FROM (SELECT *, {pairs} FROM {source})"
    e2 = f"SELECT *, {_UP('e0', 'a1')} + s1 AS e1 FROM ({e1})"
    e3 = f"SELECT *, {_UP('e1', 'a2')} + s2 AS e2 FROM ({e2})"
    e4 = f"SELECT *, {_UP('e2', 'a3')} + s3 AS e3, greatest(a0, a1, a2, a3) AS g FROM ({e3})"
    return f"SELECT *, CASE WHEN f = 1 THEN s0 + s1 + s2 ELSE {_UP('e3', 'g')} END AS size, CASE WHEN f = 1 THEN 1 ELSE g END AS align FROM ({e4})"


SQL = f"""d AS (SELECT p_partkey AS p, p_partkey % 6 AS f, {_PICK(1)} AS a, {_PICK(11)} AS b, {_PICK(121)} AS c, {_ISNUM(1)} AS an, {_ISNUM(11)} AS bn, {_ISINT(1)} AS ai, {_ISINT(11)} AS bi,
  CASE WHEN p_partkey % 97 = 0 THEN p_partkey ELSE p_partkey // 5 // 3 * 5 + p_partkey % 5 END AS q FROM part),
root AS (SELECT *, CAST(0 AS BIGINT) AS rs, CAST(1 AS BIGINT) AS ra, f IN (3, 5) AS complete FROM d WHERE f IN (3, 5) OR q NOT IN (SELECT p FROM d)),
lay AS (SELECT p, size, align, complete FROM ({_sized("root")})
  UNION ALL SELECT p, size, align, complete FROM ({_sized("(SELECT d.*, l.size AS rs, l.align AS ra, l.complete FROM lay l JOIN d ON d.q = l.p AND d.f NOT IN (3, 5))")})),
whole AS MATERIALIZED (SELECT d.*, CASE WHEN d.f IN (3, 5) OR l.p IS NULL THEN 0 ELSE l.size END AS rs, CASE WHEN d.f IN (3, 5) OR l.p IS NULL THEN 1 ELSE l.align END AS ra, m.complete FROM d JOIN lay m ON m.p = d.p LEFT JOIN lay l ON l.p = d.q),
sized AS MATERIALIZED ({_sized("whole")})"""


def d6_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, alignment and padding of nested structs (D-6, F-30)."""
    laid = layouts.layouts(structs(spark, sf_dir))
    return laid.select("module_id", "name", "packed", "size", "align", "padding", "complete", "recursive")


QUERIES["d6_layouts"] = d6_layouts
ORACLE["d6_layouts"] = f"""WITH RECURSIVE {SQL}
SELECT 'm' || d.p % 5 AS module_id, 'struct.T' || d.p AS name, d.f = 1 AS packed, CAST(s.size AS BIGINT) AS size, CAST(s.align AS BIGINT) AS align, CAST(s.size - s0 - s1 - s2 - s3 AS BIGINT) AS padding, coalesce(s.complete, FALSE) AS complete, s.p IS NULL AS recursive FROM d LEFT JOIN sized s ON s.p = d.p"""


def d6_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padding, order, endianness and bit fields of nested structs (D-6, T-7)."""
    return layouts.findings(layouts.layouts(structs(spark, sf_dir)))


_BEST = "list_sort([struct_pack(a := -a0, s := -s0, i := 0), struct_pack(a := -a1, s := -s1, i := 1), struct_pack(a := -a2, s := -s2, i := 2), struct_pack(a := -a3, s := -s3, i := 3)])"
_B = lambda i: (f"(-o[{i + 1}].s)", f"(-o[{i + 1}].a)")
_END = _B(0)[0]
for _i in range(1, 4):
    _END = f"({_UP(_END, _B(_i)[1])} + {_B(_i)[0]})"
#: By form: the scalar fields, as (place from 1, column).
_SCALAR = {0: [(1, "a"), (3, "b")], 1: [(1, "a"), (3, "b")], 2: [(2, "a"), (3, "b")], 3: [(1, "a"), (2, "b")], 4: [(2, "b")], 5: [(1, "a"), (3, "b")]}
_NUMBERS = " UNION ALL ".join(f"SELECT p, f, {place} AS field, {col} AS s, {col}n AS num, {col}i AS int_ FROM sized WHERE f = {form}" for form, had in _SCALAR.items() for place, col in had)
_GAPS = " UNION ALL ".join(f"SELECT p, 'StructPadding' AS issue, {i + 1} AS field, {_UP(f'e{i - 1}', f'a{i}')} - e{i - 1} AS bytes FROM sized WHERE f <> 1" for i in range(1, 4))
QUERIES["d6_findings"] = d6_findings
ORACLE["d6_findings"] = f"""WITH RECURSIVE {SQL}, num AS ({_NUMBERS}), gap AS ({_GAPS}), best AS (SELECT p, size, {_UP("x", "g")} AS y FROM (SELECT *, {_END} AS x FROM (SELECT *, {_BEST} AS o FROM sized WHERE f <> 1))),
u AS (SELECT p, issue, field, bytes FROM gap WHERE bytes > 0 UNION ALL SELECT p, 'FieldOrdering', NULL, size - y FROM best WHERE y < size
UNION ALL SELECT p, 'ExcessivePadding', NULL, size - s0 - s1 - s2 - s3 FROM sized WHERE (size - s0 - s1 - s2 - s3) * 2 > size
UNION ALL SELECT p, 'EndiannessIssue', field, s FROM num WHERE num AND s > 1 UNION ALL SELECT p, 'EndiannessIssue', field, s FROM num WHERE num AND s > 1 AND f = 1 UNION ALL SELECT p, 'BitfieldLayoutIssue', field, s FROM num WHERE int_ AND s = 1 AND f = 1)
SELECT 'm' || p % 5 AS module_id, 'struct.T' || p AS name, issue, CAST(field AS INTEGER) AS field, CAST(bytes AS BIGINT) AS bytes FROM u"""
