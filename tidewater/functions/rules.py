"""Ordered string rules as data: one table renders to a Spark column and to a SQL expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A rule is (result, test, text, ...): all its (test, text) pairs must hold. Tests: prefix, suffix, contains, exact, regex.
Rule = tuple


def _test(name: Column, how: str, text: str) -> Column:
    if how == "prefix":
        return F.startswith(name, F.lit(text))
    if how == "suffix":
        return F.endswith(name, F.lit(text))
    if how == "contains":
        return F.contains(name, F.lit(text))
    if how == "regex":
        return F.regexp_like(name, F.lit(text))
    return name == text


def classify(name: Column, rules: list[Rule], default: str | None = "Unknown") -> Column:
    """The result of the first rule that holds, as one CASE; code generation keeps it inside the scan's stage."""
    out = None
    for result, *pairs in rules:
        holds = _test(name, *pairs[:2])
        for i in range(2, len(pairs), 2):
            holds = holds & _test(name, *pairs[i : i + 2])
        out = F.when(holds, result) if out is None else out.when(holds, result)
    return out.otherwise(F.lit(default))


def any_of(name: Column, how: str, texts: list[str]) -> Column:
    """Whether one of the texts fits. Exact texts become one IN list."""
    if how == "exact":
        return name.isin(*texts)
    out = F.lit(False)
    for t in texts:
        out = out | _test(name, how, t)
    return out


def _sql_test(name: str, how: str, text: str) -> str:
    t = "'" + text.replace("'", "''") + "'"
    return {"prefix": f"starts_with({name}, {t})", "suffix": f"suffix({name}, {t})", "contains": f"contains({name}, {t})", "exact": f"{name} = {t}", "regex": f"regexp_matches({name}, {t})"}[how]


def classify_sql(name: str, rules: list[Rule], default: str | None = "Unknown") -> str:
    arms = []
    for result, *pairs in rules:
        arms.append("WHEN " + " AND ".join(_sql_test(name, *pairs[i : i + 2]) for i in range(0, len(pairs), 2)) + f" THEN '{result}'")
    return "CASE " + " ".join(arms) + (f" ELSE '{default}' END" if default is not None else " ELSE NULL END")


def any_sql(name: str, how: str, texts: list[str]) -> str:
    return "(" + " OR ".join(_sql_test(name, how, t) for t in texts) + ")"
