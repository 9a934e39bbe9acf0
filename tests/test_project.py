import numpy as np

from tidewater import spark as T
from tidewater.operators import project

FUNCTIONS, CALLS = "module_id string, name string, is_declaration boolean", "module_id string, caller string, callee string, line int"


def resolved(functions, calls):
    """By plain loops over all definitions."""
    out = []
    for module, caller, callee, line in calls:
        at = {m for m, n, declared in functions if n == callee and not declared and n is not None}
        kind = "Local" if module in at else "External" if not at else "Unique" if len(at) == 1 else "Ambiguous"
        out.append((module, caller, callee, line, kind, module if module in at else min(at) if len(at) == 1 else None))
    return sorted(out, key=repr)


def test_calls_resolve_as_by_loops(spark, monkeypatch):
    rng = np.random.default_rng(1)
    # one callee holds a third of the calls, and one module half of those
    functions = [(f"m{rng.integers(12)}", f"f{rng.integers(60)}", bool(rng.integers(3))) for _ in range(90)] + [("m1", None, False)]
    calls = [(f"m{0 if i % 6 == 0 else rng.integers(12)}", "f1", "f7" if i % 3 == 0 else None if i % 50 == 1 else f"f{rng.integers(80)}", i) for i in range(3000)] + [("m99", "f1", "f2", 1)] * 2
    f, c = spark.createDataFrame(functions + functions[:5], FUNCTIONS), spark.createDataFrame(calls, CALLS)
    want = resolved(functions, calls)
    assert {r[4] for r in want} == {"Local", "Unique", "Ambiguous", "External"}
    for busy in (1000, 20, 10**9):
        monkeypatch.setattr(T.split_join, "__defaults__", ("inner", busy))
        got = project.resolved_calls(f, c).select("module_id", "caller", "callee", "line", "resolution", "target")
        assert sorted(map(tuple, got.collect()), key=repr) == want
    deps = {(r["module_id"], r["target"]): (r["n_calls"], r["n_symbols"]) for r in project.dependencies(got).collect()}
    unique = [r for r in want if r[4] == "Unique"]
    assert deps == {k: (sum((r[0], r[5]) == k for r in unique), len({r[2] for r in unique if (r[0], r[5]) == k})) for k in {(r[0], r[5]) for r in unique}}


def test_symbols(spark):
    rows = [("a", "f", False), ("b", "f", True), ("c", "f", False), ("c", "f", False), ("b", "g", True), ("a", "h", False), ("a", "h", True), ("a", None, False)]
    got = {r["symbol"]: tuple(r)[1:] for r in project.symbols(spark.createDataFrame(rows, FUNCTIONS)).collect()}
    assert got == {"f": (2, 1, "a", True), "g": (0, 1, None, False), "h": (1, 1, "a", False)}


def test_languages_of_modules(spark):
    rust, declared = ("main_rust", "_RNvC3app4main", False), lambda m, *names: [(m, n, True) for n in names]
    functions = [
        ("pure", "_RNvC3app4main", False), *declared("pure", "__rust_alloc", "llvm.memcpy"),
        ("two_externs", "_RNvC3app4main", False), *declared("two_externs", "malloc", "free"), ("two_externs", "free", True),
        ("imports", "_RNvC3app4main", False), *declared("imports", "malloc", "free", "mmap"),
        ("only_intrinsics", "_RNvC3app4main", False), *declared("only_intrinsics", "llvm.a", "llvm.b", "llvm.c"),
        ("defines_c", "_RNvC3app4main", False), ("defines_c", "a", False), ("defines_c", "b", False), ("defines_c", "c", False),
        ("cpp", "app::run", False), *declared("cpp", "__cxa_throw", "__gxx_personality", "__cxa_begin"),
        ("cpp_mangled", "_Z3runv", False), ("mixed", "_RNvC3app4main", False), ("mixed", "PyList_New", True), ("plain_c", "run", False), *declared("plain_c", "malloc", "free", "mmap"), ("nothing", None, False), rust,
    ]
    calls = [("main_rust", "_RNvC3app4main", "_cgo_run", 1), ("called", "run", "PyList_New", 1), ("called", None, None, 2)]
    got = {r["module_id"]: tuple(r)[1:] for r in project.module_languages(spark.createDataFrame(functions, FUNCTIONS), spark.createDataFrame(calls, CALLS)).collect()}
    assert got == {
        "pure": ("Rust", 0, False, True), "two_externs": ("Rust", 2, False, True), "imports": ("Rust", 3, False, False), "only_intrinsics": ("Rust", 0, False, True), "defines_c": ("Rust", 0, False, True),
        "cpp": ("Cpp", 0, False, True), "cpp_mangled": ("Cpp", 0, True, False), "mixed": ("Python,Rust", 0, False, False), "plain_c": ("", 0, False, True), "main_rust": ("Go,Rust", 0, False, False), "called": ("Python", 0, False, True),
    }


def test_no_rows(spark):
    f, c = spark.createDataFrame([], FUNCTIONS), spark.createDataFrame([], CALLS)
    assert project.symbols(f).count() == project.resolved_calls(f, c).count() == project.module_languages(f, c).count() == 0
    only = project.resolved_calls(f, spark.createDataFrame([("a", "f", "g", 1)], CALLS)).collect()
    assert [(r["resolution"], r["target"]) for r in only] == [("External", None)]
