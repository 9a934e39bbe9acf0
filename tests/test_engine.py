import json

import pytest

from tidewater.plans import engine
from tidewater.sources import ir, sinks

MODULE = '''
target datalayout = "e-m:e-p:64:64-i64:64"
target triple = "x86_64-unknown-linux-gnu"
declare ptr @malloc(i64)
declare void @free(ptr)
declare ptr @_Znwm(i64)
declare ptr @_Znam(i64)
declare void @_ZdlPv(ptr)
declare void @"odd name"(ptr)

define void @wrong(i64 %n) {
entry:
  %p = call ptr @malloc(i64 %n)   ; grab
  store i32 1, ptr %p
  call void @_ZdlPv(ptr %p)
  ret void
}
define void @clean(i64 %n) {
  %p = call ptr @malloc(i64 %n), !dbg !7
  %c = icmp eq ptr %p, null
  br i1 %c, label %a, label %b
  call void @free(ptr %p)
  ret void
}
define void @twice() {
  %p = call ptr @malloc(i64 8)
  call void @free(ptr %p)
  call void @free(ptr %p)
  ret void
}
define void @after() {
  %p = call ptr @malloc(i64 8)
  call void @free(ptr %p)
  %x = load i32, ptr %p
  ret void
}
define ptr @gives() {
  %p = call ptr @malloc(i64 8)
  ret ptr %p
}
define void @leaks() {
  %p = call ptr @_Znam(i64 8)
  ret void
}
!7 = !DILocation(line: 12, column: 3, scope: !5)
'''


@pytest.fixture(scope="module")
def tables(spark):
    rows = spark.createDataFrame([("a.ll", MODULE), ("b.ll", "define void @malloc(i64 %n) {\n  ret void\n}\n")], "module_id string, value string")
    return ir.parse(ir.from_text(rows))


def test_parse(spark, tables):
    f = {(r["module_id"], r["name"]): r for r in tables["functions"].collect()}
    assert f["a.ll", "malloc"]["is_declaration"] and not f["b.ll", "malloc"]["is_declaration"] and ("a.ll", "odd name") in f
    assert f["a.ll", "malloc"]["return_type"] == "ptr" and f["a.ll", "wrong"]["params"] == ["i64 %n"]
    calls = [(r["caller"], r["callee"], r["result"], r["is_external"]) for r in tables["calls"].orderBy("call_idx").collect()]
    assert calls[:2] == [("wrong", "malloc", "%p", True), ("wrong", "_ZdlPv", None, True)] and len(calls) == 11
    kinds = [r["kind"] for r in tables["instructions"].filter("func = 'clean'").orderBy("inst_idx").collect()]
    assert kinds == ["Call", "ICmp", "Br", "Call", "Ret"]
    m = {r["module_id"]: r for r in tables["modules"].collect()}
    assert m["a.ll"]["pointer_size"] == 8 and m["a.ll"]["little_endian"] and m["a.ll"]["target_triple"].startswith("x86_64")
    assert [(r["dbg"], r["line"], r["column"]) for r in tables["locations"].collect()] == [("7", 12, 3)]


def test_issues(spark, tables):
    got = sorted((r["function"], r["issue_kind"]) for r in engine.issues(spark, tables).collect())
    assert got == [("after", "UseAfterFree"), ("leaks", "DefiniteLeak"), ("twice", "DoubleFree"), ("wrong", "CrossLanguageFree")]


def test_user_family_from_config(spark, tables):
    from tidewater.operators import dimensions as D

    made = ir.config(spark, '[[families]]\nname = "POOL"\nacquire = ["pool_get"]\nrelease = ["pool_put"]\n[[boundaries]]\nfrom = "C"\nto = "Rust"\npattern = "rs_*"\n')
    rows = [tuple(r) for r in made["families"].collect()]
    assert ("pool_put", "POOL", "Release") in rows and made["boundaries"].count() == 1
    assert D.family_symbols(spark, rows).filter("family = 'POOL'").count() == 2


def test_project_and_sinks(spark, tables):
    assert [tuple(r) for r in engine.project(tables).collect()] == [("malloc", "b.ll", "a.ll")]
    found = engine.issues(spark, tables)
    report = json.loads(sinks.sarif(found))
    assert report["version"] == "2.1.0" and len(report["runs"][0]["results"]) == 4
    assert json.loads(sinks.to_json(found).first()["value"])["module_id"] == "a.ll"


def test_sarif_has_every_issue_or_says_how_many_are_left_out(spark):
    found = spark.range(10_050).selectExpr("'DoubleFree' AS issue_kind", "'Error' AS severity", "cast(id % 7 AS string) AS module_id", "id AS line", "'f' AS function", "'free' AS symbol")
    run = json.loads(sinks.sarif(found))["runs"][0]
    assert len({r["locations"][0]["physicalLocation"]["region"]["startLine"] for r in run["results"]}) == 10_050 and "properties" not in run
    cut = json.loads(sinks.sarif(found, 50))["runs"][0]
    assert len(cut["results"]) == 50 and cut["properties"] == {"resultsLeftOut": 10_000}


def test_json_source_and_cache(spark, tables, tmp_path):
    module = {"module_id": "j", "functions": [{"name": "f", "return_type": "void", "params": [], "blocks": [{"label": "e", "successors": ["x"], "instructions": [{"opcode": "call", "dest": "%p", "operands": ["8"], "callee": "malloc"}]}]}], "declarations": [{"name": "malloc"}]}
    (tmp_path / "m.json").write_text(json.dumps(module))
    got = ir.read_json(spark, str(tmp_path / "m.json"))
    assert got["calls"].first()["callee"] == "malloc" and got["cfg_edges"].count() == 1 and got["functions"].count() == 2
    assert got["calls"].first()["is_external"] and got["instructions"].first()["kind"] == "Call"
    assert got["calls"].columns == tables["calls"].columns or set(got["calls"].columns) == set(tables["calls"].columns)
    assert {name: set(got[name].columns) for name in tables} == {name: set(df.columns) for name, df in tables.items()} | {"functions": set(got["functions"].columns)}
    assert [x["issue_kind"] for x in engine.issues(spark, got).collect()] == ["DefiniteLeak"]
    ir.save({"calls": tables["calls"]}, str(tmp_path / "cache"))
    assert ir.load(spark, str(tmp_path / "cache"), ["calls"], ["a.ll"])["calls"].count() == 11 and ir.load(spark, str(tmp_path / "cache"), ["calls"], ["none"])["calls"].count() == 0
    assert spark.read.parquet(str(tmp_path / "cache/calls")).filter("module_id = 'a.ll'").count() == 11
    (tmp_path / "x.ll").write_text(MODULE)
    assert ir.parse(ir.lines(spark, str(tmp_path / "x.ll")))["calls"].count() == 11
