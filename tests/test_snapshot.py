import tempfile

from pyspark.sql import functions as F

from tidewater.sources import ir, snapshot

TEXT = {
    "a": "define void @fa() {\n  call void @fb()\n  ret void\n}\ndeclare void @fb()",
    "b": "define void @fb() {\n  call void @fc()\n  ret void\n}\ndeclare void @fc()",
    "c": "define void @fc() {\n  ret void\n}",
    "d": "define void @fd() {\n  call void @fa()\n  ret void\n}\ndeclare void @fa()",
    "e": "define void @fe() {\n  call void @puts()\n  ret void\n}\ndeclare void @puts()",
    "f": "define void @ff() {\n  call void @fe()\n  ret void\n}\ndeclare void @fe()",
}


def run(spark, path, texts, seen):
    def parse(modules):
        seen.append(sorted(r["module_id"] for r in modules.collect()))
        found = ir.parse(ir.from_text(modules))
        return {name: found[name] for name in ("functions", "calls", "instructions")}

    def analyse(tables):
        """Calls of what other modules define, with the number of that function's instructions: it reads two modules at once."""
        size = tables["instructions"].groupBy(F.col("func").alias("callee"), F.col("module_id").alias("home")).agg(F.count(F.lit(1)).alias("n"))
        return tables["calls"].join(size, "callee").select("module_id", "caller", "callee", "home", "n")

    rows = spark.createDataFrame(list(texts.items()), "module_id string, value string")
    state = snapshot.update(spark, path, rows, parse, analyse, parts=8)
    read = lambda name: sorted(map(repr, snapshot.read(spark, f"{path}/{name}").collect()))
    return {r["module_id"]: r["state"] for r in state.collect()}, {name: read(name) for name in ("functions", "calls", "instructions", "analysis", "snapshot")}


def test_only_what_changed_is_parsed_again(spark):
    path, seen = "file://" + tempfile.mkdtemp(prefix="spark-snapshot-"), []
    first, _ = run(spark, path, TEXT, seen)
    assert set(first.values()) == {"added"} and seen == [sorted(TEXT)]
    now = dict(TEXT) | {"c": "define void @fc() {\n  %x = add i32 1, 2\n  ret void\n}", "g": "define void @fg() {\n  call void @fc()\n  ret void\n}\ndeclare void @fc()"}
    del now["e"]
    state, tables = run(spark, path, now, seen)
    assert seen[1] == ["c", "g"]
    assert state == {"a": "affected", "b": "affected", "c": "changed", "d": "affected", "e": "removed", "f": "affected", "g": "added"}
    whole, _seen = "file://" + tempfile.mkdtemp(prefix="spark-snapshot-"), []
    assert run(spark, whole, now, _seen)[1] == tables
    state, again = run(spark, path, now, seen)
    assert set(state.values()) == {"same"} and seen[2] == [] and again == tables


def test_files_are_told_apart_without_reading(spark):
    import os
    import time

    path = tempfile.mkdtemp(prefix="spark-snapshot-")
    for n in "ab":
        with open(f"{path}/{n}.ll", "w") as f:
            f.write(n)
    before = snapshot.listing(spark, path).collect()
    os.utime(f"{path}/b.ll", (time.time() + 60, time.time() + 60))
    then = spark.createDataFrame(before, "module_id string, digest string")
    assert {r["module_id"]: r["state"] for r in snapshot.changes(snapshot.listing(spark, path), then).collect()} == {"a.ll": "same", "b.ll": "changed"}


def test_edges(spark):
    none = spark.createDataFrame([], "module_id string, digest string")
    used = spark.createDataFrame([], "module_id string, used string")
    assert snapshot.stale(snapshot.changes(none, none), used).collect() == []
    cycle = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c")], "module_id string, used string")
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "module_id string, digest string")
    now = spark.createDataFrame([("a", "2"), ("b", "1"), ("c", "1")], "module_id string, digest string")
    assert {r["module_id"]: r["state"] for r in snapshot.stale(snapshot.changes(now, old), cycle).collect()} == {"a": "changed", "b": "affected", "c": "same"}
