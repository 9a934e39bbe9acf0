import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tidewater.sources import sarif

SCHEMA = "kind string, severity string, description string, cwe int, file string, line int, column int, trace array<struct<file:string,line:int,description:string>>, boundary struct<caller:string,caller_lang:string,callee:string,callee_lang:string,kind:string>"
ROWS = [
    ("DoubleFree", "Error", 'said "twice"\n', 415, "a.c", 7, None, [("a.c", 3, "made"), (None, None, "freed")], ("f", "Rust", "g", "C", "Call")),
    ("NoSuchKind", "Info", None, None, None, None, None, [], None),
    ("MemoryLeak", "Warning", "é", None, "b.c", 9, 4, None, None),
]


def test_one_document_with_flows(spark):
    path = tempfile.mkdtemp(prefix="spark-sarif-") + "/out.sarif"
    sarif.write(spark.createDataFrame(ROWS, SCHEMA).repartition(3), path, "X/")
    with open(path) as f:
        got = json.load(f)
    assert got["version"] == "2.1.0" and len(got["runs"][0]["tool"]["driver"]["rules"]) == len(sarif.RULES)
    found = {r["ruleId"]: r for r in got["runs"][0]["results"]}
    first, none, leak = found["X/DoubleFree"], found["X/NoSuchKind"], found["X/MemoryLeak"]
    rules = got["runs"][0]["tool"]["driver"]["rules"]
    assert rules[first["ruleIndex"]]["id"] == "X/DoubleFree" and rules[leak["ruleIndex"]]["id"] == "X/MemoryLeak"
    assert first["message"]["text"] == 'said "twice"\n (CWE-415)' and first["level"] == "error"
    flow = first["codeFlows"][0]["threadFlows"][0]["locations"]
    assert flow[0]["location"]["physicalLocation"] == {"artifactLocation": {"uri": "a.c"}, "region": {"startLine": 3}} and flow[1] == {"location": {"message": {"text": "freed"}}}
    assert first["relatedLocations"][0]["message"]["text"] == "FFI boundary: f (Rust) -> g (C) [Call]"
    assert none["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "unknown"}, "region": {"startLine": 1}} and not {"codeFlows", "relatedLocations", "ruleIndex"} & set(none) and none["level"] == "note"
    assert leak["locations"][0]["physicalLocation"]["region"] == {"startLine": 9, "startColumn": 4} and leak["message"]["text"] == "é"
    assert os.listdir(os.path.dirname(path)) == ["out.sarif"]


def test_no_issue_and_failed_jobs(spark):
    folder = tempfile.mkdtemp(prefix="spark-sarif-")
    sarif.write(spark.createDataFrame([], SCHEMA), f"{folder}/none.sarif")
    with open(f"{folder}/none.sarif") as f:
        assert json.load(f)["runs"][0]["results"] == []
    broken = spark.createDataFrame(ROWS, SCHEMA).withColumn("description", F.when(F.col("kind") == "MemoryLeak", F.raise_error("no")).otherwise(F.col("description")))
    with pytest.raises(Exception, match="no"):
        sarif.write(broken, f"{folder}/broken.sarif")
    assert os.listdir(folder) == ["none.sarif"]


def test_many_issues(spark):
    path = tempfile.mkdtemp(prefix="spark-sarif-") + "/many.sarif"
    one = spark.createDataFrame(ROWS[:1], SCHEMA)
    sarif.write(spark.range(0, 60_000, 1, 5).crossJoin(F.broadcast(one)).withColumn("line", F.col("id").cast("int")).drop("id"), path)
    with open(path) as f:
        got = json.load(f)["runs"][0]["results"]
    assert sorted(r["locations"][0]["physicalLocation"]["region"]["startLine"] for r in got) == list(range(60_000))
