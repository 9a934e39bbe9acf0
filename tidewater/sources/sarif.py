"""SARIF 2.1.0 of any number of issues: results are built and written by the tasks, and joined to one document piece by piece."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tidewater.spark import ship

# The kinds that have a rule, in the order of their index, and their CWE numbers.
RULES = [
    ("CrossLanguageFree", 762), ("OwnershipViolation", 763), ("FfiTypeMismatch", 843), ("AbiMismatch", 758), ("UncheckedReturn", 252), ("FfiUnsafeCall", 119), ("CallbackEscape", 749), ("DoubleFree", 415), ("UseAfterFree", 416), ("InvalidFree", 763), ("MemoryLeak", 401), ("BufferOverflow", 120), ("NullDereference", 476), ("IntegerOverflow", 190),
    ("CrossFamilyFree", 762), ("ConditionalLeak", 772), ("DefiniteLeak", 772), ("BorrowEscape", 822), ("CallbackEscapeIssue", 749), ("NeedsModel", None), ("DataRace", 362), ("LockOrderViolation", 833), ("ThreadCrossing", 362), ("WriteToImmutable", 123), ("DoubleReclaim", 415), ("OwnershipEscapeLeak", 772), ("Unknown", None),
]
# Kinds that concern a boundary between languages; SARIF levels of severities, all others are notes.
AT_BOUNDARY = {"CrossLanguageFree", "OwnershipViolation", "FfiTypeMismatch", "AbiMismatch", "UncheckedReturn", "FfiUnsafeCall", "CallbackEscape"}
LEVEL = {"Error": "error", "Warning": "warning"}
#: Bytes copied at once when the parts are joined.
PIECE = 1 << 20


def _look(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def results(issues: DataFrame, prefix: str = "") -> DataFrame:
    """One SARIF result a row, as ``value``, from (kind, severity, description, cwe, file, line, column, trace, boundary).

    ``trace`` is an array of (file, line, description) in order, its code flow; ``boundary`` is (caller, caller_lang, callee,
    callee_lang, kind), its related location. Null ones are left out; an entry without a file has only its message. An issue without a
    file is at "unknown", line 1. A kind without a rule has no index. JSON is built by the JVM.
    """
    place = lambda file, line: F.struct(F.struct(file.alias("uri")).alias("artifactLocation"), line.alias("region"))
    line, column = F.col("line").cast("int"), F.coalesce(F.col("column").cast("int"), F.lit(1))
    region = F.when(F.col("file").isNotNull(), F.struct(F.coalesce(line, F.lit(1)).alias("startLine"), column.alias("startColumn"))).otherwise(F.struct(F.lit(1).alias("startLine"), F.lit(None).cast("int").alias("startColumn")))
    message = F.concat(F.coalesce("description", F.lit("")), F.coalesce(F.concat(F.lit(" (CWE-"), F.col("cwe").cast("string"), F.lit(")")), F.lit("")))

    def entry(t: Column) -> Column:
        at = F.when(t["file"].isNotNull(), place(t["file"], F.struct(t["line"].cast("int").alias("startLine"))))
        return F.struct(F.struct(at.alias("physicalLocation"), F.struct(F.coalesce(t["description"], F.lit("")).alias("text")).alias("message")).alias("location"))

    flow = F.when(F.size("trace") > 0, F.array(F.struct(F.array(F.struct(F.transform("trace", entry).alias("locations"))).alias("threadFlows"))))
    b = F.col("boundary")
    text = F.format_string("FFI boundary: %s (%s) -> %s (%s) [%s]", b["caller"], b["caller_lang"], b["callee"], b["callee_lang"], b["kind"])
    related = F.when(b.isNotNull(), F.array(F.struct(F.struct(text.alias("text")).alias("message"))))
    number = {k: i for i, (k, _) in enumerate(RULES)}
    whole = F.struct(
        F.concat(F.lit(prefix), "kind").alias("ruleId"), _look(number, F.col("kind")).alias("ruleIndex"), F.coalesce(_look(LEVEL, F.col("severity")), F.lit("note")).alias("level"), F.struct(message.alias("text")).alias("message"),
        F.array(F.struct(place(F.coalesce("file", F.lit("unknown")), region).alias("physicalLocation"))).alias("locations"), flow.alias("codeFlows"), related.alias("relatedLocations"),
    )
    return issues.select(F.to_json(whole).alias("value"))


def head(prefix: str = "", name: str = "tidewater", version: str = "1") -> tuple[str, str]:
    """What stands before and after the results."""
    rules = []
    for kind, cwe in RULES:
        short = f"{kind} detected"
        tag = "ffi-boundary" if kind in AT_BOUNDARY else "memory-safety"
        rules.append({"id": prefix + kind, "shortDescription": {"text": short}, "fullDescription": {"text": short if cwe is None else f"{short} (CWE-{cwe})"}, "properties": {"tags": [tag, "security"]}} | ({} if cwe is None else {"helpUri": f"https://cwe.mitre.org/data/definitions/{cwe}.html"}))
    driver = {"name": name, "version": version, "rules": rules}
    return '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":' + json.dumps(driver) + '},"results":[', '],"invocations":[{"executionSuccessful":true}]}]}\n'


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int


class SarifSource(DataSource):
    """``df.write.format("sarif").option("path", file)``: rows (value) become one document at ``path``.

    Each task writes a part of its own beside it, under a name no other attempt has. The commit copies the parts that count to the
    document in pieces of a megabyte, so the driver holds no issue, then deletes them; a failed job leaves no document. The order of
    results is that of the partitions. The document is one file, so its copying is the one serial step.
    """

    @classmethod
    def name(cls) -> str:
        return "sarif"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> SarifWriter:  # noqa: ANN001
        return SarifWriter(self.options["path"], self.options.get("prefix", ""), overwrite)


class SarifWriter(DataSourceWriter):
    def __init__(self, path: str, prefix: str, overwrite: bool) -> None:
        self.path, self.prefix, self.overwrite = path, prefix, overwrite
        self.scratch = f"{path}.parts-{uuid.uuid4().hex}"
        system, _, scratch = self._open()
        system.create_dir(scratch, recursive=True)  # here only: a task that outlives a failed job finds no folder to write to

    def _open(self):  # noqa: ANN202
        from pyarrow import fs

        where = self.path if "://" in self.path else f"file://{self.path}"
        system, path = fs.FileSystem.from_uri(where)
        return system, path, path + self.scratch[len(self.path) :]

    def write(self, rows: Iterator) -> Part:
        system, _, scratch = self._open()
        mine, n = f"{scratch}/{uuid.uuid4().hex}", 0
        with system.open_output_stream(mine) as out:
            for row in rows:
                out.write((",\n" if n else "").encode() + row[0].encode())
                n += 1
        return Part(mine.rsplit("/", 1)[1], n)

    def commit(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        system, path, scratch = self._open()
        if not self.overwrite and system.get_file_info(path).type != fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(self.path)
        before, after = head(self.prefix)
        whole, first = f"{scratch}/whole", True
        with system.open_output_stream(whole) as out:
            out.write(before.encode())
            for part in messages:
                if part is not None and part.rows:
                    out.write(b"\n" if first else b",\n")
                    first = False
                    with system.open_input_stream(f"{scratch}/{part.path}") as piece:
                        while got := piece.read(PIECE):
                            out.write(got)
            out.write(after.encode())
        system.move(whole, path)
        system.delete_dir(scratch)

    def abort(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        system, _, scratch = self._open()
        if system.get_file_info(scratch).type != fs.FileType.NotFound:
            system.delete_dir(scratch)


def write(issues: DataFrame, path: str, prefix: str = "") -> None:
    """One SARIF document of all ``issues`` (see ``results``) at ``path``, a file in a file system that driver and executors share."""
    spark = issues.sparkSession
    ship(spark)
    spark.dataSource.register(SarifSource)
    results(issues, prefix).write.format("sarif").mode("overwrite").option("path", path).option("prefix", prefix).save()
