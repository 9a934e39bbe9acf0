"""Compiler IR as tables: textual modules line by line, JSON modules, and parsed tables kept as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.spark import carried

#: Instruction kinds by opcode, in rule order. The IR's own opcodes.
KINDS = [
    ("Alloca", "alloca"), ("Load", "load"), ("Store", "store"), ("GetElementPtr", "getelementptr"), ("ICmp", "icmp"), ("FCmp", "fcmp"), ("AtomicRmw", "atomicrmw"), ("CmpXchg", "cmpxchg"), ("Br", "br|switch|indirectbr"), ("Ret", "ret"), ("Phi", "phi"), ("Select", "select"),
    ("Conversion", "trunc|zext|sext|fptrunc|fpext|fptoui|fptosi|uitofp|sitofp|ptrtoint|inttoptr|bitcast|addrspacecast"), ("BinaryOp", "add|fadd|sub|fsub|mul|fmul|udiv|sdiv|fdiv|urem|srem|frem|shl|lshr|ashr|and|or|xor"),
]
#: A name with its sigil: a register, or a global, quoted or not.
_NAME = r'"[^"]*"|[-\w.$]+'
#: Calls: the register made, then a named or an indirect callee, then the arguments up to the call's own closing bracket.
_MADE = rf"^(?:(%(?:{_NAME}))\s*=\s*)?(?:tail |musttail |notail )?(?:call|invoke)\s"
_CALLED = rf"{_MADE}(?:[^@\"(]|\([^()]*\)\**\s)*?([@%](?:{_NAME}))\((.*)$"
_LABEL = rf"^({_NAME}):(?:\s.*)?$"
#: What stands in a line beside its values: types in brackets and braces, named types, labels, alignments, address spaces, metadata.
_NO_VALUE = r"<?\{[^{}]*\}>?|\[\d+ x [^\[\]]*\]|<\d+ x [^<>]*>|%(?:struct|class|union|enum)\.[-\w.$:]+|label %(?:\"[^\"]*\"|[-\w.$]+)|,?\s*align \d+|addrspace\(\d+\)|,?\s*![-\w.$]+(?:\s*![-\w.$]+|\([^()]*\))*|\b(?:call|invoke|to|unwind)\b"
_VALUE = rf"(?<![\w.$%@\"!#-])([%@](?:{_NAME})|(?:null|undef|poison|zeroinitializer|true|false|-?\d+(?:\.\d+)?(?:e[+-]?\d+)?|0x[0-9A-Fa-f]+)(?![\w.$\"]))"
_COMMENT = r'^((?:[^";]++|"[^"]*+"?)*+);.*$'


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(module_id, line_no, line) of textual modules. Line numbers come from each file's own text, so they don't depend on how
    files are split; a module is one row while it is split, so modules, not folders, must fit a task."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("module_id"), "value")
    return from_text(text)


def from_text(modules: DataFrame) -> DataFrame:
    """The same from rows (module_id, value)."""
    return modules.select("module_id", F.posexplode(F.split("value", "\n")).alias("line_no", "raw")).select("module_id", "line_no", without_comment("raw").alias("line"), "raw")


def without_comment(raw: str) -> Column:
    """A line without its comment, which begins at the first semicolon outside quotes."""
    return F.trim(F.when(F.contains(F.col(raw), F.lit(";")), F.regexp_replace(raw, _COMMENT, "$1")).otherwise(F.col(raw)))


def _name(found: Column) -> Column:
    return F.regexp_replace(found, '^[@%]?"?|"$', "")


def _arguments(rest: Column) -> Column:
    """The arguments of a call, from what follows its opening bracket: up to the bracket that closes it, split at outer commas."""
    inside = F.regexp_replace(rest, r'("[^"]*"|\((?:[^()"]|"[^"]*"|\((?:[^()"]|"[^"]*")*\))*\)|\{[^{}]*\}|\[[^\[\]]*\]|<[^<>]*>)', "\u0002$1\u0002")
    simple = F.split(F.substring_index(rest, ")", 1), ",")
    pieces = F.split(F.regexp_extract(inside, "^((?:[^\u0002)]|\u0002[^\u0002]*\u0002)*)", 1), ",(?=(?:[^\u0002]*\u0002[^\u0002]*\u0002)*[^\u0002]*$)")
    args = F.when(F.rlike(rest, F.lit(r'["(\[{<]')), F.transform(pieces, lambda p: F.translate(p, "\u0002", ""))).otherwise(simple)
    return F.filter(F.transform(args, lambda a: F.trim(a)), lambda a: a != "")


def kind_of(opcode: Column, indirect: Column | None = None) -> Column:
    kind = F.when(opcode.isin("call", "invoke"), "Call" if indirect is None else F.when(indirect, "IndirectCall").otherwise("Call"))
    for name, ops in KINDS:
        kind = kind.when(opcode.isin(*ops.split("|")), name)
    return kind.otherwise("Other")


def successors(opcode: Column, line: Column) -> Column:
    """The labels that a branch may go to; null for other instructions."""
    targets = F.regexp_extract_all(line, F.lit(rf"label %({_NAME})"), F.lit(1))
    return F.when(opcode.isin("br", "switch", "invoke", "indirectbr"), F.array_distinct(F.transform(targets, _name)))


def parse(rows: DataFrame, short: bool = False) -> dict[str, DataFrame]:
    """modules, functions, instructions, calls, control-flow edges and debug locations of textual modules.

    The current function and block are carried forward over stretches of each module's lines, so a long module is no one task (one
    window a module where the caller knows all of them to be ``short``);
    everything else is one projection a table. Operands are an instruction's values in order: registers, globals and constants, for
    a call its arguments, for a phi what comes in. An indirect call has the register as its callee. Calls outside any function have
    the caller <top-level>. A call is external if its module declares the callee. A function's first block is "entry" if unnamed.
    """
    head = F.when(F.startswith("line", F.lit("define")), _name(F.regexp_extract("line", rf"(@(?:{_NAME}))\(", 1)))
    close = F.when(F.col("line") == "}", F.lit("\u0000"))
    label = F.when(head.isNotNull() | close.isNotNull(), F.lit("\u0000")).otherwise(F.when(F.endswith("line", F.lit(":")) | F.contains("line", F.lit(": ")), F.nullif(_name(F.regexp_extract("line", _LABEL, 1)), F.lit(""))))
    rows = carried(rows, ["module_id"], "line_no", {"_at": F.coalesce(head, close), "_block": label}, "idx", short=short)
    rows = rows.withColumn("func", F.when(F.col("_at") != "\u0000", F.col("_at"))).withColumn("block", F.when(F.col("_block") != "\u0000", F.col("_block")).otherwise(F.lit("entry")))
    signature = F.startswith("line", F.lit("define")) | F.startswith("line", F.lit("declare"))
    functions = rows.filter(signature).select(
        "module_id", _name(F.regexp_extract("line", rf"(@(?:{_NAME}))\(", 1)).alias("name"), F.startswith("line", F.lit("declare")).alias("is_declaration"),
        F.filter(F.transform(F.split(F.regexp_extract("line", r"@(?:\"[^\"]+\"|[-\w.$]+)\(([^)]*)\)", 1), ","), lambda p: F.trim(p)), lambda p: p != "").alias("params"),
        F.regexp_extract("line", r"^(?:define|declare)\s+(?:[a-z_]+\s+)*?((?:void|ptr|i\d+|float|double|\{[^}]*\}|%[\w.]+)\**)\s+@", 1).alias("return_type"),
    )
    body = rows.filter(F.col("func").isNotNull() & ~signature & ~F.col("line").isin("", "}") & ~F.startswith("line", F.lit("!")) & ~(F.contains("line", F.lit(":")) & F.rlike("line", F.lit(_LABEL))))
    op = F.regexp_extract("line", rf"^(?:%(?:{_NAME})\s*=\s*)?(?:tail |musttail |notail )?(\w+)", 1)
    made = F.startswith("line", F.lit("%"))
    body = body.withColumn("opcode", op).withColumn("dest", F.when(made, F.nullif(F.regexp_extract("line", rf"^(%(?:{_NAME}))\s*=", 1), F.lit(""))))
    is_call = F.col("opcode").isin("call", "invoke")
    target, rest = F.when(is_call, F.nullif(F.regexp_extract("line", _CALLED, 2), F.lit(""))), F.when(is_call, F.regexp_extract("line", _CALLED, 3))
    body = body.withColumn("_target", target).withColumn("args", F.when(is_call, _arguments(rest)))
    value = lambda text: F.regexp_extract_all(text, F.lit(_VALUE), F.lit(1))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("line", rf"^%(?:{_NAME})\s*=\s*", ""), r"^(?:getelementptr|load)\b[^,]*,|^alloca\b[^,]*", ""), _NO_VALUE, " ")
    incoming = F.regexp_extract_all("line", F.lit(rf"\[\s*((?:[%@](?:{_NAME})|[-\w.]+))\s*,\s*%(?:{_NAME})\s*\]"), F.lit(1))
    last_value = lambda a: F.try_element_at(value(F.regexp_replace(a, _NO_VALUE, " ")), F.lit(-1))
    operands = F.when(is_call, F.filter(F.transform("args", last_value), lambda v: v.isNotNull())).when(F.col("opcode") == "phi", incoming).otherwise(value(bare))
    indirect = F.startswith("_target", F.lit("%"))
    instructions = body.select(
        "module_id", "func", F.col("idx").alias("inst_idx"), kind_of(F.col("opcode"), indirect).alias("kind"), "opcode", "dest", operands.alias("operands"), F.when(F.contains("line", F.lit("cmp")), F.nullif(F.regexp_extract("line", r"[if]cmp\s+(?:\w+\s+)*?(\w+)\s+(?:ptr|i\d+|float|double|half|<|%|\[|\{)", 1), F.lit(""))).alias("icmp_pred"),
        F.when(~indirect, _name(F.col("_target"))).otherwise(F.col("_target")).alias("callee"), F.when(F.contains("line", F.lit("atomicrmw")), F.nullif(F.regexp_extract("line", r"atomicrmw\s+(?:volatile\s+)?(\w+)", 1), F.lit(""))).alias("atomic_op"), "block", F.col("line").alias("raw_text"),
    )
    edges = body.select("module_id", "func", "block", F.explode(successors(F.col("opcode"), F.col("line"))).alias("successor")).distinct()
    declared = functions.filter("is_declaration").select("module_id", F.col("name").alias("_n")).distinct()
    in_body = rows.filter(F.rlike("line", F.lit(_MADE)))
    call_rest = F.regexp_extract("line", _CALLED, 3)
    calls = in_body.select(
        "module_id", F.col("idx").alias("call_idx"), F.coalesce("func", F.lit("<top-level>")).alias("caller"), F.nullif(F.regexp_extract("line", _CALLED, 2), F.lit("")).alias("_t"), F.nullif(F.regexp_extract("line", _CALLED, 1), F.lit("")).alias("result"),
        _arguments(call_rest).alias("args"), F.nullif(F.regexp_extract("line", r"!dbg !(\d+)", 1), F.lit("")).alias("dbg"),
    ).filter("_t is not null")
    calls = calls.select("module_id", "call_idx", "caller", F.when(F.startswith("_t", F.lit("@")), _name(F.col("_t"))).otherwise(F.col("_t")).alias("callee"), "result", "args", "dbg")
    calls = calls.join(declared, (calls["module_id"] == declared["module_id"]) & (F.col("callee") == F.col("_n")), "left").select(calls["*"], F.col("_n").isNotNull().alias("is_external"))
    places = rows.filter(F.rlike("line", F.lit(r"^!\d+ = .*!DILocation"))).select("module_id", F.regexp_extract("line", r"^!(\d+)", 1).alias("dbg"), F.regexp_extract("line", r"line: (\d+)", 1).cast("int").alias("line"), F.regexp_extract("line", r"column: (\d+)", 1).cast("int").alias("column"))
    quoted = lambda key: F.max(F.nullif(F.regexp_extract("line", key + r'\s*=\s*"([^"]*)"', 1), F.lit("")))
    modules = rows.groupBy("module_id").agg(quoted("^target triple").alias("target_triple"), quoted("^target datalayout").alias("data_layout"))
    size = F.regexp_extract("data_layout", r"(?:^|-)p(?:0)?:(\d+)", 1)
    modules = modules.withColumn("pointer_size", F.when(size != "", size.cast("int") / 8).otherwise(8).cast("int")).withColumn("little_endian", ~F.coalesce(F.startswith("data_layout", F.lit("E")), F.lit(False)))
    return {"modules": modules, "functions": functions, "instructions": instructions, "calls": calls, "cfg_edges": edges, "locations": places}


MODULE_JSON = "module_id string, target_triple string, functions array<struct<name:string,return_type:string,params:array<string>,blocks:array<struct<label:string,successors:array<string>,instructions:array<struct<opcode:string,dest:string,operands:array<string>,callee:string,raw:string>>>>>>, declarations array<struct<name:string,return_type:string,params:array<string>>>"


def read_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Functions, instructions, calls and control-flow edges of modules in JSON, one or more objects a file."""
    return tables(spark.read.schema(MODULE_JSON).json(path, multiLine=True))


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The same from rows of the schema ``MODULE_JSON``."""
    f = rows.select("module_id", F.explode("functions").alias("f"))
    blocks = f.select("module_id", F.col("f.name").alias("func"), F.posexplode("f.blocks").alias("block_no", "b"))
    inst = blocks.select("module_id", "func", "block_no", F.col("b.label").alias("label"), F.posexplode("b.instructions").alias("i", "x")).withColumn("inst_idx", F.row_number().over(Window.partitionBy("module_id", "func").orderBy("block_no", "i")))
    decls = rows.select("module_id", F.explode_outer("declarations").alias("d")).select("module_id", F.col("d.name").alias("name"), F.lit(True).alias("is_declaration"), F.col("d.params").alias("params"), F.col("d.return_type").alias("return_type")).filter("name is not null")
    functions = f.select("module_id", F.col("f.name").alias("name"), F.lit(False).alias("is_declaration"), F.col("f.params").alias("params"), F.col("f.return_type").alias("return_type")).unionByName(decls)
    declared = decls.select("module_id", F.col("name").alias("callee"), F.lit(True).alias("_d")).distinct()
    calls = inst.filter("x.callee is not null").select("module_id", F.col("inst_idx").alias("call_idx"), F.col("func").alias("caller"), F.col("x.callee").alias("callee"), F.col("x.dest").alias("result"), F.col("x.operands").alias("args"), F.lit(None).cast("string").alias("dbg"))
    calls = calls.join(declared, ["module_id", "callee"], "left").withColumn("is_external", F.col("_d").isNotNull()).drop("_d")
    opcode, none = F.col("x.opcode"), F.lit(None).cast("string")
    size = rows.select("module_id", "target_triple").distinct()
    return {
        "modules": size.select("module_id", "target_triple", none.alias("data_layout"), F.lit(8).alias("pointer_size"), F.lit(True).alias("little_endian")),
        "functions": functions,
        "instructions": inst.select("module_id", "func", "inst_idx", kind_of(opcode, F.startswith("x.callee", F.lit("%"))).alias("kind"), opcode.alias("opcode"), F.col("x.dest").alias("dest"), F.coalesce("x.operands", F.array().cast("array<string>")).alias("operands"), F.nullif(F.regexp_extract(F.coalesce("x.raw", F.lit("")), r"icmp\s+(\w+)", 1), F.lit("")).alias("icmp_pred"), F.col("x.callee").alias("callee"), F.nullif(F.regexp_extract(F.coalesce("x.raw", F.lit("")), r"atomicrmw\s+(?:volatile\s+)?(\w+)", 1), F.lit("")).alias("atomic_op"), F.col("label").alias("block"), F.col("x.raw").alias("raw_text")),
        "calls": calls.select("module_id", "call_idx", "caller", "callee", "result", "args", "dbg", "is_external"),
        "cfg_edges": blocks.select("module_id", "func", F.col("b.label").alias("block"), F.explode("b.successors").alias("successor")),
        "locations": calls.select("module_id", "dbg", F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column")).filter("dbg is not null"),
    }


def config(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """User families and boundaries from TOML: families (symbol, family, effect), boundaries (from, to, function, pattern)."""
    import tomllib

    got = tomllib.loads(text)
    families = [(s, f["name"], effect) for f in got.get("families", []) for effect, key in (("Acquire", "acquire"), ("Release", "release")) for s in f.get(key, [])]
    bounds = [(b.get("from"), b.get("to"), b.get("function"), b.get("pattern")) for b in got.get("boundaries", [])]
    return {"families": spark.createDataFrame(families, "symbol string, family string, effect string"), "boundaries": spark.createDataFrame(bounds, "from string, to string, function string, pattern string")}


def load(spark: SparkSession, path: str, names: list[str], modules: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables that ``save`` wrote, of all modules or of some: other modules' folders are not even listed as input."""
    found = {name: spark.read.parquet(f"{path}/{name}") for name in names}
    return found if modules is None else {name: df.filter(F.col("module_id").isin(*modules)) for name, df in found.items()}


def save(tables: dict[str, DataFrame], path: str) -> None:
    """Parsed tables as Parquet, partitioned by module, for runs that read only changed modules."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("module_id").parquet(f"{path}/{name}")
