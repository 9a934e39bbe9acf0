"""Layouts of nested types: structs, arrays and vectors in any nesting, named types bottom-up by levels, and what is wrong with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.evidence import SCALARS
from tidewater.spark import materialize, release

# Sizes of scalar types, each aligned to its size; all other types count as (0, 1). Vectors are aligned to at most 16.
SIZES = SCALARS | {"fp128": 16, "ppc_fp128": 16}
VECTOR_ALIGN = 16
# Whether a language may reorder a struct's fields.
REORDERS = {"c": False, "rust": True, "go": True}

_DEFINITION = r'^%("[^"]*"|[-\w.$]+)\s*=\s*type\s+(<?\{.*\}>?|opaque)\s*$'
_TOKEN = r'(<\{|\}>\**|\}\**|\]\**|>\**|[{\[<,]|%(?:"[^"]*"|[-\w.$]+)\**|\d+ x|[A-Za-z]\w*\**)'
_FUNCTION = r"[\w%.]+\**\s*\([^()]*\)\*+"


def definitions(lines: DataFrame) -> DataFrame:
    """(module_id, name, body) of the named types that lines of modules define; of several for one name, the least body."""
    line = F.trim("line")
    found = lines.select("module_id", F.translate(F.regexp_extract(line, _DEFINITION, 1), '"', "").alias("name"), F.regexp_extract(line, _DEFINITION, 2).alias("body"))
    return found.filter("name != ''").groupBy("module_id", "name").agg(F.min("body").alias("body"))


def _up(at: Column, to: Column) -> Column:
    return F.ceil(at / to).cast("long") * to


def _fields(tokens: Column, known: Column) -> Column:
    """Sizes, alignments and texts of a body's outermost fields: one pass over its tokens with a stack of open types.

    A frame is (open, n, at, align, whole): what opened it, the length of an array or vector, the running end and alignment, and whether
    all within is known. A type that ends is put into the frame below; those of the outermost frame are fields.
    """
    sizes = F.create_map(*[F.lit(x) for kv in SIZES.items() for x in kv])
    long = lambda v: F.lit(v).cast("long")
    frame = lambda o, n, at, align, whole: F.struct(o.alias("open"), n.alias("n"), at.alias("at"), align.alias("align"), whole.alias("whole"))
    value = lambda s, a, w: F.struct(s.cast("long").alias("size"), a.cast("long").alias("align"), w.alias("whole"))
    zero = F.struct(
        F.expr("CAST(array() AS array<struct<open:string,n:bigint,at:bigint,align:bigint,whole:boolean>>)").alias("stack"), F.expr("CAST(array() AS array<struct<size:bigint,align:bigint,text:string>>)").alias("fields"), F.lit("").alias("text"), F.lit(True).alias("complete")
    )

    def put(top: Column, v: Column) -> Column:
        s, a, w = v["size"], v["align"], top["whole"] & v["whole"]
        many = top["n"] * s
        return (
            F.when(top["open"] == "{", frame(top["open"], top["n"], _up(top["at"], a) + s, F.greatest(top["align"], a), w))
            .when(top["open"] == "[", frame(top["open"], top["n"], many, a, w))
            .when(top["open"] == "<", frame(top["open"], top["n"], many, F.greatest(long(1), F.least(many, long(VECTOR_ALIGN))), w))
            .otherwise(frame(top["open"], top["n"], top["at"] + s, long(1), w))
        )

    def step(acc: Column, token: Column) -> Column:
        stack, deep = acc["stack"], F.size(acc["stack"])
        top = F.try_element_at(stack, F.lit(-1))
        below = F.slice(stack, 1, F.greatest(deep - 1, F.lit(0)))
        opens, closes = token.isin("{", "<{", "[", "<"), F.substring(token, 1, 1).isin("}", "]", ">")
        counts, pointer = F.endswith(token, F.lit(" x")), F.endswith(token, F.lit("*"))
        named = F.startswith(token, F.lit("%"))
        seen = F.try_element_at(known, F.translate(F.substring(token, 2, 1_000_000), '"', ""))
        plain = F.try_element_at(sizes, token).cast("long")
        eight, yes = value(long(8), long(8), F.lit(True)), F.lit(True)
        by_name = value(F.coalesce(seen["size"], long(0)), F.coalesce(seen["align"], long(1)), F.coalesce(seen["complete"], F.lit(False)))
        scalar = F.when(pointer, eight).when(named, by_name).otherwise(value(F.coalesce(plain, long(0)), F.coalesce(plain, long(1)), plain.isNotNull()))
        closed = F.when(pointer, eight).otherwise(value(F.when(top["open"] == "{", _up(top["at"], top["align"])).otherwise(top["at"]), top["align"], top["whole"]))
        done = F.when(closes, closed).otherwise(scalar)
        rest = F.when(closes, below).otherwise(stack)
        outer = F.size(rest) == 1
        text = F.concat(acc["text"], token, F.when(counts | (token == ","), F.lit(" ")).otherwise(F.lit("")))
        state = lambda st, fi, tx, co: F.struct(st.alias("stack"), fi.alias("fields"), tx.alias("text"), co.alias("complete"))
        fresh = F.when(deep == 0, F.lit("")).otherwise(text)
        grown = F.concat(F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0))), F.array(put(F.try_element_at(rest, F.lit(-1)), done)))
        return (
            F.when(opens, state(F.concat(stack, F.array(frame(token, long(0), long(0), long(1), yes))), acc["fields"], fresh, acc["complete"]))
            .when(counts, state(F.concat(below, F.array(frame(top["open"], F.regexp_extract(token, r"^(\d+)", 1).cast("long"), top["at"], top["align"], top["whole"]))), acc["fields"], text, acc["complete"]))
            .when(token == ",", state(stack, acc["fields"], F.when(deep == 1, F.lit("")).otherwise(text), acc["complete"]))
            .when(closes & (deep == 1), state(below, acc["fields"], F.lit(""), top["whole"]))
            .otherwise(state(grown, F.when(outer, F.concat(acc["fields"], F.array(F.struct(done["size"].alias("size"), done["align"].alias("align"), text.alias("text"))))).otherwise(acc["fields"]), F.when(outer, F.lit("")).otherwise(text), acc["complete"]))
        )

    return F.aggregate(tokens, zero, step, lambda acc: F.struct(acc["fields"].alias("fields"), acc["complete"].alias("complete")))


def _placed(fields: Column, packed: Column) -> Column:
    """Size, alignment and each field's offset and the padding before it."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(1).cast("long").alias("align"), F.expr("CAST(array() AS array<struct<offset:bigint,gap:bigint>>)").alias("places"))

    def step(acc: Column, f: Column) -> Column:
        at = F.when(packed, acc["at"]).otherwise(_up(acc["at"], f["align"]))
        return F.struct((at + f["size"]).alias("at"), F.when(packed, acc["align"]).otherwise(F.greatest(acc["align"], f["align"])).alias("align"), F.concat(acc["places"], F.array(F.struct(at.alias("offset"), (at - acc["at"]).alias("gap")))).alias("places"))

    return F.aggregate(fields, zero, step, lambda acc: F.struct(F.when(packed, acc["at"]).otherwise(_up(acc["at"], acc["align"])).alias("size"), acc["align"].alias("align"), acc["places"].alias("places")))


def layouts(types: DataFrame) -> DataFrame:
    """(module_id, name, packed, size, align, padding, complete, recursive, fields, places) of named types (module_id, name, body).

    Levels go bottom-up: a round lays out the types all of whose named parts are known and hands their sizes to the types that hold
    them, each use once, so rounds are as many as types nest. Types that hold themselves by value never get ready: they and what holds
    them come out ``recursive`` without a size. Undefined, opaque and unknown types take (0, 1), and whatever holds one is not
    ``complete``. Behind a pointer a type's own layout plays no part. Names and modules that are null take no part.
    """
    keys = ["module_id", "name"]
    tokens = F.regexp_extract_all(F.regexp_replace("body", _FUNCTION, "ptr"), F.lit(_TOKEN), F.lit(1))
    types = types.filter("module_id is not null and name is not null and body is not null").groupBy(*keys).agg(F.min("body").alias("body"))
    types = types.select(*keys, F.startswith("body", F.lit("<{")).alias("packed"), (F.col("body") == "opaque").alias("opaque"), F.when(F.col("body") != "opaque", tokens).otherwise(F.array().cast("array<string>")).alias("tokens"))
    named = F.filter("tokens", lambda t: F.startswith(t, F.lit("%")) & ~F.endswith(t, F.lit("*")))
    types = types.withColumn("refs", F.array_distinct(F.transform(named, lambda t: F.translate(F.substring(t, 2, 1_000_000), '"', ""))))
    defined = types.select("module_id", F.col("name").alias("ref"))
    uses = materialize(types.select(*keys, F.explode("refs").alias("ref")).join(defined, ["module_id", "ref"]))
    needs = uses.groupBy(*keys).agg(F.count(F.lit(1)).alias("needs"))
    waiting = materialize(types.drop("refs").join(needs, keys, "left").withColumns({"needs": F.coalesce("needs", F.lit(0)), "known": F.expr("CAST(map() AS map<string,struct<size:bigint,align:bigint,complete:boolean>>)")}))
    done, is_ready = [], F.size("known") == F.col("needs")
    total = F.aggregate("_f.fields", F.lit(0).cast("long"), lambda n, f: n + f["size"])
    while True:
        laid = waiting.filter(is_ready).withColumn("_f", _fields(F.col("tokens"), F.col("known"))).withColumn("_p", _placed(F.col("_f.fields"), F.col("packed")))
        done.append(materialize(laid.select(*keys, "packed", F.col("_p.size").alias("size"), F.col("_p.align").alias("align"), (F.col("_p.size") - total).alias("padding"), (F.col("_f.complete") & ~F.col("opaque")).alias("complete"), F.lit(False).alias("recursive"), F.col("_f.fields").alias("fields"), F.col("_p.places").alias("places"))))
        if done[-1].isEmpty():
            break
        part = done[-1].select("module_id", F.col("name").alias("ref"), F.struct("size", "align", "complete").alias("layout"))
        sent = uses.join(part, ["module_id", "ref"]).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("ref", "layout"))).alias("_sent"))
        still = materialize(waiting.filter(~is_ready).join(sent, keys, "left").withColumn("known", F.when(F.col("_sent").isNull(), F.col("known")).otherwise(F.map_concat("known", "_sent"))).drop("_sent"))
        release(waiting)
        waiting = still
    none = done[0]
    left = waiting.select(*keys, "packed", *[F.lit(None).cast("long").alias(c) for c in ("size", "align", "padding")], F.lit(False).alias("complete"), F.lit(True).alias("recursive"), *[F.lit(None).cast(none.schema[c].dataType).alias(c) for c in ("fields", "places")])
    return reduce(DataFrame.unionByName, done, left)


def findings(laid: DataFrame) -> DataFrame:
    """(module_id, name, issue, field, bytes) of layouts: ``field`` from 1, null where the whole struct is meant.

    EmptyStruct ends a struct's findings. StructPadding is a gap before a field; FieldOrdering what sorting the fields by falling
    alignment, then size, would save; ExcessivePadding more than half of the size; EndiannessIssue a number of several bytes, told
    twice in a packed struct; BitfieldLayoutIssue a number of one byte in a packed struct of several fields.
    """
    ordered = F.transform("fields", lambda f, i: F.struct((-f["align"]).alias("a"), (-f["size"]).alias("s"), i.alias("i"), f["align"].alias("align"), f["size"].alias("size"), f["text"].alias("text")))
    best = _placed(F.array_sort(ordered), F.col("packed"))["size"]
    row = lambda issue, field, n: F.struct(F.lit(issue).alias("issue"), field.cast("int").alias("field"), n.cast("long").alias("bytes"))
    none, number = F.lit(None), F.sequence(F.lit(1), F.size("fields"))
    field = lambda i: F.element_at("fields", i)
    wide = F.filter(number, lambda i: (field(i)["size"] > 1) & (F.startswith(field(i)["text"], F.lit("i")) | field(i)["text"].isin("float", "double")))
    found = F.concat(
        F.transform(F.filter(number, lambda i: F.element_at("places", i)["gap"] > 0), lambda i: row("StructPadding", i, F.element_at("places", i)["gap"])),
        F.when(~F.col("packed") & (best < F.col("size")), F.array(row("FieldOrdering", none, F.col("size") - best))).otherwise(F.array()),
        F.when(F.col("padding") * 2 > F.col("size"), F.array(row("ExcessivePadding", none, F.col("padding")))).otherwise(F.array()),
        F.transform(wide, lambda i: row("EndiannessIssue", i, field(i)["size"])),
        F.transform(F.filter(wide, lambda i: F.col("packed") & (field(i)["align"] > 1)), lambda i: row("EndiannessIssue", i, field(i)["size"])),
        F.transform(F.filter(number, lambda i: F.col("packed") & (F.size("fields") > 1) & (field(i)["size"] == 1) & F.startswith(field(i)["text"], F.lit("i"))), lambda i: row("BitfieldLayoutIssue", i, field(i)["size"])),
    )
    found = F.when(F.size("fields") == 0, F.array(row("EmptyStruct", none, F.lit(0)))).otherwise(found)
    return laid.filter("not recursive").select("module_id", "name", F.inline(found))


def cross_language(laid: DataFrame, first: str, second: str) -> DataFrame:
    """Structs (module_id, name, mismatch) that two languages, named by columns, may order differently; unknown languages tell nothing."""
    rule = F.create_map(*[F.lit(x) for kv in REORDERS.items() for x in kv])
    return laid.filter(F.try_element_at(rule, F.col(first)) != F.try_element_at(rule, F.col(second))).select("module_id", "name", F.lit("Field ordering rules differ").alias("mismatch"))
