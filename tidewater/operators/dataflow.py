"""Dataflow over control-flow graphs: live registers, stores that reach, slots assigned on every path. Sets are bitsets in rows of 64-bit
words, so a function may have any number of registers; union and intersection are bit aggregations. Functions of up to ``SHORT``
instructions and edges are one row each, solved where they stand.

Edges are a table (module_id, func, block, successor), or None where instructions have the labels that they branch to as
``successors``; with ``short`` the caller knows that every function is, and nothing is counted or written in between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators.detectors import FUNC
from tidewater.operators.graph import bitsets, flow
from tidewater.spark import bounded_broadcast, materialize, ship

#: Instructions and edges of a function that is solved as one row.
SHORT = 1024


def _numbered(items: DataFrame) -> DataFrame:
    """Distinct items (module_id, func, item) with their word and bit within the function."""
    number = F.row_number().over(Window.partitionBy(*FUNC).orderBy("item")) - 1
    return items.distinct().withColumn("_n", number).withColumn("word", F.floor(F.col("_n") / 64).cast("int")).withColumn("bit", (F.col("_n") % 64).cast("int")).drop("_n")


def _bit() -> Column:
    return F.expr("shiftleft(1L, bit)")


def blocks(instructions: DataFrame, edges: DataFrame) -> DataFrame:
    """(module_id, func, node, begins): the blocks of every function; flow begins at that of the first instruction."""
    first = instructions.groupBy(*FUNC, F.col("block").alias("node")).agg(F.min("inst_idx").alias("_at"))
    begin = instructions.groupBy(*FUNC).agg(F.min("inst_idx").alias("_first"))
    ends = edges.select(*FUNC, F.explode(F.array("block", "successor")).alias("node"), F.lit(None).cast("long").alias("_at"))
    every = first.select(*FUNC, "node", F.col("_at").cast("long").alias("_at")).unionByName(ends).groupBy(*FUNC, "node").agg(F.min("_at").alias("_at"))
    return every.join(begin, FUNC).select(*FUNC, "node", F.coalesce(F.col("_at") == F.col("_first"), F.lit(False)).alias("begins"))


def _solve(instructions: DataFrame, edges: DataFrame, items: DataFrame, facts: DataFrame, every: bool, backward: bool, side: str) -> DataFrame:
    """(module_id, func, block, item) that hold at ``side`` (before, after) of each block. ``facts`` has (module_id, func, node, item,
    gen, kill); ``items`` what is counted at all."""
    numbers, edges = materialize(_numbered(items)), materialize(edges)
    words = facts.join(numbers, [*FUNC, "item"]).groupBy(*FUNC, "node", "word").agg(F.bit_or(F.when(F.col("gen"), _bit()).otherwise(F.lit(0).cast("long"))).alias("gen"), F.bit_or(F.when(F.col("kill"), _bit()).otherwise(F.lit(0).cast("long"))).alias("kill"))
    width = numbers.groupBy(*FUNC).agg(F.max("word").alias("_w"))
    dense = blocks(instructions, edges).join(width, FUNC).withColumn("word", F.explode(F.sequence(F.lit(0), F.col("_w")))).drop("_w")
    nodes = dense.join(words, [*FUNC, "node", "word"], "left").fillna(0, ["gen", "kill"])
    between = edges.select(*FUNC, F.col("block").alias("src"), F.col("successor").alias("dst"))
    solved = flow(bitsets(every, backward), nodes, between, FUNC, ["word"])
    holds = solved.filter(F.col(side) != 0).select(*FUNC, "node", "word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"), F.col(side).alias("_set"))
    holds = holds.filter(F.expr("shiftright(_set, bit) & 1 = 1"))
    return holds.join(numbers, [*FUNC, "word", "bit"]).select(*FUNC, F.col("node").alias("block"), "item")


def _fixpoint(gen: list[int], kill: list[int], start: list[int], near: list[set[int]]) -> tuple[list[int], list[int]]:
    """What comes in and what goes out at each block, as bits: least fixpoint of unions over the neighbours ``near``."""
    into, out, moved = start[:], [g | (s & ~k) for g, k, s in zip(gen, kill, start, strict=True)], True
    while moved:
        moved = False
        for i, (g, k) in enumerate(zip(gen, kill, strict=True)):
            v = start[i]
            for j in near[i]:
                v |= out[j]
            into[i] = v
            if (o := g | (v & ~k)) != out[i]:
                out[i], moved = o, True
    return into, out


def _function(what: str, at: list, block: list[str], dest: list[str], used: list[list[str]], after: list[list[str]]) -> tuple[list[str], list, list[int]]:
    """Blocks, items and each block's items as bits, of one function. A null ``at`` is an edge; registers read, or the address that a
    store writes to, are ``used``."""
    backward = what == "live"
    number = {b: i for i, b in enumerate(dict.fromkeys([*block, *(s for x in after for s in x)]))}
    n, order = len(number), sorted((a, i) for i, a in enumerate(at) if a >= 0)
    items: dict = {}
    gen, kill, start, near = [0] * n, [0] * n, [0] * n, [set() for _ in range(n)]
    for b, x in zip(block, after, strict=True):
        for s in x:
            i, j = number[b], number[s]
            near[i if backward else j].add(j if backward else i)
    if what == "reaching":
        to: dict[str, int] = {}
        for a, i in order:
            for u in used[i]:
                to[u] = to.get(u, 0) | 1 << items.setdefault(a, len(items))
        for a, i in order:
            for u in used[i]:
                b = number[block[i]]
                gen[b], kill[b] = gen[b] & ~to[u] | 1 << items[a], kill[b] | to[u]
    else:
        for a, i in order:
            b = number[block[i]]
            for u in used[i]:
                k = 1 << items.setdefault(u, len(items))
                if not backward:
                    kill[b] |= k
                elif not kill[b] & k:
                    gen[b] |= k
            if backward and dest[i]:
                kill[b] |= 1 << items.setdefault(dest[i], len(items))
        if not backward and order:
            start[number[block[order[0][1]]]] = (1 << len(items)) - 1  # of what is missing
    into, out = _fixpoint(gen, kill, start, near)
    return list(number), list(items), out if backward else into if what == "reaching" else [~v & (1 << len(items)) - 1 for v in into]


def _functions(what: str, item: str):
    """For ``mapInArrow``: rows of one function each to rows (module_id, func, block, item)."""

    def solve(batches):
        import pyarrow as pa

        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            at, block, dest = (col(c).flatten().to_pylist() for c in ("at", "block", "dest"))
            used, after = ((x.flatten().to_pylist(), x.offsets.to_pylist()) for x in (col(c).flatten() for c in ("used", "after")))
            ends = col("at").offsets.to_pylist()
            # a slice of a list column keeps offsets of the whole
            lists = lambda x, i, j: [x[0][p - x[1][0] : q - x[1][0]] for p, q in zip(x[1][i:j], x[1][i + 1 : j + 1], strict=True)]
            rows, blocks, found = [], [], []
            for f, (i, j) in enumerate(zip(ends, ends[1:], strict=False)):
                i, j = i - ends[0], j - ends[0]
                names, items, bits = _function(what, at[i:j], block[i:j], dest[i:j], lists(used, i, j), lists(after, i, j))
                for name, v in zip(names, bits, strict=True):
                    while v:
                        low = v & -v
                        rows.append(f)
                        blocks.append(name)
                        found.append(items[low.bit_length() - 1])
                        v ^= low
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([col("module_id").take(take), col("func").take(take), pa.array(blocks, pa.string()), pa.array(found, pa.int64() if what == "reaching" else pa.string())], names=[*FUNC, "block", item])

    return solve


def _solved(what: str, rows: DataFrame, used: Column, item: str) -> DataFrame:
    """(module_id, func, block, item) of short functions: a row a function, gathered where its instructions are."""
    ship(rows.sparkSession)
    none = F.array().cast("array<string>")
    dest = F.coalesce("dest", F.lit("")) if "dest" in rows.columns else F.lit("")
    flat = {"at": F.coalesce(F.col("inst_idx").cast("long"), F.lit(-1)), "block": F.col("block"), "dest": dest, "used": F.coalesce(used, none), "after": F.coalesce("successors", none)}
    per = rows.groupBy(*FUNC).agg(*[F.collect_list(c).alias(n) for n, c in flat.items()])
    return per.mapInArrow(_functions(what, item), f"module_id string, func string, block string, {item} {'long' if what == 'reaching' else 'string'}")


def _parted(instructions: DataFrame, edges: DataFrame | None, short: bool, most: int) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """Rows with ``successors`` of the short functions, instructions and edges of the others; None for what isn't there."""
    none = F.lit(None).cast("array<string>").alias("successors")
    if edges is None:
        if short:
            return instructions, None, None
        instructions = materialize(instructions)
        edges = instructions.select(*FUNC, "block", F.explode("successors").alias("successor")).distinct()
        instructions = instructions.drop("successors")
    else:
        instructions = materialize(instructions)
    edges = materialize(edges)
    blank = [F.lit(None).cast(t).alias(c) for c, t in instructions.dtypes if c not in (*FUNC, "block")]
    rows = instructions.select("*", none).unionByName(edges.select(*FUNC, "block", *blank, F.array("successor").alias("successors")))
    if short:
        return rows, None, None
    long = materialize(rows.select(*FUNC).groupBy(*FUNC).count().filter(F.col("count") > most).select(*FUNC))
    if long.isEmpty():
        return rows, None, None
    few = bounded_broadcast(long)
    return rows.join(few, FUNC, "left_anti"), instructions.join(few, FUNC, "left_semi"), edges.join(few, FUNC, "left_semi")


def live_registers(instructions: DataFrame, edges: DataFrame | None, short: bool = False, most: int = SHORT) -> DataFrame:
    """(module_id, func, block, register): registers that are live where a block begins: read there, or on some path from there, before
    they are made. What a phi takes counts as read in its own block."""
    columns = [*FUNC, "inst_idx", "block", "dest", "operands", *["successors"] * (edges is None)]
    rows, long, links = _parted(instructions.select(*columns), edges, short, most)
    out = _solved("live", rows, F.filter("operands", lambda o: F.startswith(o, F.lit("%"))), "register")
    return out if long is None else out.unionByName(_live(long, links))


def _live(rows: DataFrame, edges: DataFrame) -> DataFrame:
    reads = rows.select(*FUNC, "block", "inst_idx", F.explode("operands").alias("item")).filter("startswith(item, '%')").groupBy(*FUNC, "block", "item").agg(F.min("inst_idx").alias("_r"))
    makes = rows.filter("dest is not null").groupBy(*FUNC, "block", F.col("dest").alias("item")).agg(F.min("inst_idx").alias("_m"))
    facts = reads.join(makes, [*FUNC, "block", "item"], "full").select(*FUNC, F.col("block").alias("node"), "item", F.coalesce(F.col("_r") <= F.coalesce("_m", "_r"), F.lit(False)).alias("gen"), F.col("_m").isNotNull().alias("kill"))
    facts = materialize(facts)
    return _solve(rows, edges, facts.filter("gen").select(*FUNC, "item"), facts, False, True, "after").withColumnRenamed("item", "register")


def _stores(rows: DataFrame) -> DataFrame:
    address = F.try_element_at("operands", F.lit(2))
    return rows.filter("kind = 'Store'").select(*FUNC, F.col("block").alias("node"), F.col("inst_idx").cast("long").alias("item"), address.alias("address")).filter("address is not null")


def _addresses() -> Column:
    # one use of the operands, so that those of other instructions need not be read from their text
    return F.when(F.col("kind") == "Store", F.array_compact(F.slice("operands", 2, 1)))


def reaching_definitions(instructions: DataFrame, edges: DataFrame | None, short: bool = False, most: int = SHORT) -> DataFrame:
    """(module_id, func, block, inst_idx): stores that may still be the last one to their address where a block begins."""
    columns = [*FUNC, "inst_idx", "kind", "block", "operands", *["successors"] * (edges is None)]
    rows, long, links = _parted(instructions.select(*columns), edges, short, most)
    out = _solved("reaching", rows, _addresses(), "inst_idx")
    return out if long is None else out.unionByName(_reaching(long, links))


def _reaching(rows: DataFrame, edges: DataFrame) -> DataFrame:
    stores = materialize(_stores(rows))
    last = stores.groupBy(*FUNC, "node", "address").agg(F.max("item").alias("_last"))
    facts = last.join(stores.select(*FUNC, "address", "item"), [*FUNC, "address"]).select(*FUNC, "node", "item", (F.col("item") == F.col("_last")).alias("gen"), F.lit(True).alias("kill"))
    return _solve(rows, edges, stores.select(*FUNC, "item"), facts, False, False, "before").withColumnRenamed("item", "inst_idx")


def assigned_slots(instructions: DataFrame, edges: DataFrame | None, short: bool = False, most: int = SHORT) -> DataFrame:
    """(module_id, func, block, address): addresses that every path from the function's beginning has stored to where a block begins. A
    block that no path reaches has them all. In a short function, what some path has not stored to is followed instead."""
    columns = [*FUNC, "inst_idx", "kind", "block", "operands", *["successors"] * (edges is None)]
    rows, long, links = _parted(instructions.select(*columns), edges, short, most)
    out = _solved("assigned", rows, _addresses(), "address")
    return out if long is None else out.unionByName(_assigned(long, links))


def _assigned(rows: DataFrame, edges: DataFrame) -> DataFrame:
    stores = _stores(rows).select(*FUNC, "node", F.col("address").alias("item")).distinct()
    return _solve(rows, edges, stores.select(*FUNC, "item"), stores.withColumns({"gen": F.lit(True), "kill": F.lit(False)}), True, False, "before").withColumnRenamed("item", "address")
