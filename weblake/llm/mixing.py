"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblake.llm.columns import indexes, let
from weblake.llm.ranks import ranked
from weblake.llm.storage import stored

#: Rows of a block, while the mix has no more than MOST_BLOCKS of them; beyond, blocks grow.
BLOCK_ROWS = 32
MOST_BLOCKS = 1 << 18
#: Weights become whole numbers of this sum, so that all times are exact.
SCALE = 1 << 40
#: Blocks that one array of the schedule holds.
CHUNK = 128
#: A table of block positions up to this many rows may be broadcast.
BROADCAST_ROWS = 1 << 19
LAST = (1 << 63) - 1
#: What ``placed`` adds.
PLACE = ("mix source", "mix block", "mix position", "mix offset", "mix release", "mix deadline")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _window(members: Column, k: Column, turn: Column) -> Column:
    """Release and deadline of block ``turn`` of source k, with k and turn.

    In the fluid mix all sources flow at rates in the ratio of their units until they are dry, so
    when source k has let through j blocks, source q has let through min(blocks, units * j / k's units),
    and the time is the sum of these. A block may run from the slot in which the fluid starts on it
    until the slot in which the fluid ends it. Whole numbers throughout: nothing is rounded.
    """

    def time(u: Column, j: Column, up: bool) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("dry"), F.lit(0).cast("long").alias("flow"))

        def add(acc: Column, q: Column) -> Column:
            dry = q["blocks"] * u <= j * q["units"]
            return F.struct((acc["dry"] + F.when(dry, q["blocks"]).otherwise(0)).alias("dry"), (acc["flow"] + F.when(dry, 0).otherwise(q["units"])).alias("flow"))

        return F.aggregate(members, zero, add, lambda acc: acc["dry"] + _div(acc["flow"] * j + (u - 1 if up else 0), u))

    def of(m: Column) -> Column:
        more = turn < m["blocks"]
        return F.struct(
            F.when(more, time(m["units"], turn + 1, True)).otherwise(F.lit(LAST)).alias("deadline"), k.alias("k"),
            F.when(more, time(m["units"], turn, False)).otherwise(F.lit(LAST)).alias("release"), turn.alias("turn"),
        )

    return let(F.get(members, k), of)


def _schedule(members: Column) -> Column:
    """The slots of the mix in order, in arrays of CHUNK: struct(deadline, k, release, turn).

    In each slot, of the sources' next blocks that are released, the one with the earliest deadline
    runs, ties by source. The fluid keeps every slot busy and meets all deadlines, so this does too:
    each source is always less than one block away from its fluid.
    """
    slot = "array<struct<deadline:bigint,k:int,release:bigint,turn:bigint>>"

    def steps(m: Column) -> Column:
        total = F.aggregate(m, F.lit(0).cast("long"), lambda acc, x: acc + x["blocks"])
        first = F.transform(m, lambda _, k: _window(m, k, F.lit(0).cast("long"))).cast(slot)

        def step(state: Column, t: Column) -> Column:
            def run(pick: Column) -> Column:
                after = _window(m, pick["k"], pick["turn"] + 1)
                return F.struct(
                    let(after, lambda a: F.transform(state["next"], lambda x: F.when(x["k"] == pick["k"], a).otherwise(x))).alias("next"),
                    F.array_append(state["slots"], pick).alias("slots"),
                )

            return let(F.array_min(F.filter(state["next"], lambda x: x["release"] <= t)), run)

        def chunk(state: Column, c: Column, n: Column) -> Column:
            begin = F.struct(state["next"].alias("next"), F.array().cast(slot).alias("slots"))
            of = F.transform(indexes(F.least(F.lit(CHUNK).cast("long"), n - c * CHUNK).cast("int")), lambda i: i + c.cast("long") * CHUNK)
            return let(
                F.aggregate(of, begin, step),
                lambda done: F.struct(done["next"].alias("next"), F.array_append(state["chunks"], done["slots"]).alias("chunks")),
            )

        start = F.struct(first.alias("next"), F.array().cast(f"array<{slot}>").alias("chunks"))
        chunks = lambda n: indexes(F.ceil(n / CHUNK).cast("int"))
        return let(total, lambda n: F.aggregate(chunks(n), start, lambda s, c: chunk(s, c, n), lambda s: s["chunks"]))

    return let(members, steps)


def plan_of(sizes: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row: ``block_rows`` and ``members``, an array of struct(source, blocks, units) sorted by source.

    sizes: a row per source with its ``rows``.
    """
    if weights:
        if min(weights.values()) <= 0:
            raise ValueError("weights must be positive")
        named = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
        weight = F.coalesce(F.try_element_at(named, F.col("source")), F.lit(min(weights.values()))).cast("double")
    else:
        weight = F.pow("rows", F.lit(temperature))
    one = sizes.agg(F.array_sort(F.collect_list(F.struct("source", "rows", weight.alias("weight")))).alias("m"))
    one = one.where(F.size("m") > 0)
    rows = F.aggregate("m", F.lit(0).cast("long"), lambda acc, x: acc + x["rows"])
    total = F.aggregate("m", F.lit(0.0), lambda acc, x: acc + x["weight"])
    one = one.select("m", F.greatest(F.lit(block_rows).cast("long"), F.ceil(rows / MOST_BLOCKS)).alias("block_rows"), total.alias("weight"))
    member = lambda x: F.struct(
        x["source"].alias("source"), F.ceil(x["rows"] / F.col("block_rows")).alias("blocks"),
        F.greatest(F.lit(1).cast("long"), F.round(x["weight"] / F.col("weight") * SCALE).cast("long")).alias("units"),
    )
    return one.select("block_rows", F.transform("m", member).alias("members"))


def positions(plan: DataFrame) -> DataFrame:
    """A row per block of the plan: source, block, position (its slot), release and deadline."""
    # Stored first: a generator's filters would work the schedule out again.
    chunks = stored(plan.select(_schedule(F.col("members")).alias("chunks")))
    slots = chunks.select(F.posexplode("chunks").alias("chunk", "slots"))
    slots = slots.select("chunk", F.posexplode("slots").alias("slot", "s"))
    slots = slots.select("s.k", F.col("s.turn").alias("block"), (F.col("chunk").cast("long") * CHUNK + F.col("slot")).alias("position"), "s.release", "s.deadline")
    names = plan.select(F.posexplode("members").alias("k", "m")).select("k", "m.source")
    return slots.join(names, "k").drop("k")


def _placed(docs: DataFrame, weights: Mapping[str, float] | None, temperature: float, id_col: str, source_col: str, block_rows: int) -> DataFrame:
    """The columns of ``docs`` as ``doc 0``, ``doc 1``, ..., so that none has the name of a column made here, and PLACE; see ``placed``."""
    names = [f"doc {i}" for i in range(len(docs.columns))]
    source = F.coalesce(F.col(source_col), F.lit(""))
    rows = docs.select("*", F.col(id_col), source).toDF(*names, "mix id", "mix source")
    content = F.xxhash64(*names, *(F.isnull(c) for c in names))
    known = F.col("mix id").cast("string")
    rows = rows.withColumn("mix salt", F.md5(F.coalesce(known, content.cast("string")).cast("binary")))
    sizes = docs.groupBy(source.alias("source")).agg(F.count("*").alias("rows"))
    plan = stored(plan_of(sizes, weights, temperature, block_rows))
    slots = positions(plan).withColumnsRenamed({"source": "mix source", "block": "mix block", "position": "mix position", "release": "mix release", "deadline": "mix deadline"})
    blocks = F.aggregate("members", F.lit(0).cast("long"), lambda acc, x: acc + x["blocks"])
    if plan.where(blocks > BROADCAST_ROWS).isEmpty():
        slots = F.broadcast(slots)
    shares = plan.select("block_rows", F.explode("members").alias("m")).select(F.col("m.source").alias("mix source"), "block_rows")
    # The first three hexadecimal digits are the bucket, so that buckets follow the order of the digests.
    bucket = F.conv(F.substring("mix salt", 1, 3), 16, 10).cast("int")
    rows = ranked(rows, "mix source", [F.col("mix salt"), F.isnull("mix id"), content], bucket, extra=shares)
    rows = rows.withColumn("mix block", F.floor(F.col("rank") / F.col("block_rows"))).withColumn("mix offset", (F.col("rank") % F.col("block_rows")).cast("int"))
    return rows.join(slots, ["mix source", "mix block"]).select(*names, *PLACE)


def placed(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with all rows and columns and each row's place in a mix of the sources to target weights.

    Adds ``mix source`` (the source, null as the empty name), ``mix block`` (number within the source),
    ``mix position`` (the block's place in the mix, 0, 1, ...), ``mix offset`` (place in the block), ``mix
    release`` and ``mix deadline`` (the slots between which Pfair lets the block run); a column of
    ``docs`` of one of these names gives way to it. No row is dropped
    or repeated. Within a source rows are in the order of the MD5 of their id, rows of one id or
    of none in the order of their values; rows equal in all columns are interchangeable.

    Weights: as given, positive (sources that are not named get the least weight given), else the power
    ``temperature`` of the source's rows. At every position each source is less than one block
    away from the mix that flows at the weights, over the whole run: sources that run dry leave
    the others in their ratios. Blocks have ``block_rows`` rows, more where there would be over MOST_BLOCKS of
    them: the schedule is worked out in one row from the sources' sizes alone, and its work does not
    grow with the corpus beyond that (steps times sources; thousands of sources take minutes).
    """
    rows = _placed(docs, weights, temperature, id_col, source_col, block_rows)
    kept = [(i, c) for i, c in enumerate(docs.columns) if c.lower() not in PLACE]
    return rows.select(*(F.col(f"doc {i}").alias(c) for i, c in kept), *PLACE)


def mix_order(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Where each document stands in the mix: id, source, block, position, offset, release, deadline; see ``placed``.

    Other input columns are left out, texts are not read. A null source counts as the empty name.
    """
    rows = placed(docs.select(id_col, source_col), weights, temperature, id_col, source_col, block_rows)
    return rows.select(id_col, *(F.col(f"mix {c}").alias(c) for c in ("source", "block", "position", "offset", "release", "deadline")))


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with all their rows and columns, of whatever names, sorted into the mix."""
    rows = _placed(docs, weights, temperature, id_col, source_col, block_rows).orderBy("mix position", "mix offset")
    return rows.select(*(F.col(f"doc {i}").alias(c) for i, c in enumerate(docs.columns)))
