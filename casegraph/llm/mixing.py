"""Mixing sources to target weights: Pfair scheduling of source blocks, in built-in functions only.

The rows of a source, in hash order, form blocks of ``block_rows``. One slot runs one block. With the weight w of its
source, a share of 1, block j (from 0) is released at floor(j / w) and due at ceil((j + 1) / w); in each slot the
released block with the earliest deadline runs. Weights sum to 1, so every block meets its deadline, and after any
number of slots of a phase a source has run less than one block more or less than its weight says. When a source ends,
a new phase begins: the others share its weight in proportion. All rows stay.

Weights are integer parts of a total: exact where a total that 64 bits allow for a phase of n blocks (2**62 / n, 2**48 at
most) suffices, else the nearest parts of the largest such total; what this rounding adds over a phase is n * n / 2**62 of a block, or
n / 2**48 for small n. The schedule doesn't repeat. The driver walks it, a step a block and none a row, and keeps only
where each source stands at the bounds of stretches; tasks run these stretches again, side by side, for the slots of the
blocks, and each cell of a source (below) gets those of its own blocks.

Numbering a source's rows never sorts a source in one task: a source is cut by hash in cells, cells are counted
(pre-aggregated), and a row's rank is its cell's offset and its rank in the cell.

Sources, their counts and the walk over the blocks are on the driver: a step a block, and a row for each pair of sources, as each
source that ends begins a phase of all that are left.

Defined results: a null source is a source of its own; rows that agree in doc_id follow one another by a hash of their
other columns where the row is carried; repeated rows are rows like any; a source without a given
weight gets ``default_weight``; a weight of 0 or less is refused; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from fractions import Fraction
from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows aimed at in a cell, and most cells of a source.
CELL_ROWS, MOST_CELLS = 1024, 8192
#: The most parts that weights are divided into.
MOST_PARTS = 1 << 48
#: About so many stretches of slots are handed to tasks, or fewer.
MOST_STRETCHES = 1024


def quotas(weights: list[float], period: int) -> list[int]:
    """Integers of at least 1 that sum to the period, nearest to the weights by largest remainder."""
    shares = [Fraction(w) for w in weights]
    total = sum(shares)
    exact = [w * period / total for w in shares]
    out = [max(1, int(x)) for x in exact]
    order = sorted(range(len(out)), key=lambda i: (int(exact[i]) - exact[i], i))
    for i in order[: max(0, period - sum(out))]:
        out[i] += 1
    while sum(out) > period:
        out[max(range(len(out)), key=lambda i: (out[i] - exact[i], out[i]))] -= 1
    return out


def parts(weights: list[float], most: int) -> list[int]:
    """The weights as integers whose sum is ``most`` at most: exact where these suffice, else the nearest."""
    shares = [Fraction(w) for w in weights]
    whole = [int(w * math.lcm(*(x.denominator for x in shares))) for w in shares]
    whole = [w // math.gcd(*whole) for w in whole]
    return whole if sum(whole) <= most else quotas(weights, most)


def schedule(blocks: list[int], weights: list[float], period: int) -> tuple[list[dict], list[dict], list[int]]:
    """The phases, in which the same sources are active, with their quotas, first slot and first blocks; stretches of at
    most ``period`` slots of them with the blocks that each source has run before; and the slot of each source's last block."""
    left, phases, stretches, ends, slot = list(blocks), [], [], [0] * len(blocks), 0
    while active := [i for i, n in enumerate(left) if n > 0]:
        q = parts([weights[i] for i in active], max(2 * len(active), min(MOST_PARTS, (1 << 62) // (sum(left) + 1))))
        total = sum(q)
        first = [blocks[i] - left[i] for i in active]
        phases.append({"first_slot": slot, "period": total, "sources": [{"source_no": i, "quota": n, "first_block": f} for i, n, f in zip(active, q, first, strict=True)]})
        done, t, begin, before = [0] * len(active), 0, 0, [0] * len(active)
        ready, waiting = [(-(-total // n), k) for k, n in enumerate(q)], []
        heapify(ready)
        ended = False
        while not ended:
            while waiting and waiting[0][0] <= t:
                heappush(ready, heappop(waiting)[1:])
            k = heappop(ready)[1]
            done[k] += 1
            ended = done[k] == left[active[k]]
            heappush(waiting, (done[k] * total // q[k], -(-(done[k] + 1) * total // q[k]), k))
            t += 1
            if ended or t - begin == period:
                stretches.append({"first_slot": slot, "begin": begin, "slots": t - begin, "period": total, "q": q, "done": before, "source_no": active, "first_block": first})
                begin, before = t, list(done)
        ends[active[k]] = slot + t - 1
        for i, n in zip(active, done, strict=True):
            left[i] -= n
        slot += t
    return phases, stretches, ends


def literal(rows: list[dict], schema: str, spark) -> DataFrame:
    """A small table from Python values, as a JSON literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<{schema}>")))


def earliest_deadline_first(q: Column, period: Column, begin: str = "0L", slots: str = "period", done: str = "transform(q, x -> 0L)", steps: int = 1024) -> Column:
    """The order in which slots go to the sources: an array of indexes into the quotas.

    ``slots`` slots from ``begin`` on, before which the sources have run ``done`` blocks: one whole period by default. They are
    run ``steps`` at a time, as an array that grows is copied at each step."""
    due = "((s.done[i] + 1) * period + q[i] - 1) div q[i]"
    pick = f"array_min(transform(sequence(0, size(q) - 1), i -> if((s.done[i] * period) div q[i] <= t, struct({due} as due, i as i), null))).i"
    first, n = f"({begin} + c * {steps}L)", f"least({steps}L, {slots} - c * {steps}L)"
    part = f"aggregate(sequence({first}, {first} + {n} - 1), struct(o.done as done, cast(array() as array<int>) as ran), (s, t) -> aggregate(array({pick}), s, (z, p) -> struct(transform(z.done, (d, k) -> if(k = p, d + 1, d)) as done, concat(z.ran, array(p)) as ran)))"
    return F.expr(f"aggregate(sequence(0L, ({slots} - 1) div {steps}L), struct({done} as done, cast(array() as array<array<int>>) as ran), (o, c) -> aggregate(array({part}), o, (y, x) -> struct(x.done as done, concat(y.ran, array(x.ran)) as ran)), o -> flatten(o.ran))")


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[tuple[str | None, int]]]:
    """The rows with ``source_no``, their cell and rank in it (in hash order), the cells with their offsets in the source's ranks, and the sources with their counts."""
    counts = [(r["source"], r["n"]) for r in docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("source").collect()]
    spark = docs.sparkSession
    table = literal([{"source": s, "source_no": i, "cells": max(1, min(MOST_CELLS, n // CELL_ROWS))} for i, (s, n) in enumerate(counts)], "struct<source string, source_no int, cells long>", spark)
    keyed = docs.join(F.broadcast(table), docs["source"].eqNullSafe(table["source"])).drop(table["source"])
    rest = [c for c in docs.columns if c != "source"]
    keyed = keyed.withColumns({"_order": F.xxhash64("doc_id"), "_tie": F.xxhash64(*rest)}).withColumn("_cell", F.expr("pmod(_order, cells)"))
    per_cell = keyed.groupBy("source_no", "_cell").agg(F.count(F.lit(1)).alias("n"))
    offsets = per_cell.select("source_no", "_cell", "n", (F.sum("n").over(Window.partitionBy("source_no").orderBy("_cell")) - F.col("n")).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("source_no", "_cell").orderBy("_order", "doc_id", "_tie")) - 1
    return keyed.withColumn("_within", within).drop("cells", "_order", "_tie"), offsets, counts


def block_slots(stretches: list[dict], spark, steps: int = 1024) -> DataFrame:
    """(source_no, block, slot) of all blocks: each row of the stretches is run by itself."""
    table = literal(stretches, "struct<first_slot long, begin long, slots long, period long, q array<long>, done array<long>, source_no array<int>, first_block array<long>>", spark)
    ran = table.repartition(F.col("first_slot") + F.col("begin")).withColumn("order", earliest_deadline_first(F.col("q"), F.col("period"), "begin", "slots", "done", steps))
    each = ran.select("first_slot", "begin", "source_no", "first_block", "done", F.posexplode("order").alias("at", "who"))
    each = each.select("first_slot", "begin", "at", F.expr("source_no[who]").alias("source_no"), F.expr("first_block[who] + done[who]").alias("_from"))
    nth = F.row_number().over(Window.partitionBy("first_slot", "begin", "source_no").orderBy("at")) - 1
    return each.select("source_no", (F.col("_from") + nth).alias("block"), (F.col("first_slot") + F.col("begin") + F.col("at")).alias("slot"))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_rows: int = 64, period: int = 1024, temper: float = 0.5, default_weight: float = 1.0, id_col: str = "doc_id", source_col: str = "source", carry: bool = False) -> DataFrame:
    """(doc_id, source) of all rows with source_rank, block, release, deadline, slot and position (gapless from 0: the order of the mixture).

    ``weights``: of the sources; without, a source's row count to the power ``temper``. ``release`` and ``deadline``
    are slots: the block runs in ``slot`` with release <= slot < deadline. ``period``: slots that are run at a time; it
    doesn't change the result. Blocks have ``block_rows`` rows at any size. A task's stretch is as many periods as leave about
    MOST_STRETCHES of them, so that their table doesn't grow with the blocks; the driver's walk is a step a block. The table of sources is collected (a row a source), never their rows. ``carry``: keep the
    whole row as a struct, ``row``."""
    if weights is not None and any(w <= 0 for w in [*weights.values(), default_weight]):
        raise ValueError("weights must be above 0")
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []))
    rows, offsets, counts = numbered(slim)
    blocks = [-(-n // block_rows) for _, n in counts]
    target = [float(n) ** temper if weights is None else float(weights.get(s, default_weight)) for s, n in counts]
    plan, stretches, ends = schedule(blocks, target, period * max(1, sum(blocks) // (period * MOST_STRETCHES)))
    # a cell's rows are consecutive ranks: it gets the slots of the blocks from its first rank's to its last's
    spans = offsets.withColumn("block", F.explode(F.expr(f"sequence(_offset div {block_rows}L, (_offset + n - 1) div {block_rows}L)")))
    met = spans.join(block_slots(stretches, spark, period), ["source_no", "block"])
    cells = met.groupBy("source_no", "_cell", "_offset").agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "slot"))), lambda x: x["slot"]).alias("_slots"))
    # a row a source: bounded by the numbers of sources and phases
    per_source = [{"source_no": i, "phases": []} for i in range(len(counts))]
    for p in plan:
        for x in p["sources"]:
            per_source[x["source_no"]]["phases"].append({"first_block": x["first_block"], "first_slot": p["first_slot"], "period": p["period"], "quota": x["quota"]})
    phases = literal(per_source, "struct<source_no int, phases array<struct<first_block long, first_slot long, period long, quota long>>>", spark)
    out = rows.join(cells, ["source_no", "_cell"]).withColumn("source_rank", F.col("_offset") + F.col("_within")).withColumn("block", F.expr(f"source_rank div {block_rows}L"))
    out = out.withColumn("slot", F.expr(f"_slots[cast(block - _offset div {block_rows}L as int)]")).drop("_cell", "_offset", "_within", "_slots").join(F.broadcast(phases), "source_no")
    out = out.withColumn("p", F.expr("element_at(filter(phases, x -> x.first_block <= block), -1)")).drop("phases")
    out = out.withColumn("j", F.expr("block - p.first_block"))
    out = out.withColumns({
        "release": F.expr("p.first_slot + (j * p.period) div p.quota"),
        "deadline": F.expr("p.first_slot + ((j + 1) * p.period + p.quota - 1) div p.quota"),
    }).drop("p", "j")
    # only a source's last block may be short: what the earlier ones lack is a list of one entry a source
    gaps = [{"end_slot": e, "lack": b * block_rows - n} for e, (_, n), b in zip(ends, counts, blocks, strict=True) if b * block_rows > n]
    lacking = F.aggregate(F.from_json(F.lit(json.dumps(gaps)), "array<struct<end_slot long, lack long>>"), F.lit(0).cast("long"), lambda t, g: t + F.when(g["end_slot"] < F.col("slot"), g["lack"]).otherwise(0))
    return out.withColumn("position", F.col("slot") * block_rows + F.col("source_rank") % block_rows - lacking).select("doc_id", "source", "source_rank", "block", "release", "deadline", "slot", "position", *(["row"] if carry else []))


def in_order(docs: DataFrame, **options) -> DataFrame:
    """The documents with their own columns, in partitions of consecutive places in the mixture, each sorted.

    Each file written from it holds one range, in order, but Spark reads files by size and not by range: a reader that
    needs the order asks for it again, which gives the same order as all rows are still there."""
    mixed = mix(docs, carry=True, **options)
    # places are gapless, so that ranges need no sample, which would run the mixture twice
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = max(1, -(-docs.count() // parts))
    return mixed.repartitionById(parts, F.expr(f"cast(position div {width}L as int)")).sortWithinPartitions("position").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
