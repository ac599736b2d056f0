"""Sharding: vector bin packing of groups of equal texts by bytes, tokens and rows.

Each item has a vector of three shares (of all bytes, all tokens, all rows). Items are placed from the largest to
the smallest, each in the shard whose residual capacity vector has the greatest dot product with the item's.

The number of items is bounded, whatever the number of groups: groups of equal texts fall by their hash in
``shards * cells_per_shard`` cells, and a cell is an item. A group with more than a cell's share of the bytes or rows is
no part of its cell; there can't be more of these than twice the number of cells. It is counted in chunks of about a
cell's size, by a hash of doc_id, and all its chunks go to one shard as long as a shard has room for them in bytes and
rows, ``TOLERANCE`` of a shard's share above the even share at most. Only a group that no shard has room for is heavy:
its chunks become items of their own. So the table of items, which the driver packs and all tasks get by broadcast, has
a proven bound. Slots are an item's offset in its shard and a rank within the item; items of many rows are ranked in
parts of about ``PART_ROWS`` by a hash, so no task's sort grows with the corpus. Texts are read once, for their sizes and hashes.

Defined results: a null text has no bytes, 0 tokens and the size of the fixed 16 bytes; equal texts share a shard
unless they are heavy; repeated rows get slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casegraph.llm.common import materialise, text_or_empty

#: Bytes of a row besides its text.
ROW_BYTES = 16
#: What a shard may hold above its even share of the bytes or rows so that a group stays whole, as a share of a shard.
TOLERANCE = 0.02
#: Rows of an item that are ranked in one part.
PART_ROWS = 100_000


def pack(vectors: np.ndarray, shards: int, groups: list | None = None) -> np.ndarray:
    """The shard of each item: largest first, each where the dot product with the residual capacity is highest.

    Items with the same entry in ``groups``, unless it is None, are placed before the others, together, where there is
    room for them; those that no shard has room for are placed one by one. The columns are bytes, tokens and rows."""
    share = vectors / np.maximum(vectors.sum(axis=0), 1)
    residual = np.full((shards, share.shape[1]), 1.0 / shards)
    out = np.full(len(share), -1, dtype=np.int64)
    whole: dict = {}
    for i, g in enumerate(groups or []):
        if g is not None:
            whole.setdefault(g, []).append(i)
    sums = [(share[items].sum(axis=0), items) for items in whole.values()]
    for total, items in sorted(sums, key=lambda x: (-x[0].max(), x[1][0])):
        room = (residual[:, ::2] + TOLERANCE / shards >= total[::2]).all(axis=1)
        if room.any():
            out[items] = k = int(np.argmax(np.where(room, residual @ total, -np.inf)))
            residual[k] -= total
    for i in np.lexsort((np.arange(len(share)), -share.max(axis=1))):
        if out[i] < 0:
            out[i] = k = int(np.argmax(residual @ share[i]))
            residual[k] -= share[i]
    return out


def shard(docs: DataFrame, shards: int = 40, cells_per_shard: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, tokens) of each row."""
    text = text_or_empty(text_col)
    cells = shards * cells_per_shard
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.size(F.expr("filter(split(`%s`, '[ \\t-\\r]+'), x -> x != '')" % text_col.replace("`", "``"))).alias("n_tokens"), F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(1), text).alias("g2"),
    ).withColumn("tokens", F.greatest(F.col("n_tokens"), F.lit(0)).cast("long")).drop("n_tokens")
    rows = materialise(rows, "sizes")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    # rows and bytes of each group are summed before they meet; a group beyond a cell's share of either is counted in chunks
    groups = rows.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    most = F.greatest(F.col("n") * cells / max(total["n"], 1), F.col("b") * cells / max(total["b"], 1))
    large = groups.where((F.col("n") > 1) & (most > 1)).select("g1", "g2", F.least(F.ceil(most * 2), F.col("n")).cast("long").alias("chunks"))
    part = F.pmod(F.xxhash64("doc_id"), F.col("chunks"))
    keyed = rows.join(F.broadcast(large), ["g1", "g2"], "left")
    item = F.when(F.col("chunks").isNull(), F.struct(F.lit(None).cast("long").alias("g1"), F.pmod(F.col("g1"), F.lit(cells)).alias("g2"), F.lit(0).cast("long").alias("part"))).otherwise(F.struct("g1", "g2", part.alias("part")))
    keyed = keyed.select("doc_id", "size", "text_crc32", "tokens", "g1", "g2", item.alias("item"))
    sums = keyed.groupBy("item").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).orderBy("item").collect()
    placed = pack(np.array([[r["size"], r["tokens"], r["n"]] for r in sums], dtype=float).reshape(len(sums), 3), shards, [None if r["item"]["g1"] is None else (r["item"]["g1"], r["item"]["g2"]) for r in sums])
    offset, table = [0] * shards, []
    for r, k in zip(sums, placed.tolist(), strict=True):
        table.append({"item": r["item"].asDict(), "shard": k, "base": offset[k], "parts": -(-r["n"] // PART_ROWS)})
        offset[k] += r["n"]
    items = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(table)), "array<struct<item struct<g1 long, g2 long, part long>, shard int, base long, parts int>>")))
    placed_rows = keyed.join(F.broadcast(items), keyed["item"].eqNullSafe(items["item"])).drop("item").withColumn("in_part", F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.col("parts")).cast("int"))
    counts = placed_rows.groupBy("shard", "base", "in_part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "base", "in_part", (F.sum("n").over(Window.partitionBy("shard", "base").orderBy("in_part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "base", "in_part").orderBy("g1", "g2", "doc_id")) - 1
    ranked = placed_rows.withColumn("rank", rank).join(before, ["shard", "base", "in_part"])
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("before") + F.col("rank")).alias("slot"), "tokens")


def by_bytes(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The sharding under the law that the shards' bytes are nearly equal."""
    return shard(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
