"""Balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Rows with equal text form a group that stays in one shard. Each group is an
item of its total size if that is at least the grain (1 / (shards * GRAIN) of
all bytes); smaller groups are gathered by hash into at most
shards * GRAIN bundles. So the number of items is bounded by twice that, at
any input size, while no item but an indivisible group is large.

Differencing starts with one partial partition per item (the item in one
shard, nothing in the others). The two with the largest spread (largest less
smallest shard) are taken again and again and combined in opposite order, the
largest shard of one with the smallest of the other, until one is left. Going
back through the combinations gives each item's shard.

Slots are numbered without a window over a whole shard: rows are dealt into
cells of a shard, counted, and numbered within their cell from the count of
the cells before it.

Law of the query: ``bytes``. Shard sizes are as near to equal as whole groups
allow; a group larger than a fair share makes its shard larger, and the rest
is balanced over the other shards.

Defined results: null text has no bytes and groups with empty text; a null id
is sharded like any other; each repeated row has a slot of its own; with fewer
groups than shards some shards stay empty; an empty table gives no rows. Other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value, written

by_value(__name__)

SHARDS = 40
ROW_BYTES = 16
GRAIN = 256
CELL_ROWS = 50_000


def differencing(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item by largest differencing."""
    n = sizes.size
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    sums: dict[int, np.ndarray] = {}
    heap = []
    for i, size in enumerate(sizes.tolist()):
        part = np.zeros(shards, dtype=np.int64)
        part[-1] = size  # in ascending order
        sums[i] = part
        heap.append((-size if shards > 1 else 0, i))
    heapq.heapify(heap)
    joined = []  # (left, right, order of the sums): node n + k
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(total, kind="stable")
        node = n + len(joined)
        sums[node] = total[order]
        joined.append((a, b, order))
        heapq.heappush(heap, (-int(total[order[-1]] - total[order[0]]), node))
    place = {n + len(joined) - 1: np.arange(shards)}  # shard of each position of a node
    out = np.zeros(n, dtype=np.int64)
    for k in range(len(joined) - 1, -1, -1):
        a, b, order = joined[k]
        before = np.empty(shards, dtype=np.int64)
        before[order] = place.pop(n + k)
        for child, own in ((a, before), (b, before[::-1])):
            if child < n:
                out[child] = own[-1]
            else:
                place[child] = own
    if not joined:
        out[0] = shards - 1
    return out


def shard_items(items: DataFrame, shards: int) -> DataFrame:
    """``item, shard`` for a bounded table ``item, size``."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("item", "ascending")])
        got = differencing(table.column("size").to_numpy(), shards)
        return pa.table({"item": table.column("item"), "shard": pa.array(got, pa.int32())})

    return items.withColumn("__all", F.lit(0)).groupBy("__all").applyInArrow(run, "item string, shard int")


def shard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
                 row_bytes: int = ROW_BYTES, grain: int = GRAIN) -> DataFrame:
    """``id, size, text_crc32, shard, slot`` for every row of ``docs``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = written(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(row_bytes)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group"),
        F.monotonically_increasing_id().alias("row")), "sharding-rows")
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    total = groups.agg(F.sum("size"), F.sum("rows")).first()
    fair = (total[0] or 0) / (shards * grain)
    cells = max(1, -(-(total[1] or 0) // (shards * CELL_ROWS)))
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("group", F.lit(1)), F.lit(shards * grain)).cast("string"))
    item = F.when(F.col("size") >= fair, F.concat(F.lit("g"), F.col("group").cast("string"))).otherwise(bundle)
    named = written(groups.select("group", "size", item.alias("item")), "sharding-groups")
    placed = written(shard_items(named.groupBy("item").agg(F.sum("size").alias("size")), shards), "sharding-items")
    where = named.join(F.broadcast(placed), "item").select("group", "shard")
    put = written(rows.join(where, "group").withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)))
                  .select("id", "size", "text_crc32", "row", "shard", "cell"), "sharding-placed")
    counts = put.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "cell").orderBy("row")
    return put.withColumn("k", F.row_number().over(order)).join(starts, ["shard", "cell"]).select(
        "id", "size", "text_crc32", "shard", (F.col("start") + F.col("k") - 1).alias("slot"))


def sharding_query(docs: DataFrame) -> DataFrame:
    return shard_groups(docs).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
