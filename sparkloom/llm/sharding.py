"""Operator 9: sharding by vector bin packing.

Bytes, tokens and rows are balanced jointly. Rows of equal text form a group. Small groups are gathered by hash into
``cells`` cells; a group of more than a ``1 / cells`` share of the whole, in any of the three, is weighed in pieces of about
that weight, dealt by a hash of the row's id, so at most 7 x ``cells`` weights reach the driver whatever the size of the
table. The rows of a group stay in one shard, unless it weighs more than a whole shard: only then its pieces are placed
one by one. Heaviest first, each cell, group or piece goes to the shard for which the dot product of its weight with the
shard's residual capacity is highest; last, they move from the fullest to the emptiest shard while that evens out the
bytes. Slots are counted within cells on the executors and shifted by the sums of the cells before.

Null text: one byte, no tokens; null texts are one group. Null ids are an id. Rows that agree in id and text stay
together. An empty table gives an empty one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import textscan as ts
from sparkloom.llm.durable import written

CELLS = 4096


def _weighed(docs: DataFrame) -> DataFrame:
    """(id, size, tokens, crc, group) of each row."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            for start, end, data, offsets in ts.slices(column):
                _, _, rows = ts.runs(ts.SPACED[data], offsets)
                group = ts.Hasher(data)(offsets[:-1], offsets[1:]).view(np.int64)
                part = column.slice(start, end - start)
                group = np.where(np.asarray(part.is_null()), 0, group)
                view = memoryview(np.ascontiguousarray(data))
                crc = [zlib.crc32(view[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array(np.diff(offsets) + 1), pa.array(np.bincount(rows, minlength=end - start)), pa.array(crc, pa.int64()), pa.array(group)],
                    ["id", "size", "tokens", "crc", "group"],
                )

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, size long, tokens long, crc long, group long")


def place(weights: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each weight vector (rows of ``weights``)."""
    total = np.maximum(weights.sum(axis=0), 1)
    share = weights / total
    residual = np.full((shards, weights.shape[1]), 1.0 / shards)
    out = np.zeros(len(weights), np.int64)
    for i in np.lexsort((np.arange(len(share)), -share.max(axis=1))):
        out[i] = int(np.argmax(residual @ share[i]))
        residual[out[i]] -= share[i]
    load = np.bincount(out, weights=weights[:, 0], minlength=shards)
    for _ in range(10 * shards):
        high, low = int(load.argmax()), int(load.argmin())
        gap = load[high] - load[low]
        mine = np.flatnonzero(out == high)
        if len(mine) < 2:
            break
        move = mine[np.argmin(np.abs(weights[mine, 0] - gap / 2))]
        size = weights[move, 0]
        if not 0 < size < gap:
            break
        out[move] = low
        load[high] -= size
        load[low] += size
    return out


def sharded(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """One row per row of ``docs``: id, size (UTF-8 bytes + 1), text_crc32, shard, slot."""
    rows = written(_weighed(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))), "weighed")
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    total = rows.agg(*sums).first()
    if not total["rows"]:
        return rows.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    heaviest = F.greatest(*[F.col(c) / F.lit(max(total[c] or 0, 1)) for c in ("size", "tokens", "rows")])
    groups = rows.groupBy("group").agg(*sums).withColumn("heavy", heaviest).where(F.col("heavy") > 1.0 / cells)
    hot = groups.select("group", "heavy", F.ceil(F.col("heavy") * cells).cast("int").alias("pieces")).orderBy("group").collect()
    starts = np.cumsum([0, *[r["pieces"] for r in hot]])
    table = docs.sparkSession.createDataFrame([(r["group"], r["pieces"], int(cells + a)) for r, a in zip(hot, starts, strict=False)], "group long, pieces int, start long")
    dealt = rows.join(F.broadcast(table), "group", "left")
    cell = F.when(F.col("pieces").isNull(), F.pmod("group", F.lit(cells))).otherwise(F.col("start") + F.pmod(F.xxhash64("id"), F.col("pieces")))
    dealt = dealt.withColumn("cell", cell).select("id", "size", "tokens", "crc", "cell")
    weights = dealt.groupBy("cell").agg(*sums).orderBy("cell").toArrow()
    names = weights["cell"].to_numpy()
    unit = names.copy()
    for r, start in zip(hot, starts, strict=False):
        if r["heavy"] <= 1 / shards:
            unit[(names >= cells + start) & (names < cells + start + r["pieces"])] = cells + start
    units, member = np.unique(unit, return_inverse=True)
    loads = np.zeros((len(units), 3))
    np.add.at(loads, member, np.stack([weights[c].to_numpy() for c in ("size", "tokens", "rows")], axis=1))
    shard = place(loads, shards)[member]
    counts, before = weights["rows"].to_numpy(), np.zeros(len(shard), np.int64)
    for s in range(shards):
        mine = np.flatnonzero(shard == s)
        before[mine] = np.cumsum(counts[mine]) - counts[mine]
    plan = docs.sparkSession.createDataFrame(pa.table({"cell": weights["cell"], "shard": pa.array(shard, pa.int32()), "before": before}))
    order = Window.partitionBy("cell").orderBy("id", "crc", "size")
    out = dealt.withColumn("nth", F.row_number().over(order)).join(F.broadcast(plan), "cell")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"))
