"""Operator 4: conflict-constrained best-fit packing.

Documents become pieces of at most ``capacity`` words. Pieces are dealt by a hash to packing groups of about
``group_pieces`` (the number of groups follows the table), so no source or group of copies gathers in one task; rows that
agree in id and cluster more than ``group_pieces / 4`` times are dealt by their place in the table as well. Within
a group, largest first, the open bins are kept in order of their residual space; each bin carries a bitmap of the
sources that have used up their places in it and one of the duplicate clusters it holds. The search starts at the
smallest residual that fits and goes on to the successor until a bin has no conflict: the tightest compatible bin.
A bin holds at most ``source_limit`` pieces of one source and one piece of a duplicate cluster.

Clusters: documents that agree but for case and white space, or the values of ``cluster_col``. Null or empty texts
have no words: they are listed with no bin. A null source is a source, a null id an id. Repeated rows are copies of one
cluster. Pieces of one size are taken in order of id and piece; of bins of one residual the oldest is taken. An empty
table gives an empty one.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textscan as ts
from sparkloom.llm.durable import sized_join, written

GROUP_BITS = 24


def _sized(docs: DataFrame) -> DataFrame:
    """(id, source, n, cluster) of rows (id, source, text, given): words of each document, and a hash of its word sequence
    where no cluster is given."""

    def run(batches):
        for batch in batches:
            for start, end, data, offsets in ts.slices(batch.column(2)):
                data = ts.LOWER[data]
                starts, ends, rows = ts.runs(ts.SPACED[data], offsets)
                size = end - start
                counts = np.bincount(rows, minlength=size)
                begins = np.cumsum(counts) - counts
                values = ts.Hasher(data)(starts, ends) * ts.powers(max(len(starts), 1))[0][np.arange(len(starts)) - begins[rows]]  # a word at another place weighs differently
                total = np.concatenate([np.zeros(1, ts.U), np.cumsum(values, dtype=ts.U)])
                cluster = ts.mix(total[begins + counts] - total[begins] + counts.astype(ts.U)).view(np.int64)
                cluster = pc.coalesce(batch.column(3).slice(start, size), pa.array(cluster))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, size), batch.column(1).slice(start, size), pa.array(counts), cluster], ["id", "source", "n", "cluster"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.mapInArrow(run, f"id {kinds['id']}, source {kinds['source']}, n long, cluster long")


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, source_limit: int) -> list[int]:
    """The bin of each piece; ``sizes`` must not exceed ``capacity``."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, n in _tally(clusters).items() if n > 1)}
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    full, held, used, out = [], [], [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        source, cluster = source_bit[sources[i]], cluster_bit.get(clusters[i], 0)
        at = bisect.bisect_left(open_bins, (sizes[i], -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not (full[b] & source or held[b] & cluster):
                break
            at += 1
        if at < len(open_bins):
            residual, b = open_bins.pop(at)
        else:
            residual, b = capacity, len(full)
            full.append(0)
            held.append(0)
            used.append({})
        out[i] = b
        held[b] |= cluster
        used[b][source] = used[b].get(source, 0) + 1
        if used[b][source] >= source_limit:
            full[b] |= source
        if residual > sizes[i]:
            bisect.insort(open_bins, (residual - sizes[i], b))
    return out


def _tally(values: list) -> dict:
    counts: dict = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    return counts


def packed(docs: DataFrame, capacity: int = 2048, source_limit: int = 2, group_pieces: int = 4096, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """One row per piece: id, piece (from 0), first_word, n_tokens, bin_id (null without words).

    The words ``first_word`` to ``first_word + n_tokens - 1`` of a document are its piece; the pieces of a document
    make up the whole of it. A bin belongs to one packing group, so bins are numbered without a further shuffle.
    """
    given = F.xxhash64(cluster_col) if cluster_col else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).cast("string").alias("text"), given.alias("given"))
    sized = written(_sized(rows), "sized")
    count = sized.agg(F.sum(F.ceil(F.col("n") / capacity))).first()[0] or 0
    groups = max(1, -(-count // group_pieces))
    crowds = sized.groupBy("id", "cluster").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > group_pieces // 4)
    crowds = written(crowds.select("id", "cluster", F.lit(True).alias("crowd")), "crowds")
    rows = sized_join(sized.withColumn("row", F.monotonically_increasing_id()), crowds, ["id", "cluster"], "left").withColumn("row", F.when(F.col("crowd"), F.col("row")))
    pieces = rows.select("id", "source", "n", "cluster", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)))).alias("piece"))
    pieces = pieces.select("id", "source", "cluster", "row", "piece", (F.col("piece") * capacity).alias("first_word"), F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).alias("n_tokens"))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("id", "piece", "cluster", "row"), F.lit(groups))).drop("row")
    kind = sized.schema["id"].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("piece", "ascending")])
        sizes = table["n_tokens"].to_pylist()
        some = [i for i, n in enumerate(sizes) if n]
        source, cluster = table["source"].to_pylist(), table["cluster"].to_pylist()
        bins = best_fit([sizes[i] for i in some], [source[i] for i in some], [cluster[i] for i in some], capacity, source_limit)
        names: list = [None] * len(sizes)
        group = table["group"][0].as_py() << GROUP_BITS
        for i, b in zip(some, bins, strict=True):
            names[i] = group + b
        return table.select(["id", "piece", "first_word", "n_tokens"]).append_column("bin_id", pa.array(names, pa.int64()))

    out = dealt.groupBy("group").applyInArrow(pack, f"id {kind}, piece long, first_word long, n_tokens long, bin_id long")
    return out.withColumnRenamed("id", id_col)
