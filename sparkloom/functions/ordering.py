"""Positions of rows in a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.staging import staged


def numbered(df: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """The rows with their position (from 0) in the given order, as the last column; an own column of that name is replaced.
    Rows are sorted by range; each partition numbers its own, and learns from a count per partition how many stand before
    it, so no task sees all rows as a global window would make it. Where partitions are drawn depends on a sample, so the
    sorted rows are written once and both steps read the files: positions outlive any executor and nothing is cached.
    Rows that agree in the order stand in any order among themselves. An empty table gives none."""
    part, nth = f"_{name}_part", f"_{name}_nth"
    ranged = staged(df.orderBy(*order).withColumns({part: F.spark_partition_id(), nth: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranged")
    counts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy(part)) - F.col("n")).drop("n")
    out = ranged.join(F.broadcast(before), part)
    return out.select(*[c for c in df.columns if c != name], (F.col(nth) + F.col("before")).alias(name))


def exact_quantiles(df: DataFrame, columns: list[str], at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, n, q0, q1, ...): exact interpolated quantiles of numeric columns of very many values. Values are counted,
    sorted by range, written and counted up, so no task holds all distinct values of a column."""
    values = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))).where("value is not null")
    counts = values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    ranged = staged(counts.orderBy("column", "value").withColumn("part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("column", "part").agg(F.sum("n").alias("n"))
    offset = Window.partitionBy("column").orderBy("part")
    sums = sums.select("column", "part", (F.sum("n").over(offset) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("column")).alias("total"))
    own = Window.partitionBy("column", "part").orderBy("value")
    placed = ranged.join(F.broadcast(sums), ["column", "part"]).withColumn("end", F.col("before") + F.sum("n").over(own))
    found = []
    for i, q in enumerate(at):
        place = F.lit(q) * (F.col("total") - 1)
        low, high = (F.when((F.col("end") > p) & (F.col("end") - F.col("n") <= p), F.col("value")) for p in (F.floor(place), F.ceil(place)))
        found.append((F.max(low) + (F.max(high) - F.max(low)) * F.max(place - F.floor(place))).alias(f"q{i}"))
    return placed.groupBy("column").agg(F.max("total").alias("n"), *found)
