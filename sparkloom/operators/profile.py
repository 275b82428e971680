"""Profiles of a table, each from one scan; exact quantiles of many values take a second."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.ordering import exact_quantiles


def _rows(one: DataFrame, names: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per column from a one-row aggregate of columns named name__field."""
    structs = [F.struct(F.lit(n).alias("column"), *[F.col(f"{n}__{f}").alias(f) for f in fields]) for n in names]
    return one.select(F.inline(F.array(*structs)))


def nulls(df: DataFrame) -> DataFrame:
    """(column, nulls)"""
    return _rows(df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}__nulls") for c in df.columns]), df.columns, ["nulls"])


def info(df: DataFrame) -> DataFrame:
    """(column, type, non_null, row_count)"""
    aggs = [x for c, kind in df.dtypes for x in (F.lit(kind).alias(f"{c}__type"), F.count(c).alias(f"{c}__non_null"), F.count(F.lit(1)).alias(f"{c}__row_count"))]
    return _rows(df.agg(*aggs), df.columns, ["type", "non_null", "row_count"])


def numeric(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max); quantiles are exact and interpolated."""
    aggs = []
    for c in names:
        x = F.col(c).cast("double")
        q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        values = {"count": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "q25": q[0], "q50": q[1], "q75": q[2], "max": F.max(x)}
        aggs += [v.alias(f"{c}__{k}") for k, v in values.items()]
    return _rows(df.agg(*aggs), names, ["count", "mean", "std", "min", "q25", "q50", "q75", "max"])


def numeric_of_many(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """As :func:`numeric`, for columns of very many distinct values: the quantiles come from sorted counts."""
    simple = {c: {"count": F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(F.col(c).cast("double")), "max": F.max(F.col(c).cast("double"))} for c in names}
    one = df.agg(*[v.alias(f"{c}__{k}") for c, values in simple.items() for k, v in values.items()])
    rows = _rows(one, names, ["count", "mean", "std", "min", "max"])
    found = exact_quantiles(df, list(names)).toDF("column", "n", "q25", "q50", "q75").drop("n")
    return rows.join(F.broadcast(found), "column", "left").select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def text(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, count, unique, top, freq); top is the most frequent value, the smallest of equals.

    Values are counted by a grouping over (column, value), so columns of very many values need no large buffer; the counts
    are then reduced in one more grouping.
    """
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names]))).where("value is not null")
    counts = pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("least"), "value"))
    one = counts.groupBy("column").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), first.alias("first"))
    return one.select("column", "count", "unique", F.col("first.value").alias("top"), (-F.col("first.least")).alias("freq"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
