"""Constraint checks as data-quality jobs: each returns the offending rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """(key, rule): a row for each listed column that is null or blank."""
    rules = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), f"{c} missing") for c in names]))
    return df.select(key, F.explode(rules).alias("rule"))


def unique(df: DataFrame, name: str) -> DataFrame:
    """(name, rows): values that occur more than once; nulls don't clash."""
    return df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def foreign_key(child: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows that name a parent which doesn't exist; null names none."""
    keys = parent.select(F.col(parent_key).alias(column))
    return child.where(F.col(column).isNotNull()).join(keys, column, "left_anti").select(child.columns)


def email_shape(c: Column) -> Column:
    """Something, an at sign, a name with a dot; no blanks."""
    return F.coalesce(c.rlike(r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"), F.lit(False))
