"""Cleaning of dirty sales tables: coercion, sentinels, derived and imputed values, in a fixed order.

Medians and modes are exact. They hold a count per distinct value, which suits prices and quantities; ``median_of``
takes ``accuracy`` for columns of very many values. Their one-row result is joined by broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import columns as C
from sparkloom.functions.staging import staged

#: The columns of a sales table, in order.
SALES_COLUMNS = ("Transaction_ID", "Item", "Quantity", "Price_Per_Unit", "Total_Spent", "Payment_Method", "Location", "Transaction_Date")
NUMBERS = ("Quantity", "Price_Per_Unit", "Total_Spent")


def renamed(df: DataFrame, names: Sequence[str] = SALES_COLUMNS) -> DataFrame:
    """All columns renamed by position."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns, {len(names)} names")
    return df.toDF(*names)


def coerced(df: DataFrame, numbers: Sequence[str] = NUMBERS, dates: Sequence[str] = ("Transaction_Date",), pattern: str | None = None) -> DataFrame:
    """Numbers and dates parsed; what cannot be parsed is null."""
    return df.withColumns({c: C.parse_number(F.col(c)) for c in numbers} | {c: C.parse_time(F.col(c), pattern) for c in dates})


def without_sentinels(df: DataFrame, sentinels: Sequence[str] = C.SENTINELS) -> DataFrame:
    """Sentinel texts become null in every text column."""
    return df.withColumns({f.name: C.without_sentinels(F.col(f.name), sentinels) for f in df.schema if f.dataType.typeName() == "string"})


def price_and_quantity_derived(df: DataFrame) -> DataFrame:
    """Price from total / quantity, then quantity from total / price; a division by zero fills nothing."""
    out = df.withColumn("Price_Per_Unit", F.coalesce("Price_Per_Unit", F.try_divide("Total_Spent", "Quantity")))
    return out.withColumn("Quantity", F.coalesce("Quantity", F.try_divide("Total_Spent", "Price_Per_Unit")))


def total_derived(df: DataFrame) -> DataFrame:
    return df.withColumn("Total_Spent", F.coalesce("Total_Spent", F.col("Quantity") * F.col("Price_Per_Unit")))


def median_of(c: str, accuracy: int | None = None) -> Column:
    """The exact median, or an approximate one of the given accuracy."""
    return F.median(c) if accuracy is None else F.percentile_approx(c, 0.5, accuracy).cast("double")


def _filled(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    one = df.agg(*[v.alias(f"_{c}") for c, v in values.items()])
    out = df.join(F.broadcast(one))
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in values}).drop(*[f"_{c}" for c in values])


def statistics_filled(df: DataFrame, medians: Sequence[str] = (), modes: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """Nulls become the column's median or its most frequent value (the smallest of equals), as the column is listed. One
    aggregate gives all of them, so ``df`` is evaluated twice, however many fills there are."""
    return _filled(df, {c: median_of(c, accuracy) for c in medians} | {c: F.mode(c, deterministic=True) for c in modes})


def median_filled(df: DataFrame, names: Sequence[str] = ("Quantity", "Price_Per_Unit"), accuracy: int | None = None) -> DataFrame:
    return statistics_filled(df, medians=names, accuracy=accuracy)


def mode_filled(df: DataFrame, names: Sequence[str] = ("Payment_Method", "Location")) -> DataFrame:
    return statistics_filled(df, modes=names)


def group_mode(df: DataFrame, key: str = "Price_Per_Unit", value: str = "Item") -> DataFrame:
    """(key, value): the most frequent value of each key, the smallest of equals; null where a group has none."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.mode(value, deterministic=True).alias(value))


def group_mode_filled(df: DataFrame, key: str = "Price_Per_Unit", value: str = "Item") -> DataFrame:
    """Nulls become the most frequent value among the rows of the same key."""
    found = group_mode(df, key, value).withColumnRenamed(value, "_mode")
    return df.join(found, key, "left").withColumn(value, F.coalesce(value, "_mode")).drop("_mode").select(df.columns)


def with_season(df: DataFrame, date: str = "Transaction_Date") -> DataFrame:
    return df.withColumn("Season", C.season(F.col(date)))


def imputed_sales(df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Every fill of the chain at once: derived values, medians, modes and the mode of each price, in three passes over the
    table: one for a row of statistics, which is staged, one for the counts and one for the fills. The medians need only derived columns and the modes none, so one aggregate gives them all; the items are counted
    per price before the median is known, and the counts of rows without a price are added to those of the median's."""
    derived = price_and_quantity_derived(df)
    medians = [median_of(c, accuracy).alias(f"_{c}") for c in ("Quantity", "Price_Per_Unit")]
    one = staged(derived.agg(*medians, *[F.mode(c, deterministic=True).alias(f"_{c}") for c in ("Payment_Method", "Location")]), "statistics")
    counts = derived.where("Item is not null").groupBy("Price_Per_Unit", "Item").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(one.select("_Price_Per_Unit")))
    counts = counts.groupBy(F.coalesce("Price_Per_Unit", "_Price_Per_Unit").alias("_price"), "Item").agg(F.sum("n").alias("n"))
    modes = counts.groupBy("_price").agg(F.min(F.struct(-F.col("n"), "Item"))["Item"].alias("_Item"))
    out = derived.join(F.broadcast(one))
    filled = out.withColumns({c: F.coalesce(c, f"_{c}") for c in ("Quantity", "Price_Per_Unit", "Payment_Method", "Location")})
    filled = total_derived(filled).join(modes, F.col("Price_Per_Unit") == F.col("_price"), "left")
    return filled.withColumn("Item", F.coalesce("Item", "_Item")).select(df.columns)


def clean_sales(raw: DataFrame, pattern: str | None = None) -> DataFrame:
    """The whole chain, from texts to a table with seasons; rows without a date go."""
    out = imputed_sales(without_sentinels(coerced(renamed(raw), pattern=pattern)))
    return with_season(out.dropna(subset=["Transaction_Date"]))
