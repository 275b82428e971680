"""Readers. Those that can meet bad rows return (accepted, rejects)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import columns as C
from sparkloom.operators import score

#: Texts read as missing by common data-frame readers.
NULL_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: Fixed value: a line of an audit log: [time] ACTION, then anything.
AUDIT_LINE = r"^\[([^\]]+)\]\s+([A-Za-z_]+):?\s*(.*)$"


def with_ordinal(df: DataFrame) -> DataFrame:
    """Adds ``ordinal``, which follows the order of files and of rows in them. Take it right at the scan."""
    return df.withColumn("ordinal", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row")))


def text_table(spark: SparkSession, path: str, names: Sequence[str], multiline: bool = False, nulls: Sequence[str] = ()) -> DataFrame:
    """A CSV with a header, all columns as text. ``multiline`` allows line breaks in quotes, at the price of files that
    are not split."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = with_ordinal(spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", multiline).csv(path))
    return df.withColumns({n: C.without_sentinels(F.col(n), nulls) for n in names}) if nulls else df


def scores(spark: SparkSession, path: str, measures: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Typed scores, the first row of each id, and the rows refused for a measure out of range."""
    parsed = score.parse_scores(text_table(spark, path, ["id", "name", *measures]), measures)
    return score.keep_first(score.accepted(parsed), "id", "ordinal"), score.rejected(parsed)


def articles(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, content); an id that isn't a whole number fails the load."""
    raw = text_table(spark, path, ["id", "title", "content"], multiline=True)
    return raw.select(F.col("id").cast("int").alias("id"), "title", "content", "ordinal")


def sales(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    return text_table(spark, path, names, nulls=NULL_TEXTS).drop("ordinal")


def keyed(spark: SparkSession, path: str, names: Sequence[str], key: str) -> DataFrame:
    """A CSV where a later row of a key replaces an earlier one."""
    return score.keep_last(text_table(spark, path, names), key, "ordinal").drop("ordinal")


def database_table(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int, **properties: str) -> DataFrame:
    """A table over JDBC, read in ranges of a numeric column; filters, columns and limits go to the database."""
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=properties)


def database_table_by_quantiles(spark: SparkSession, url: str, table: str, column: str, partitions: int, **properties: str) -> DataFrame:
    """As :func:`database_table`, for a numeric column whose values are dense in some places and sparse in others: the bounds
    are quantiles of the column (one read of it alone), so the ranges have about equal rows. Rows without a value are in
    the first range; one value's rows are in one range."""
    name = f'"{column}"'
    values = spark.read.jdbc(url, table, properties=properties).select(column)
    steps = [i / partitions for i in range(1, partitions)]
    bounds = values.agg(F.percentile_approx(column, steps, 100 * partitions)).first()[0] if steps else None
    cuts = sorted(set(bounds or ()))
    if not cuts:
        return spark.read.jdbc(url, table, properties=properties)
    inner = [f"{name} >= {a} AND {name} < {b}" for a, b in zip(cuts, cuts[1:], strict=False)]
    return spark.read.jdbc(url, table, predicates=[f"{name} < {cuts[0]} OR {name} IS NULL", *inner, f"{name} >= {cuts[-1]}"], properties=properties)


def parse_audit(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """((ts, action, detail), rejects) of log lines; blank lines are neither."""
    parts = lines.select(F.col(value).alias("line"), *[F.regexp_extract(value, AUDIT_LINE, i).alias(n) for i, n in ((1, "t"), (2, "action"), (3, "detail"))])
    typed = parts.where(F.trim("line") != "").withColumn("ts", F.try_to_timestamp("t", F.lit("yyyy-MM-dd HH:mm:ss")))
    good = F.col("ts").isNotNull() & (F.col("action") != "")
    return typed.where(good).select("ts", "action", "detail"), typed.where(~good).select("line")


def audit_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_audit(spark.read.text(path))


def audit_events(spark: SparkSession, path: str) -> DataFrame:
    """(ts, action, detail) of a table of events, all batches."""
    return spark.read.schema("ts timestamp, action string, detail string, batch string").parquet(path).drop("batch")
