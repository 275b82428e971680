"""Scores of entities over several measures: parsing, score cards, rankings and summaries.

Wide frames have one row per entity with ``id``, ``name`` and a column per measure. Functions that rank take an ordinal
column that settles ties by input order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import columns as C


def parse_scores(raw: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Typed scores with ``accepted`` and ``reason``: a measure outside 0 to 100 rejects its whole row."""
    typed = raw.select("id", F.trim("name").alias("name"), *[c for c in raw.columns if c not in ("id", "name", *measures)], *[C.parse_measure(F.col(m)).alias(m) for m in measures])
    bad = F.concat_ws(",", *[F.when(~F.col(m).between(0, 100), m) for m in measures])
    return typed.withColumn("reason", bad).withColumn("accepted", F.col("reason") == "")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("accepted").drop("accepted", "reason")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where("not accepted").drop("accepted")


def keep_first(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row per key, the first in input order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(ordinal))).where("_n = 1").drop("_n")


def keep_last(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row per key; a later row replaces an earlier one."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ordinal)))).where("_n = 1").drop("_n")


def scorecard(scores: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Adds total, average, band, band_label and display to the scores; absent measures count as 0."""
    zeroed = scores.withColumns({m: F.coalesce(F.col(m), F.lit(0)) for m in measures})
    total = sum((F.col(m) for m in measures[1:]), F.col(measures[0]))
    out = zeroed.withColumn("total", total.cast("long")).withColumn("average", F.col("total") / len(measures))
    out = out.withColumn("band", C.letter(F.col("average"))).withColumn("band_label", C.letter_label(F.col("band")))
    return out.withColumn("display", F.concat("band", F.lit("     "), "band_label"))


def below(cards: DataFrame, threshold: float = 60.0) -> DataFrame:
    return cards.where(F.col("average") < threshold)


def at_least(cards: DataFrame, threshold: float = 90.0) -> DataFrame:
    return cards.where(F.col("average") >= threshold)


def top(cards: DataFrame, n: int = 5, ordinal: str = "ordinal") -> DataFrame:
    return cards.orderBy(F.desc("average"), ordinal).limit(n)


def bottom(cards: DataFrame, n: int = 5, ordinal: str = "ordinal") -> DataFrame:
    return cards.orderBy("average", ordinal).limit(n)


def measure_averages(scores: DataFrame, measures: Sequence[str]) -> DataFrame:
    """(position, measure, average), in the order of the measures; without rows every average is 0."""
    means = scores.agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in measures])
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(m).alias("measure"), F.col(m).alias("average")) for i, m in enumerate(measures)])
    return means.select(F.inline(pairs))


def best_measure(scores: DataFrame, measures: Sequence[str]) -> DataFrame:
    """The measure of the highest average, the first of equals; without rows null and 0."""
    return _extreme(scores, measures, F.desc("average"))


def worst_measure(scores: DataFrame, measures: Sequence[str]) -> DataFrame:
    return _extreme(scores, measures, F.asc("average"))


def _extreme(scores: DataFrame, measures: Sequence[str], order) -> DataFrame:
    means = scores.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in measures])
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(m).alias("measure"), F.col(m).alias("average")) for i, m in enumerate(measures)])
    one = means.select("n", F.inline(pairs)).orderBy(order, "position").limit(1)
    return one.select(F.when(F.col("n") > 0, F.col("measure")).alias("measure"), "average")


def band_distribution(cards: DataFrame) -> DataFrame:
    """All bands with label, count, percent of the entities and bar units (one per 5 %)."""
    names = [(name, label) for _, name, label in C.BANDS] + [C.LOWEST_BAND]
    counts = cards.agg(F.count(F.lit(1)).alias("entities"), *[F.count_if(F.col("band") == name).alias(name) for name, _ in names])
    rows = F.array(*[F.struct(F.lit(name).alias("band"), F.lit(label).alias("label"), F.col(name).alias("count")) for name, label in names])
    percent = F.coalesce(F.try_divide(F.col("count") * 100.0, F.col("entities")), F.lit(0.0))
    return counts.select("entities", F.inline(rows)).select("band", "label", "count", percent.alias("percent"), F.floor(percent / 5).alias("bar_units"))


def score_summary(cards: DataFrame, passing: float = 60.0) -> DataFrame:
    """One row: entities, mean and exact median of the averages, pass rate in percent; 0 without rows."""
    n = F.count(F.lit(1))
    return cards.agg(
        n.alias("entities"), F.coalesce(F.avg("average"), F.lit(0.0)).alias("mean_average"), F.coalesce(F.median("average"), F.lit(0.0)).alias("median_average"),
        F.coalesce(F.try_divide(100.0 * F.count_if(F.col("average") >= passing), n), F.lit(0.0)).alias("pass_rate"),
    )


def whole_summary(cards: DataFrame, measures: Sequence[str], passing: float = 60.0, n: int = 3, ordinal: str = "ordinal") -> DataFrame:
    """One row: :func:`score_summary` with the n best and worst entities (lists of id, name, average), the best and worst
    measure with their averages, and the band distribution (a list). Lists are bounded by n and the bands; the parts are
    one-row frames that are joined by broadcast."""

    def listed(ranked: DataFrame, order: list, name: str) -> DataFrame:
        rows = ranked.select(*order, "id", "name", "average")
        return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct(*rows.columns))), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["average"].alias("average"))).alias(name))

    place = F.col(ordinal).alias("_at")
    parts = [
        listed(top(cards, n, ordinal), [(-F.col("average")).alias("_by"), place], "top"), listed(bottom(cards, n, ordinal), [F.col("average").alias("_by"), place], "bottom"),
        best_measure(cards, measures).toDF("best_measure", "best_average"), worst_measure(cards, measures).toDF("worst_measure", "worst_average"),
        band_distribution(cards).agg(F.array_sort(F.collect_list(F.struct("band", "label", "count", "percent"))).alias("bands")),
    ]
    out = score_summary(cards, passing)
    for part in parts:
        out = out.join(F.broadcast(part))
    return out
