"""A written index of texts as sets of words, and exact nearest neighbours of one question.

The index holds each text's word numbers (rarest first), the words, and postings sorted by word number. A question reads
the postings of its own words alone, the rarest first. A text that none of the opened words is in shares at most the words
that are left, so its cosine is at most the root of their share; as soon as the n-th best that is sure reaches this, the
postings of the other words, which are the longest, stay closed. Texts that may still be among the n best by what is
left are settled by their whole sets. No text is cut into words again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import columns as C
from sparkloom.functions.staging import dropped
from sparkloom.operators.text import ranked_sets

#: Postings that a question opens before it knows any neighbour.
FIRST = 100_000
#: Ranges of values that a filter names to the files.
RANGES = 32


@dataclass
class TextIndex:
    """(id, ranks, size), (term, n, rank), (rank, id, size) and (id): all texts that have an id."""

    sets: DataFrame
    words: DataFrame
    postings: DataFrame
    ids: DataFrame


def write_index(docs: DataFrame, folder: str, id_col: str = "id", text_col: str = "content") -> None:
    sets, words = ranked_sets(docs, id_col, text_col)
    docs.select(F.col(id_col).alias("id")).where("id is not null").distinct().write.parquet(f"{folder}/ids")
    sets.write.parquet(f"{folder}/sets")
    words.orderBy("term").write.parquet(f"{folder}/words")
    sets.select(F.explode("ranks").alias("rank"), "id", "size").orderBy("rank").write.parquet(f"{folder}/postings")
    dropped(sets, words)


def open_index(spark: SparkSession, folder: str) -> TextIndex:
    return TextIndex(*[spark.read.parquet(f"{folder}/{name}") for name in ("sets", "words", "postings", "ids")])


def _one_of(rows: DataFrame, column: str, values: list) -> DataFrame:
    """The rows with one of the values. The values are sent and looked up by their hash, so their number costs a row nothing;
    a few ranges around them reach the files, which are sorted by the column."""
    if not values:
        return rows.where("false")
    values = sorted(values)
    step = -(-len(values) // RANGES)
    near = reduce(Column.__or__, [F.col(column).between(*(values[i : i + step][x] for x in (0, -1))) for i in range(0, len(values), step)])
    kind = rows.schema[column].dataType.simpleString()
    return rows.where(near).join(F.broadcast(_listed(rows.sparkSession, column, values, kind)), column, "left_semi")


def _listed(spark: SparkSession, column: str, values: list, kind: str) -> DataFrame:
    return spark.createDataFrame([(values,)], f"v array<{kind}>").select(F.explode("v").alias(column))


def _question(index: TextIndex, spark: SparkSession, text: str) -> tuple[list[tuple[int, int]], int]:
    """(rank, n) of the question's words that the index has, the rarest first, and the number of all its words."""
    terms = spark.createDataFrame([(text,)], "t string").select(F.array_distinct(C.tokens(F.col("t")))).first()[0]
    known = _one_of(index.words, "term", terms).select("rank", "n").collect()
    return sorted((r["rank"], r["n"]) for r in known), len(terms)


def _enough(words: list[tuple[int, int]], most: int) -> int:
    """How many of the words, one at least, have ``most`` postings together."""
    total = 0
    for i, (_, n) in enumerate(words):
        total += n
        if total > most:
            return max(1, i)
    return len(words)


def nearest(index: TextIndex, text: str, n: int = 3, but: object = None) -> DataFrame:
    """(id, similarity): the ``n`` texts most similar to a question's text, ties by id; texts of similarity 0 fill up. ``but``: an id
    that is left out. An empty question has only texts of similarity 0."""
    spark = index.sets.sparkSession
    words, size = _question(index, spark, text)
    score = F.col("shared") / F.sqrt(F.lit(float(size)) * F.col("size"))
    opened, least = _enough(words, FIRST), 0.0
    while opened:
        met = _met(index, [rank for rank, _ in words[:opened]], but)
        sure = met.select(score.alias("sure")).orderBy(F.desc("sure")).limit(n).collect()  # what is open counts for certain
        least = sure[-1]["sure"] if len(sure) == n else 0.0
        needed = len(words) - max(0, int(least * least * size - 1e-9))  # a text of none of these words stays below
        if opened >= needed:
            break
        opened = needed if least else len(words)
    left = len(words) - opened
    if not opened:
        found = index.sets.where("false").select("id", F.lit(0.0).alias("similarity"))
    else:
        reach = (F.col("shared") + F.least(F.lit(left), F.col("size") - F.col("shared"))) / F.sqrt(F.lit(float(size)) * F.col("size"))
        near = met.where(reach >= least - 1e-9)
        if left:
            own = spark.createDataFrame([([rank for rank, _ in words],)], "own array<long>")
            near = index.sets.join(near.select("id"), "id").join(F.broadcast(own)).select("id", "size", F.size(F.array_intersect("ranks", "own")).alias("shared"))
        found = near.select("id", score.alias("similarity"))
    best = found.orderBy(F.desc(F.round("similarity", 9)), "id").limit(n)
    others = index.ids.where(~F.col("id").eqNullSafe(F.lit(but))).orderBy("id").limit(2 * n)  # n are left without those of the best
    fill = others.join(best.select("id"), "id", "left_anti").select("id", F.lit(0.0).alias("similarity"))
    return best.unionByName(fill).orderBy(F.desc(F.round("similarity", 9)), "id").limit(n)


def _met(index: TextIndex, ranks: list[int], but: object) -> DataFrame:
    """(id, size, shared) of the texts that have any of these words."""
    rows = _one_of(index.postings, "rank", ranks).where(~F.col("id").eqNullSafe(F.lit(but)))
    return rows.groupBy("id", "size").agg(F.count(F.lit(1)).alias("shared"))
