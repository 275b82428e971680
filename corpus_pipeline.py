"""A corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the columns of
``documents``; where a stage changes a text, ``n_chars`` follows. The result, one row per packed piece, depends on
sketches and packing that SQL cannot express, so there is no ORACLE_SQL; tests hold it against brute force.

In every stage, null and empty texts have no words: the quality rules drop them, as any text of fewer than 20 words. Ids may
be null or repeat: rows that agree in id and text are one document and meet one fate, of near copies one row stays, ties go to the
smallest id, and of one id to the smallest text hash. Texts of any length are worked on whole. Columns beyond those of ``documents`` are
kept by all stages but the last, whatever their names. An empty table gives an empty one of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, line_dedup, ngram_join, packing, quality
from sparkloom.llm.durable import discard, discard_since, mark, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules of their host accept."""
    return quality.accepted(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; a document that loses all its words goes."""
    return _recounted(docs, line_dedup.without_lines(docs, drop_emptied=True))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies."""
    return ngram_join.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _recounted(docs, decontaminate.contaminated_removed(docs, benchmark))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in bins of 2048 words."""
    return packing.packed(docs)


def _recounted(docs: DataFrame, changed: DataFrame) -> DataFrame:
    kind = docs.schema["n_chars"].dataType
    return changed.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars"))).select(docs.columns)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again. When it is written, the tables it was made
    from go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, done = mark(), stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            done = written(done, f"stage{i}")
            discard_since(spark, before, done)
            discard(docs)
        docs = done
    return docs
