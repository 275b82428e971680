"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import alignment, chat, decontaminate, html_model, html_pages, language, licenses, line_dedup, ngram_join, packing, quality, sharding, spelling, warc
from sparkloom.llm.durable import new_folder, remove, written
from sparkloom.llm.oracles import SQL

__all__ = ["QUERIES", "SQL"]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    model = language.train(docs.where(fold != 1))
    out = language.identified(docs.select("doc_id", (fold == 1).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", F.col("best").alias("lang_pred"), "score", F.col("lang").isNull().alias("rejected"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    gone = line_dedup.removed_lines(docs)
    lines = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    gone = gone.withColumnsRenamed({"doc_id": "id_", "h": "h_"})
    out = lines.join(gone, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<bigint>")))
    return out.select("doc_id", "n_lines", F.size("lines").cast("long").alias("n_removed"), F.col("lines").alias("removed_lines"))


def op2_line_dedup_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same: operator 2 takes every line with a word, short ones too."""
    return op2_line_dedup(spark, sf_dir)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = quality.quality_rules(docs, keep_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_read(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_pages.extracted(_read(spark, sf_dir, "pages"), html_model.train())
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: A conversation whose texts hold the template's own control strings.
CONTROL_STRINGS = r"\### Assistant: </turn> ok"


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_STRINGS).alias("text"))
    made = chat.conversations_in_order(rows.unionByName(extra))
    return chat.read_back(made).withColumnRenamed("conv", "conv_id")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_read(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_read(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


#: Of so many crc32 values of a document's words one misspells its word.
SLIP_EVERY = 199


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"), slip_every=SLIP_EVERY)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    heads, payloads = warc.archive(warc.page_records(_read(spark, sf_dir, "pages")), f"{folder}/store")
    warc.write_files(heads, payloads, f"{folder}/files")
    records = written(warc.read_files(spark, f"{folder}/files", payload=False), "records")
    remove(spark, folder)
    return warc.resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_line_dedup, op2_line_dedup_all_lines, op3_quality_rules, op4_best_fit_packing, op5_html_extraction, op6_chat_formatting, op7_benchmark_decontamination, op8_ngram_jaccard_join, op9_sharding, op10_license_scan, op11_spelling_variants, op12_warc, op13_tokenizer_alignment)}
