"""Operator 1: language identification by compression.

For each language a raw-content Zstandard dictionary is made of the words of labelled documents, the most frequent
last (the nearest). A whole text, in pieces that all count, is compressed with every dictionary; the language whose
dictionary leaves the fewest bytes wins. A narrow margin is rejected: ``lang`` is null and ``best`` still tells the
nearest language.

Training reads a bounded sample: of each language the ``rows_per_language`` rows of the smallest hashes of id and text, in
whole; Spark counts their words. A language costs a dictionary of 32 KB. Texts to be classified are never cut.

Null texts and texts without a letter are ``und`` with score 0, as is everything where no labelled row exists. Ties go
to the language with more labelled rows, then to the smaller name. Repeated rows are classified one by one. An empty table
gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.durable import sized_join, written

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
PIECE = 2048
DICTIONARY_BYTES = 32 * 1024
SALTS = 64


def letters_only(text: str) -> str:
    """Lower-case words of letters, joined by blanks."""
    return " ".join(LETTERS.findall(text.lower()))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 300) -> list[tuple[str, bytes]]:
    """(language, dictionary), the language with most labelled rows first."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("place"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    chosen = rows.select("lang", "place", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("part"))
    for keys in (["lang", "part"], ["lang"]):  # by parts first, so that no task ranks what all partitions send of one language
        first = Window.partitionBy(*keys).orderBy("place")
        chosen = chosen.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= rows_per_language)
    last = written(chosen.groupBy("lang").agg(F.max("place").alias("last")), "sample")  # the texts stay where they are
    sample = sized_join(rows, last, "lang").where("place <= last").select("lang", "text")
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    words = sample.mapInArrow(_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = words.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= DICTIONARY_BYTES // 2)
    counts: dict[str, Counter] = {r["lang"]: Counter() for r in sizes.orderBy(F.desc("n"), "lang").toLocalIterator()}
    for r in words.select("lang", "word", "n").toLocalIterator():
        counts[r["lang"]][r["word"]] = r["n"]
    return [(lang, dictionary(c)) for lang, c in counts.items() if c]


def _words(batches):
    """(lang, word, n) of the words of rows (lang, text)."""
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.update((lang, word) for word in letters_only(text).split())
        langs, words = ([k[i] for k in counts] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])


def dictionary(counts: Counter) -> bytes:
    """The most frequent words that fit, the most frequent last."""
    kept, size = [], 1
    for word, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        size += len(word.encode()) + 1
        if size > DICTIONARY_BYTES:
            break
        kept.append(word)
    return (" " + " ".join(reversed(kept)) + " ").encode()


class Model:
    """Compressors of the languages."""

    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        self.names = [lang for lang, _ in dictionaries]
        self.compressors = []
        for _, content in dictionaries:
            shape = zstandard.ZstdCompressionParameters.from_level(
                9, source_size=PIECE, dict_size=len(content), min_match=3, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            self.compressors.append(zstandard.ZstdCompressor(compression_params=shape, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)))

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin (bytes between the two best, as a share of the best)."""
        letters = letters_only(text).encode() if text and self.names else b""
        if not letters or not any(c.isalpha() for c in letters.decode()):
            return UNKNOWN, 0.0, 0.0
        sizes = [0] * len(self.names)
        for at in range(0, len(letters), PIECE):
            piece = letters[at : at + PIECE]
            for k, compressor in enumerate(self.compressors):
                sizes[k] += len(compressor.compress(piece))
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [s - sizes[best] for k, s in enumerate(sizes) if k != best]
        return self.names[best], 1.0 / (1.0 + sum(2.0 ** -min(d, 1000) for d in rest)), (min(rest) if rest else sizes[best]) / sizes[best]


def identified(docs: DataFrame, dictionaries: list[tuple[str, bytes]], text_col: str = "text", margin: float = 0.01) -> DataFrame:
    """The rows without their text, with best, lang (null if rejected), score and margin (columns of these names are
    replaced)."""
    new = ("best", "lang", "score", "margin")
    base = docs.drop(*[c for c in new if c != text_col])
    kept = [f for f in base.schema if f.name != text_col]
    at, places = base.columns.index(text_col), [base.columns.index(f.name) for f in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["best string, lang string, score double, margin double"])
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        model = Model(sent.value)
        for batch in batches:
            found = [model.classify(t.as_py()) for t in batch.column(at)]
            best, score, gap = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
            lang = [b if b == UNKNOWN or g >= margin else None for b, g in zip(best, gap, strict=True)]
            columns = [pa.array(best, pa.string()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gap, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in places] + columns, [f.name for f in kept] + list(new))

    return base.mapInArrow(run, schema)
