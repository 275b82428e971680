"""Operator 7: benchmark decontamination.

The benchmark's word windows form a hash set that every task gets; tasks scan the windows of whole texts against it,
verify each hit word by word, and report or cut the words inside hits. The set is sent in parts of bounded rows and bytes,
one after the other; the hits of a part are written before the next part is fetched, so neither the driver nor a task
ever holds more than one, and the size of the benchmark has no limit. Windows: ``n`` consecutive words of an item; an item
of fewer words, but some, is one window.

Null or empty texts have no words and no hits. Repeated benchmark items all count. The words of an item without an id are
hit like any, but it can't be named, so it is in no list of items. Documents that share id and text share their hits;
repeated rows stay. Empty tables: no rows, or no hits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textscan as ts
from sparkloom.llm.durable import sized_join, written

WINDOW = 10
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def normal_words(text: str | None) -> list[str]:
    """Words after A-Z became a-z."""
    return WORD.findall((text or "").translate(UPPER))


#: Bytes of windows and item ids that are sent to the tasks at once.
PART_BYTES = 32 << 20


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = WINDOW) -> DataFrame:
    """Distinct (item, window): an item's id as a string and the words of a window joined by one blank."""

    def run(batches):
        for batch in batches:
            ids, found = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = normal_words(text)
                for j in range(max(min(len(words), 1), len(words) - n + 1)):
                    ids.append(i)
                    found.append(" ".join(words[j : j + n]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.string())], ["item", "window"])

    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "item string, window string").distinct()


class WindowSet:
    """A part of the benchmark's windows, ready to scan slices of text."""

    def __init__(self, windows: list[tuple[str, str | None]], n: int):
        self.n = n
        self.items: dict[str, list[str]] = {}
        for window, item in windows:
            self.items.setdefault(window, []).extend([] if item is None else [item])
        self.by_size: dict[int, np.ndarray] = {}
        self.known = np.zeros(1 << 16, bool)
        column = pa.array(list(self.items), pa.string())
        sizes: dict[int, list[np.ndarray]] = {}
        for _, _, data, offsets in ts.slices(column):
            starts, ends, rows = ts.runs(ts.ALNUM[data], offsets)
            hashes = ts.Hasher(data)(starts, ends)
            self.known[hashes & ts.U(0xFFFF)] = True
            counts = np.bincount(rows, minlength=len(offsets) - 1)
            for m in np.unique(counts[counts > 0]):
                pick = counts[rows] == m
                sizes.setdefault(int(m), []).append(ts.windows(hashes[pick], rows[pick], int(m))[1])
        for m, parts in sizes.items():
            self.by_size[m] = np.unique(np.concatenate(parts))

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """Word bounds and rows of a slice, which words are hit, and the items of each row with hits."""
        data = ts.LOWER[data]
        starts, ends, rows = ts.runs(ts.ALNUM[data], offsets)
        hashes = ts.Hasher(data)(starts, ends)
        cover = np.zeros(len(starts) + 1, np.int64)
        items: dict[int, set[str]] = {}
        reach = np.concatenate([[0], np.cumsum(self.known[hashes & ts.U(0xFFFF)])])
        for m, values in self.by_size.items():
            if len(starts) < m:
                continue
            at = np.flatnonzero((reach[m:] - reach[:-m] == m) & (rows[m - 1 :] == rows[: len(rows) - m + 1]))
            total = np.zeros(len(at), ts.U)
            for j, factor in enumerate(ts.window_factors(m)):
                total += hashes[at + j] * factor
            total = ts.mix(total + ts.U(m))
            place = np.minimum(np.searchsorted(values, total), len(values) - 1)
            for i in at[values[place] == total].tolist():
                found = self.items.get(" ".join(bytes(data[starts[j] : ends[j]]).decode() for j in range(i, i + m)))
                if found is not None:
                    cover[i] += 1
                    cover[i + m] -= 1
                    items.setdefault(int(rows[i]), set()).update(found)
        return starts, ends, rows, np.cumsum(cover[:-1]) > 0, items

    def scan_text(self, text: str):
        data = np.frombuffer(text.encode(), np.uint8)
        return self.scan(data, np.array([0, len(data)]))


def _parts(windows: DataFrame, max_windows: int) -> tuple[int, DataFrame]:
    """The number of parts, and the windows (item, window, part)."""
    windows = written(windows, "windows")
    size = windows.agg(F.count(F.lit(1)), F.sum(F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0)) + 100)).first()
    n = max(1, -(-size[0] // max_windows), -(-(size[1] or 0) // PART_BYTES))
    return n, windows.withColumn("part", F.pmod(F.xxhash64("window", "item"), F.lit(n)))


def _part(windows: DataFrame, part: int):
    """One part, sent to the tasks."""
    rows = [(r["window"], r["item"]) for r in windows.where(F.col("part") == part).select("window", "item").collect()]
    return windows.sparkSession.sparkContext.broadcast(rows)


SPAN = "struct<w:long,v:long,s:long,e:long>"


def _scanned(rows: DataFrame, sent, n: int) -> DataFrame:
    """(id, h, n_words, items, spans) of each row (id, h, t): spans are maximal runs of hit words, from word w to before v
    and from character s to before e."""
    kind = rows.schema["id"].dataType.simpleString()
    span_type = pa.list_(pa.struct([(c, pa.int64()) for c in "wvse"]))

    def run(batches):
        known = WindowSet(sent.value, n)
        for batch in batches:
            for start, end, data, offsets in ts.slices(batch.column(2)):
                starts, ends, where, hit, items = known.scan(data, offsets)
                size = end - start
                spans: list[list[dict]] = [[] for _ in range(size)]
                for r in items:
                    a, b = np.searchsorted(where, [r, r + 1])
                    chars = np.cumsum((data[offsets[r] : offsets[r + 1]] & 0xC0) != 0x80)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].view(np.int8), [0]])))
                    for x, y in edge.reshape(-1, 2).tolist():
                        spans[r].append({"w": x, "v": y, "s": int(chars[starts[a + x] - offsets[r]]) - 1, "e": int(chars[ends[a + y - 1] - 1 - offsets[r]])})
                ids, hashes = (batch.column(i).slice(start, size) for i in (0, 1))
                found = [sorted(items.get(r, ())) for r in range(size)]
                yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(np.bincount(where, minlength=size), pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(spans, span_type)], ["id", "h", "n_words", "items", "spans"])

    return rows.mapInArrow(run, f"id {kind}, h long, n_words long, items array<string>, spans array<{SPAN}>")


def _merged(spans: list[dict]) -> list[dict]:
    """Maximal spans from spans that may overlap or touch."""
    out: list[dict] = []
    for x in sorted(spans, key=lambda x: (x["w"], x["v"])):
        if out and x["w"] <= out[-1]["v"]:
            if x["v"] > out[-1]["v"]:
                out[-1] = {**out[-1], "v": x["v"], "e": x["e"]}
        else:
            out.append(x)
    return out


def _hits(rows: DataFrame, n_parts: int, windows: DataFrame, n: int) -> DataFrame:
    """(id, h, items, spans) of the documents with hits, from one pass per part; spans are maximal."""
    found = None
    for part in range(n_parts):
        sent = _part(windows, part)
        one = written(_scanned(rows, sent, n).where(F.size("spans") > 0).select("id", "h", "items", "spans"), "hits").dropDuplicates(["id", "h"])
        sent.unpersist()
        found = one if found is None else found.unionAll(one)
    kind = rows.schema["id"].dataType.simpleString()
    met = found.groupBy("id", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))  # of one document

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([_merged(x) for x in batch.column(3).to_pylist()], batch.column(3).type)], batch.schema.names)

    return met.mapInArrow(run, f"id {kind}, h long, items array<string>, spans array<{SPAN}>")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", n: int = WINDOW, max_windows: int = 250_000) -> DataFrame:
    """One row per document: its id, n_words, n_hit, items (ids as strings, sorted) and spans (of maximal runs of hit words:
    first word w and end v, first character s and end e, in code points)."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("t"))
    n_parts, windows = _parts(benchmark_windows(benchmark, item_col, n=n), max_windows)
    if n_parts == 1:
        out = _scanned(rows, _part(windows, 0), n)
    else:
        words = _scanned(rows, docs.sparkSession.sparkContext.broadcast([]), n).select("id", "h", "n_words")
        out = sized_join(words, written(_hits(rows, n_parts, windows, n), "hits"), ["id", "h"], "left")
    n_hit = F.aggregate(F.coalesce("spans", F.array().cast(f"array<{SPAN}>")), F.lit(0).cast("long"), lambda total, x: total + x["v"] - x["w"])
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def contaminated_removed(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", n: int = WINDOW, max_windows: int = 250_000) -> DataFrame:
    """The documents without hit words: the columns of ``docs``, rows with any hit cut out of their text; a document
    with nothing left but separators goes. Texts without hits stay as they are; a text that was cut is scanned again,
    by all parts, until nothing is hit, as what stood around a passage may form one."""
    n_parts, windows = _parts(benchmark_windows(benchmark, item_col, n=n), max_windows)
    at = docs.columns.index(text_col)
    if n_parts == 1:
        return _cut_at_once(docs, at, _part(windows, 0), n)
    names = [f"c{i}" for i in range(len(docs.columns))]
    todo, done = docs.toDF(*names), None
    while True:
        rows = todo.select(F.lit(0).alias("id"), F.xxhash64(names[at]).alias("h"), F.col(names[at]).cast("string").alias("t"))
        hits = written(_hits(rows, n_parts, windows, n), "hits")
        keyed = todo.withColumn("h", F.xxhash64(names[at]))
        clean = sized_join(keyed, hits, "h", "left_anti").select(names)
        done = clean if done is None else done.unionAll(clean)
        if hits.isEmpty():
            return done.toDF(*docs.columns)
        todo = written(_cut(sized_join(keyed, hits, "h"), names, at, docs.schema[text_col].dataType), "cut")


def _cut(rows: DataFrame, names: list[str], at: int, kind) -> DataFrame:
    """Rows with their spans cut out; those that keep no word go."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in names)

    def run(batches):
        for batch in batches:
            spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
            texts, keep = [], []
            for text, found in zip(batch.column(at).to_pylist(), spans, strict=True):
                kept, last = [], 0
                for x in found:
                    kept.append(text[last : x["s"]])
                    last = x["e"]
                texts.append("".join([*kept, text[last:]]))
                keep.append(bool(normal_words(texts[-1])))
            columns = [pa.array(texts, batch.column(i).type) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return rows.select(*names, "spans").mapInArrow(run, schema)


def _cut_at_once(docs: DataFrame, at: int, sent, n: int) -> DataFrame:
    """All rounds of the only part in one pass."""
    names = docs.columns

    def run(batches):
        known = WindowSet(sent.value, n)
        for batch in batches:
            for start, end, data, offsets in ts.slices(batch.column(at)):
                part = batch.slice(start, end - start)
                starts, ends, where, hit, items = known.scan(data, offsets)
                if items:
                    texts = part.column(at).to_pylist()
                    keep = np.ones(end - start, bool)
                    for r in items:
                        texts[r] = cut(bytes(data[offsets[r] : offsets[r + 1]]), starts, ends, hit, *np.searchsorted(where, [r, r + 1]), offsets[r])
                        while (again := known.scan_text(texts[r]))[4]:
                            texts[r] = cut(texts[r].encode(), *again[:2], again[3], 0, len(again[0]), 0)
                        keep[r] = bool(normal_words(texts[r]))
                    columns = [pa.array(texts, part.column(i).type) if i == at else part.column(i) for i in range(len(names))]
                    part = pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))
                yield part

    return docs.mapInArrow(run, docs.schema)


def cut(text: bytes, starts, ends, hit, a: int, b: int, shift: int) -> str:
    """The text without its hit words and the separators between them."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].view(np.int8), [0]]))).reshape(-1, 2)
    kept, last = [], 0
    for x, y in edge.tolist():
        kept.append(text[last : starts[a + x] - shift])
        last = ends[a + y - 1] - shift
    return b"".join([*kept, text[last:]]).decode()
