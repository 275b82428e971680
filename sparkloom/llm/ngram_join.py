"""Operator 8: n-gram Jaccard join by parity sketches.

Each document's set of distinct word shingles is XOR-hashed into a sparse bit sketch: a shingle flips one bit, so the
Hamming distance of two sketches is at most the symmetric difference of the sets. The sketch of a size band has a fixed
number of chunks. Two sets of Jaccard similarity t or more differ in at most D = (|A| + |B|)(1 - t)/(1 + t) shingles and
so in at most D chunks; of a document's p non-empty chunks p - D or more agree (pigeonhole), hence two linked documents
agree in one of the D + 1 chunks of each that come first in any common order. Chunks are ordered by how rarely their
content occurs, counted over all documents in a table of fixed size, so the chunks that thousands of documents share
are hardly ever sent.

Documents of one shingle set are one class from the start. The classes that agree in a chunk are candidates. Where few
do, all their pairs are verified. Where many do (near copies), each is verified against one hub, the class with the most
common chunks; pairs that are then in one component need no further look, and the others are compared in blocks of
sketches, where the Hamming bound leaves few pairs to verify. No pair of linked documents is lost: every pair that agrees
in a sent chunk is verified, is in one component already, or is ruled out by the bound.

Null texts and texts without words have no shingles and are linked with nothing. Rows that share an id are one document
per distinct text; a null id is an id. Components are named by the smallest id in them, null only if they have no other.
An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textscan as ts
from sparkloom.llm.components import components
from sparkloom.llm.durable import discard, is_small, sized_join, written

#: Counters of chunk contents. Fixed: contents that share a counter are only ordered less well.
COUNTERS = 1 << 18
#: Sizes of the first band; each further band is 16 times as wide.
FIRST_BAND, BAND_STEP = 4096, 16
#: Up to so many classes that agree in a chunk, all pairs are candidates.
FEW = 5
#: Rows of a chunk's classes that a task holds at once.
HELD = 1 << 18
#: Members of a hub, and pairs of sketches, that are compared in one step.
BLOCK = 256


class Shape:
    """Threshold (as a fraction over 100) and shingle length."""

    def __init__(self, percent: int = 80, words: int = 5):
        self.percent, self.words = percent, words

    def largest(self, n: np.ndarray) -> np.ndarray:
        """The largest set that a set of n can be linked with."""
        return n * 100 // self.percent

    def bands(self, n: np.ndarray) -> np.ndarray:
        """A number for each size, such that linked sets have the same number or neighbouring ones."""
        starts = [1]
        while starts[-1] <= n.max(initial=1):
            starts.append(starts[-1] * 100 // self.percent + 1)
        return np.searchsorted(starts, n, "right")

    def apart(self, a, b):
        """The largest symmetric difference of linked sets of these sizes."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds and sorted distinct shingle hashes of each row of a slice."""
        data = ts.LOWER[data]
        starts, ends, rows = ts.runs(ts.SPACED[data], offsets)
        n = len(offsets) - 1
        return ts.distinct(*ts.shingles(ts.Hasher(data)(starts, ends), rows, self.words, n), n)

    def chunks(self, bounds: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, band and 64-bit content of every non-empty chunk, in each band where the row can have a partner."""
        sizes = np.diff(bounds)
        found_rows, found_bands, found_keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, ts.U)]
        level, low, high = 0, 0, FIRST_BAND
        while len(sizes) and low < self.largest(sizes.max()):
            here = (sizes > 0) & (sizes <= high) & (self.largest(sizes) > low)
            if here.any():
                rows = np.repeat(np.arange(len(sizes)), sizes)
                pick = here[rows]
                rows, v = rows[pick], values[pick]
                k = 2 * high
                place = rows * k + ((v >> ts.U(20)) % ts.U(k)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                place = place[order]
                first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                content = np.bitwise_xor.reduceat(ts.mix(v[order] ^ ts.U(0xA5A5A5A55A5A5A5A)), first)
                found_rows.append(place[first] // k)
                found_bands.append(np.full(len(first), level))
                found_keys.append(ts.mix(content + (place[first] % k).astype(ts.U) * ts.U(0x9E3779B97F4A7C15) + ts.U(level)))
            level, low, high = level + 1, high, high * BAND_STEP
        return np.concatenate(found_rows), np.concatenate(found_bands), np.concatenate(found_keys)


def class_ids(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set (0 for empty)."""
    total = np.concatenate([np.zeros(1, ts.U), np.cumsum(ts.mix(values ^ ts.U(0x632BE59BD9B4E019)), dtype=ts.U)])
    sizes = np.diff(bounds)
    return np.where(sizes > 0, ts.mix(total[bounds[1:]] - total[bounds[:-1]] + sizes.astype(ts.U)), ts.U(0))


def _named(docs: DataFrame, shape: Shape) -> DataFrame:
    """(id, h, n, class, sketch) of each row (id, h, text), and the counters of each task as rows (counter, hits)."""
    names_out = ["id", "h", "n", "class", "sketch", "counter", "hits"]

    def run(batches):
        counters = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for start, end, data, offsets in ts.slices(batch.column(2)):
                bounds, values = shape.sets(data, offsets)
                keys = shape.chunks(bounds, values)[2]
                np.add.at(counters, (keys & ts.U(COUNTERS - 1)).astype(np.int64), 1)
                names, sizes = class_ids(bounds, values).view(np.int64), np.diff(bounds)
                empty = pa.nulls(end - start, pa.int64())
                sketches = pa.array([_sketch(values[a:b]) if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                ids, hashes = (batch.column(i).slice(start, end - start) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(sizes), pa.array(names, mask=sizes == 0), sketches, empty, empty], names_out)
                id_type = batch.column(0).type
        used = np.flatnonzero(counters)
        if len(used):
            none = pa.nulls(len(used), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(used), id_type), none, none, none, pa.nulls(len(used), pa.binary()), pa.array(used), pa.array(counters[used])], names_out)

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, h long, n long, class long, sketch binary, counter long, hits long")


class Remembered:
    """The classes that a task has sent: a table of fixed size that forgets some, but never takes a new one for known."""

    def __init__(self):
        self.names = np.zeros(1 << 16, ts.U)

    def fresh(self, names: np.ndarray) -> np.ndarray:
        slot = (names & ts.U(len(self.names) - 1)).astype(np.int64)
        new = self.names[slot] != names
        self.names[slot] = names
        return new


def _keys(docs: DataFrame, shape: Shape, counts: np.ndarray) -> DataFrame:
    """(key, place, class): the chunks that each document sends, once per class and task. The high byte of ``place`` is
    the band of the document's size; within it, documents of common chunks come first."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        counts, known = sent.value, Remembered()
        for batch in batches:
            for _, _, data, offsets in ts.slices(batch.column(1)):
                bounds, values = shape.sets(data, offsets)
                sizes, names = np.diff(bounds), class_ids(bounds, values)
                new = (sizes > 0) & known.fresh(names)
                pick = np.repeat(new, sizes)
                bounds = np.concatenate([[0], np.cumsum(np.where(new, sizes, 0))])
                rows, bands, keys = shape.chunks(bounds, values[pick])
                often = counts[keys & ts.U(COUNTERS - 1)]
                weights = np.bincount(rows, weights=np.minimum(often, 1 << 30), minlength=len(sizes)) / np.maximum(np.bincount(rows, minlength=len(sizes)), 1)
                place = (shape.bands(sizes) << 24) + (1 << 24) - 1 - np.minimum(weights, (1 << 24) - 1).astype(np.int64)
                by = (np.minimum(often, (1 << 31) - 1).astype(ts.U) << ts.U(32)) | (keys >> ts.U(32))
                # a document in two bands sends a prefix in each
                group = rows * 16 + bands
                order = np.lexsort((by, group))
                group, by, keys, rows = group[order], by[order], keys[order], rows[order]
                first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
                lengths = np.diff(np.concatenate([first, [len(group)]]))
                need = shape.apart(sizes[rows[first]], shape.largest(sizes[rows[first]]))
                last = first + np.minimum(need, lengths - 1)
                rank = np.arange(len(group))
                keep = (rank <= np.repeat(last, lengths)) | (by == np.repeat(by[last], lengths))
                out_keys, out_rows = [keys[keep]], [rows[keep]]
                short = lengths <= need  # all chunks may differ: such documents meet under one key
                if short.any():
                    out_keys.append(ts.mix(group[first[short]].astype(ts.U) & ts.U(15)))
                    out_rows.append(rows[first[short]])
                out_rows = np.concatenate(out_rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_keys).view(np.int64)), pa.array(place[out_rows].astype(np.int32)), pa.array(names.view(np.int64)[out_rows])], ["key", "place", "class"])

    return docs.mapInArrow(run, "key long, place int, class long")


class Runs:
    """Turns classes that share a key, in ascending order of their size bands, into candidate pairs."""

    def __init__(self):
        self.key, self.hubs = None, {}

    def pairs(self, key: np.ndarray, band: np.ndarray, name: np.ndarray, going_on: bool) -> pa.RecordBatch | None:
        """``going_on``: the rows are a part of one key's."""
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])])
        key, band, name = key[fresh], band[fresh], name[fresh]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (band[1:] != band[:-1])]))
        length = np.diff(np.concatenate([first, [len(key)]]))
        k, b = key[first], band[first]
        joined = np.zeros(len(first), np.int64)  # members in the next band
        joined[:-1] = np.where((k[1:] == k[:-1]) & (b[1:] == b[:-1] + 1), length[1:], 0)
        hot = (length + joined > FEW) | (k == self.key) | going_on
        a_all, b_all, hot_all = [], [], []

        def add(x, y, is_hot: bool):
            a_all.append(x if is_hot else np.minimum(x, y))
            b_all.append(y if is_hot else np.maximum(x, y))
            hot_all.append(np.full(len(x), is_hot))

        for i in np.flatnonzero(hot | np.concatenate([[False], hot[:-1]])):
            if k[i] != self.key:
                self.key, self.hubs = k[i], {}
            members = name[first[i] : first[i] + length[i]]
            if hot[i]:
                self.hubs.setdefault(b[i], members[0])
            for hub in (self.hubs.get(b[i]), self.hubs.get(b[i] - 1)):
                if hub is not None:
                    others = members[members != hub]
                    add(np.full(len(others), hub), others, True)
        for m in range(1, FEW + 1):
            for more in range(FEW + 1 - m):
                at = first[~hot & (length == m) & (joined == more)]
                if m + more > 1 and len(at):
                    for x in range(m):
                        for y in range(x + 1, m + more):
                            add(name[at + x], name[at + y], False)
        if not sum(map(len, a_all)):
            return None
        both = np.unique(np.stack([np.concatenate(a_all), np.concatenate(b_all), np.concatenate(hot_all)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(both[2].astype(bool))], ["a", "b", "hot"])


def _candidates(keys: DataFrame) -> DataFrame:
    """Distinct (a, b, hot) from keys that several classes of like size share: pairs if they are few, else hub and
    member."""

    def run(batches):
        held, runs = None, Runs()
        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy() >> 24, batch.column(2).to_numpy()]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1], "left"))
            if cut and (out := runs.pairs(*[x[:cut] for x in held], False)):
                yield out
            held = [x[cut:] for x in held]
            if len(held[0]) > HELD:
                if out := runs.pairs(*held, True):
                    yield out
                held = [x[:0] for x in held]
        if held is not None and len(held[0]) and (out := runs.pairs(*held, False)):
            yield out

    dealt = keys.repartition("key").sortWithinPartitions("key", "place", "class")
    return dealt.mapInArrow(run, "a long, b long, hot boolean").groupBy("a", "b").agg(F.max("hot").alias("hot"))


def _sketch(values: np.ndarray) -> bytes:
    """The parity sketch of a set: each element flips one of at least twice as many bits."""
    width = max(256, 1 << int(2 * len(values) - 1).bit_length())
    parity = np.bincount((values & ts.U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def _folded(sketches: list[bytes], width: int = 0) -> np.ndarray:
    """Sketches as rows of one width, by default the least: a wider sketch folds onto a narrower one by XOR."""
    width = width or min(map(len, sketches))
    out = np.zeros((len(sketches), width), np.uint8)
    by_size: dict[int, list[int]] = {}
    for i, s in enumerate(sketches):
        by_size.setdefault(len(s), []).append(i)
    for size, rows in by_size.items():
        out[rows] = np.bitwise_xor.reduce(np.frombuffer(b"".join([sketches[i] for i in rows]), np.uint8).reshape(len(rows), size // width, width), axis=1)
    return out.view(np.uint64)


def _distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The Hamming distance of each pair of sketches, at the width of the narrower one."""
    out = np.zeros(len(a), np.int64)
    by_width: dict[int, list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        by_width.setdefault(min(len(x), len(y)), []).append(i)
    for width, rows in by_width.items():
        for at in range(0, len(rows), BLOCK):
            some = rows[at : at + BLOCK]
            out[some] = np.bitwise_count(_folded([a[i] for i in some], width) ^ _folded([b[i] for i in some], width)).sum(axis=1)
    return out


def _close(pairs: DataFrame, classes: DataFrame, shape: Shape) -> DataFrame:
    """The pairs (a, b) whose sizes and whose sketches' Hamming distance allow a link."""
    left = classes.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    right = classes.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    near = (F.col("na") * 100 >= F.col("nb") * shape.percent) & (F.col("nb") * 100 >= F.col("na") * shape.percent)
    both = pairs.select("a", "b").join(left, "b").join(right, "a").where(near).select("a", "b", "na", "nb", "ka", "kb")

    def run(batches):
        for batch in batches:
            limits = shape.apart(batch.column(2).to_numpy(), batch.column(3).to_numpy())
            keep = _distances(batch.column(4).to_pylist(), batch.column(5).to_pylist()) <= limits
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, shape: Shape) -> DataFrame:
    """(class, set) of the wanted classes, read from one document of each; sets are sorted."""

    def run(batches):
        for batch in batches:
            for start, end, data, offsets in ts.slices(batch.column(0)):
                bounds, values = shape.sets(data, offsets)
                names = class_ids(bounds, values).view(np.int64)
                rows = np.flatnonzero(names == batch.column(1).slice(start, end - start).to_numpy())
                if len(rows):
                    parts = [values[bounds[r] : bounds[r + 1]] for r in rows]
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]), pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(names[rows]), lists], ["class", "set"])

    return sized_join(docs, wanted, "id").select("text", "class").mapInArrow(run, "class long, set array<long>")


def _linked(near: DataFrame, docs: DataFrame, classes: DataFrame, shape: Shape) -> DataFrame:
    """The pairs (a, b) that are linked, by their whole sets."""
    names = near.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted = names.join(classes, "class").select(F.col("first").alias("id"), "class")
    wanted = written(wanted, "wanted")
    sets = written(_sets(docs, wanted, shape), "sets")
    both = near.join(sets.withColumnsRenamed({"class": "b", "set": "sb"}), "b").join(sets.withColumnsRenamed({"class": "a", "set": "sa"}), "a").select("a", "b", "sa", "sb")
    percent = shape.percent

    def run(batches):
        for batch in batches:
            a, b = (batch.column(i) for i in (2, 3))
            oa, ob, va, vb = np.asarray(a.offsets), np.asarray(b.offsets), a.values.to_numpy(), b.values.to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    links = written(both.mapInArrow(run, "a long, b long"), "links")
    discard(sets)
    return links


def _left_over(hubs: DataFrame, labels: DataFrame, classes: DataFrame, shape: Shape) -> DataFrame:
    """Pairs of one hub's members in different components that the Hamming bound can't rule out."""
    of = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    top = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    members = hubs.join(of, "b", "left").join(top, "a", "left").select("a", "b", F.coalesce("cb", "b").alias("cb"), F.coalesce("ca", "a").alias("ca"))
    members = written(members.withColumn("odd", F.col("ca") != F.col("cb")), "members")
    sizes = members.groupBy("a").agg(F.count(F.lit(1)).alias("m"), F.count_if("odd").alias("odds")).where("odds > 0")
    sizes = sizes.select("a", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sizes, "a").withColumn("own", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    asking = placed.where("odd").groupBy("a").agg(F.collect_set("own").alias("asking"))  # of the blocks of one hub
    base = placed.join(asking, "a").select("a", "b", "cb", F.explode("asking").alias("other"), "own", F.lit(False).alias("probe"))
    probes = placed.where("odd").select("a", "b", "cb", F.explode(every).alias("other"), "own", F.lit(True).alias("probe"))
    cells = base.select("a", "b", "cb", "probe", F.col("own").alias("x"), F.col("other").alias("y")).unionAll(probes.select("a", "b", "cb", "probe", F.col("other").alias("x"), F.col("own").alias("y")))
    cells = cells.join(classes.select(F.col("class").alias("b"), "n", "sketch"), "b")

    def compare(table: pa.Table) -> pa.Table:
        name, comp, n = (table.column(c).to_numpy() for c in ("b", "cb", "n"))
        probe, flat = table.column("probe").to_numpy(), _folded(table.column("sketch").to_pylist())
        base = np.flatnonzero(~probe)
        found_a, found_b = [], []
        for i in np.flatnonzero(probe):
            limit = shape.apart(n[base], n[i])
            close = np.bitwise_count(flat[base] ^ flat[i]).sum(axis=1) <= limit
            close &= (comp[base] != comp[i]) & (n[base] * 100 >= n[i] * shape.percent) & (n[i] * 100 >= n[base] * shape.percent)
            other = name[base[close]]
            found_a.append(np.minimum(other, name[i]))
            found_b.append(np.maximum(other, name[i]))
        pairs = np.unique(np.stack([np.concatenate([np.zeros(0, np.int64), *x]) for x in (found_a, found_b)]), axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    return cells.groupBy("a", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def _components(rows: DataFrame, shape: Shape) -> DataFrame:
    """(id, h, n, class, label, component_id) of each row (id, h, text); rows of one label are linked."""
    named = written(_named(rows, shape), "named")
    counts = np.zeros(COUNTERS, np.int64)
    table = named.where("counter is not null").groupBy("counter").agg(F.sum("hits").alias("hits")).toArrow()
    counts[table["counter"].to_numpy()] = table["hits"].to_numpy()
    texts = rows.select("id", "text")
    pairs = written(_candidates(_keys(texts, shape, counts)), "pairs")
    classes = named.where("class is not null").groupBy("class")
    classes = classes.agg(F.min("id").alias("first"), F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.count(F.lit(1)).alias("docs"))
    classes = written(classes, "classes")
    links = _linked(written(_close(pairs, classes, shape), "near"), texts, classes, shape)
    labels = components(links)
    more = written(_left_over(pairs.where("hot"), labels, classes, shape), "near")
    if not more.isEmpty():
        links = _linked(more, texts, classes, shape)
        labels = components(labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(links))
    discard(pairs)
    grouped = labels.join(classes, labels["node"] == classes["class"]).select("class", "component", "first")
    least = grouped.groupBy("component").agg(F.min("first").alias("least"))
    known = classes.join(grouped.join(least, "component").select("class", "component", "least"), "class", "left")
    known = known.select("class", F.coalesce("component", "class").alias("label"), F.coalesce("least", "first").alias("component_id"), "docs")
    known = written(known, "known")
    discard(classes)
    return _by_class(named.where("counter is null").select("id", "h", "n", "class"), known)


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = 5) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id that links lead to)."""
    text = F.col(text_col).cast("string")
    found = _components(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text")), Shape(percent, words))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


#: Documents of a class beyond which they are joined in several tasks.
CROWD = 100_000


def _by_class(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows with the columns of ``known`` for their class. Where ``known`` is not small, classes of very many documents
    are dealt to several tasks; there are few of these."""
    if is_small(known):
        return sized_join(rows, known, "class", "left")
    parts = F.ceil(F.col("docs") / CROWD).cast("int")
    crowds = written(known.where(F.col("docs") > CROWD).select("class", parts.alias("parts")), "crowds")
    dealt = sized_join(rows, crowds, "class", "left").withColumn("part", F.pmod(F.xxhash64("id", "h"), F.coalesce("parts", F.lit(1))).cast("int"))
    copies = known.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(copies, ["class", "part"], "left")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = 5) -> DataFrame:
    """The documents without those that have a smaller id in their component; the columns of ``docs``. Of texts of one id in
    one component that of the smallest hash stays, of equal rows one. Documents without shingles all stay."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    rows = docs.toDF(*names).withColumns({"id": key, "h": F.xxhash64(text.cast("string"))})
    found = _components(rows.select("id", "h", text.cast("string").alias("text")), Shape(percent, words)).where("n > 0")
    found = found.groupBy("id", "label", "h").agg(F.first("component_id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    best = found.groupBy(F.col("id").alias("id_"), F.col("label").alias("label_")).agg(F.min("h").alias("least"), F.count(F.lit(1)).alias("texts")).where("texts > 1")
    judged = found.join(best, found["id"].eqNullSafe(best["id_"]) & (found["label"] == best["label_"]), "left")
    stays = F.col("id").eqNullSafe(F.coalesce("component_id", "id")) & (F.col("h") == F.coalesce("least", "h"))
    judged = judged.select("id", "h", stays.alias("stays"), "rows")
    gone = written(judged.where("not stays or rows > 1"), "gone")
    kept = sized_join(rows, written(gone.select("id", "h"), "gone"), ["id", "h"], "left_anti")
    again = written(gone.where("stays").select("id", "h"), "again")
    if not again.isEmpty():  # rows of one id and text
        kept = kept.unionByName(sized_join(rows, again, ["id", "h"]).dropDuplicates(["id", "h"]))
    return kept.select(names).toDF(*docs.columns)
