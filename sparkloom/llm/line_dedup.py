"""Operator 2: line dedup by an exact set-similarity join.

A line is the set of its distinct words (lower-cased A-Z). It goes if an earlier line, in order of document id, hash of
the text and line number, has a Jaccard similarity of ``percent`` or more to it, no matter whether that line goes itself.

Lines of one word set are one class, whose first line is its earliest; the others go without a comparison. Words are
ordered by rarity, counted over all texts in a table of fixed size; a class sends its first n - ceil(t n) + 1 words, less
those that occur only once. Classes that share one of these are compared where they meet: by size (length filter), by the
overlap that can still follow the shared word (positional filter) and by parity sketches of 128 bits, whose Hamming
distance is at most the symmetric difference. The NEAREST earlier partners of a class under each word are verified on
whole sets; a class that these have not removed although it has more is looked up again, with all its partners, in a
second round. A word of more than HOT occurrences is split by bands of set size, each class meeting its own band and the
next; in a run of more than LONG classes only those without a close partner among the earliest LEADERS are compared with
all the rest.

Null text: no lines. Empty lines stay. Null ids come first. Rows that agree in id and text are one document: they lose
the same lines. Rows of one id with different texts are different documents. A document whose lines all go is left with
an empty text. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textscan as ts
from sparkloom.llm.durable import discard, sized_join, written
from sparkloom.llm.ngram_join import Shape, class_ids

#: Counters of words, in blocks. Fixed: words that share a counter are only ordered less well.
COUNTERS, COUNTER_BLOCK = 1 << 20, 1 << 12
#: Partners of a class that a word sends to verification in the first round.
NEAREST = 2
#: Rows of one key that a task holds at once, and pairs that are compared in one step.
HELD, STEP = 1 << 16, 1 << 18
#: Occurrences beyond which a word is split by set size; classes beyond which a run is led by its earliest.
HOT, LONG, LEADERS = 1 << 14, 1 << 12, 64
#: Classes that a task remembers having sent.
REMEMBERED = 1 << 16
#: Lines that are sorted together: their number and a word's hash fill 64 bits.
LINE_BITS = 12
WORD_BITS, RANK_BITS = 64 - LINE_BITS, 16
WORD_MASK = ts.U((1 << WORD_BITS) - 1)


class Lines:
    """How lines become sets: threshold (percent) and least number of distinct words."""

    def __init__(self, percent: int, min_words: int):
        self.shape, self.percent, self.min_words = Shape(percent), percent, min_words

    def sets(self, data: np.ndarray, offsets: np.ndarray):
        """Row, line number, bounds and sorted distinct word hashes of the lines that count."""
        data = ts.LOWER[data]
        starts, ends, rows = ts.runs(ts.SPACED[data], offsets)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, ts.U)
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        place = breaks[starts] + rows
        fresh = np.concatenate([[True], place[1:] != place[:-1]])
        first, line_of = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        line_rows = rows[first]
        number = breaks[starts[first]] - breaks[offsets[line_rows]]
        sizes, values = _sorted_sets(line_of, ts.Hasher(data)(starts, ends) >> ts.U(LINE_BITS), first)
        if self.min_words > 1:
            keep = sizes >= self.min_words
            line_rows, number, values, sizes = line_rows[keep], number[keep], values[np.repeat(keep, sizes)], sizes[keep]
        return line_rows, number, np.concatenate([[0], np.cumsum(sizes)]), values

    def spare(self, n):
        """Words that a line of n words need not share."""
        return n * (100 - self.percent) // 100


def _in_blocks(line_of: np.ndarray, values: np.ndarray, first: np.ndarray):
    """Sorted values of WORD_BITS bits in each line: blocks of (line in the block, value) and the block's first line."""
    for at in range(0, len(first), 1 << LINE_BITS):
        a = first[at]
        b = first[at + (1 << LINE_BITS)] if at + (1 << LINE_BITS) < len(first) else len(values)
        both = ((line_of[a:b] - at).astype(ts.U) << ts.U(WORD_BITS)) | values[a:b]
        both.sort()
        yield both, at


def _sorted_sets(line_of: np.ndarray, values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of distinct values of each line, and these in order."""
    sizes, parts = np.zeros(len(first), np.int64), []
    for both, at in _in_blocks(line_of, values, first):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
        counts = np.bincount((both >> ts.U(WORD_BITS)).astype(np.int64))
        sizes[at : at + len(counts)] = counts
        parts.append(both & WORD_MASK)
    return sizes, np.concatenate(parts)


def word_ranks(docs: DataFrame) -> np.ndarray:
    """The rarity of the words (of rows (text)) by counter, from 0 for one occurrence: counts of all tasks are summed in
    blocks, so a table of fixed size reaches the driver."""

    def count(batches):
        hits = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for _, _, data, offsets in ts.slices(batch.column(0)):
                data = ts.LOWER[data]
                starts, ends, _ = ts.runs(ts.SPACED[data], offsets)
                np.add.at(hits, _counter(ts.Hasher(data)(starts, ends) >> ts.U(LINE_BITS)), 1)
        for block in np.flatnonzero(hits.reshape(-1, COUNTER_BLOCK).any(axis=1)):
            part = hits[block * COUNTER_BLOCK : (block + 1) * COUNTER_BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "hits"])

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, hits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.setdefault(block, np.zeros(COUNTER_BLOCK, np.int64))
                sums[block] += np.frombuffer(hits, np.uint32)
        for block, hits in sums.items():
            ranks = np.minimum(256 * np.log2(np.maximum(hits, 1)), (1 << RANK_BITS) - 1).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([ranks.tobytes()], pa.binary())], ["block", "ranks"])

    ranks = np.zeros(COUNTERS, np.uint16)
    counted = docs.select("text").mapInArrow(count, "block int, hits binary").repartition("block").mapInArrow(total, "block int, ranks binary")
    for r in counted.collect():  # COUNTERS / COUNTER_BLOCK rows at most
        ranks[r["block"] * COUNTER_BLOCK : (r["block"] + 1) * COUNTER_BLOCK] = np.frombuffer(r["ranks"], np.uint16)
    return ranks


def _counter(values: np.ndarray) -> np.ndarray:
    return (values & ts.U(COUNTERS - 1)).astype(np.int64)


class Remembered:
    """The classes that a task has sent, with the place of the earliest line; forgets classes of one slot, never errs."""

    def __init__(self):
        self.names, self.early = np.zeros(REMEMBERED, np.int64), np.zeros(REMEMBERED, np.int64)

    def fresh(self, names: np.ndarray, early: np.ndarray) -> np.ndarray:
        slot = names & (REMEMBERED - 1)
        new = (self.names[slot] != names) | (self.early[slot] > early)
        self.names[slot[new]], self.early[slot[new]] = names[new], early[new]
        return new


def _named(docs: DataFrame, how: Lines, ranks: np.ndarray) -> DataFrame:
    """(id, h, line, class, early, n, bits, more_bits, sent) of each line of rows (id, h, early, text). ``sent``: the keys
    of its rare words in order (0 for a word without another line), then further ones of split words; null where the task
    has sent the class of an earlier line, or where none but an equal set can be similar."""
    kind = docs.schema["id"].dataType.simpleString()
    spread = docs.sparkSession.sparkContext.broadcast(ranks)
    hot = int(256 * np.log2(HOT))

    def run(batches):
        ranks, known = spread.value, Remembered()
        for batch in batches:
            for start, end, data, offsets in ts.slices(batch.column(3)):
                rows, number, bounds, values = how.sets(data, offsets)
                if not len(rows):
                    continue
                sizes, names = np.diff(bounds), class_ids(bounds, values).view(np.int64)
                take = pa.array(rows)
                early = batch.column(2).slice(start, end - start).to_numpy()[rows]
                new = (how.shape.largest(sizes) > sizes) & known.fresh(names, early)
                spot = ts.mix(values)
                bit, high = ts.U(1) << (spot & ts.U(63)), (spot & ts.U(64)) > 0
                bits, more_bits = (np.bitwise_xor.reduceat(np.where(half, bit, ts.U(0)), bounds[:-1]).view(np.int64) for half in (~high, high))
                pick, picked = np.repeat(new, sizes), sizes[new]
                lists, ends = _sent(how, values[pick], picked, ranks, hot) if len(picked) else (np.zeros(0, ts.U), np.zeros(0, np.int64))
                upto = np.zeros(len(sizes) + 1, np.int64)
                upto[1:][new] = np.diff(np.concatenate([[0], ends]))
                sent = pa.ListArray.from_arrays(pa.array(np.cumsum(upto), pa.int32()), pa.array(lists.view(np.int64)), mask=pa.array(~new))
                ids, hashes = (batch.column(i).slice(start, end - start).take(take) for i in (0, 1))
                numbers = [pa.array(x) for x in (number, names, early, sizes.astype(np.int32), bits, more_bits)]
                yield pa.RecordBatch.from_arrays([ids, hashes, *numbers, sent], ["id", "h", "line", "class", "early", "n", "bits", "more_bits", "sent"])

    return docs.mapInArrow(run, f"id {kind}, h long, line long, class long, early long, n int, bits long, more_bits long, sent array<long>")


def _sent(how: Lines, values: np.ndarray, sizes: np.ndarray, ranks: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of some lines, and the end of each line's."""
    first = np.cumsum(sizes) - sizes
    line_of = np.repeat(np.arange(len(sizes)), sizes)
    rank = ranks[_counter(values)].astype(ts.U)
    ordered = (rank << ts.U(WORD_BITS - RANK_BITS)) | (values >> ts.U(RANK_BITS))  # a function of the word alone
    ordered = np.concatenate([both & WORD_MASK for both, _ in _in_blocks(line_of, ordered, first)])
    keep = np.arange(len(values)) - first[line_of] <= how.spare(sizes)[line_of]
    word, line = ordered[keep], line_of[keep]
    rank = (word >> ts.U(WORD_BITS - RANK_BITS)).astype(np.int64)
    key = np.where(rank > 0, ts.mix(word), ts.U(0))
    split = np.flatnonzero(rank > hot)
    if not len(split):
        return key, np.cumsum(np.bincount(line, minlength=len(sizes)))
    band = how.shape.bands(sizes)[line[split]].astype(ts.U)
    key[split], more = ts.mix(word[split] + ts.mix(band)), ts.mix(word[split] + ts.mix(band + ts.U(1)))
    line = np.concatenate([line, line[split]])
    order = np.argsort(line, kind="stable")  # a line's further keys come last
    return np.concatenate([key, more])[order], np.cumsum(np.bincount(line, minlength=len(sizes)))


def _keys(named: DataFrame, how: Lines) -> DataFrame:
    """(key, n, place, bits, more_bits, early, class): a row for each key that a line sends. Of a further key the place is
    not known; 0 keeps the positional filter right."""
    columns = ["n", "bits", "more_bits", "early", "class"]
    rows = named.where("sent is not null").select(*columns, F.posexplode("sent").alias("at", "key")).where("key <> 0")
    place = F.when(F.col("at") <= F.expr(f"n * {100 - how.percent} div 100"), F.col("at")).otherwise(0)
    return rows.select("key", "n", place.alias("place"), *columns[1:])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Hamming distance of sketches, two words each."""
    return np.bitwise_count(a[0] ^ b[0]) + np.bitwise_count(a[1] ^ b[1])


def _once(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Rows in order of their keys (first column), each class (last) of a key once, by its earliest line (the one before)."""
    order = np.lexsort((rows[5], rows[6], rows[0]))
    key, name = rows[0][order], rows[6][order]
    return [x[order[np.concatenate([[True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])])]] for x in rows]


class Run:
    """Rows of complete keys, or of a part of one, ready for comparison."""

    def __init__(self, how: Lines, rows: list[np.ndarray]):
        key, n, place, bits, more_bits, early, name = _once(rows)
        self.how = how
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        self.span = (np.cumsum(fresh) - 1) << 32  # of each key
        order = np.argsort(self.span + n, kind="stable")
        self.at = (self.span + n)[order]
        self.span, self.n, self.place, self.early, self.name = self.span[order], n[order].astype(np.int64), place[order].astype(np.int64), early[order], name[order]
        self.sketch = np.stack([bits[order], more_bits[order]]).view(ts.U)
        self.first = np.flatnonzero(fresh)
        self.length = np.diff(np.concatenate([self.first, [len(key)]]))
        self.found: list[np.ndarray] = []
        self.more = np.zeros(len(key), bool)

    def close(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the pairs, x not after y, whose places and sketches allow the similarity, and how far they are apart."""
        n1, n2, percent = self.n[x], self.n[y], self.how.percent
        reach = np.minimum(n1 - self.place[x], n2 - self.place[y])
        ok = ((100 + percent) * reach >= percent * (n1 + n2)) & (self.early[x] <= self.early[y]) & (self.name[x] != self.name[y])
        x, y, limit = x[ok], y[ok], self.how.shape.apart(n1[ok], n2[ok])
        apart = _apart(self.sketch[:, x], self.sketch[:, y])
        ok = apart <= limit
        return x[ok], y[ok], apart[ok]

    def nearest(self, x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> None:
        """Of all pairs of some y, keep the NEAREST."""
        order = np.lexsort((apart, y))
        x, y = x[order], y[order]
        rank = np.arange(len(y)) - np.searchsorted(y, y, "left")
        keep = rank < NEAREST
        self.more[y[~keep]] = True
        self.found.append(np.stack([self.name[x[keep]], self.name[y[keep]]]))

    def led(self) -> np.ndarray:
        """Compare the classes of long runs with the earliest of these; those that found a partner."""
        out = np.zeros(len(self.n), bool)
        for a, length in zip(self.first, self.length, strict=True):
            if length <= LONG:
                continue
            leaders = a + np.argsort(self.early[a : a + length], kind="stable")[:LEADERS]
            for b in range(a, a + length, STEP // LEADERS):
                mine = np.arange(b, min(b + STEP // LEADERS, a + length))
                x, y = np.tile(leaders, len(mine)), np.repeat(mine, len(leaders))
                sized = (self.n[x] * 100 >= self.n[y] * self.how.percent) & (self.n[y] * 100 >= self.n[x] * self.how.percent)
                x, y, apart = self.close(x[sized], y[sized])
                self.nearest(x, y, apart)
                out[y] = True
        self.more |= out  # others than the leaders may be similar too
        return out

    def pairs(self, whole: bool) -> pa.RecordBatch | None:
        """Candidates (a, b), ``more`` if b has partners that aren't sent. ``whole`` False: the rows are a part of one
        key's, so all its classes have more; a = b only carries that."""
        asking = np.flatnonzero(~self.led() & (np.repeat(self.length, self.length) > 1))
        low = np.searchsorted(self.at, self.span[asking] + -(-self.n[asking] * self.how.percent // 100), "left")
        counts = np.searchsorted(self.at, self.span[asking] + self.how.shape.largest(self.n[asking]), "right") - low
        ends, at = np.cumsum(counts), 0
        while at < len(asking):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
            c = counts[at:to]
            y = np.repeat(asking[at:to], c)
            x = np.arange(len(y)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[at:to], c)
            self.nearest(*self.close(x, y))
            at = to
        if not whole:
            self.more[:] = True
        more = self.name[self.more]
        a, b = np.concatenate([*self.found, np.stack([more, more])], axis=1)
        if not len(a):
            return None
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(a == b)], ["a", "b", "more"])


def _candidates(keys: DataFrame, how: Lines) -> DataFrame:
    """Distinct (a, b, more) of classes that share a key and may be similar, a not after b; a = b carries ``more``. All
    parts of a key of more than HELD rows count as parts, the last included, as none of them sees the others."""

    def run(batches):
        held, parted = None, None

        def found(rows):
            """The pairs of some rows, of which those of the key in parts stand in front."""
            part = 0 if parted is None else int(np.searchsorted(rows[0], parted, "right"))
            for some, whole in (([x[:part] for x in rows], False), ([x[part:] for x in rows], True)):
                if len(some[0]) and (out := Run(how, some).pairs(whole)):
                    yield out

        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(7)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1], "left"))
            yield from found([x[:cut] for x in held])
            held = [x[cut:] for x in held]
            if len(held[0]) > HELD:
                held = _once(held)  # all tasks have sent the classes that are everywhere
                if len(held[0]) > HELD // 2:
                    parted = held[0][0]
                    yield from found(held)
                    held = [x[:0] for x in held]
        if held is not None:
            yield from found(held)

    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, more boolean").distinct()


def _all_partners(keys: DataFrame, asking: DataFrame, how: Lines) -> DataFrame:
    """Distinct (a, b) of the asking classes b with every class that shares a key and may be similar."""
    mine = written(sized_join(keys, asking, "class"), "asking")
    other = mine.withColumnsRenamed({c: f"{c}_" for c in mine.columns if c != "key"})
    n, n_, percent = F.col("n"), F.col("n_"), how.percent
    reach = (100 + percent) * F.least(n - F.col("place"), n_ - F.col("place_")) >= percent * (n + n_)
    apart = F.bit_count(F.col("bits").bitwiseXOR(F.col("bits_"))) + F.bit_count(F.col("more_bits").bitwiseXOR(F.col("more_bits_")))
    close = (n * 100 >= n_ * percent) & (n_ * 100 >= n * percent) & reach & (apart <= F.expr(f"((n + n_) * {100 - percent}) div {100 + percent}"))
    pairs = keys.join(other, "key").where(close & (F.col("early") <= F.col("early_")) & (F.col("class") != F.col("class_")))
    return pairs.select(F.col("class").alias("a"), F.col("class_").alias("b")).distinct()


def _sets(docs: DataFrame, wanted: DataFrame, how: Lines) -> DataFrame:
    """(class, set) of the wanted classes (class, id, h, line): only their first lines are cut into words again."""
    asked = written(wanted.groupBy("id", "h").agg(F.collect_list(F.struct("line", "class")).alias("asked")), "asked")  # of one document's lines
    found = sized_join(docs.select("id", "h", "text"), asked, ["id", "h"]).withColumn("lines", F.split("text", "\n"))
    found = found.select(F.explode(F.expr("transform(asked, x -> struct(x.class as class, element_at(lines, cast(x.line as int) + 1) as text))")).alias("x")).select("x.class", "x.text")

    def run(batches):
        for batch in batches:
            for start, end, data, offsets in ts.slices(batch.column(1)):
                rows, _, bounds, values = how.sets(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start).take(pa.array(rows)), lists], ["class", "set"])

    return found.mapInArrow(run, "class long, set array<long>")


def _linked(near: DataFrame, docs: DataFrame, classes: DataFrame, how: Lines) -> DataFrame:
    """The pairs (a, b) that are similar, by their whole sets."""
    wanted = near.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(classes, "class")
    sets = written(_sets(docs, wanted, how), "sets")
    both = near.join(sets.withColumnsRenamed({"class": "b", "set": "sb"}), "b").join(sets.withColumnsRenamed({"class": "a", "set": "sa"}), "a").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            sizes = [np.diff(np.asarray(x.offsets)) for x in (a, b)]
            row = np.concatenate([np.repeat(np.arange(batch.num_rows), n) for n in sizes])
            words = np.concatenate([x.flatten().to_numpy() for x in (a, b)])
            order = np.lexsort((words, row))
            row, words = row[order], words[order]
            shared = np.bincount(row[1:][(row[1:] == row[:-1]) & (words[1:] == words[:-1])], minlength=batch.num_rows)
            keep = 100 * shared >= how.percent * (sizes[0] + sizes[1] - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    links = written(both.mapInArrow(run, "a long, b long"), "links")
    discard(sets)
    return links


def _later(links: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes whose first line comes after that of a similar class."""
    place = classes.select("class", F.struct("id", "h", "line").alias("at"))
    a, b = (place.withColumnsRenamed({"class": c, "at": f"at_{c}"}) for c in ("a", "b"))
    return links.join(a, "a").join(b, "b").select(F.when(F.col("at_a") < F.col("at_b"), F.col("b")).otherwise(F.col("a")).alias("class")).distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, min_words: int = 1) -> DataFrame:
    """(id, h, lines): the numbers (from 0) of the lines that go, for each document that loses any; ``h`` is the xxhash64 of
    its text. Lines of fewer than ``min_words`` distinct words are left alone."""
    how = Lines(percent, min_words)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    numeric = rows.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long")
    # a bound on which lines can be earlier: documents of one value count as earlier than each other
    early = F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63))) if numeric else F.lit(0).cast("long")
    rows = rows.select("id", F.xxhash64("text").alias("h"), early.alias("early"), "text")
    named = written(_named(rows, how, word_ranks(rows)), "lines")
    lines = named.select("id", "h", "line", "class")
    classes = lines.groupBy("class").agg(F.min(F.struct("id", "h", "line")).alias("at"))
    classes = written(classes.select("class", "at.id", "at.h", "at.line"), "classes")
    keys = _keys(named, how)
    pairs = written(_candidates(keys, how), "pairs")
    gone = written(_later(_linked(pairs.where("a <> b").select("a", "b"), rows, classes, how), classes), "gone")
    asking = written(pairs.where("more").select(F.col("b").alias("class")).distinct().join(gone, "class", "left_anti"), "asking")
    if not asking.isEmpty():
        near = written(_all_partners(keys, asking, how).join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "near")
        gone = written(gone.unionAll(_later(_linked(near, rows, classes, how), classes)).distinct(), "gone")
    firsts = classes.select("class", F.struct("id", "h", "line").alias("first"))
    judged = lines.join(firsts, "class").join(gone.select("class", F.lit(True).alias("gone")), "class", "left")
    bad = judged.where(F.col("gone").isNotNull() | (F.struct("id", "h", "line") != F.col("first")))
    out = written(bad.groupBy("id", "h").agg(F.array_sort(F.collect_set("line")).alias("lines")), "removed")
    discard(named, classes, pairs, gone, asking)
    return out.withColumnRenamed("id", id_col)


def without_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, min_words: int = 1, drop_emptied: bool = False) -> DataFrame:
    """The documents with their lines removed; columns and rows of ``docs``, other texts unchanged. ``drop_emptied``: a
    document that has lost lines and has no word left goes."""
    gone = removed_lines(docs, id_col, text_col, percent, min_words).toDF("id", "h", "lines")
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    rows = docs.toDF(*names).withColumns({"id": key, "h": F.xxhash64(text.cast("string"))})
    joined = sized_join(rows, written(gone, "removed"), ["id", "h"], "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("lines", i.cast("long"))), "\n")
    text_name = names[docs.columns.index(text_col)]
    out = joined.withColumn(text_name, F.when(F.col("lines").isNull(), text).otherwise(kept))
    if drop_emptied:
        out = out.where(F.col("lines").isNull() | F.col(text_name).rlike(r"[^\x20\x09-\x0D]"))
    return out.select(names).toDF(*docs.columns)
