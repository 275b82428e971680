"""Operator 13: the tokens of two tokenizers over the same texts, aligned by bytes.

A text with a blank before it is encoded by a byte-level BPE (A) and by a sentence-piece model (B, which adds the blank
itself). For a batch of documents the tokens of both sides stand in two pandas frames; ``merge_asof``, keyed by document,
finds for the start of each token the other side's token that covers it. Both directions together give all overlaps.
A token that starts where its covering token starts begins a group: up to there, tokens of both sides end at one byte.
All A and B tokens of a group are linked.

Links are counted over the corpus by (A id, B id): in how many documents a pair is linked. Tokens are found once; each
document's pairs with their multiplicity are written, one number a pair. The most frequent pairs, COUNTS of them at most,
and their counts are sent to all tasks; pairs beyond those are joined by a shuffle, in which none is frequent.

Tokens never cross the place before a blank or line end that follows a visible character, so texts are encoded by such
pieces, and a task encodes a piece that it knows only once. Whether this holds for a model is tested on its vocabulary.
Special tokens of either tokenizer inside texts are plain text.

Null or empty texts, and texts that a side's tokens don't give back byte for byte, have no tokens: zeros and an empty
digest. Repeated rows and rows without an id are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.durable import discard, written

FOLDER = "/opt/tokenizers"
BYTE_LEVEL, PIECES = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
#: A piece that may be encoded alone: a blank or line end, white space, then all up to the next of these two after a
#: visible character.
PIECE = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")
#: Encoded pieces that a task keeps, and bytes of text that it aligns at once.
KEPT, SLICE = 300_000, 1 << 20
#: Links that are made at once.
LINKS = 1 << 21
#: Pairs whose counts are sent to all tasks: 16 bytes each.
COUNTS = 1 << 20


def byte_level_decoder() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the others, in order, for
    the characters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A: ids of pieces, and the bytes of each id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        bytes_of = byte_level_decoder()
        vocabulary = json.loads(self.model.to_str())["model"]["vocab"]
        self.table = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.table[i] = bytes(bytes_of[c] for c in token) if all(c in bytes_of for c in token) else token.encode()

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(pieces, add_special_tokens=False)]


class Pieces:
    """Tokenizer B, which puts a blank before what it encodes: ids of pieces that begin with a blank or line end."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.table = [bytes([int(n[3:5], 16)]) if m.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        # no entry goes on after a word has ended, so what is encoded piece by piece is encoded alike in one go
        if any(re.search("[^▁]▁|.\n|\n.", n, re.S) for n in names):
            raise ValueError("this model has entries that cross words")
        self.blank = m.piece_to_id("▁")

    def encode(self, pieces: list[str]) -> list[list[int]]:
        out = self.model.encode([p[1:] if p[0] == " " else p for p in pieces], out_type=int, num_threads=1)
        for p, ids in zip(pieces, out, strict=True):
            if p == " ":  # the model gives no tokens for an empty text, not even the blank
                ids.append(self.blank)
            elif p[0] != " ":
                if ids[:1] != [self.blank]:
                    raise ValueError("a line end joins the blank before it")
                del ids[0]
        return out


class Side:
    """The ids of all pieces that a task has seen, one after the other."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.sizes = np.array([len(b) for b in tokenizer.table], np.int64)
        self.clear()

    def clear(self) -> None:
        self.ids, self.first, self.exact = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool)

    def add(self, pieces: list[str]) -> None:
        found = self.tokenizer.encode(pieces)
        table = self.tokenizer.table
        self.exact = np.concatenate([self.exact, [b"".join([table[i] for i in ids]) == p.encode() for p, ids in zip(pieces, found, strict=True)]])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(ids) for ids in found])])
        self.ids = np.concatenate([self.ids, np.fromiter((i for ids in found for i in ids), np.int32)])

    def tokens(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these pieces, and how many each has."""
        sizes = self.first[numbers + 1] - self.first[numbers]
        end = np.cumsum(sizes)
        return self.ids[np.repeat(self.first[numbers] - end + sizes, sizes) + np.arange(end[-1] if len(end) else 0)], sizes


class Encoder:
    """Encodes lists of texts by both sides."""

    def __init__(self, a: str, b: str):
        self.sides = Side(ByteLevel(a)), Side(Pieces(b))
        self.known: dict[str, int] = {}

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side the ids of all texts, and how many each text has; none where a side doesn't give the text back."""
        if len(self.known) > KEPT:
            self.known.clear()
            for side in self.sides:
                side.clear()
        pieces = [PIECE.findall(" " + t) for t in texts]
        new = list(dict.fromkeys(p for ps in pieces for p in ps if p not in self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            for side in self.sides:
                side.add(new)
        known = self.known
        numbers = np.array([known[p] for ps in pieces for p in ps], np.int64)
        bounds = np.cumsum([0, *map(len, pieces)])
        exact = np.ones(len(texts), bool)
        for side in self.sides:
            for t in np.unique(np.searchsorted(bounds, np.flatnonzero(~side.exact[numbers]), "right") - 1).tolist():
                whole = side.tokens(numbers[bounds[t] : bounds[t + 1]])[0]
                exact[t] &= b"".join([side.tokenizer.table[i] for i in whole.tolist()]) == (" " + texts[t]).encode()
        keep = np.repeat(exact, np.diff(bounds))
        numbers, owner = numbers[keep], np.repeat(np.arange(len(texts)), np.diff(bounds))[keep]
        out = []
        for side in self.sides:
            ids, sizes = side.tokens(numbers)
            out.append((ids, np.bincount(owner, sizes, len(texts)).astype(np.int64)))
        return out


def covering(doc: tuple[np.ndarray, np.ndarray], start: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For the start of each token of a side, the other side's token that covers it. ``start`` grows over all documents."""
    frames = [pd.DataFrame({"at": s, "doc": d, f"token{i}": np.arange(len(s))}) for i, (d, s) in enumerate(zip(doc, start, strict=True))]
    there = pd.merge_asof(frames[0], frames[1], on="at", by="doc")["token1"]
    back = pd.merge_asof(frames[1], frames[0], on="at", by="doc")["token0"]
    return there.to_numpy(np.int64), back.to_numpy(np.int64)


def overlaps(there: np.ndarray, back: np.ndarray) -> np.ndarray:
    """(A token, B token), each once: tokens that share a byte. Of two such, the one that starts later, or either where both
    start together, starts inside the other."""
    pairs = np.concatenate([np.stack([np.arange(len(there)), there], 1), np.stack([back, np.arange(len(back))], 1)])
    return np.unique(pairs, axis=0)


class Aligned:
    """Groups of the tokens of some documents."""

    def __init__(self, encoded: list[tuple[np.ndarray, np.ndarray]], sizes: tuple[np.ndarray, np.ndarray]):
        self.ids = tuple(ids for ids, _ in encoded)
        self.counts = tuple(n for _, n in encoded)
        self.doc = tuple(np.repeat(np.arange(len(n)), n) for n in self.counts)
        ends = tuple(np.cumsum(size[ids]) for ids, size in zip(self.ids, sizes, strict=True))
        self.start = tuple(end - size[ids] for end, ids, size in zip(ends, self.ids, sizes, strict=True))
        self.there, self.back = covering(self.doc, self.start)
        begins = self.start[1][self.there] == self.start[0], self.start[0][self.back] == self.start[1]
        self.group = tuple(np.cumsum(b) - 1 for b in begins)
        self.first = tuple(np.flatnonzero(b) for b in begins)
        self.members = tuple(np.diff(np.append(f, len(ids))) for f, ids in zip(self.first, self.ids, strict=True))
        self.group_doc = self.doc[0][self.first[0]]

    def text(self) -> tuple[np.ndarray, np.ndarray]:
        """The groups of all documents as bytes (``a1,a2|b1;a3|b2``), and where each document begins."""
        n = len(self.ids[0]), len(self.ids[1])
        at = np.arange(n[0]) + self.first[1][self.group[0]], np.arange(n[1]) + np.append(self.first[0], n[0])[self.group[1] + 1]
        ids, mark, doc = np.zeros(sum(n), np.int64), np.full(sum(n), ord(","), np.uint8), np.zeros(sum(n), np.int64)
        for side in (0, 1):
            ids[at[side]], doc[at[side]] = self.ids[side], self.doc[side]
            mark[at[side][np.append(self.first[side], n[side])[1:] - 1]] = ord("|;"[side])
        digits = 1
        while len(ids) and ids.max() >= 10**digits:
            digits += 1
        cells = np.zeros((len(ids), digits + 1), np.uint8)
        for d in range(digits):
            cells[:, digits - 1 - d] = ids // 10**d % 10 + 48
        cells[:, digits] = mark
        used = np.ones(cells.shape, bool)
        for d in range(1, digits):
            used[:, digits - 1 - d] = ids >= 10**d
        length = np.bincount(doc, used.sum(1), len(self.counts[0])).astype(np.int64)
        return cells[used], np.concatenate([[0], np.cumsum(length)])

    def links(self, shift: int):
        """(document, pair, multiplicity) of the linked ids, a pair being the A id times 2**``shift`` plus the B id; a pair of a
        document comes several times only where its links are too many to be made at once. Ids that a large group has
        several times are counted first, so it gives a row for each pair of different ids."""
        sizes = self.members[0] * self.members[1]
        weigh = [np.ones(len(ids), np.int64) for ids in self.ids]
        ids, first, members = list(self.ids), list(self.first), list(self.members)
        if len(sizes) and sizes.max() > 1024:
            for side in (0, 1):
                key = self.group[side].astype(np.int64) << 32 | ids[side]
                unique, weigh[side] = np.unique(key, return_counts=True)
                ids[side], group = unique & 0xFFFFFFFF, unique >> 32
                first[side] = np.searchsorted(group, np.arange(len(sizes)))
                members[side] = np.diff(np.append(first[side], len(group)))
            sizes = members[0] * members[1]
        end = np.cumsum(sizes)
        for low in range(0, int(end[-1]) if len(end) else 0, LINKS):
            k = np.arange(low, min(low + LINKS, int(end[-1])))
            g = np.searchsorted(end, k, "right")
            k -= end[g] - sizes[g]
            a, b = first[0][g] + k // members[1][g], first[1][g] + k % members[1][g]
            key = self.group_doc[g] << 40 | ids[0][a].astype(np.int64) << shift | ids[1][b]
            order = np.argsort(key)
            key, times = key[order], (weigh[0][a] * weigh[1][b])[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            yield key[at] >> 40, key[at] & (1 << 40) - 1, np.add.reduceat(times, at)


DOCUMENT = "row long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = BYTE_LEVEL, b: str = PIECES, shift: int = 15) -> DataFrame:
    """(id, row, n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, pairs, times) of each document. ``shift``: the
    number of bits of B's ids. The paths are read by the tasks."""
    names = [part.split()[0] for part in DOCUMENT.split(", ")]

    def run(batches):
        encoder = Encoder(a, b)
        if len(encoder.sides[1].sizes) > 1 << shift or len(encoder.sides[0].sizes) > 1 << 40 - shift:
            raise ValueError("a vocabulary is too large")
        for batch in batches:
            texts = batch.column(2).to_pylist()
            low = size = 0
            for i, text in enumerate(texts):
                size += len(text or "")
                if size > SLICE or i + 1 == len(texts):
                    yield made(encoder, batch.slice(low, i + 1 - low), texts[low : i + 1])
                    low, size = i + 1, 0

    def made(encoder, batch, texts):
        real = [i for i, t in enumerate(texts) if t]
        found = Aligned(encoder.encode([texts[i] for i in real]), tuple(s.sizes for s in encoder.sides))
        n = len(real)
        text, bounds = found.text()
        digests = [hashlib.sha256(text[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        n_groups = np.bincount(found.group_doc, minlength=n)
        n_links = np.bincount(found.group_doc, found.members[0] * found.members[1], n).astype(np.int64)
        n_overlaps = found.counts[0] + found.counts[1] - n_groups
        parts = list(found.links(shift)) or [(np.zeros(0, np.int64),) * 3]
        doc, pair, times = (np.concatenate([p[i] for p in parts]) for i in range(3))
        if len(parts) > 1:
            order = np.lexsort([pair, doc])
            doc, pair, times = doc[order], pair[order], times[order]
            at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])]))
            doc, pair, times = doc[at], pair[at], np.add.reduceat(times, at)
        place = np.zeros(len(texts), np.int64)
        place[real] = np.arange(1, n + 1)
        per = np.zeros(len(texts), np.int64)
        per[real] = np.bincount(doc, minlength=n)
        lists = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
        columns = [pa.array(np.concatenate([[0], c])[place], pa.int64()) for c in (*found.counts, n_groups, n_links, n_overlaps)]
        columns += [pa.array([["", *digests][k] for k in place.tolist()], pa.string())]
        columns += [pa.ListArray.from_arrays(pa.array(lists), pa.array(c, pa.int64())) for c in (pair, times)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {DOCUMENT}").withColumnRenamed("id", id_col)


def pair_counts(documents: DataFrame, shift: int = 15) -> DataFrame:
    """(pair, n, best), written: the number of documents with each pair, and whether no pair of its A id has more. There is one row of
    A ids for each entry of A's vocabulary at most."""
    counts = documents.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.withColumn("a", F.shiftright("pair", shift)), "pair_counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    out = written(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    discard(counts)
    return out


def scored(documents: DataFrame, counts: DataFrame, limit: int = COUNTS) -> DataFrame:
    """``documents`` (written, from :func:`aligned`) with n_best and count_sum. ``counts``: written, from :func:`pair_counts`."""
    spark = documents.sparkSession
    common = counts.orderBy(F.desc("n"), "pair").limit(limit) if (beyond := counts.count() > limit) else counts
    table = common.select("pair", "n", "best").toPandas().sort_values("pair")  # at most ``limit`` rows
    sent = spark.sparkContext.broadcast((table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.int64), table["best"].to_numpy(bool)))
    kept = [c for c in documents.columns if c not in ("pairs", "times")]

    def looked_up(batch):
        key, n, best = sent.value
        lists, times = batch.column(batch.schema.get_field_index("pairs")), batch.column(batch.schema.get_field_index("times")).flatten().to_numpy()
        pair = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        at = np.minimum(np.searchsorted(key, pair), len(key) - 1) if len(key) else np.zeros(len(pair), np.int64)
        known = key[at] == pair if len(key) else np.zeros(len(pair), bool)
        return n, best, pair, times, owner, at, known

    def near(batches):
        for batch in batches:
            n, best, pair, times, owner, at, known = looked_up(batch)
            rows = batch.num_rows
            n_best, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            np.add.at(n_best, owner[known], times[known] * best[at[known]])
            np.add.at(total, owner[known], times[known] * n[at[known]])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(n_best), pa.array(total)], [*kept, "n_best", "count_sum"])

    def far(batches):
        for batch in batches:
            _, _, pair, times, owner, _, known = looked_up(batch)
            row = batch.column(batch.schema.get_field_index("row")).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(row[owner[~known]]), pa.array(pair[~known]), pa.array(times[~known])], ["row", "pair", "times"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(kept).schema)
    out = documents.mapInArrow(near, f"{fields}, n_best long, count_sum long")
    if not beyond:
        return out.drop("row")
    rest = documents.select("row", "pairs", "times").mapInArrow(far, "row long, pair long, times long").join(counts, "pair")
    more = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("times") * F.col("n")).alias("c"))
    out = out.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("c", F.lit(0))})
    return out.drop("row", "b", "c")


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = BYTE_LEVEL, b: str = PIECES, limit: int = COUNTS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, n_best, count_sum) of each document."""
    documents = written(aligned(docs, id_col, text_col, a, b), "aligned")
    return scored(documents, pair_counts(documents), limit)
