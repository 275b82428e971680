"""Operator 11: words grouped with their spelling variants, by pivotal grams.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, of which only A-Z become a-z. Two words are near if one inserted,
deleted or replaced code point turns one into the other. A word's form is its near word of largest count (of equals the
smallest in code-point order) if that count is ``ratio`` times its own or more; its root is the last word of its forms.

Near words are found by an exact join. The bigrams of a word are ordered by rarity in the vocabulary; its prefix is the
first three of them with all places of the third. One edit spoils only one of two disjoint bigrams, so two of the prefix,
chosen by dynamic programming to be disjoint and as rare as can be, are the word's pivots: of two near words, one has a
pivot that the edit leaves alone and that stands in the other's prefix. The edit is to the left or to the right of it, so
the pivot has the same place there from one end of the word, and all letters from that end on are the same; of the other
side, cut into halves, one half is the same too. Pivots meet prefixes by the bigram, its place from that end and these
letters, for lengths that differ by one at most. What meets is verified in the join.
Texts are counted in tasks, by document and by part of a table, before anything is shuffled; a word of a third of all
occurrences is one row of each part. The bigrams number at most 90 x 90, so their ranks go to all tasks.

Null text: no words. A null id counts as an empty one. Repeated rows count each. No words, or an empty table: no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.durable import discard, written

#: A run of letters in UTF-8 after A-Z became a-z. U+00C0 to U+00FF are the byte C3 and one that follows.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Words that a task counts before it sends them on.
HELD = 200_000


def _points(word: bytes) -> int:
    return len(word) - word.count(b"\xc3")


def slipped(word: bytes, check: int) -> bytes:
    """The word without its code point number ``check`` modulo its length."""
    text = word.decode()
    at = check % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, slip_every: int | None = None) -> DataFrame:
    """(word, n): the occurrences of each word of ``least_length`` code points or more. With ``slip_every``, a word of a
    document whose crc32 of ``<id>:<word>`` it divides is misspelled first: it loses the code point of that number modulo
    its length."""

    def run(batches):
        held: Counter[bytes] = Counter()

        def sent():
            words = [w for w in held if _points(w) >= least_length]
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                start = zlib.crc32(b"%s:" % (name or "").encode())
                for word, n in Counter(LETTERS.findall((text or b"").lower())).items():
                    if slip_every:
                        check = zlib.crc32(word, start)
                        if check % slip_every == 0:
                            word = slipped(word, check)
                    held[word] += n
                if len(held) > HELD:
                    yield sent()
                    held.clear()
        yield sent()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pivotal(entries: list[tuple[int, int]], k: int = 2) -> list[int]:
    """Of (place, weight) in order of places, the indices of ``k`` bigrams that share no letter and weigh least together."""
    best: list[list[tuple[int, list[int]] | None]] = [[(0, [])] * (len(entries) + 1)]
    for _ in range(k):
        row: list[tuple[int, list[int]] | None] = [None]
        for i, (place, weight) in enumerate(entries):
            free = sum(p <= place - 2 for p, _ in entries[:i])
            before = best[-1][free]
            taken = None if before is None else (before[0] + weight, [*before[1], i])
            row.append(min((x for x in (row[-1], taken) if x is not None), default=None))
        best.append(row)
    return best[-1][-1][1]


def prefix_and_pivots(word: str, ranks: dict[str, tuple[int, int]]) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """(bigram, place) of the word's prefix and of its two pivots. ``ranks``: rank and count of each bigram."""
    grams = sorted((ranks[word[i : i + 2]][0], i) for i in range(len(word) - 1))
    last = grams[min(2, len(grams) - 1)][0]
    places = sorted(i for rank, i in grams if rank <= last)
    chosen = pivotal([(i, ranks[word[i : i + 2]][1]) for i in places])
    return [(word[i : i + 2], i) for i in places], [(word[places[c] : places[c] + 2], places[c]) for c in chosen]


def asked_keys(word: str, place: int) -> list[str]:
    """The four keys of a pivot. The edit is to its right or to its left; the rest of the word on that side is cut into
    halves, of which the edit leaves one alone."""
    after, before = place + 2 + (len(word) - place - 2) // 2, place // 2
    return ["1" + word[:after], f"2{word[: place + 2]}|{word[after:]}", f"3{word[:before]}|{word[place:]}", "4" + word[before:]]


def indexed_keys(word: str, place: int) -> set[str]:
    """The keys under which pivots of near words, one letter shorter, as long or one longer, ask for a bigram of a prefix."""
    size, out = len(word), set()
    for asking in (size - 1, size, size + 1):
        rest = asking - place - 2
        if rest >= 0 and place + 2 + rest // 2 <= size:
            out.add("1" + word[: place + 2 + rest // 2])
        if 0 <= rest - rest // 2 <= size - place - 2:
            out.add(f"2{word[: place + 2]}|{word[size - (rest - rest // 2) :]}")
        there = place + asking - size  # the place of the pivot, as far from the end
        if there >= 0:
            out.add(f"3{word[: there // 2]}|{word[place:]}")
            if asking - there // 2 <= size:
                out.add("4" + word[size - (asking - there // 2) :])
    return out


def gram_entries(words: DataFrame) -> DataFrame:
    """(word, n, pivot, key): the keys of the pivots, and of the bigrams of the prefix, of ``words`` (word, n), which are
    distinct and have four code points or more. Keys are hashes; what they bring together is verified."""
    grams = words.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("gram"))
    counted = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "gram").collect()  # of 90 x 90 at most
    ranks = {r["gram"]: (i, r["n"]) for i, r in enumerate(counted)}

    def run(batches):
        for batch in batches:
            asks, index = [], []
            for word in batch.column(0).to_pylist():
                prefix, pivots = prefix_and_pivots(word, ranks)
                asks.append([key for _, place in pivots for key in asked_keys(word, place)])
                index.append(sorted({key for _, place in prefix for key in indexed_keys(word, place)}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(asks, pa.list_(pa.string())), pa.array(index, pa.list_(pa.string()))], ["word", "n", "asks", "index"])

    made = words.select("word", "n").mapInArrow(run, "word string, n long, asks array<string>, index array<string>")
    asks = F.transform("asks", lambda key: F.struct(F.lit(True).alias("pivot"), F.xxhash64(key).alias("key")))
    index = F.transform("index", lambda key: F.struct(F.lit(False).alias("pivot"), F.xxhash64(key).alias("key")))
    return made.select("word", "n", F.inline(F.concat(asks, index)))


def near_words(entries: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b), a < b: all pairs of near words, from their :func:`gram_entries`."""
    index = entries.where("not pivot").select(F.col("word").alias("other"), F.col("n").alias("n_other"), F.col("key").alias("k"))
    near = (F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1)
    met = entries.where("pivot").join(index, (F.col("key") == F.col("k")) & near)
    first, a, b = F.col("word") < F.col("other"), F.struct("word", "n"), F.struct(F.col("other").alias("word"), F.col("n_other").alias("n"))
    pairs = met.select(F.when(first, a).otherwise(b).alias("x"), F.when(first, b).otherwise(a).alias("y"))
    return pairs.select(F.col("x.word").alias("a"), F.col("x.n").alias("n_a"), F.col("y.word").alias("b"), F.col("y.n").alias("n_b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each (word, form): the last of its forms, by doubling; counts grow along the forms, so there are no
    circles and few rounds. Each round is written to the shared folder."""
    state = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(state.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")), "roots")
        discard(state)
        more, state = not moved.where("more").isEmpty(), moved
        if not more:
            return state.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, ratio: int = 5, slip_every: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``least_length`` code points and ``least_count`` occurrences
    or more; form and form_n are null where no near word is ``ratio`` times as frequent."""
    if least_length < 4:
        raise ValueError("words of fewer than four code points have no three bigrams")
    words = written(word_counts(docs, id_col, text_col, least_length, slip_every).where(F.col("n") >= least_count), "words")
    entries = written(gram_entries(words), "grams")
    pairs = near_words(entries)
    both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = words.join(best, "word", "left")
    large = -F.col("best.less") >= ratio * F.col("n")
    named = written(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n")), "forms")
    discard(entries, words)
    last = roots(named.where("form is not null"))
    out = named.join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
