"""Plain Python forms of the corpus operators, and documents that hold their edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACED = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
LONG = " ".join(f"word{i % 7919}é" for i in range(60_000))
SENTENCE = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark green wood today"
#: (doc_id, text, lang, source, n_chars) and columns whose names clash with those of the operators.
EDGES = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t\n ", "en", "a"), (4, "one", "en", None), (5, LONG, "en", "a"), (6, SENTENCE, "en", "a"), (6, SENTENCE, "en", "a"), (7, SENTENCE, "en", "b"),
    (8, SENTENCE.replace("fox", "cat"), "en", "b"), (9, "!!! ### $$$ %%%", "de", "b"), (10, "Ünïcödé \U0001f600 İstanbul ﬁne space naïve", "de", "b"), (11, "a\n\n\nb\nA B\n", None, "b"), (12, "\x00\x01 nul", "en", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string, class long, id string, score string, lang_pred string, `component_id` int, n int, `group` int, shard int, lines int, h int"


def edges(spark):
    rows = [(*r, len(r[1] or ""), -1, "x", 1, "y", "z", "q", 5, 6, 7, 8, 9, 10) for r in EDGES]
    return spark.createDataFrame(rows, SCHEMA)


def quality(text):
    """Base measures of operator 3."""
    text = text or ""
    w = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def normal(text):
    return ALNUM.findall((text or "").translate(UPPER))


def decontamination(docs, items, n=10):
    """(n_words, n_hit, n_items, digest) of each text of operator 7."""
    windows = defaultdict(set)
    for i, t in items:
        w = normal(t)
        for j in range(max(1 if w else 0, len(w) - n + 1)):
            windows[tuple(w[j : j + n])] |= set() if i is None else {str(i)}
    sizes, out = {len(k) for k in windows}, []
    for t in docs:
        w, hit, found = normal(t), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if (x := windows.get(tuple(w[k : k + m]))) is not None:
                    hit.update(range(k, k + m))
                    found |= x
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


def components(docs):
    """{id: (n_shingles, component)} of operator 8 for [(id, text)] with one text per id."""
    sets = {}
    for i, t in docs:
        w = SPACED.findall((t or "").translate(UPPER))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1 if w else 0, len(w) - 4)))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    some = [(i, s) for i, s in sets.items() if s]
    for a, (i, s) in enumerate(some):
        for j, z in some[:a]:
            shared = len(s & z)
            if 100 * shared >= 80 * (len(s) + len(z) - shared):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def spark_hash(text):
    """Spark's xxhash64 of a text."""
    return xxhash.xxh64(text.encode(), seed=42).intdigest() - (1 << 64 if xxhash.xxh64(text.encode(), seed=42).intdigest() >> 63 else 0)


def lost_lines(docs, min_words=1):
    """{(id, text): [line]} of operator 2 for [(id, text)]; equal rows are one document."""
    places = []
    for i, t in sorted({(i, t) for i, t in docs if t}, key=lambda x: (x[0] is not None, x[0] or 0, spark_hash(x[1]))):
        for k, line in enumerate(t.split("\n")):
            s = frozenset(SPACED.findall(line.translate(UPPER)))
            if len(s) >= min_words:
                places.append((i, t, k, s))
    first, gone = {}, set()
    for i, t, k, s in places:
        first.setdefault(s, (i, t, k))
    sets = list(first)
    for b in range(len(sets)):
        for a in range(b):
            if len(sets[a]) * 100 < 80 * len(sets[b]) or len(sets[b]) * 100 < 80 * len(sets[a]):
                continue
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                gone.add(sets[b])
                break
    out = defaultdict(list)
    for i, t, k, s in places:
        if s in gone or first[s] != (i, t, k):
            out[i, t].append(k)
    return dict(out)


PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def licenses(text):
    """Base values of operator 10."""
    w, at, labels = normal(text), [], set()
    for p, label in PHRASES.items():
        for k in range(len(w) - len(p) + 1):
            if tuple(w[k : k + len(p)]) == p:
                at.append(k)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def size_and_crc(text):
    data = (text or "").encode()
    return len(data) + 1, zlib.crc32(data)
