"""Operators 11 to 13 against brute force, round trips and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import alignment, queries, spelling, warc
from sparkloom.llm.durable import new_folder, written


# operator 11


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, slip_every=None):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip_every and h % slip_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    forms, found = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(v, w)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * n else None
        found[w] = len(others)
    out = set()
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.add((w, forms[w], root, n, found[w], words[forms[w]] if forms[w] else None))
    return out


def variants(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, word string").repartition(3)
    return [tuple(r) for r in spelling.variants(df, **more).select("word", "form", "root", "n", "n_near", "form_n").collect()]


@pytest.mark.parametrize("alphabet", ["ab", "abÉé", "aàe", "abcdefghijklmnop"])
def test_variants_equal_brute_force(spark, alphabet):
    rng = random.Random(len(alphabet))
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 8))) for _ in range(60)]
    for w in words[:30]:  # misspell some, with counts that fall along chains
        at = rng.randrange(len(w))
        words += [w[:at] + w[at + 1 :], w[:at] + rng.choice(alphabet) + w[at + 1 :], w[:at] + rng.choice(alphabet) + w[at:]]
    bag = [w for w in words for _ in range(rng.choice([1, 4, 5, 6, 25, 30, 130, 150]))]
    rng.shuffle(bag)
    rows = [(i if i % 9 else None, " ".join(bag[i::40]).title() + "-9", "x", "y") for i in range(40)]
    for slips in (None, 3):
        got = variants(spark, rows, slip_every=slips)
        assert len(got) == len(set(got)) and set(got) == brute_variants([r[:2] for r in rows], slips)


def test_variants_edges(spark):
    assert variants(spark, [(1, None, "", ""), (2, "", "", ""), (3, "short 123 x", "", "")]) == []
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = "wordone " * 200_000 + "wordonee " * 7
    assert set(variants(spark, [(1, long, "", "")] * 2)) == {("wordone", None, "wordone", 400_000, 1, None), ("wordonee", "wordone", "wordone", 14, 1, 400_000)}
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "doc_id long, text string"), least_length=3)


def test_ties_take_the_smallest_form_and_chains_end_at_the_root(spark):
    text = "abcdeX " * 30 + "abcdeY " * 30 + "abcde " * 40 + "abcdez " * 6 + "abcdeff " * 5 + "abcdef " * 900
    got = {w: (form, root) for w, form, root, *_ in variants(spark, [(1, text, "", "")])}
    assert got["abcdez"] == ("abcdef", "abcdef") and got["abcdeff"] == ("abcdef", "abcdef")
    got = {w: (form, root) for w, form, root, *_ in variants(spark, [(1, "qqqqqq " * 5 + "qqqqqqa " * 30 + "qqqqqqb " * 30 + "qqqqqqaa " * 200, "", "")])}
    assert got["qqqqqq"] == ("qqqqqqa", "qqqqqqaa") and got["qqqqqqa"] == ("qqqqqqaa", "qqqqqqaa") and got["qqqqqqb"] == (None, "qqqqqqb")


def test_pivots_share_no_letter_and_are_the_rarest():
    rng = random.Random(1)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randint(3, 6)))
        entries = [(p, rng.randint(1, 9)) for p in places]
        i, j = spelling.pivotal(entries)
        assert entries[j][0] - entries[i][0] >= 2
        best = min(a[1] + b[1] for k, a in enumerate(entries) for b in entries[k + 1 :] if b[0] - a[0] >= 2)
        assert entries[i][1] + entries[j][1] == best


def test_op11_query_equals_brute_force(spark, tables):
    docs = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.QUERIES["op11_spelling_variants"](spark, tables).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_variants(docs, 199) and len(got) > 100


# operator 12

BIG = "<p>" + "payload é " * 200 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n</p>"
PAGES = [
    (1, "http://a.example/x?y=1", BIG), (2, "http://b.example/ ü\r\nX: 1", BIG), (9, None, BIG), (9, "http://c.example/%20", BIG), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", "\r\n\r\n"),
    (None, "n", BIG), (10, "w", "W" * 999), (11, "w", "W" * 999), (12, "w", "V" * 1000), (13, "w", "V" * 1000), (14, "w", "é" * 500), (15, "w", "é" * 500),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, address string, payload string").repartition(3)


def archived(spark, rows, compression="gzip"):
    folder = new_folder(spark, "test_warc")
    heads, payloads = warc.archive(warc.page_records(pages(spark, rows)), f"{folder}/store")
    warc.write_files(heads, payloads, f"{folder}/files", compression=compression)
    return heads, payloads, folder


def brute_records(rows):
    last = {}
    for page, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if page is None else page)
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        again = len(body) >= 1000 and page != last[html or ""]
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", last[html or ""] if again else None))
    return out


def digest_rows(spark, folder):
    out = warc.resolved(written(warc.read_files(spark, f"{folder}/files", payload=False), "test_records"))
    assert out.where("not intact").count() == 0
    return [tuple(r) for r in out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archive_round_trip(spark, compression):
    heads, payloads, folder = archived(spark, PAGES, compression)
    assert payloads.count() == len({html or "" for *_, html in PAGES}) and heads.count() == len(PAGES)
    back = [tuple(r) for r in warc.restored(heads, payloads).select("page_id", "url", F.col("payload").cast("string"), "intact").collect()]
    assert sorted(back, key=repr) == sorted([(p, u, h or "", True) for p, u, h in PAGES], key=repr)
    rows = digest_rows(spark, folder)
    want = brute_records(PAGES)
    # of the two rows of page 9 one is the response
    twice = [r for r in rows if r[0] == 9]
    assert sorted(r[3] for r in twice) == ["response", "revisit"] and {r[4] for r in twice} == {None, 9}
    assert sorted((r for r in rows if r[0] != 9), key=repr) == sorted((r for r in want if r[0] != 9), key=repr)
    read = warc.read_files(spark, f"{folder}/files")
    got = {(r.page, r.url): bytes(r.payload).decode() for r in read.where("record_type = 'response'").collect()}
    assert got["4", "u"] == "small" and BIG in got.values() and got["8", "u"] == "\r\n\r\n"
    assert {(r.page, r.url) for r in read.collect()} == {(None if p is None else str(p), u) for p, u, _ in PAGES}


def test_files_are_warc(spark):
    _, _, folder = archived(spark, PAGES[:4], "none")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(f"{folder}/files").collect()
    kinds = []
    for f in files:
        rest = bytes(f.content)
        while rest:  # a reader of its own
            head, _, rest = rest.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            assert lines[0] == "WARC/1.1" and rest[int(fields["Content-Length"]) :].startswith(b"\r\n\r\n")
            block, rest = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) + 4 :]
            body = block.split(b"\r\n\r\n", 1)[1]
            kinds.append(fields["WARC-Type"])
            assert body.decode() == (BIG if kinds[-1] == "response" else "")
            assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(BIG.encode()).hexdigest()
    assert sorted(kinds) == ["response", "revisit", "revisit", "revisit"]


def test_damage_is_seen(spark):
    heads, payloads, _ = archived(spark, PAGES)
    broken = payloads.withColumn("payload", F.when(F.octet_length("payload") == 5, F.lit("smalL").cast("binary")).otherwise(F.col("payload"))).where("octet_length(payload) <> 999")
    assert {r.page_id for r in warc.restored(heads, broken).where("not intact").collect()} == {4, 5, 10, 11}
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parsed(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
    with pytest.raises(ValueError, match="not a record"):
        list(warc.parsed(b"hello\r\n\r\n"))


def test_many_equal_rows_and_empty_tables(spark):
    rows = [(3, "u", "z" * 2000)] * 50 + [(i, "v", "z" * 2000) for i in range(3)] + [(None, None, None)] * 2
    _, payloads, folder = archived(spark, rows)
    assert payloads.count() == 2
    got = Counter(r[3:] for r in digest_rows(spark, folder))
    assert got == {("response", None): 3, ("revisit", 3): 52}
    _, _, folder = archived(spark, [])
    assert digest_rows(spark, folder) == []


def test_op12_query_equals_brute_force(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/pages.parquet").select("page_id", "url", "html").collect()]
    got = queries.QUERIES["op12_warc"](spark, tables).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_records(rows), key=repr)


# operator 13

TEXTS = [
    "Hello world", "", None, " ", "\n", "  two  blanks ", "a\n\nb\n c", "tab\tand\x0bothers  x \u0085 y", "<|endoftext|> </s> <s><unk><0x41>", "it's don't WE'LL 12345 12 3", "naïve Zürich Straße œuvre", "日本語 テキスト",
    "emoji 👩‍👩‍👧 🎉🎉", "has ▁ in it", "a▁", "x" * 3000, "é" * 500 + " " * 700 + "ab" * 900, "mixed\r\nline\r\n ends\r", "́combining é", "  sep 　wide", "12² ½ ⅷ", "ﬁ ligature ＡＢ", "end ", "a  \n  b", "zero\u0000nul \x1c\x1d x",
]


@pytest.fixture(scope="module")
def models():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.BYTE_LEVEL)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=alignment.PIECES)


def brute_alignments(rows, models):
    """Whole texts, one token at a time."""
    a, b = models
    decode = alignment.byte_level_decoder()
    made = []
    for _, text in rows:
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ta = [bytes(decode[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in ia]
        tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(ta) != whole or b"".join(tb) != whole:
            made.append([])
            continue
        groups, x, y = [], 0, 0
        ga, gb, na, nb = [], [], 0, 0
        while x < len(ia) or y < len(ib):
            if na <= nb:
                ga.append(ia[x])
                na += len(ta[x])
                x += 1
            else:
                gb.append(ib[y])
                nb += len(tb[y])
                y += 1
            if na == nb:
                groups.append((ga, gb))
                ga, gb = [], []
        made.append(groups)
    held = Counter()
    for groups in made:
        held.update({(i, j) for ga, gb in groups for i in ga for j in gb})
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    out = []
    for (doc, _), groups in zip(rows, made, strict=True):
        links = [(i, j) for ga, gb in groups for i in ga for j in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def found(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


def test_alignments_equal_brute_force(spark, models, monkeypatch):
    rng = random.Random(7)
    rows = [(i if i % 7 else None, t) for i, t in enumerate(TEXTS + TEXTS[:5] + ["".join(rng.choice("ab é\n '1▁.\t") for _ in range(rng.randint(1, 60))) for _ in range(60)])]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, row int, pairs string").repartition(3)
    want = sorted(brute_alignments(rows, models), key=repr)
    assert found(alignment.alignments(df)) == want
    assert found(alignment.alignments(df, limit=50)) == want  # most counts come by the join
    assert found(alignment.alignments(df, limit=0)) == want
    monkeypatch.setattr(alignment, "KEPT", 3)
    monkeypatch.setattr(alignment, "SLICE", 40)
    monkeypatch.setattr(alignment, "LINKS", 7)
    assert found(alignment.alignments(df)) == want


def test_overlaps_join_the_tokens_of_a_group(models):
    encoder = alignment.Encoder(alignment.BYTE_LEVEL, alignment.PIECES)
    made = alignment.Aligned(encoder.encode([t for t in TEXTS if t]), tuple(s.sizes for s in encoder.sides))
    ends = [s + side.sizes[ids] for s, ids, side in zip(made.start, made.ids, encoder.sides, strict=True)]
    pairs = {(i, j) for i, j in alignment.overlaps(made.there, made.back).tolist()}
    assert pairs == {(i, j) for i in range(len(made.ids[0])) for j in range(len(made.ids[1])) if made.start[0][i] < ends[1][j] and made.start[1][j] < ends[0][i]}
    assert all(made.group[0][i] == made.group[1][j] for i, j in pairs)


def test_alignment_of_an_empty_table(spark):
    assert alignment.alignments(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    none = alignment.alignments(spark.createDataFrame([(1, None), (1, "")], "doc_id long, text string"))
    assert found(none) == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_op13_query_equals_brute_force(spark, tables, models):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.QUERIES["op13_tokenizer_alignment"](spark, tables)) == sorted(brute_alignments(rows, models), key=repr)
