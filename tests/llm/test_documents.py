"""Operators 1, 3, 4, 7, 9 and 10: edge cases and comparison with plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, language, licenses, packing, quality, queries, sharding
from tests.llm import brute


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet")


@pytest.fixture(scope="module")
def local(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]


# 1


def test_language_on_held_out_documents(spark, tables, local):
    lang = {r[0]: r[2] for r in local}
    out = queries.op1_language_id(spark, tables).collect()
    assert len(out) == len(local)
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edges(spark, docs):
    model = language.train(docs)
    out = language.identified(brute.edges(spark), model).collect()
    assert len(out) == len(brute.EDGES) and "text" not in out[0].asDict()
    best = {r.doc_id: r.best for r in out}
    assert all(best[i] == "und" for i in (1, 2, 3, 9)) and best[6] == "en" and best[5] != "und"
    assert {r.best for r in out} <= {"und", "en", "de", "fr", "es"}
    assert language.train(docs.limit(0)) == []
    assert {r.best for r in language.identified(brute.edges(spark), []).collect()} == {"und"}
    assert language.identified(docs.limit(0), model).count() == 0


def test_language_narrow_margin_is_rejected():
    model = language.Model([("aa", b" left right middle "), ("bb", b" left right middle ")])
    lang, score, margin = model.classify("left right")
    assert lang == "aa" and score == 0.5 and margin == 0.0


def test_language_is_the_smallest_compressed_size(spark):
    """Against sizes that zstd gives for each piece and dictionary; all words of the sample count, whole texts and any number of languages."""
    rng = random.Random(4)
    words = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(2, 9))) for _ in range(60)] for k in range(230)}
    texts = [(i, lang, " ".join(rng.choice(w) for _ in range(40)) + " " + "x" * 9000 + f" late{lang[1:].translate(str.maketrans('0123456789', 'abcdefghij'))}") for i, (lang, w) in enumerate(words.items())]
    model = language.train(spark.createDataFrame(texts, "doc_id int, lang string, text string"))
    assert sorted(lang for lang, _ in model) == sorted(words) and all(f"late{lang[1:].translate(str.maketrans('0123456789', 'abcdefghij'))}".encode() in d for lang, d in model)
    few = [x for x in model if x[0] < "l005"]
    made = language.Model(few)
    for _ in range(20):
        text = " ".join(rng.choice(words[f"l00{rng.randint(0, 6)}"]) for _ in range(rng.choice((3, 30, 700))))
        data = language.letters_only(text).encode()
        sizes = [sum(len(c.compress(data[a : a + language.PIECE])) for a in range(0, len(data), language.PIECE)) for c in made.compressors]
        lang, score, margin = made.classify(text)
        assert lang == few[sizes.index(min(sizes))][0] and margin == (sorted(sizes)[1] - min(sizes)) / min(sizes)
        assert abs(score - 1 / sum(2.0 ** (min(sizes) - s) for s in sizes)) < 1e-9


# 3


def test_quality_measures(spark, tables, local):
    out = {r.doc_id: r for r in queries.op3_quality_rules(spark, tables).collect()}
    for i, text, *_ in local:
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(text)
        assert not (r.base_failed and r.kept)


def test_quality_edges(spark):
    out = quality.quality_rules(brute.edges(spark))
    got = rows(out, "doc_id", *quality.MEASURES[:5], "base_failed")
    assert got == sorted(((i, *brute.quality(t)) for i, t, *_ in brute.EDGES), key=repr)
    kept = quality.accepted(brute.edges(spark))
    assert kept.dtypes == brute.edges(spark).dtypes and sorted(r.doc_id for r in kept.collect()) == [6, 6, 7, 8]
    assert kept.where("n_words = -1 and kept = 'x'").count() == 4
    assert quality.accepted(brute.edges(spark).limit(0)).count() == 0


def test_quality_distrusts_a_bad_host_but_keeps_its_clean_documents(spark):
    clean = " ".join(f"word{i}" for i in range(30))
    junk = " ".join(f"word{i}###" for i in range(30))
    faint = " ".join(f"word{i}" + ("*" if i % 15 == 0 else "") for i in range(30))  # 2 symbols in 30 words
    docs = spark.createDataFrame([(i, junk, "bad") for i in range(50)] + [(60, clean, "bad"), (61, faint, "bad")] + [(i, clean, "good") for i in range(70, 120)] + [(130, faint, "good")], "doc_id int, text string, source string")
    kept = {r.doc_id for r in quality.accepted(docs).collect()}
    assert kept == {60, 130, *range(70, 120)}
    named = docs.withColumnRenamed("source", "host").withColumn("tolerance", F.lit("x"))
    out = quality.quality_rules(named, host_col="host")
    assert out.columns[:4] == ["doc_id", "text", "host", "tolerance"] and {r.doc_id for r in out.where("kept").collect()} == kept


def test_quality_verdict_follows_the_rate_of_the_host(spark):
    """A document at a given share of a limit stays in a host exactly as long as the host's shrunk rate leaves that share."""
    clean, junk = " ".join(f"word{i}" for i in range(40)), " ".join(f"word{i}###" for i in range(40))
    rows = []
    for bad in range(0, 100, 10):  # hosts with 0 to 90 of 100 documents that fail, and a document for each share of the symbol limit
        rows += [(junk if i < bad else clean, f"h{bad}", 3.0 if i < bad else 0.0) for i in range(100)]
        rows += [(" ".join(f"word{i}" + ("*" if i < s else "") for i in range(40)), f"h{bad}", s / 4) for s in range(1, 5)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id int, text string, source string, share double")
    out = quality.quality_rules(docs).collect()
    assert all(r.kept == (r.share <= max(0.5, 1 - r.host_rate)) for r in out)
    alone = {r.doc_id for r in out if r.share <= 1}  # what the rules would keep without their hosts
    assert len(alone - {r.doc_id for r in out if r.kept}) > 10 and all(r.kept for r in out if r.share <= 0.5)


def test_quality_host_verdicts_decide_rows_of_the_tables(spark, tables):
    out = quality.quality_rules(spark.read.parquet(f"{tables.replace('sf0.001', 'sf0.01')}/documents.parquet"), keep_text=False)
    alone = out.where(~F.col("base_failed") & ~quality.misshapen() & (quality.burden() <= 1))
    assert 0 < alone.where("not kept").count() < 0.01 * alone.count()


# 4


def check_packing(out, texts, capacity, limit):
    words, bins = Counter(), defaultdict(list)
    for r in out:
        words[r.doc_id] += r.n_tokens
        if r.bin_id is None:
            assert r.n_tokens == 0
        else:
            bins[r.bin_id].append(r)
    assert words == Counter({i: len(brute.SPACED.findall(t or "")) for i, t, _ in texts})
    source = {i: s for i, _, s in texts}
    cluster = {i: tuple(brute.SPACED.findall((t or "").translate(brute.UPPER))) for i, t, _ in texts}
    for b in bins.values():
        assert sum(r.n_tokens for r in b) <= capacity
        assert max(Counter(source[r.doc_id] for r in b).values()) <= limit
        assert len({cluster[r.doc_id] for r in b}) == len(b)
    return bins


def test_packing_places_every_word_once(docs, local):
    out = packing.packed(docs, group_pieces=100).collect()
    check_packing(out, [(i, t, s) for i, t, _, s in local], 2048, 2)


def test_packing_deals_many_equal_rows(spark):
    rows = [(7, "one two three", "s")] * 300 + [(None, None, None)] * 300 + [(i, f"word{i} and more", "t") for i in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = packing.packed(df, capacity=9, group_pieces=40).collect()
    assert sum(r.n_tokens for r in out) == 1800 and len(out) == 900
    assert sorted(r.doc_id for r in out if r.bin_id is not None) == [7] * 300 + list(range(100, 400))
    equal = [r.bin_id for r in out if r.doc_id == 7]
    assert len(set(equal)) == 300  # copies of one cluster
    groups = [b >> packing.GROUP_BITS for b in equal]
    assert len(set(groups)) > 10 and max(groups.count(g) for g in set(groups)) < 60


def test_packing_edges(spark):
    out = packing.packed(brute.edges(spark).where("doc_id <> 6"), capacity=100).collect()
    check_packing(out, [(i, t, s) for i, t, _, s in brute.EDGES if i != 6], 100, 2)
    twice = packing.packed(brute.edges(spark).where("doc_id = 6")).collect()
    assert len({r.bin_id for r in twice}) == 2  # repeated rows are copies and may not share a bin
    assert packing.packed(brute.edges(spark).limit(0)).count() == 0


def test_best_fit_takes_the_tightest_bin_without_conflict():
    sizes, sources, clusters = [60, 50, 45, 40, 35], list("abcad"), [1, 2, 3, 4, 5]
    assert packing.best_fit(sizes, sources, clusters, 100, 1) == [0, 1, 1, 2, 0]
    assert packing.best_fit(sizes, sources, clusters, 100, 2) == [0, 1, 1, 0, 2]
    assert packing.best_fit([50, 50], ["a", "b"], [9, 9], 100, 2) == [0, 1]


def naive_best_fit(sizes, sources, clusters, capacity, limit):
    """The oldest of the tightest bins that fit and don't conflict, by looking at all of them."""
    bins, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(capacity - sum(sizes[j] for j in b) - sizes[i], k) for k, b in enumerate(bins) if sum(sizes[j] for j in b) + sizes[i] <= capacity and sum(sources[j] == sources[i] for j in b) < limit and clusters[i] not in {clusters[j] for j in b}]
        out[i] = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        bins[out[i]].append(i)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_equals_brute_force(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 40) for _ in range(300)]
    sources, clusters = [rng.choice("abcdefg") for _ in sizes], [rng.randint(0, 200) for _ in sizes]
    for limit in (1, 2, 50):
        assert packing.best_fit(sizes, sources, clusters, 100, limit) == naive_best_fit(sizes, sources, clusters, 100, limit)


def test_packing_query_equals_brute_force(spark, tables, local):
    out = sorted((r.doc_id, r.piece, r.first_word, r.n_tokens, r.bin_id if r.bin_id is not None else -1) for r in queries.op4_best_fit_packing(spark, tables).collect())
    pieces = []
    for i, text, _, source in sorted(local, key=lambda r: r[0]):
        words = brute.SPACED.findall((text or "").translate(brute.UPPER))
        pieces += [(i, k, 2048 * k, min(2048, len(words) - 2048 * k), source, tuple(words)) for k in range(max(1, -(-len(words) // 2048)))]
    some = [p for p in pieces if p[3] > 0]
    bins = naive_best_fit([p[3] for p in some], [p[4] for p in some], [p[5] for p in some], 2048, 2)
    want = [(*p[:4], b) for p, b in zip(some, bins, strict=True)] + [(*p[:3], 0, -1) for p in pieces if p[3] <= 0]
    assert out == sorted(want)


# 7


def test_decontamination_equals_brute_force(spark, tables, local):
    items = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    want = dict(zip([r[0] for r in local], brute.decontamination([r[1] for r in local], items), strict=True))
    out = queries.op7_benchmark_decontamination(spark, tables).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in out} == want and any(r.contaminated for r in out)


ITEMS = [(1, "The Quick brown fox jumps OVER the lazy dog and runs"), (2, "bad wolf"), (3, None), (4, ""), (5, "word1é word2é"), (2, "bad wolf"), (None, "one")]


@pytest.mark.parametrize("max_windows", [1000, 2])
def test_decontamination_edges(spark, max_windows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.decontaminated(brute.edges(spark), items, max_windows=max_windows)
    want = brute.decontamination([t for _, t, *_ in brute.EDGES], ITEMS)
    assert want[3][1:3] == (1, 0)  # the item without an id is hit and not named
    got = sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in out.collect()), key=repr)
    assert got == sorted(((e[0], *w[:3]) for e, w in zip(brute.EDGES, want, strict=True)), key=repr)
    text = brute.SENTENCE
    spans = out.where("doc_id = 7").first().spans
    assert [text[s.s : s.e] for s in spans] == ["the quick brown fox jumps over the lazy dog and runs", "bad wolf"]
    assert decontaminate.decontaminated(brute.edges(spark).limit(0), items).count() == 0
    assert decontaminate.decontaminated(brute.edges(spark), items.limit(0)).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("max_windows", [1000, 2, 1])
def test_decontaminated_texts_hold_no_window(spark, max_windows):
    items = spark.createDataFrame(ITEMS[:-1] + [(7, "x y")], "item_id long, text string")
    nested = spark.createDataFrame([(1, "a bad bad wolf wolf b"), (2, "Bad, wolf!"), (3, "x"), (4, None), (5, "keep bad x y wolf end"), (5, "keep bad x y wolf end"), (6, "Bad x y wolf x y")], "doc_id int, text string")
    out = decontaminate.contaminated_removed(nested, items, max_windows=max_windows)
    assert rows(out, "doc_id", "text") == [(1, "a  b"), (3, "x"), (4, None), (5, "keep  end"), (5, "keep  end")]
    kept = decontaminate.contaminated_removed(brute.edges(spark), items, max_windows=max_windows)
    assert kept.dtypes == brute.edges(spark).dtypes and kept.where("doc_id in (6, 7)").first().text == " away from the big  in the dark green wood today"
    assert decontaminate.contaminated_removed(nested.limit(0), items, max_windows=max_windows).count() == 0


def test_decontamination_in_parts_equals_one_pass(spark, tables, docs):
    """Also with the bound on bytes; overlapping spans of different parts become one."""
    items = spark.read.parquet(f"{tables}/benchmark.parquet")
    one = rows(decontaminate.decontaminated(docs, items), "doc_id", "n_words", "n_hit", "items", "spans")
    n_windows = decontaminate.benchmark_windows(items).count()
    assert rows(decontaminate.decontaminated(docs, items, max_windows=n_windows // 3), "doc_id", "n_words", "n_hit", "items", "spans") == one


# 9


def check_shards(out, texts, shards):
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in out) == sorted((i, *brute.size_and_crc(t)) for i, t in texts)
    for s in range(shards):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    return [sum(r["size"] for r in out if r.shard == s) for s in range(shards)]


def test_sharding(docs, local):
    out = sharding.sharded(docs).collect()
    loads = check_shards(out, [(r[0], r[1]) for r in local], 8)
    assert max(loads) - min(loads) < 0.02 * sum(loads) / 8
    assert rows(sharding.sharded(docs), "doc_id", "shard", "slot") == rows(sharding.sharded(docs.repartition(7)), "doc_id", "shard", "slot")


def test_sharding_splits_only_a_hot_group(spark):
    texts = [(i, "same text") for i in range(4000)] + [(i, f"text {i % 2000} of others") for i in range(4000, 12000)]
    out = sharding.sharded(spark.createDataFrame(texts, "doc_id int, text string")).collect()
    loads = check_shards(out, texts, 8)
    assert max(loads) - min(loads) < 0.02 * sum(loads) / 8
    where = defaultdict(set)
    for r in out:
        where[texts[r.doc_id][1]].add(r.shard)
    assert len(where["same text"]) == 8 and all(len(v) == 1 for k, v in where.items() if k != "same text")


def test_sharding_keeps_groups_that_fit_in_a_shard(spark):
    texts = [(i, "copies") for i in range(200)] + [(i, "more copies") for i in range(200, 1500)] + [(i, f"text {i} of others") for i in range(1500, 12000)]
    out = sharding.sharded(spark.createDataFrame(texts, "doc_id int, text string")).collect()
    loads = check_shards(out, texts, 8)
    assert max(loads) - min(loads) < 0.02 * sum(loads) / 8
    assert len({r.shard for r in out if r.doc_id < 200}) == 1 and len({r.shard for r in out if 200 <= r.doc_id < 1500}) == 1


@pytest.mark.parametrize("seed", range(4))
def test_placing_equals_brute_force(seed):
    """Each vector, heaviest first, goes where the dot product with what is left is highest; then bytes are evened out."""
    rng = np.random.default_rng(seed)
    weights, shards = rng.integers(1, 1000, (60, 3)).astype(float), 4
    shares = [[w / t for w, t in zip(row, weights.sum(axis=0), strict=True)] for row in weights]
    left, at = [[1 / shards] * 3 for _ in range(shards)], [0] * len(shares)
    for i in sorted(range(len(shares)), key=lambda i: (-max(shares[i]), i)):
        dots = [sum(x * y for x, y in zip(left[s], shares[i], strict=True)) for s in range(shards)]
        at[i] = dots.index(max(dots))
        left[at[i]] = [x - y for x, y in zip(left[at[i]], shares[i], strict=True)]
    load = [sum(weights[i][0] for i in range(60) if at[i] == s) for s in range(shards)]
    for _ in range(10 * shards):
        high, low = load.index(max(load)), load.index(min(load))
        gap, mine = load[high] - load[low], [i for i in range(60) if at[i] == high]
        best = min(mine, key=lambda i: (abs(weights[i][0] - gap / 2), i))
        if len(mine) < 2 or not 0 < weights[best][0] < gap:
            break
        at[best] = low
        load[high], load[low] = load[high] - weights[best][0], load[low] + weights[best][0]
    assert sharding.place(weights, shards).tolist() == at and max(load) - min(load) < 0.05 * sum(load) / shards


def test_sharding_edges(spark):
    check_shards(sharding.sharded(brute.edges(spark), 3).collect(), [(i, t) for i, t, *_ in brute.EDGES], 3)
    assert sharding.sharded(brute.edges(spark).limit(0)).count() == 0


# 10


def test_licenses_equal_brute_force(spark, tables, local):
    out = {r.doc_id: r for r in queries.op10_license_scan(spark, tables).collect()}
    for i, text, *_ in local:
        assert (out[i].n_words, out[i].n_base, out[i].first_word, out[i].last_word, out[i].base_labels) == brute.licenses(text)
        assert set(filter(None, out[i].base_labels.split(","))) <= set(out[i].labels.split(",")) and 0 <= out[i].score <= 1


def test_license_edges(spark):
    more = [(20, "CC BY, cc-by; (cc)by General Public License all rights reserved"), (21, "Released\nunder the\nMIT License"), (22, "ccby cc  by"), (23, "licensed under the Apache Licence"), (24, "Licensed under the Apache License,\nVersion 2.0")]
    docs = brute.edges(spark).select("doc_id", "text", "n_words", "h").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    out = licenses.license_scan(docs)
    got = rows(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == sorted(((i, *brute.licenses(t)) for i, t in [(e[0], e[1]) for e in brute.EDGES] + more), key=repr)
    labels = {r.doc_id: r.labels for r in out.collect()}
    assert labels[20] == "cc-by,gpl,reserved" and labels[22] == "cc-by" and labels[23] == "" and labels[24] == "apache-2.0" and labels[1] == "" and labels[21] == "mit"
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_license_scan_runs_no_python(spark, tables):
    plan = queries.op10_license_scan(spark, tables)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_template_words_in_any_order_of_rarity(spark):
    text = "x y z\n" + licenses.TEMPLATES["mit-text"].replace("hereby", "now") + "\nnothing here"
    found = licenses.template_matches(spark.createDataFrame([(1, text)], "id int, text string"), 0.9).collect()
    words = set(licenses.TEMPLATES["mit-text"].split())
    assert [(r.label, round(r.containment, 9)) for r in found] == [("mit-text", round((len(words) - 1) / len(words), 9))]


def places(words, template):
    """(first word, last word, containment) of every place, by trying every run of words."""
    known, span = set(template.split()), -(-len(template.split()) * 10 // 9)
    overlap = [len(known & set(words[i : i + span])) for i in range(len(words))]
    good, out = [10 * n >= 9 * len(known) for n in overlap], []
    for i, ok in enumerate(good):
        if ok and (not i or not good[i - 1]):
            end = next((j for j in range(i, len(words)) if not good[j]), len(words))
            best = max(range(i, end), key=lambda j: (overlap[j], j))
            out.append((best, min(best + span, len(words)) - 1, round(overlap[best] / len(known), 9)))
    return out


def matches(spark, texts):
    """{(number, label): containment} of template_matches, whose places all equal those of plain Python."""
    want = {(k, label, *p) for k, text in enumerate(texts) for label, t in licenses.TEMPLATES.items() for p in places(brute.normal(text), t)}
    found = licenses.template_matches(spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "id int, text string")).collect()
    assert {(r.id, r.label, r.first_word, r.last_word, round(r.containment, 9)) for r in found} == want and len(found) == len(want)
    return {(k, label): max(c for i, name, _, _, c in want if (i, name) == (k, label)) for k, label, *_ in want}


def test_every_place_of_a_template_is_found(spark):
    text = " ".join(["released under the mit license", "filler " * 9, "licensed under the apache license version 2 0", "more " * 30, "released under the mit license", "released under the mit license", "x " * 20, "this is released under the the mit license"])
    want = places(brute.normal(text), licenses.TEMPLATES["mit"])
    assert len(want) >= 3
    matches(spark, [text, "", text + " " + text])


def test_templates_wrapped_over_any_lines(spark):
    texts, labels = [], []
    for label, t in licenses.TEMPLATES.items():
        words = t.split()
        texts += ["\n".join(" * " + " ".join(words[i : i + m]) for i in range(0, len(words), m)) for m in (1, 3, 9)]
        labels += [label] * 3
    texts.append("\n".join(f"{w} here and there it stands alone" for w in licenses.TEMPLATES["bsd"].split()))  # too far apart
    rng = random.Random(5)
    known = sorted({w for t in licenses.TEMPLATES.values() for w in t.split()})
    for _ in range(60):
        words = licenses.TEMPLATES[rng.choice(sorted(licenses.TEMPLATES))].split()
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n", "\nplainly\n", f"\n{rng.choice(known)}\n"]) for w in words if rng.random() < 0.97))
    want = matches(spark, texts)
    assert all((k, label) in want for k, label in enumerate(labels)) and (len(labels), "bsd") not in want


def test_words_of_a_template_that_stand_apart_give_no_label(spark):
    texts = ["Der Plan, released under the pressure of time, ist mit der neuen license verbunden", "Released\nunder the\nMIT License", "permission is hereby granted free of charge\nto any person obtaining a copy of this software\nand associated documentation files"]
    texts.append(" ".join(f"{w} filler" for w in licenses.TEMPLATES["mit"].split()) + " the of and" * 30_000)
    assert set(matches(spark, texts)) == {(1, "mit"), (2, "mit-text")}
    odd = spark.createDataFrame([(None, "released under the mit license"), (1, "\u212aeep \u0130t \u212aind"), (2, "")], "doc_id int, text string")
    assert rows(licenses.license_scan(odd), "doc_id", "n_words", "labels") == [(1, 3, ""), (2, 0, ""), (None, 5, "mit")]
