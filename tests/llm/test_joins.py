"""Operators 2 and 8, the components and the pipeline: comparison with plain Python, hot groups and edge cases."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.functions import staging
from sparkloom.llm import line_dedup, ngram_join, oracles, queries
from sparkloom.llm.components import components
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet")


def near_copies(n, seed=1):
    """Texts of one base with a few words changed each, exact copies among them, and unrelated ones."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    texts = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 4, 6))):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
        texts.append(" ".join(words[: rng.choice((120, 120, 110, 60))]))
    return texts + [" ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 60))) for _ in range(n // 2)]


def test_components_by_name_of_the_smallest(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (7, 8), (9, 9), (4, 3), (2, 1)] + [(100, 100 + i) for i in range(1, 50)] + [(149 + i, 150 + i) for i in range(20)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert {k: got[k] for k in (1, 2, 3, 4, 7, 8)} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7} and got[169] == got[149] == got[101] == 100
    assert components(links.limit(0)).count() == 0


def test_ngram_join_equals_brute_force(spark, tables, docs):
    want = brute.components([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8_ngram_jaccard_join(spark, tables).collect()}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_of_near_copies(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "HELD", 40)  # keys of many classes are taken in parts
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    texts = list(enumerate(near_copies(150, seed)))
    random.Random(seed).shuffle(texts)
    out = ngram_join.ngram_components(spark.createDataFrame(texts, "doc_id int, text string").repartition(5))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute.components(texts)


def test_ngram_join_edges(spark):
    edges = brute.edges(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(edges).collect()}
    want = brute.components([(i, t) for i, t, *_ in brute.EDGES])
    assert got == want and ngram_join.ngram_components(edges).count() == len(brute.EDGES)
    kept = ngram_join.one_of_each(edges)
    assert kept.dtypes == edges.dtypes and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})
    assert ngram_join.ngram_components(edges.limit(0)).count() == 0 and ngram_join.one_of_each(edges.limit(0)).count() == 0


def test_one_of_each_of_rows_that_share_an_id(spark, monkeypatch):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(2, a), (2, a), (2, a + " more"), (2, b), (1, a), (None, c), (None, c), (None, b + " more"), (7, c), (8, None), (8, None), (9, "one"), (9, "one"), (None, "lone words"), (None, "other lone words")]
    for small in (1 << 20, 0):  # the second time, no side of a join counts as small
        monkeypatch.setattr(staging, "BROADCAST_ROWS", small)
        monkeypatch.setattr(ngram_join, "CROWD", 2)
        out = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id int, text string"))
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
        assert got == sorted([(1, a), (2, b), (7, c), (8, None), (8, None), (9, "one"), (None, "lone words"), (None, "other lone words")], key=repr)


def test_ngram_join_threshold_is_exact(spark):
    # 18 shared shingles of 22: below 0.8; 20 of 24: above
    words = [f"a{i}" for i in range(26)]
    texts = [(1, " ".join(words[:24])), (2, " ".join(words[:22] + ["z1", "z2"])), (3, " ".join(words[:22])), (4, "q " * 4)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(texts, "doc_id int, text string")).collect()}
    assert got == brute.components(texts)


def lost(out):
    """{(id, hash of the text): lines} of removed_lines."""
    return {(r.doc_id, r.h): list(r["lines"]) for r in out.collect()}


def hashed(want):
    return {(i, brute.spark_hash(t)): lines for (i, t), lines in want.items()}


def test_line_dedup_equals_brute_force(spark, tables, docs):
    want = brute.lost_lines([(r.doc_id, r.text) for r in docs.collect()])
    for query in ("op2_line_dedup", "op2_line_dedup_all_lines"):
        got = {r.doc_id: sorted(r.removed_lines) for r in queries.QUERIES[query](spark, tables).collect() if r.n_removed}
        assert got == {i: lines for (i, _), lines in want.items()}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("small", [False, True])
def test_line_dedup_of_near_copies(spark, seed, small, monkeypatch):
    if small:  # keys are taken in parts, words are split by size, long runs are led
        for name, value in {"HELD": 40, "HOT": 8, "LONG": 10, "LEADERS": 3, "STEP": 64, "REMEMBERED": 4}.items():
            monkeypatch.setattr(line_dedup, name, value)
    rng = random.Random(seed)
    lines = [" ".join(rng.sample(t.split(), min(len(t.split()), 30))) for t in near_copies(60, seed)] + [t for t in near_copies(60, seed + 9)]
    lines += [" ".join(f"s{rng.randint(0, 9)}" for _ in range(rng.randint(1, 7))) for _ in range(60)]
    texts = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 4)))) for i in range(120)]
    out = line_dedup.removed_lines(spark.createDataFrame(texts, "doc_id int, text string").repartition(5))
    assert lost(out) == hashed(brute.lost_lines(texts))
    out = line_dedup.removed_lines(spark.createDataFrame([(f"{i}", t) for i, t in texts], "doc_id string, text string"), percent=80, min_words=5)
    assert lost(out) == hashed(brute.lost_lines([(f"{i}", t) for i, t in texts], 5))


def test_line_dedup_of_short_repeated_and_null_rows(spark):
    menu = [(1, "Home\nLog in\n\nread more"), (2, "home\nabout\n\nMore read\nlog"), (3, "log in")]
    assert lost(line_dedup.removed_lines(spark.createDataFrame(menu, "doc_id int, text string"))) == hashed({menu[1]: [0, 3], menu[2]: [0]})
    lines = {c: " ".join(f"{c}{i}" for i in range(8)) for c in "ABCDE"}
    texts = [(1, f"{lines['A']}\n{lines['B']}"), (1, f"{lines['C']}\n{lines['A']}"), (2, lines["D"]), (2, lines["D"]), (None, lines["E"]), (None, f"{lines['E']} more"), (5, lines["E"]), (6, None)]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    want = brute.lost_lines(texts)
    assert lost(line_dedup.removed_lines(df)) == hashed(want) and len(want) == 3
    out = sorted(((r.doc_id, r.text) for r in line_dedup.without_lines(df).collect()), key=repr)
    kept = [(i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get((i, t), ()))) for i, t in texts]
    assert out == sorted(kept, key=repr)  # B and C stand once and stay; rows that repeat (2, D) are one document


def test_line_dedup_of_a_key_in_parts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HELD", 40)
    rng = random.Random(3)
    rows = []
    for i in range(50):  # i and i + 50 are alike; no part need hold both
        bits = rng.getrandbits(63), rng.getrandbits(63)
        rows += [(7, 10, 0, *bits, at, at) for at in (i, i + 50)]
    rng.shuffle(rows)
    rows += [(8, 10, 0, 5, 5, at, at) for at in (200, 201)] + [(8, 10, 0, 5, 5, 201 + i, 201) for i in range(100)]
    keys = spark.createDataFrame(rows, "key long, n int, place int, bits long, more_bits long, early long, class long")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = [tuple(r) for r in line_dedup._candidates(keys, line_dedup.Lines(80, 1)).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    pairs, more = {(a, b) for a, b, _ in got}, {b for _, b, m in got if m}
    assert [i for i in range(50) if (i, i + 50) not in pairs and i + 50 not in more] == []
    assert (200, 201) in pairs and not more & {200, 201}  # a class that every task has sent is one


def test_line_dedup_edges(spark):
    edges = brute.edges(spark)
    out = line_dedup.without_lines(edges)
    assert out.dtypes == edges.dtypes
    want = brute.lost_lines([(i, t) for i, t, *_ in brute.EDGES])
    kept = [(i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get((i, t), ()))) for i, t, *_ in brute.EDGES]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(kept, key=repr)
    assert sorted(i for i, _ in want) == [7, 8]
    clash = edges.withColumn("_lines", F.lit(1)).withColumn("c0", F.lit(2)).withColumn("early", F.lit(3))
    assert line_dedup.without_lines(clash).count() == len(brute.EDGES)
    assert line_dedup.without_lines(edges.limit(0)).count() == 0


def test_pipeline_stages_on_their_own_input(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    local = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else {}
        docs_out = stage(spark, docs, tables).persist()
        local[name] = (before, docs_out.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs_out.columns == docs.columns
        docs = docs_out
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet'")
    kept = {i for i, good in con.execute(f"SELECT doc_id, kept FROM ({oracles.SQL['op3_quality_rules']})").fetchall() if good}
    before, out = local["quality rules"]
    assert {r.doc_id: r.text for r in out} == {i: t for i, t in before.items() if i in kept} and 0 < len(kept) < len(before)
    before, out = local["line dedup"]
    gone = brute.lost_lines(list(before.items()))
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ())) for i, t in before.items()}
    assert {r.doc_id: r.text for r in out} == {i: t for i, t in want.items() if brute.SPACED.search(t)}
    assert all(r.n_chars == len(r.text) for r in out)
    before, out = local["n-gram Jaccard join"]
    assert {r.doc_id for r in out} == {c for _, c in brute.components(list(before.items())).values()}
    before, out = local["benchmark decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    assert not any(hit for _, hit, *_ in brute.decontamination([r.text for r in out], items))
    hit_before = {i for i, (_, hit, *_) in zip(before, brute.decontamination(before.values(), items), strict=True) if hit}
    assert {r.doc_id: r.text for r in out if r.doc_id not in hit_before} == {i: t for i, t in before.items() if i not in hit_before}
    before, out = local["best-fit packing"]
    words = {}
    for r in out:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.n_tokens
    assert words == {i: len(brute.SPACED.findall(t)) for i, t in before.items()}


def test_pipeline_edges_and_whole_run(spark, tables, tmp_path):
    docs = brute.edges(spark)
    spark.read.parquet(f"{tables}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    held = set(staging.FOLDERS)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {6}
    assert sum("/stage" in path for path in set(staging.FOLDERS) - held) == 1 and len(set(staging.FOLDERS) - held) <= 3
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_line_dedup_query_tells_rows_without_an_id_apart(spark, tmp_path):
    rows = [(None, "A one\nB two"), (None, "B two\nA one"), (5, "A one"), (None, None), (7, "other")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op2_line_dedup(spark, str(tmp_path)).collect()
    lost = brute.lost_lines([r for r in rows if r[1] is not None])
    want = [(i, sorted(lost.get((i, t), ()))) for i, t in rows]
    assert sorted(((r.doc_id, sorted(r.removed_lines)) for r in got), key=repr) == sorted(want, key=repr)
