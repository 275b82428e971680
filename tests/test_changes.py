"""Batches and logs of changes against one-by-one application."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import change_log, changes

USERS = "id int, username string, email string, city string"


def sequential_inserts(table, rows, unique):
    taken = {(c, r[c]) for r in table for c in unique if r[c] is not None}
    good, bad = [], []
    for r in rows:
        cells = {(c, r[c]) for c in unique if r[c] is not None}
        if cells & taken:
            bad.append(r["n"])
        else:
            taken |= cells
            good.append(r["n"])
    return good, sorted(bad)


def inserted(spark, table, rows, unique, left):
    base = spark.createDataFrame([(r["id"], r["username"], r["email"], "c") for r in table], USERS)
    new = spark.createDataFrame([(r["n"], r["username"], r["email"], str(r["n"]), 5) for r in rows], "n int, username string, email string, city string, position int").repartition(3)
    snapshot, rejects = changes.inserts(base, new, unique, "n", left=left)
    added = sorted((r.id, int(r.city)) for r in snapshot.where("city <> 'c'").collect())
    assert [i for i, _ in added] == list(range(len(table) + 1, len(table) + 1 + len(added)))
    return [n for _, n in added], sorted(r.n for r in rejects.collect())


@pytest.mark.parametrize("left", [0, 5, 100_000])
def test_inserts_equal_one_by_one(spark, left):
    rng = random.Random(left)
    for size, names in ((60, 25), (40, 60)):
        table = [{"id": i + 1, "username": f"u{i}", "email": f"m{i}"} for i in range(4)]
        rows = [{"n": n, "username": f"u{rng.randrange(names)}" if rng.random() < 0.9 else None, "email": f"m{rng.randrange(names)}" if rng.random() < 0.9 else None} for n in range(size)]
        want = sequential_inserts(table, rows, ["username", "email"])
        assert inserted(spark, table, rows, ["username", "email"], left) == want
        if left == 5:
            assert inserted(spark, table, rows, ["email", "username"], left) == want


def test_a_row_refused_takes_no_value(spark):
    rows = [{"n": 1, "username": "u1", "email": "m1"}, {"n": 2, "username": "u2", "email": "m1"}, {"n": 3, "username": "u2", "email": "m3"}]
    for unique in (["username", "email"], ["email", "username"]):
        for left in (0, 100):
            assert inserted(spark, [], rows, unique, left) == ([1, 3], [2])


def test_a_long_chain_of_conflicts(spark):
    rows = [{"n": n, "username": f"u{n // 2}", "email": f"m{(n + 1) // 2}"} for n in range(30)]  # each row conflicts with the next
    assert inserted(spark, [], rows, ["username", "email"], 20) == (list(range(0, 30, 2)), list(range(1, 30, 2)))


def test_hot_values_and_empty_batches(spark):
    rows = [{"n": n, "username": "same" if n % 3 else f"u{n}", "email": None} for n in range(300)]
    assert inserted(spark, [], rows, ["username", "email"], 0) == sequential_inserts([], rows, ["username", "email"])
    assert inserted(spark, [], [], ["username", "email"], 0) == ([], [])


def test_patches_fold_field_by_field(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "id int, title string, status string")
    schema = "id int, set_fields array<string>, title string, status string, n int"
    batch = spark.createDataFrame([(1, ["title"], "new", None, 1), (1, ["status"], None, "done", 2), (2, ["title", "status"], "p", "q", 5), (2, ["status"], None, None, 7), (2, ["status"], None, "early", 6), (9, ["title"], "n", None, 1), (None, ["title"], "n", None, 1), (3, None, "n", None, 1)], schema)
    out, rejects = changes.patches(table, batch, ["title", "status"], order="n")
    assert sorted(map(tuple, out.collect())) == [(1, "new", "done"), (2, "p", None), (3, "c", "z")]
    assert sorted((str(r.id), r.reason) for r in rejects.collect()) == [("9", "unknown"), ("None", "unknown")]
    # without an order: different columns of a key all count, the same column twice can't be decided
    out, rejects = changes.patches(table, batch, ["title", "status"])
    assert sorted(map(tuple, out.collect())) == [(1, "new", "done"), (2, "b", "y"), (3, "c", "z")]
    assert sorted(r.n for r in rejects.where("reason = 'repeated'").collect()) == [5, 6, 7]


def test_patches_equal_one_by_one(spark):
    rng = random.Random(5)
    rows = [(i, f"t{i}", f"s{i}", i) for i in range(20)]
    batch = [(rng.randrange(25), rng.sample(["title", "status", "size"], rng.randint(0, 3)), rng.choice([None, f"T{n}"]), rng.choice([None, f"S{n}"]), rng.choice([None, n]), n) for n in range(200)]
    want = {r[0]: list(r) for r in rows}
    for key, fields, title, status, size, _ in batch:
        if key in want:
            for c, v in (("title", title), ("status", status), ("size", size)):
                if c in fields:
                    want[key][["id", "title", "status", "size"].index(c)] = v
    table = spark.createDataFrame(rows, "id int, title string, status string, size int")
    df = spark.createDataFrame(batch, "id int, set_fields array<string>, title string, status string, size int, n int").repartition(4)
    out, rejects = changes.patches(table, df, ["title", "status", "size"], order="n")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.values())) and rejects.count() == sum(b[0] >= 20 for b in batch)


LOG = "n int, id int, op string, set_fields array<string>, title string, status string"


def one_by_one(table, log):
    rows, rejects, gone = {r[0]: list(r[1:]) for r in table}, [], set()
    for n, key, op, fields, title, status in sorted(log):
        fields = fields or []
        bad_patch = op == "patch" and "status" in fields and status not in ("pending", "open", "completed")
        if op not in change_log.OPERATIONS or key is None or bad_patch:
            rejects.append((n, "invalid"))
        elif (op == "insert") == (key in rows):
            rejects.append((n, "exists" if op == "insert" else "unknown"))
        elif op == "insert":
            rows[key] = [title, status or "pending", None]
        elif op == "patch":
            rows[key] = [title if "title" in fields else rows[key][0], status if "status" in fields else rows[key][1], rows[key][2]]
        elif op == "toggle":
            rows[key][1] = "pending" if rows[key][1] == "completed" else "completed"
        else:
            del rows[key]
            gone.add(key)
    return sorted((k, *v) for k, v in rows.items()), sorted(rejects), sorted(gone)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_log_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    table = [(i, f"t{i}", rng.choice(["pending", "completed", None, "odd"]), i * 10) for i in range(12)]
    keys = [rng.randrange(20) if rng.random() < 0.6 else 7 for _ in range(250)] + [None]
    log = []
    for n, key in enumerate(keys):
        op = rng.choice(["insert", "patch", "patch", "toggle", "toggle", "delete", "rename" if rng.random() < 0.1 else "patch"])
        log.append((n, key, op, rng.choice([None, [], ["title"], ["status"], ["title", "status"]]), rng.choice([None, f"T{n}"]), rng.choice([None, "pending", "open", "completed", "bad"])))
    rows = log[:]
    rng.shuffle(rows)
    base = spark.createDataFrame(table, "id int, title string, status string, size int")
    df = spark.createDataFrame(rows, LOG).repartition(3)
    valid = {"status": F.col("status").isin("pending", "open", "completed")}
    children = spark.createDataFrame([(i, i % 20) for i in range(40)], "id int, parent int")
    want, refused, gone = one_by_one(table, log)
    for chunk in (4, 1000):
        out, rejects, (kids,) = change_log.applied(base, df, [(children, "parent")], "n", defaults={"status": "pending"}, valid=valid, chunk=chunk)
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
        assert sorted((r.n, r.reason) for r in rejects.collect()) == refused
        assert sorted(r.id for r in kids.where("parent is null").collect()) == [i for i in range(40) if i % 20 in gone]


def test_an_empty_log_and_an_empty_table(spark):
    base = spark.createDataFrame([(1, "a", "s")], "id int, title string, status string")
    out, rejects, gone = change_log.apply_log(base, spark.createDataFrame([], LOG), "n")
    assert out.collect() == base.collect() and rejects.count() == gone.count() == 0
    out, rejects, gone = change_log.apply_log(base.where("false"), spark.createDataFrame([(1, 5, "insert", None, "x", None), (2, 5, "toggle", None, None, None), (3, 5, "insert", None, "y", None), (4, 6, "delete", None, None, None)], LOG), "n")
    assert list(map(tuple, out.collect())) == [(5, "x", "completed")] and sorted((r.n, r.reason) for r in rejects.collect()) == [(3, "exists"), (4, "unknown")] and gone.count() == 0
