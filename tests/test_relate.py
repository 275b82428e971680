import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.ordering import exact_quantiles, numbered
from sparkloom.functions import columns as C
from sparkloom.operators import changes, relate
from sparkloom.plans import catalog
from sparkloom.plans import views as V


@pytest.fixture(scope="module")
def tracker(spark):
    users = spark.createDataFrame([(1, "ann", "a@x.yz", "h", True), (2, "bo", "b@x.yz", "h", None), (3, "cy", "c@x.yz", "h", False)], "id int, username string, email string, hashed_password string, is_active boolean")
    projects = spark.createDataFrame([(1, "P", None, 1), (2, "", "", 9), (3, "Q", "d", None)], "id int, title string, description string, owner_id int")
    tasks = spark.createDataFrame(
        [(1, "t1", None, "pending", 1, 1), (2, "t2", None, "completed", 1, 2), (3, "t3", None, None, 2, None), (4, "t4", None, "odd", 7, 1)], "id int, title string, description string, status string, project_id int, assigned_to int"
    )
    return users, projects, tasks


def test_lookups(tracker):
    users, projects, tasks = tracker
    assert [r.project_title for r in relate.task_project(tasks, projects).orderBy("id").collect()] == ["P", "P", "Unassigned", "Unassigned"]
    rows = relate.project_owner(projects, users).orderBy("id").collect()
    assert [(r.owner, r.owner_email, r.description) for r in rows] == [("ann", "a@x.yz", "No description"), ("Unassigned", "", "No description"), ("Unassigned", "", "d")]


def test_nesting(tracker):
    users, projects, tasks = tracker
    nested = {r.id: [t.id for t in r.tasks] for r in relate.nested_projects(projects, tasks).collect()}
    assert nested == {1: [1, 2], 2: [3], 3: []}
    out = relate.nested_users(users, projects, tasks)
    assert "hashed_password" not in out.columns
    ann = out.where("id = 1").first()
    assert [[t.id for t in p.tasks] for p in ann.projects] == [[1, 2]] and [t.id for t in ann.tasks] == [1, 4]
    assert out.where("id = 3").first().projects == []
    assert {r.id: r.task_count for r in relate.project_detail(projects, users, tasks).collect()} == {1: 2, 2: 1, 3: 0}
    assert relate.tracker_counts(users, projects, tasks).first().asDict() == {"projects": 3, "tasks": 4, "pending": 1, "users": 3}


def test_paging_joins_up_to_the_whole_table(tracker):
    tasks = tracker[2]
    assert [r.id for s in (0, 2) for r in relate.page(tasks, s, 2).collect()] == [1, 2, 3, 4]
    for skip, limit in ((-1, 5), (0, 0), (0, 101)):
        with pytest.raises(ValueError):
            relate.page(tasks, skip, limit)


def test_search_and_sort(spark, tracker):
    users, projects, tasks = tracker
    df = spark.createDataFrame([(1, "100% Sure", 0, True), (2, None, 10, False), (3, "sure_", None, None)], "id int, name string, n int, b boolean")
    assert [r.id for r in relate.search_name(df, " SURE ").orderBy("id").collect()] == [1, 3]
    assert [r.id for r in relate.search_name(df, "%").collect()] == [1]
    assert [r.id for r in relate.search_fields(df, "0", ["name", "n"]).orderBy("id").collect()] == [1, 2]
    assert [r.id for r in relate.search_fields(df, "fal", ["b"]).collect()] == []
    assert relate.search_fields(df, "", ["b"]).count() == 3
    assert [r.id for r in relate.sorted_nulls_last(df, "n").collect()] == [1, 2, 3] and [r.id for r in relate.sorted_nulls_last(df, "n", True).collect()] == [2, 1, 3]
    assert relate.of_parent(tasks, 0).count() == relate.of_parent(tasks, None).count() == 4 and relate.of_parent(tasks, 1).count() == 2
    assert [r.id for r in relate.find_by_id(users, "2").collect()] == [r.id for r in relate.find_by_id(users, 2).collect()] == [2] and relate.find_by_id(users, "two").count() == 0
    assert [r.id for r in relate.tail(tasks, 2).collect()] == [3, 4] and [r.id for r in relate.recent(tasks, 2).collect()] == [1, 2]


def test_labels(spark):
    row = spark.range(1)
    ts = F.lit("2024-01-05 15:07:00").cast("timestamp")
    assert row.select(C.date_label(ts), C.time_label(ts), C.date_label(F.lit(None).cast("timestamp"))).first()[:] == ("Jan 5, 2024", "Jan 5, 2024, 03:07 PM", "-")
    statuses = spark.createDataFrame([("completed",), ("in_progress",), ("pending",), ("odd",), (None,)], "s string")
    assert [r[0] for r in statuses.select(C.status_label(F.col("s"))).collect()] == ["Completed", "In Progress", "Pending", "Pending", "Pending"]
    active = spark.createDataFrame([(True,), (False,), (None,)], "a boolean")
    assert [r[0] for r in active.select(C.active_label(F.col("a"))).collect()] == ["Active", "Inactive", "Active"]


@pytest.mark.parametrize(("seconds", "label"), [(59, "Just now"), (60, "1 minute ago"), (119, "1 minute ago"), (3600, "1 hour ago"), (6 * 86400, "6 days ago"), (7 * 86400, "1 week ago"), (30 * 86400, "1 month ago"), (730 * 86400, "2 years ago"), (-5, "Just now")])
def test_ages(spark, seconds, label):
    now = datetime.datetime(2024, 6, 1)
    df = spark.createDataFrame([(now - datetime.timedelta(seconds=seconds),)], "ts timestamp")
    assert df.select(C.age_label(F.col("ts"), F.lit(now))).first()[0] == label


def test_inserts(spark, tracker):
    users = tracker[0]
    new = spark.createDataFrame([(1, "d", "d@x.yz", "h", None), (2, "e", "a@x.yz", "h", True), (3, "f", "d@x.yz", "h", True), (4, "g", "g@x.yz", "h", False)], "n int, username string, email string, hashed_password string, is_active boolean")
    snapshot, rejects = changes.inserts(users, new, "email", "n", {"is_active": True})
    assert [(r.id, r.username, r.is_active) for r in snapshot.where("id > 3").orderBy("id").collect()] == [(4, "d", True), (5, "g", False)]
    assert sorted(r.n for r in rejects.collect()) == [2, 3]
    first, _ = changes.inserts(users.limit(0), new.where("n = 1"), "email", "n")
    assert first.first().id == 1
    back, unknown = changes.deletes(snapshot, snapshot.where("id > 3").select("id"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, users.collect()), key=str) and unknown.count() == 0


def test_inserts_with_several_unique_columns_nulls_or_none(spark, tracker):
    users = tracker[0]
    rows = [(1, "d", None, "h", True), (2, "e", None, "h", True), (3, "d", "z@x.yz", "h", True), (4, "f", "a@x.yz", "h", True), (5, "g", "z@x.yz", "h", True), (6, "h", "z@x.yz", "h", True)]
    new = spark.createDataFrame(rows, "n int, username string, email string, hashed_password string, is_active boolean")
    snapshot, rejects = changes.inserts(users, new, ["username", "email"], "n")
    assert [(r.id, r.username) for r in snapshot.where("id > 3").orderBy("id").collect()] == [(4, "d"), (5, "e"), (6, "g")]
    assert sorted(r.n for r in rejects.collect()) == [3, 4, 6]  # a name, an address of the table, an address of the batch
    snapshot, rejects = changes.inserts(users, new, None, "n")
    assert [r.username for r in snapshot.where("id > 3").orderBy("id").collect()] == ["d", "e", "d", "f", "g", "h"] and rejects.count() == 0


def test_measure_updates(spark):
    scores = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "id string, math int, art int")
    batch = spark.createDataFrame([(1, "a", "math", 50), (2, "a", "math", 60), (3, "a", "latin", 7), (4, "b", "art", 101), (5, "b", "art", None), (6, "z", "art", 5), (7, "b", "math", 0), (8, "b", None, 1)], "n int, id string, measure string, value int")
    out, rejects = changes.measure_updates(scores, batch, ["math", "art"], "n")
    assert sorted(map(tuple, out.collect())) == [("a", 60, 2), ("b", 0, 4)]
    assert sorted((r.n, r.reason) for r in rejects.collect()) == [(3, "measure"), (4, "value"), (5, "value"), (6, "unknown"), (8, "measure")]


def test_patches_that_repeat_a_key(spark, tracker):
    tasks = tracker[2]
    batch = spark.createDataFrame([(1, ["title"], "x", 1), (1, ["title"], "y", 2)], "id int, set_fields array<string>, title string, n int")
    out, rejects = changes.patches(tasks, batch, ["title"], order="n")  # both are applied, the later one over the earlier
    assert out.count() == tasks.count() and out.where("id = 1").first().title == "y" and rejects.count() == 0
    out, rejects = changes.patches(tasks, batch, ["title"])
    assert out.count() == tasks.count() and rejects.count() == 2


def test_children_in_chunks(spark):
    tasks = spark.createDataFrame([(i, i % 3 or None) for i in range(50)], "id int, project_id int")
    out = relate.children_in_chunks(tasks, "project_id", "tasks", 4).collect()
    assert all(len(r.tasks) <= 4 for r in out)
    for p in (1, 2):
        mine = sorted((r.chunk, [t.id for t in r.tasks]) for r in out if r.project_id == p)
        assert [i for _, ids in mine for i in ids] == [i for i in range(50) if i % 3 == p] and [c for c, _ in mine] == list(range(len(mine)))


def test_positions_and_quantiles_of_many_partitions(spark):
    values = [(i * 7919 % 1000, float(i * 31 % 97) if i % 11 else None, None) for i in range(1000)]
    df = spark.createDataFrame(values, "k int, x double, y double").repartition(13)
    assert [(r.k, r.position) for r in numbered(df, "k").orderBy("position").collect()] == [(i, i) for i in range(1000)]
    assert numbered(df.limit(0), "k").count() == 0
    got = {r.column: r[1:] for r in exact_quantiles(df, ["k", "x", "y"], (0.0, 0.1, 0.5, 0.75, 1.0)).collect()}
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, (0.0, 0.1, 0.5, 0.75, 1.0)))).alias(c) for c in ("k", "x")]).first()
    assert set(got) == {"k", "x"} and all([round(v, 9) for v in got[c][1:]] == [round(v, 9) for v in want[c]] for c in got)


def test_patches_tell_unset_from_null(spark, tracker):
    tasks = tracker[2]
    batch = spark.createDataFrame([(1, ["title"], None, "x"), (2, ["status"], None, "pending"), (3, ["status"], None, "bad"), (99, ["title"], "n", None)], "id int, set_fields array<string>, title string, status string")
    out, rejects = changes.patches(tasks, batch, ["title", "status"], valid={"status": F.col("status").isin("pending", "completed")})
    assert [(r.title, r.status) for r in out.orderBy("id").collect()] == [(None, "pending"), ("t2", "pending"), ("t3", None), ("t4", "odd")]
    assert sorted((r.id, r.reason) for r in rejects.collect()) == [(3, "invalid"), (99, "unknown")]


def test_toggle_delete_orphan(spark, tracker):
    tasks = tracker[2]
    ids = spark.createDataFrame([(1,), (2,), (3,), (1,)], "id int")
    assert [r.status for r in changes.toggled(tasks, ids).orderBy("id").collect()] == ["completed", "pending", "completed", "odd"]
    left, unknown = changes.deletes(tasks, spark.createDataFrame([(1,), (50,)], "id int"))
    assert left.count() == 3 and [r.id for r in unknown.collect()] == [50]
    assert [r.project_id for r in changes.orphaned(tasks, "project_id", spark.createDataFrame([(1,)], "id int")).orderBy("id").collect()] == [None, None, 2, 7]


def test_all_projects_are_sorted_and_those_without_owner_come_last(spark, tables):
    rows = catalog.QUERIES["sort_nulls_last_all"](spark, tables).collect()
    want = sorted(((r.id, r.owner_id) for r in V.projects(spark, tables).collect()), key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert [(r.id, r.owner_id) for r in sorted(rows, key=lambda r: r.position)] == want and sorted(r.position for r in rows) == list(range(1, len(want) + 1))
    assert len(want) > 100 and want[-1][1] is None


def test_deep_pages_are_cut_from_counted_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(relate, "HEAP", 20)
    monkeypatch.setattr(relate, "PARTS", 8)
    keys = [None] * 5 + [i * i * 3 - 1000 for i in range(400)] + [10**12 + i for i in range(300)] + [-(2**63), 2**63 - 1]
    spark.createDataFrame([(k, str(k)) for k in keys], "id long, name string").repartition(7).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    want = sorted(keys, key=lambda k: (k is not None, k or 0))
    for skip in (0, 3, 15, 40, 390, 403, 404, 500, 690, 700, 705, 706, 5000):
        assert [r.id for r in relate.page(df, skip, 10).orderBy("id").collect()] == want[skip : skip + 10]
    low, high, before, rows = relate.range_of(df, 600, "id", -(2**63), 2**63 - 1)
    assert before <= 600 < before + rows <= before + 20 and sum(k is not None and low <= k <= high for k in keys) == rows
    tied = spark.createDataFrame([(7, i) for i in range(100)] + [(9, i) for i in range(30)], "id int, n int")
    parts = [r for skip in range(0, 130, 10) for r in relate.page(tied, skip, 10).collect()]
    assert [r.id for r in parts] == [7] * 100 + [9] * 30
    assert [r.name for r in relate.page(df, 704, 5, "name").orderBy("name").collect()] == sorted(map(str, want))[704:709]


def test_pages_one_after_the_other(spark):
    df = spark.createDataFrame([(k,) for k in (5, 3, None, 9, 1)], "id int")
    seen, after = [], None
    while rows := [r.id for r in relate.page_after(df, after, 2).collect()]:
        seen, after = seen + rows, rows[-1]
    assert seen == [1, 3, 5, 9]


def test_positions_keep_no_cache_and_replace_their_column(spark):
    df = spark.createDataFrame([(i, -i) for i in range(50)], "k int, position int").repartition(5)
    out = numbered(df, "k")
    assert out.columns == ["k", "position"] and [(r.k, r.position) for r in out.orderBy("k").collect()] == [(i, i) for i in range(50)]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0 and "InMemoryTableScan" not in out._jdf.queryExecution().toString()
