import pytest
from pyspark.sql import functions as F

from sparkloom.operators import relate
from sparkloom.sources import files, sinks
from sparkloom.streaming import audit


def test_scores_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,name,math,art\n1, Ann ,90,x\n2,Bo,101,5\n1,Again,1,1\n3,Cy\n")
    good, bad = files.scores(spark, str(tmp_path / "in.csv"), ["math", "art"])
    assert sorted((r.id, r.name, r.math, r.art) for r in good.collect()) == [("1", "Ann", 90, 0), ("3", "Cy", 0, 0)]
    assert [r.id for r in bad.collect()] == ["2"]
    sinks.scores_csv(good, str(tmp_path / "out"), ["math", "art", "music"])
    again = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert again.columns == ["id", "name", "math", "art", "music"] and [r.music for r in again.collect()] == ["0", "0"]


def test_articles_refuse_a_bad_id(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,title,content\n1,T,"one, ""two""\nthree"\n')
    assert [(r.id, r.content) for r in files.articles(spark, str(tmp_path / "a.csv")).collect()] == [(1, 'one, "two"\nthree')]
    (tmp_path / "b.csv").write_text("id,title,content\nx,T,C\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.articles(spark, str(tmp_path / "b.csv")).collect()


def test_sales_nulls_and_keyed_rows(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a,b\nNA,1\nx,\n")
    assert [tuple(r) for r in files.sales(spark, str(tmp_path / "s.csv"), ["a", "b"]).collect()] == [(None, "1"), ("x", None)]
    (tmp_path / "k.csv").write_text("u,p\na,1\nb,2\na,3\n")
    assert sorted(map(tuple, files.keyed(spark, str(tmp_path / "k.csv"), ["u", "p"], "u").collect())) == [("a", "3"), ("b", "2")]


def test_quoted_csv(spark, tmp_path):
    sinks.quoted_csv(spark.createDataFrame([(1, 'say "hi"', None)], "a int, b string, c string").coalesce(1), str(tmp_path / "q"))
    lines = next((tmp_path / "q").glob("part-*")).read_text().splitlines()
    assert lines[1] == '"1","say ""hi""",""'


def test_plain_csv_json_and_matrix(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 0.5)], "id_a int, id_b int, similarity double")
    sinks.table_csv(df, str(tmp_path / "c"))
    sinks.matrix_parquet(df, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).collect() == df.collect()
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 1
    p = spark.createDataFrame([(1, "P")], "id int, title string")
    t = spark.createDataFrame([(5, 1)], "id int, project_id int")
    sinks.documents_json(relate.nested_projects(p, t), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().tasks[0].id == 5


LOG = "[2024-01-02 03:04:05] LOGIN user=a role=b\n\njunk\n[2024-01-02 03:04:06] ADD student: x\n[bad] ADD y\n[2024-01-02 03:04:07] LOGOUT\n"


def test_audit_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text(LOG)
    events, rejects = files.audit_log(spark, str(tmp_path / "log.txt"))
    assert [(r.action, r.detail) for r in events.orderBy("ts").collect()] == [("LOGIN", "user=a role=b"), ("ADD", "student: x"), ("LOGOUT", "")]
    assert sorted(r.line for r in rejects.collect()) == ["[bad] ADD y", "junk"]
    for batch in ("a", "b", "b"):  # the last is a job that runs again
        sinks.audit_append(events, str(tmp_path / "events"), batch)
    assert files.audit_events(spark, str(tmp_path / "events")).count() == 6
    sinks.audit_append(events.limit(1), str(tmp_path / "events"), "b")
    assert files.audit_events(spark, str(tmp_path / "events")).count() == 4
    with pytest.raises(ValueError):
        sinks.audit_append(events, str(tmp_path / "events"), "../x")


def test_audit_stream_reads_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text(LOG)
    for extra in (0, 1, 0):
        if extra:
            (tmp_path / "in" / "2.txt").write_text(LOG)
        audit.follow(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 6


def test_database_table_is_read_in_ranges(spark):
    url = "jdbc:derby:memory:loom;create=true"
    spark.range(100).select(F.col("id").cast("int").alias("ID"), F.concat(F.lit("n"), "id").alias("NAME")).write.jdbc(url, "PEOPLE")
    df = files.database_table(spark, url, "PEOPLE", "ID", 0, 100, 4)
    assert df.rdd.getNumPartitions() == 4 and sorted(r.ID for r in df.where("ID >= 90").collect()) == list(range(90, 100))
    assert "PushedFilters: [*IsNotNull(ID), *GreaterThanOrEqual(ID,90)]" in df.where("ID >= 90")._jdf.queryExecution().toString()


def test_stream_keeps_unreadable_lines(spark, tmp_path):
    logs, at = tmp_path / "logs", [str(tmp_path / x) for x in ("table", "checkpoint", "rejects")]
    logs.mkdir()
    (logs / "a.txt").write_text("[2024-01-01 10:00:00] ADD: x\njunk\n\n")
    audit.follow(spark, str(logs), at[0], at[1], rejects=at[2]).awaitTermination()
    (logs / "b.txt").write_text("[2024-01-02 10:00:00] DELETE y\nmore junk\n")
    audit.follow(spark, str(logs), at[0], at[1], rejects=at[2]).awaitTermination()
    assert sorted(r.action for r in spark.read.parquet(at[0]).collect()) == ["ADD", "DELETE"]
    assert sorted(r.line for r in spark.read.parquet(at[2]).collect()) == ["junk", "more junk"]


def test_stream_writes_rejects_by_default_in_the_layout_of_batches(spark, tmp_path):
    logs, table = tmp_path / "logs", str(tmp_path / "table")
    logs.mkdir()
    (logs / "a.txt").write_text("[2024-01-01 10:00:00] ADD: x\njunk\n\n")
    audit.follow(spark, str(logs), table, str(tmp_path / "c")).awaitTermination()
    events = files.audit_events(spark, table)
    assert [(r.action, r.detail) for r in events.collect()] == [("ADD", "x")] and [r.line for r in spark.read.parquet(f"{table}_rejects").collect()] == ["junk"]
    sinks.audit_append(spark.createDataFrame(events.collect(), events.schema), table, "by-hand")
    assert files.audit_events(spark, table).count() == 2


def test_database_table_in_ranges_of_equal_rows(spark):
    url = "jdbc:derby:memory:loom2;create=true"
    rows = [(i, f"n{i}") for i in range(90)] + [(10**6 + i * 1000, "far") for i in range(10)] + [(None, "none")] * 2
    spark.createDataFrame(rows, "ID int, NAME string").write.jdbc(url, "PEOPLE")
    df = files.database_table_by_quantiles(spark, url, "PEOPLE", "ID", 4)
    sizes = [len(p) for p in df.rdd.glom().collect()]
    assert df.count() == len(rows) and len(sizes) == 4 and max(sizes) <= 30
    assert files.database_table_by_quantiles(spark, url, "PEOPLE", "ID", 1).count() == len(rows)
