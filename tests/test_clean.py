import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import checks, clean, profile

RAW = "a string, b string, c string, d string, e string, f string, g string, h string"


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


ROWS = [
    ("T1", "Tea", "2", "1.5", "3", "Cash", "Shop", "2023-12-31"),
    ("T2", "ERROR", "2", "", "3", "UNKNOWN", "Shop", "2023-03-01"),
    ("T3", "Tea", "ERROR", "1.5", "6", "Cash", "", "2023-06-01"),
    ("T4", "Cake", "0", "nan", "5", "Card", "Home", "2023-11-30"),
    ("T5", "Cake", "", "", "", "Card", "Home", "bad"),
    ("T6", "Cake", "4", "3", "ERROR", "Card", "Home", "2023-02-28"),
]


def test_chain(spark):
    out = {r.Transaction_ID: r for r in clean.clean_sales(raw(spark, ROWS), "yyyy-MM-dd").collect()}
    assert sorted(out) == ["T1", "T2", "T3", "T4", "T6"]  # a bad date drops the row
    assert out["T2"].Price_Per_Unit == 1.5 and out["T2"].Item == "Cake"  # derived price, then the price's usual item; two of each, so the smaller
    assert out["T3"].Quantity == 4.0
    assert out["T4"].Price_Per_Unit == 1.5  # 5 / 0 fills nothing, nan is missing: the median does
    assert out["T6"].Total_Spent == 12.0
    assert out["T2"].Payment_Method == "Card" and out["T3"].Location == "Home"
    assert [out[k].Season for k in ("T1", "T2", "T3", "T4", "T6")] == ["Winter", "Spring", "Summer", "Fall", "Winter"]


def test_seasons_by_month(spark):
    days = spark.createDataFrame([(m, datetime.datetime(2023, m, 15)) for m in range(1, 13)] + [(0, None)], "m int, Transaction_Date timestamp")
    got = {r.m: r.Season for r in clean.with_season(days).collect()}
    assert got == {0: None, 12: "Winter", **{m: "Winter" for m in (1, 2)}, **{m: "Spring" for m in (3, 4, 5)}, **{m: "Summer" for m in (6, 7, 8)}, **{m: "Fall" for m in (9, 10, 11)}}


def test_modes_prefer_the_smallest_of_equals_and_skip_nulls(spark):
    df = spark.createDataFrame([(1.0, "b"), (1.0, "a"), (1.0, None), (2.0, None), (None, "z")], "Price_Per_Unit double, Item string")
    assert sorted((r.Price_Per_Unit, r.Item) for r in clean.group_mode(df).collect() if r.Item) == [(1.0, "a")]
    assert [r.Item for r in clean.group_mode(df).where("Price_Per_Unit = 2").collect()] == [None]
    filled = clean.group_mode_filled(df)
    assert filled.where("Price_Per_Unit = 1 and Item = 'a'").count() == 2 and filled.count() == 5


def test_rename_checks_the_number_of_columns(spark):
    with pytest.raises(ValueError):
        clean.renamed(raw(spark, ROWS).drop("h"))


def test_profiles(spark):
    df = raw(spark, [*ROWS, ROWS[0], (None,) * 8])
    assert {r["column"]: r.nulls for r in profile.nulls(df).collect()}["a"] == 1
    assert profile.info(df).where("column = 'a'").first().asDict() == {"column": "a", "type": "string", "non_null": 7, "row_count": 8}
    assert profile.duplicate_count(df).first().duplicates == 1
    assert profile.duplicate_count(df.limit(0)).first().duplicates == 0
    top = profile.text(df, ["f"]).first()
    assert (top["count"], top.unique, top.top, top.freq) == (7, 3, "Card", 3)
    n = profile.numeric(spark.range(1, 5), ["id"]).first()
    assert (n["count"], n["mean"], n.q25, n.q50, n.q75, n["max"]) == (4, 2.5, 1.75, 2.5, 3.25, 4.0)


def test_checks(spark):
    df = spark.createDataFrame([(1, "a", "x@y.zz", 1), (2, " ", "x@y.zz", 9), (3, None, "bad", None)], "id int, name string, email string, fk int")
    assert sorted((r.id, r.rule) for r in checks.not_null(df, "id", ["name"]).collect()) == [(2, "name missing"), (3, "name missing")]
    assert [(r.email, r["rows"]) for r in checks.unique(df, "email").collect()] == [("x@y.zz", 2)]
    assert [r.id for r in checks.foreign_key(df, "fk", df, "id").collect()] == [2]
    shapes = {"a@b.co": True, "a@b": False, "@b.co": False, "a b@c.de": False, "a@@b.co": False, None: False, "a@b.c.d": True, "a@b..c": False}
    mails = spark.createDataFrame([(k,) for k in shapes], "e string")
    assert {r.e: r.ok for r in mails.select("e", checks.email_shape(F.col("e")).alias("ok")).collect()} == shapes
