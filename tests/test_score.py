from sparkloom.operators import score

M = ("math", "art")


def frame(spark, rows):
    return spark.createDataFrame(rows, "ordinal int, id string, name string, math string, art string")


def test_parse_counts_bad_cells_as_zero_and_rejects_rows_out_of_range(spark):
    raw = frame(spark, [(1, "1", " Ann ", " 85 ", "x"), (2, "2", "Bo", "85.5", None), (3, "3", "Cy", "101", "50"), (4, "4", "Di", "-1", "50"), (5, "5", "Ed", "+5", "")])
    parsed = score.parse_scores(raw, M)
    assert [(r.id, r.name, r.math, r.art) for r in score.accepted(parsed).orderBy("id").collect()] == [("1", "Ann", 85, 0), ("2", "Bo", 0, 0), ("5", "Ed", 5, 0)]
    assert [(r.id, r.reason) for r in score.rejected(parsed).orderBy("id").collect()] == [("3", "math"), ("4", "math")]


def cards(spark, rows):
    return score.scorecard(spark.createDataFrame(rows, "ordinal int, id string, math int, art int"), M)


def test_bands_at_their_bounds(spark):
    rows = [(i, str(i), v, v) for i, v in enumerate((90, 89, 80, 70, 60, 59))]
    assert [(r.band, r.display) for r in cards(spark, rows).orderBy("ordinal").collect()][0] == ("A", "A     Excellent")
    assert [r.band for r in cards(spark, rows).orderBy("ordinal").collect()] == ["A", "B", "B", "C", "D", "F"]


def test_ties_keep_input_order(spark):
    c = cards(spark, [(1, "a", 70, 80), (2, "b", 80, 70), (3, "c", 75, 75), (4, "d", 10, 20)])
    assert [r.id for r in score.top(c, 2).collect()] == ["a", "b"]
    assert [r.id for r in score.bottom(c, 2).collect()] == ["d", "a"]
    assert [r.id for r in score.below(c, 60.0).collect()] == ["d"]
    assert sorted(r.id for r in score.at_least(c, 75.0).collect()) == ["a", "b", "c"]


def test_equal_measures_and_empty_tables(spark):
    c = cards(spark, [(1, "a", 70, 70)])
    assert score.best_measure(c, M).first().measure == score.worst_measure(c, M).first().measure == "math"
    none = cards(spark, [])
    assert score.score_summary(none).first().asDict() == {"entities": 0, "mean_average": 0.0, "median_average": 0.0, "pass_rate": 0.0}
    assert score.best_measure(none, M).first().asDict() == {"measure": None, "average": 0.0}
    assert [r["count"] for r in score.band_distribution(none).collect()] == [0] * 5
    assert [r.average for r in score.measure_averages(none, M).collect()] == [0.0, 0.0]


def test_median_of_even_and_odd(spark):
    c = cards(spark, [(1, "a", 60, 60), (2, "b", 70, 70), (3, "c", 90, 90), (4, "d", 100, 100)])
    assert score.score_summary(c).first().median_average == 80.0
    assert score.score_summary(c.where("id <> 'd'")).first().median_average == 70.0
    assert sum(r["count"] for r in score.band_distribution(c).collect()) == 4


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], "ordinal int, id string, v string")
    assert sorted((r.id, r.v) for r in score.keep_first(df, "id", "ordinal").collect()) == [("a", "x"), ("b", "z")]
    assert sorted((r.id, r.v) for r in score.keep_last(df, "id", "ordinal").collect()) == [("a", "y"), ("b", "z")]
