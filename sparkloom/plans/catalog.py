"""Every query of the library with SQL for the same rows. Doubles are rounded to 6 digits on both sides; nested results
are compared as counts and id lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import columns as C
from sparkloom.functions.staging import new_folder
from sparkloom.operators import change_log, changes, checks, clean, profile, relate, score, text, text_index
from sparkloom.plans import views as V
from sparkloom.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
M = V.MEASURES
AS_OF = "2001-01-01 00:00:00"


def query(sql: str):
    """Register the function under its name, with SQL that starts from common table expressions of ``views``."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def cards(spark: SparkSession, d: str) -> DataFrame:
    return score.scorecard(V.scores(spark, d), M)


TOTAL = " + ".join(M)
CARDS = (
    V.SCORES
    + f""", totals AS (SELECT *, CAST({TOTAL} AS BIGINT) AS total, ({TOTAL}) / 5.0::DOUBLE AS average FROM scores),
cards AS (SELECT *, CASE WHEN average >= 90 THEN 'A' WHEN average >= 80 THEN 'B' WHEN average >= 70 THEN 'C' WHEN average >= 60 THEN 'D' ELSE 'F' END AS band FROM totals),
bands(band, label, pos) AS (VALUES ('A', 'Excellent', 1), ('B', 'Very Good', 2), ('C', 'Good', 3), ('D', 'Pass', 4), ('F', 'Fail', 5))"""
)
MEANS = V.SCORES + ", means AS (" + " UNION ALL ".join(f"SELECT {i} AS position, '{m}' AS measure, avg({m}) AS average FROM scores" for i, m in enumerate(M)) + ")"
MEASURE_LIST = ", ".join(M)


# scores


@query(f"WITH {CARDS} SELECT id, name, {MEASURE_LIST}, total, round(average, 6) AS average, cards.band, label AS band_label, cards.band || '     ' || label AS display FROM cards JOIN bands USING (band)")
def scorecard(spark, d):
    return r6(cards(spark, d), "average").select("id", "name", *M, "total", "average", "band", "band_label", "display")


@query(f"WITH {CARDS} SELECT count(*) AS entities, round(avg(average), 6) AS mean_average, round(median(average), 6) AS median_average, round(100.0 * count(*) FILTER (average >= 60) / count(*), 6) AS pass_rate FROM cards")
def score_summary(spark, d):
    return r6(score.score_summary(cards(spark, d)), "mean_average", "median_average", "pass_rate")


@query(f"WITH {MEANS} SELECT position, measure, round(average, 6) AS average FROM means")
def measure_averages(spark, d):
    return r6(score.measure_averages(V.scores(spark, d), M), "average")


@query(f"WITH {MEANS} SELECT measure, round(average, 6) AS average FROM means ORDER BY means.average DESC, position LIMIT 1")
def best_measure(spark, d):
    return r6(score.best_measure(V.scores(spark, d), M), "average")


@query(f"WITH {MEANS} SELECT measure, round(average, 6) AS average FROM means ORDER BY means.average, position LIMIT 1")
def worst_measure(spark, d):
    return r6(score.worst_measure(V.scores(spark, d), M), "average")


@query(f"""WITH {CARDS}, counted AS (SELECT bands.band, label, count(cards.id) AS "count" FROM bands LEFT JOIN cards USING (band) GROUP BY 1, 2)
SELECT band, label, "count", round(100.0 * "count" / (SELECT count(*) FROM cards), 6) AS percent, CAST(floor(100.0 * "count" / (SELECT count(*) FROM cards) / 5) AS BIGINT) AS bar_units FROM counted""")
def band_distribution(spark, d):
    return r6(score.band_distribution(cards(spark, d)), "percent")


@query(f"WITH {CARDS} SELECT id, round(average, 6) AS average FROM cards ORDER BY cards.average DESC, ordinal LIMIT 5")
def top_n(spark, d):
    return r6(score.top(cards(spark, d), 5), "average").select("id", "average")


@query(f"WITH {CARDS} SELECT id, round(average, 6) AS average FROM cards ORDER BY cards.average, ordinal LIMIT 5")
def bottom_n(spark, d):
    return r6(score.bottom(cards(spark, d), 5), "average").select("id", "average")


@query(f"WITH {CARDS} SELECT id, total FROM cards WHERE average < 72")
def below_threshold(spark, d):
    return score.below(cards(spark, d), 72.0).select("id", "total")


@query(f"WITH {CARDS} SELECT id, total FROM cards WHERE average >= 85")
def above_threshold(spark, d):
    return score.at_least(cards(spark, d), 85.0).select("id", "total")


@query(f"WITH {V.PARSED} SELECT id, name, ordinal, {MEASURE_LIST} FROM parsed WHERE {V.IN_RANGE}")
def scores_parse(spark, d):
    return score.accepted(score.parse_scores(V.raw_scores(spark, d), M))


@query(f"WITH {V.PARSED} SELECT id, ordinal, concat_ws(',', {', '.join(f'CASE WHEN {m} NOT BETWEEN 0 AND 100 THEN {chr(39)}{m}{chr(39)} END' for m in M)}) AS reason FROM parsed WHERE NOT ({V.IN_RANGE})")
def scores_reject(spark, d):
    return score.rejected(score.parse_scores(V.raw_scores(spark, d), M)).select("id", "ordinal", "reason")


@query(f"WITH {V.RAW_SCORES} SELECT id, view, ordinal FROM raw QUALIFY row_number() OVER (PARTITION BY id ORDER BY ordinal) = 1")
def dedup_keep_first(spark, d):
    return score.keep_first(V.raw_scores(spark, d), "id", "ordinal").select("id", "view", "ordinal")


@query(f"WITH {V.RAW_SCORES} SELECT id, view, ordinal FROM raw QUALIFY row_number() OVER (PARTITION BY id ORDER BY ordinal DESC) = 1")
def dedup_keep_last(spark, d):
    return score.keep_last(V.raw_scores(spark, d), "id", "ordinal").select("id", "view", "ordinal")


NAMED = "list(struct_pack(id := id, average := round(average, 6)) ORDER BY {order})"


@query(
    f"""WITH {CARDS}, best AS (SELECT * FROM cards ORDER BY average DESC, ordinal LIMIT 3), worst AS (SELECT * FROM cards ORDER BY average, ordinal LIMIT 3), {MEANS.partition(", means")[1].lstrip(", ")}{MEANS.partition(", means")[2]},
counted AS (SELECT bands.band, count(cards.id) AS n FROM bands LEFT JOIN cards USING (band) GROUP BY 1)
SELECT count(*) AS entities, round(avg(average), 6) AS mean_average, round(median(average), 6) AS median_average, round(100.0 * count(*) FILTER (average >= 60) / count(*), 6) AS pass_rate,
    (SELECT string_agg(id || ' ' || CAST(CAST(round(average * 10) AS BIGINT) AS VARCHAR), ',' ORDER BY average DESC, ordinal) FROM best) AS top, (SELECT string_agg(id || ' ' || CAST(CAST(round(average * 10) AS BIGINT) AS VARCHAR), ',' ORDER BY average, ordinal) FROM worst) AS bottom,
    (SELECT measure FROM means ORDER BY average DESC, position LIMIT 1) AS best_measure, (SELECT measure FROM means ORDER BY average, position LIMIT 1) AS worst_measure,
    (SELECT string_agg(band || ' ' || n, ',' ORDER BY band) FROM counted) AS bands FROM cards"""
)
def score_summary_whole(spark, d):
    out = r6(score.whole_summary(cards(spark, d), M), "mean_average", "median_average", "pass_rate")
    lists = {c: F.array_join(F.transform(c, lambda x: F.concat(x["id"], F.lit(" "), F.round(x["average"] * 10).cast("bigint").cast("string"))), ",") for c in ("top", "bottom")}
    bands = F.array_join(F.transform("bands", lambda x: F.concat(x["band"], F.lit(" "), x["count"].cast("string"))), ",")
    return out.withColumns(lists | {"bands": bands}).drop("best_average", "worst_average")


# cleaning


def _renamed(spark, d) -> DataFrame:
    return clean.renamed(V.sales(spark, d))


def _blanked(spark, d) -> DataFrame:
    return clean.without_sentinels(clean.coerced(_renamed(spark, d), pattern="yyyy-MM-dd"))


def _filled(spark, d) -> DataFrame:
    """Medians, modes and totals filled, from two evaluations of the sales."""
    derived = clean.price_and_quantity_derived(_blanked(spark, d))
    return clean.total_derived(clean.statistics_filled(derived, medians=("Quantity", "Price_Per_Unit"), modes=("Payment_Method", "Location")))


SALES_OUT = "id AS Transaction_ID, item AS Item, round(quantity, 6) AS Quantity, round(price, 6) AS Price_Per_Unit, round(total, 6) AS Total_Spent, payment AS Payment_Method, location AS Location, date AS Transaction_Date"


def _sales_out(df: DataFrame) -> DataFrame:
    return r6(df, *clean.NUMBERS).withColumn("Transaction_Date", F.col("Transaction_Date").cast("timestamp_ntz"))


@query(f"WITH {V.COERCED} SELECT {SALES_OUT} FROM coerced")
def coerce_types(spark, d):
    return _sales_out(clean.coerced(_renamed(spark, d), pattern="yyyy-MM-dd"))


@query(f"WITH {V.BLANKED} SELECT {SALES_OUT} FROM blanked")
def sentinel_to_null(spark, d):
    return _sales_out(_blanked(spark, d))


@query(f"WITH {V.DERIVED} SELECT id AS Transaction_ID, round(quantity, 6) AS Quantity, round(price, 6) AS Price_Per_Unit, round(coalesce(total, quantity * price), 6) AS Total_Spent FROM derived")
def fill_derived(spark, d):
    return r6(clean.total_derived(clean.price_and_quantity_derived(_blanked(spark, d))), *clean.NUMBERS).select("Transaction_ID", *clean.NUMBERS)


@query(f"WITH {V.IMPUTED} SELECT id AS Transaction_ID, round(quantity, 6) AS Quantity, round(price, 6) AS Price_Per_Unit FROM imputed")
def fill_median(spark, d):
    return r6(clean.median_filled(clean.price_and_quantity_derived(_blanked(spark, d))), "Quantity", "Price_Per_Unit").select("Transaction_ID", "Quantity", "Price_Per_Unit")


@query(f"WITH {V.MODED} SELECT id AS Transaction_ID, payment AS Payment_Method, location AS Location FROM moded")
def fill_mode(spark, d):
    return _filled(spark, d).select("Transaction_ID", "Payment_Method", "Location")


@query(f"WITH {V.GROUPED} SELECT round(price, 6) AS Price_Per_Unit, item AS Item FROM group_modes")
def group_mode(spark, d):
    return r6(clean.group_mode(_filled(spark, d)), "Price_Per_Unit")


@query(f"WITH {V.GROUPED} SELECT id AS Transaction_ID, item AS Item FROM cleaned")
def fill_group_mode(spark, d):
    return clean.imputed_sales(_blanked(spark, d)).select("Transaction_ID", "Item")


SEASON = "CASE WHEN month(date) IN (12, 1, 2) THEN 'Winter' WHEN month(date) IN (3, 4, 5) THEN 'Spring' WHEN month(date) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS Season"


@query(f"WITH {V.GROUPED} SELECT {SALES_OUT}, {SEASON} FROM cleaned WHERE date IS NOT NULL")
def clean_sales(spark, d):
    return _sales_out(clean.clean_sales(V.sales(spark, d), pattern="yyyy-MM-dd"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {SEASON.replace('date', 'l_shipdate')} FROM lineitem")
def season(spark, d):
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.season(F.col("l_shipdate")).alias("Season"))


# checks and profiles


@query(f"""WITH {V.TRACKER} SELECT id, 'username missing' AS rule FROM users WHERE username IS NULL OR trim(username) = '' UNION ALL
SELECT id, 'title missing' FROM projects WHERE title IS NULL OR trim(title) = ''""")
def check_not_null(spark, d):
    u = checks.not_null(V.users(spark, d), "id", ["username", "email", "hashed_password"])
    return u.select(F.col("id").cast("long").alias("id"), "rule").unionByName(checks.not_null(V.projects(spark, d), "id", ["title"]))


@query(f'WITH {V.TRACKER} SELECT title, count(*) AS "rows" FROM tasks WHERE title IS NOT NULL GROUP BY 1 HAVING count(*) > 1')
def check_unique(spark, d):
    return checks.unique(V.tasks(spark, d), "title")


@query(f'WITH {V.TRACKER}, mails AS (SELECT email FROM users UNION ALL SELECT email FROM users WHERE id % 4 = 0) SELECT email, count(*) AS "rows" FROM mails WHERE email IS NOT NULL GROUP BY 1 HAVING count(*) > 1')
def check_unique_email(spark, d):
    u = V.users(spark, d).select("id", "email")
    return checks.unique(u.unionAll(u.where("id % 4 = 0")), "email")


def _astray(df, key: str):
    """Every row; each seventh names a parent that does not exist."""
    return df.withColumn(key, F.when(F.col("id") % 7 == 2, -F.col(key) - 1).otherwise(F.col(key)))


def _astray_sql(table: str, key: str) -> str:
    return f"astray AS (SELECT * REPLACE (CASE WHEN id % 7 = 2 THEN -{key} - 1 ELSE {key} END AS {key}) FROM {table})"


@query(f"WITH {V.TRACKER}, {_astray_sql('projects', 'owner_id')} SELECT id, owner_id FROM astray WHERE owner_id IS NOT NULL AND owner_id NOT IN (SELECT id FROM users)")
def check_foreign_key(spark, d):
    return checks.foreign_key(_astray(V.projects(spark, d), "owner_id"), "owner_id", V.users(spark, d), "id").select("id", "owner_id")


SALES_COLUMNS = ("id", "item", "quantity", "price", "total", "payment", "location", "date")


@query(f"WITH {V.BLANKED} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls FROM blanked" for c in SALES_COLUMNS))
def profile_nulls(spark, d):
    return profile.nulls(_blanked(spark, d).toDF(*SALES_COLUMNS))


@query(f"WITH {V.SALES} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", 'string' AS type, count({c}) AS non_null, count(*) AS row_count FROM sales" for c in SALES_COLUMNS))
def profile_info(spark, d):
    return profile.info(V.sales(spark, d))


@query(
    f"WITH {V.BLANKED} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM blanked"
        for c in ("quantity", "price", "total")
    )
)
def profile_numeric(spark, d):
    return r6(profile.numeric(_blanked(spark, d).toDF(*SALES_COLUMNS), ["quantity", "price", "total"]), "mean", "std")


@query(SQL["profile_numeric"])
def profile_numeric_of_many(spark, d):
    return r6(profile.numeric_of_many(_blanked(spark, d).toDF(*SALES_COLUMNS), ["quantity", "price", "total"]), "mean", "std")


@query(
    f"WITH {V.SALES} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", sum(n)::BIGINT AS \"count\", count(*) AS \"unique\", first(v ORDER BY n DESC, v) AS top, max(n) AS freq FROM (SELECT {c} AS v, count(*) AS n FROM sales WHERE {c} IS NOT NULL GROUP BY 1)" for c in SALES_COLUMNS
    )
)
def profile_text(spark, d):
    return profile.text(V.sales(spark, d), SALES_COLUMNS)


@query(f"WITH {V.SALES} SELECT (SELECT count(*) FROM sales) - (SELECT count(*) FROM (SELECT DISTINCT * FROM sales)) AS duplicates")
def duplicate_count(spark, d):
    return profile.duplicate_count(V.sales(spark, d))


# relations


@query(f"WITH {CARDS} SELECT id, name, {MEASURE_LIST}, total, round(average, 6) AS average, band FROM cards WHERE id = '42'")
def find_by_id(spark, d):
    return r6(relate.find_by_id(cards(spark, d), "42"), "average").select("id", "name", *M, "total", "average", "band")


@query(f"WITH {V.TRACKER} SELECT id, title, status FROM tasks WHERE id = 37")
def find_by_key(spark, d):
    return relate.find_by_id(V.tasks(spark, d), "37").select("id", "title", "status")


@query(f"WITH {V.SCORES} SELECT id, name FROM scores WHERE contains(lower(name), 'user 12')")
def search_name(spark, d):
    return relate.search_name(V.scores(spark, d), " USER 12 ").select("id", "name")


@query(f"WITH {V.TRACKER} SELECT id FROM tasks WHERE contains(lower(coalesce(title, '')), '5') OR contains(lower(coalesce(status, '')), '5') OR (coalesce(assigned_to, 0) <> 0 AND contains(CAST(assigned_to AS VARCHAR), '5'))")
def search_fields(spark, d):
    return relate.search_fields(V.tasks(spark, d), "5", ["title", "status", "assigned_to"]).select("id")


@query(f"WITH {V.TRACKER} SELECT id, title, status FROM tasks WHERE project_id = 37")
def tasks_by_project(spark, d):
    return relate.of_parent(V.tasks(spark, d), 37).select("id", "title", "status")


@query(f"WITH {V.TRACKER} SELECT id, title FROM tasks ORDER BY id LIMIT 25 OFFSET 50")
def page(spark, d):
    return relate.page(V.tasks(spark, d), 50, 25).select("id", "title")


@query(f"WITH {V.TRACKER} SELECT id, title FROM tasks ORDER BY id LIMIT 25 OFFSET (SELECT count(*) * 9 // 10 FROM tasks)")
def page_deep(spark, d):
    t = V.tasks(spark, d)
    return relate.page(t, t.count() * 9 // 10, 25).select("id", "title")


@query(f"WITH {V.TRACKER} SELECT id, title FROM tasks WHERE id > 100 ORDER BY id LIMIT 25")
def page_after(spark, d):
    return relate.page_after(V.tasks(spark, d), 100, 25).select("id", "title")


@query(f"WITH {V.TRACKER} SELECT id, owner_id, row_number() OVER (ORDER BY owner_id DESC NULLS LAST, id) AS position FROM projects")
def sort_nulls_last(spark, d):
    return relate.numbered_nulls_last(V.projects(spark, d).select("id", "owner_id"), "owner_id", True)


@query(SQL["sort_nulls_last"])
def sort_nulls_last_all(spark, d):  # a second name
    return sort_nulls_last(spark, d)


@query(f"WITH {V.TRACKER} SELECT id, title FROM tasks ORDER BY ts DESC NULLS LAST, id LIMIT 5")
def recent_n(spark, d):
    return relate.recent(V.tasks(spark, d), 5, "ts").select("id", "title")


@query(f"WITH {V.TRACKER} SELECT 'head' AS part, id FROM (SELECT id FROM tasks ORDER BY id LIMIT 5) UNION ALL SELECT 'tail', id FROM (SELECT id FROM tasks ORDER BY id DESC LIMIT 5)")
def head_tail(spark, d):
    t = V.tasks(spark, d).select("id")
    return relate.head(t).select(F.lit("head").alias("part"), "id").unionByName(relate.tail(t).select(F.lit("tail").alias("part"), "id"))


@query(f"WITH {V.TRACKER}, {_astray_sql('tasks', 'project_id')} SELECT t.id, coalesce(nullif(p.title, ''), 'Unassigned') AS project_title FROM astray t LEFT JOIN projects p ON t.project_id = p.id")
def task_project(spark, d):
    return relate.task_project(_astray(V.tasks(spark, d), "project_id"), V.projects(spark, d)).select("id", "project_title")


@query(f"WITH {V.TRACKER} SELECT p.id, coalesce(u.username, 'Unassigned') AS owner, coalesce(u.email, '') AS owner_email, coalesce(nullif(p.description, ''), 'No description') AS description FROM projects p LEFT JOIN users u ON p.owner_id = u.id")
def project_owner(spark, d):
    return relate.project_owner(V.projects(spark, d), V.users(spark, d)).select("id", "owner", "owner_email", "description")


def _ids(c: str):
    return F.array_join(F.transform(c, lambda x: x["id"].cast("string")), ",")


TASK_IDS = "SELECT project_id, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM tasks GROUP BY 1"


@query(f"WITH {V.TRACKER} SELECT p.id, p.title, coalesce(n, 0) AS n_tasks, coalesce(ids, '') AS task_ids FROM projects p LEFT JOIN ({TASK_IDS}) t ON t.project_id = p.id")
def nested_projects(spark, d):
    out = relate.nested_projects(V.projects(spark, d), V.tasks(spark, d))
    return out.select("id", "title", F.size("tasks").cast("long").alias("n_tasks"), _ids("tasks").alias("task_ids"))


@query(f"""WITH {V.TRACKER}, own AS (SELECT owner_id, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM projects GROUP BY 1),
inner_tasks AS (SELECT owner_id, count(*) AS n FROM projects JOIN tasks ON tasks.project_id = projects.id GROUP BY 1), mine AS (SELECT assigned_to, count(*) AS n FROM tasks GROUP BY 1)
SELECT u.id, u.username, u.email, u.is_active, coalesce(own.n, 0) AS n_projects, coalesce(own.ids, '') AS project_ids, coalesce(i.n, 0) AS n_project_tasks, coalesce(m.n, 0) AS n_tasks
FROM users u LEFT JOIN own ON own.owner_id = u.id LEFT JOIN inner_tasks i ON i.owner_id = u.id LEFT JOIN mine m ON m.assigned_to = u.id""")
def nested_users(spark, d):
    out = relate.nested_users(V.users(spark, d), V.projects(spark, d), V.tasks(spark, d))
    inner = F.aggregate("projects", F.lit(0).cast("long"), lambda acc, p: acc + F.size(p["tasks"]))
    return out.select("id", "username", "email", "is_active", F.size("projects").cast("long").alias("n_projects"), _ids("projects").alias("project_ids"), inner.alias("n_project_tasks"), F.size("tasks").cast("long").alias("n_tasks"))


@query(f"WITH {V.TRACKER} SELECT p.id, coalesce(u.username, 'Unassigned') AS owner, coalesce(n, 0) AS task_count, coalesce(ids, '') AS task_ids FROM projects p LEFT JOIN users u ON u.id = p.owner_id LEFT JOIN ({TASK_IDS}) t ON t.project_id = p.id")
def project_detail(spark, d):
    out = relate.project_detail(V.projects(spark, d), V.users(spark, d), V.tasks(spark, d))
    return out.select("id", "owner", F.col("task_count").cast("long").alias("task_count"), _ids("tasks").alias("task_ids"))


@query(f"WITH {V.TRACKER} SELECT (SELECT count(*) FROM projects) AS projects, (SELECT count(*) FROM tasks) AS tasks, (SELECT count(*) FROM tasks WHERE status = 'pending') AS pending, (SELECT count(*) FROM users) AS users")
def tracker_counts(spark, d):
    return relate.tracker_counts(V.users(spark, d), V.projects(spark, d), V.tasks(spark, d))


@query(f"WITH {V.TRACKER} SELECT id, CASE status WHEN 'completed' THEN 'Completed' WHEN 'in_progress' THEN 'In Progress' ELSE 'Pending' END AS label FROM tasks")
def status_label(spark, d):
    return V.tasks(spark, d).select("id", C.status_label(F.col("status")).alias("label"))


@query(f"WITH {V.TRACKER} SELECT id, title, upper(substr(title, 1, 1)) AS initial, CASE WHEN owner_id % 2 = 0 THEN 'Inactive' ELSE 'Active' END AS state FROM projects")
def user_labels(spark, d):
    return V.projects(spark, d).select("id", "title", C.initial(F.col("title")).alias("initial"), C.active_label(F.col("owner_id") % 2 != 0).alias("state"))


@query(f"WITH {V.TRACKER} SELECT id, coalesce(strftime(ts, '%b %-d, %Y'), '-') AS day, coalesce(strftime(ts, '%b %-d, %Y, %I:%M %p'), '-') AS moment FROM tasks")
def date_labels(spark, d):
    return V.tasks(spark, d).select("id", C.date_label(F.col("ts")).alias("day"), C.time_label(F.col("ts")).alias("moment"))


AGE = " ".join(f"WHEN s >= {size} THEN s // {size} || ' {unit}' || CASE WHEN s // {size} > 1 THEN 's' ELSE '' END || ' ago'" for unit, size in C.AGE_UNITS)


@query(f"WITH {V.TRACKER}, ages AS (SELECT id, ts, CAST(epoch(TIMESTAMP '{AS_OF}') - epoch(ts) AS BIGINT) AS s FROM tasks) SELECT id, CASE WHEN ts IS NULL THEN '-' {AGE} ELSE 'Just now' END AS age FROM ages")
def relative_age(spark, d):
    return V.tasks(spark, d).select("id", C.age_label(F.col("ts"), F.lit(AS_OF).cast("timestamp")).alias("age"))


# changes


@query(f"""WITH {V.TRACKER}, batch AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 6 = 0 THEN 'nation_1@example.com' ELSE 'new' || c_custkey // 2 || '@example.com' END AS email, c_name AS username,
    CASE WHEN c_custkey % 4 = 0 THEN false END AS is_active FROM customer),
good AS (SELECT *, row_number() OVER (ORDER BY n) AS k FROM (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY email ORDER BY n) = 1) WHERE email NOT IN (SELECT email FROM users))
SELECT id, username, email, is_active FROM users UNION ALL SELECT CAST((SELECT max(id) FROM users) + k AS INT), username, email, coalesce(is_active, true) FROM good""")
def apply_inserts(spark, d):
    n = F.col("c_custkey")
    batch = V.table(spark, d, "customer").select(
        n.alias("n"), F.when(n % 6 == 0, "nation_1@example.com").otherwise(F.concat(F.lit("new"), F.floor(n / 2), F.lit("@example.com"))).alias("email"), F.col("c_name").alias("username"),
        F.lit("h").alias("hashed_password"), F.when(n % 4 == 0, False).alias("is_active"),
    )
    snapshot, _ = changes.inserts(V.users(spark, d), batch, "email", "n", {"is_active": True})
    return snapshot.select("id", "username", "email", "is_active")


# rows whose numbers agree in n // 6 are the only ones that can share a value: one walk for each such block, row by row
@query(f"""WITH RECURSIVE {V.TRACKER}, batch AS (SELECT c_custkey AS n, c_custkey // 6 AS block, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'new' || c_custkey // 2 || '@example.com' END AS email, 'name' || c_custkey // 3 AS username FROM customer),
walk AS (SELECT block, -1 AS i, CAST([] AS VARCHAR[]) AS names, CAST([] AS VARCHAR[]) AS mails, CAST(NULL AS BIGINT) AS n, false AS ok FROM (SELECT DISTINCT block FROM batch)
UNION ALL SELECT w.block, w.i + 1, CASE WHEN good THEN list_append(w.names, b.username) ELSE w.names END, CASE WHEN good AND b.email IS NOT NULL THEN list_append(w.mails, b.email) ELSE w.mails END, b.n, good
    FROM walk w LEFT JOIN batch b ON b.block = w.block AND b.n = w.block * 6 + w.i + 1, LATERAL (SELECT b.n IS NOT NULL AND NOT list_contains(w.names, b.username) AND NOT coalesce(list_contains(w.mails, b.email), false) AS good) WHERE w.i < 5),
good AS (SELECT *, row_number() OVER (ORDER BY n) AS p FROM batch WHERE n IN (SELECT n FROM walk WHERE ok))
SELECT id, username, email FROM users UNION ALL SELECT CAST((SELECT max(id) FROM users) + p AS INT), username, email FROM good""")
def apply_inserts_of_two_keys(spark, d):
    n = F.col("c_custkey")
    mail = F.when(n % 5 != 0, F.concat(F.lit("new"), F.floor(n / 2), F.lit("@example.com")))
    batch = V.table(spark, d, "customer").select(n.alias("n"), mail.alias("email"), F.concat(F.lit("name"), F.floor(n / 3)).alias("username"), F.lit("h").alias("hashed_password"), F.lit(True).alias("is_active"))
    return changes.inserts(V.users(spark, d), batch, ["username", "email"], "n")[0].select("id", "username", "email")


@query(f"WITH {V.TRACKER} SELECT id, title FROM projects UNION ALL SELECT CAST((SELECT max(id) FROM projects) + row_number() OVER (ORDER BY p_partkey) AS BIGINT), p_name FROM part")
def apply_inserts_without_key(spark, d):
    batch = V.table(spark, d, "part").select(F.col("p_partkey").alias("n"), F.col("p_name").alias("title"))
    projects = V.projects(spark, d)
    blank = {c: F.lit(None).cast(projects.schema[c].dataType) for c in projects.columns if c not in ("id", "title")}
    return changes.inserts(projects, batch.withColumns(blank), None, "n")[0].select(F.col("id").cast("long").alias("id"), "title")


UPDATES = "SELECT event_id AS n, CAST(user_id AS VARCHAR) AS id, CASE WHEN event_id % 7 = 0 THEN 'latin' ELSE event_type END AS measure, CAST(event_id % 120 AS INT) AS value FROM events"


@query(f"""WITH {V.SCORES}, updates AS ({UPDATES}), last AS (SELECT id, measure, arg_max(value, n) AS value FROM updates WHERE measure IN ('{"', '".join(M)}') AND value BETWEEN 0 AND 100 GROUP BY 1, 2)
SELECT scores.id, """ + ", ".join(f"coalesce((SELECT value FROM last WHERE last.id = scores.id AND measure = '{m}'), scores.{m}) AS {m}" for m in M) + " FROM scores")
def measure_updates(spark, d):
    n = F.col("event_id")
    batch = V.table(spark, d, "events").select(n.alias("n"), F.col("user_id").cast("string").alias("id"), F.when(n % 7 == 0, "latin").otherwise(F.col("event_type")).alias("measure"), (n % 120).cast("int").alias("value"))
    return changes.measure_updates(V.scores(spark, d), batch, M, "n")[0].select("id", *M)


@query(f"WITH {V.TRACKER} SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE title END AS title, CASE WHEN id % 6 = 1 THEN 'completed' ELSE status END AS status FROM tasks")
def apply_patches(spark, d):
    t = V.tasks(spark, d)
    fields = F.when(F.col("id") % 3 == 0, F.array(F.lit("title"))).when(F.col("id") % 3 == 1, F.array(F.lit("status"))).otherwise(F.array().cast("array<string>"))
    new = F.when(F.col("id") % 6 == 1, "completed").otherwise("lost")
    batch = t.select("id", fields.alias("set_fields"), F.lit(None).cast("string").alias("title"), new.alias("status"))
    snapshot, _ = changes.patches(t, batch, ["title", "status"], valid={"status": F.col("status").isin("pending", "in_progress", "completed")})
    return snapshot.select("id", "title", "status")


@query(f"""WITH {V.TRACKER}, batch AS (SELECT l_orderkey AS id, l_partkey AS n, l_linenumber % 3 AS f, CASE WHEN l_linenumber % 4 <> 0 THEN 'part ' || l_suppkey END AS title, CASE l_returnflag WHEN 'R' THEN 'completed' WHEN 'A' THEN 'pending' END AS status FROM lineitem),
titles AS (SELECT id, first(title ORDER BY n DESC, title DESC NULLS LAST) AS v FROM batch WHERE f <> 1 GROUP BY 1), states AS (SELECT id, first(status ORDER BY n DESC, status DESC NULLS LAST) AS v FROM batch WHERE f <> 0 GROUP BY 1)
SELECT t.id, CASE WHEN x.id IS NULL THEN t.title ELSE x.v END AS title, CASE WHEN y.id IS NULL THEN t.status ELSE y.v END AS status FROM tasks t LEFT JOIN titles x ON x.id = t.id LEFT JOIN states y ON y.id = t.id""")
def apply_patches_in_order(spark, d):
    f = F.col("l_linenumber") % 3
    fields = F.when(f == 0, F.array(F.lit("title"))).when(f == 1, F.array(F.lit("status"))).otherwise(F.array(F.lit("title"), F.lit("status")))
    title, status = F.when(F.col("l_linenumber") % 4 != 0, F.concat(F.lit("part "), "l_suppkey")), F.when(F.col("l_returnflag") == "R", "completed").when(F.col("l_returnflag") == "A", "pending")
    batch = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("n"), fields.alias("set_fields"), title.alias("title"), status.alias("status"))
    return changes.patches(V.tasks(spark, d), batch, ["title", "status"], order="n")[0].select("id", "title", "status")


#: What an event does to a task.
ACTIONS = {"view": "patch", "purchase": "patch", "signup": "insert", "click": "toggle", "error": "delete"}
CHANGES = f"""log AS (SELECT event_id AS n, user_id * 4 + event_id % 4 AS id, CASE event_type {' '.join(f"WHEN '{e}' THEN '{op}'" for e, op in ACTIONS.items())} END AS op, event_id % 3 AS f,
    CASE WHEN event_id % 5 <> 0 THEN 'T' || event_id END AS title, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' END AS status FROM events),
marked AS (SELECT *, coalesce(last_value(CASE op WHEN 'insert' THEN true WHEN 'delete' THEN false END IGNORE NULLS) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), id IN (SELECT id FROM tasks)) AS there FROM log),
ok AS (SELECT * FROM marked WHERE (op = 'insert') <> there)"""


def _log(spark, d) -> DataFrame:
    n, kinds = F.col("event_id"), F.lit(None)
    for e, op in ACTIONS.items():
        kinds = F.when(F.col("event_type") == e, op).otherwise(kinds)
    fields = F.when(n % 3 == 0, F.array(F.lit("title"))).when(n % 3 == 1, F.array(F.lit("status"))).otherwise(F.array(F.lit("title"), F.lit("status")))
    title, status = F.when(n % 5 != 0, F.concat(F.lit("T"), n)), F.when(n % 4 == 0, "pending").when(n % 4 == 1, "in_progress").when(n % 4 == 2, "completed")
    return V.table(spark, d, "events").select(n.alias("n"), (F.col("user_id") * 4 + n % 4).alias("id"), kinds.alias("op"), fields.alias("set_fields"), title.alias("title"), status.alias("status"))


@query(f"""WITH {V.TRACKER}, {CHANGES}, ends AS (SELECT id, arg_max(op, n) AS last_op FROM ok WHERE op IN ('insert', 'delete') GROUP BY 1),
titles AS (SELECT id, first(title ORDER BY n DESC) AS v FROM ok WHERE op = 'insert' OR (op = 'patch' AND f <> 1) GROUP BY 1),
states AS (SELECT id, max(n) AS at, first(CASE WHEN op = 'insert' THEN coalesce(status, 'pending') ELSE status END ORDER BY n DESC) AS v FROM ok WHERE op = 'insert' OR (op = 'patch' AND f <> 0) GROUP BY 1),
flips AS (SELECT ok.id, count(*) AS k FROM ok LEFT JOIN states s ON s.id = ok.id WHERE op = 'toggle' AND (s.at IS NULL OR n > s.at) GROUP BY 1),
keys AS (SELECT id FROM tasks UNION SELECT id FROM ends WHERE last_op = 'insert'),
base AS (SELECT keys.id, CASE WHEN x.id IS NULL THEN t.title ELSE x.v END AS title, CASE WHEN y.id IS NULL THEN t.status ELSE y.v END AS s, coalesce(k, 0) AS k FROM keys LEFT JOIN tasks t ON t.id = keys.id
    LEFT JOIN ends ON ends.id = keys.id LEFT JOIN titles x ON x.id = keys.id LEFT JOIN states y ON y.id = keys.id LEFT JOIN flips ON flips.id = keys.id WHERE coalesce(last_op, '') <> 'delete')
SELECT id, title, CASE WHEN k = 0 THEN s WHEN (k % 2 = 1) = (coalesce(s, '') = 'completed') THEN 'pending' ELSE 'completed' END AS status FROM base""")
def apply_change_log(spark, d):
    t = V.tasks(spark, d).select("id", "title", "status")
    return change_log.apply_log(t, _log(spark, d), "n", defaults={"status": "pending"})[0]


@query(f"""WITH {V.TRACKER}, {CHANGES} SELECT n, id, CASE WHEN op = 'insert' THEN 'exists' ELSE 'unknown' END AS reason FROM marked WHERE (op = 'insert') = there""")
def change_log_rejects(spark, d):
    t = V.tasks(spark, d).select("id", "title", "status")
    return change_log.apply_log(t, _log(spark, d), "n", defaults={"status": "pending"})[1].select("n", "id", "reason")


@query(f"WITH {V.TRACKER} SELECT id, CASE WHEN project_id % 2 = 0 THEN CASE WHEN status = 'completed' THEN 'pending' ELSE 'completed' END ELSE status END AS status FROM tasks")
def toggle_status(spark, d):
    t = V.tasks(spark, d)
    return changes.toggled(t, t.where("project_id % 2 = 0").select("id")).select("id", "status")


@query(f"WITH {V.TRACKER} SELECT t.id, CASE WHEN c.c_acctbal < 0 THEN NULL ELSE t.project_id END AS project_id FROM tasks t LEFT JOIN customer c ON c.c_custkey = t.project_id")
def apply_deletes(spark, d):
    gone = V.table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return changes.orphaned(V.tasks(spark, d), "project_id", gone).select("id", "project_id")


@query(f"WITH {V.TRACKER} SELECT id, title, owner_id FROM projects WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def deleted_projects(spark, d):
    gone = V.table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return changes.deletes(V.projects(spark, d), gone)[0].select("id", "title", "owner_id")


# texts


def _tokens(kept: str) -> str:
    return f"SELECT doc_id AS id, len(ws) AS n, array_to_string(ws, ' ') AS words FROM (SELECT doc_id, {V.alpha_sql('text', kept)} AS ws FROM documents)"


@query(_tokens("a-z"))
def tokens_alpha(spark, d):
    w = V.articles(spark, d).select("id", C.tokens(F.col("content")).alias("w"))
    return w.select("id", F.size("w").cast("long").alias("n"), F.array_join("w", " ").alias("words"))


@query(_tokens("a-z0-9"))
def tokens_alnum(spark, d):
    w = V.articles(spark, d).select("id", C.tokens(F.col("content"), True).alias("w"))
    return w.select("id", F.size("w").cast("long").alias("n"), F.array_join("w", " ").alias("words"))


@query(f"WITH {V.ARTICLES} SELECT term, row_number() OVER (ORDER BY term) - 1 AS position FROM (SELECT DISTINCT unnest(ws) AS term FROM words)")
def vocabulary(spark, d):
    return text.vocabulary(V.articles(spark, d))


@query(f"WITH {V.ARTICLES} SELECT id, unnest(ws) AS term FROM words")
def doc_terms(spark, d):
    return text.doc_terms(V.articles(spark, d))


@query(f"""WITH w AS (SELECT d.doc_id AS id, list_distinct({V.alpha_sql("coalesce(d.text, '')", 'a-z0-9')}) AS a, list_distinct({V.alpha_sql("coalesce(e.text, '')", 'a-z0-9')}) AS b
    FROM documents d LEFT JOIN documents e ON e.doc_id = d.doc_id + 1)
SELECT id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / sqrt(len(a) * len(b)) END, 6) AS similarity FROM w""")
def pair_similarity(spark, d):
    a = V.articles(spark, d).select("id", F.coalesce("content", F.lit("")).alias("text_a"))
    following = V.articles(spark, d).select((F.col("id") - 1).alias("id"), F.col("content").alias("text_b"))
    pairs = a.join(following, "id", "left").withColumn("text_b", F.coalesce("text_b", F.lit("")))
    return r6(text.pair_similarity(pairs), "similarity").select("id", "similarity")


SIMILAR = 0.8


@query(f"WITH {V.PAIRS} SELECT id_a, id_b, round(similarity, 6) AS similarity FROM pairs WHERE similarity >= {SIMILAR} - 1e-9")
def similarity_pairs(spark, d):
    return r6(text.similarity_pairs(V.articles(spark, d), SIMILAR), "similarity")


@query(f"""WITH {V.PAIRS}, near AS (SELECT * FROM pairs WHERE similarity >= {SIMILAR} - 1e-9) SELECT id_a, id_b, round(similarity, 6) AS similarity FROM near
UNION ALL SELECT id_b, id_a, round(similarity, 6) FROM near UNION ALL SELECT id, id, 1.0 FROM articles""")
def similarity_matrix(spark, d):
    docs = V.articles(spark, d)
    return r6(text.similarity_matrix(docs, text.similarity_pairs(docs, SIMILAR)), "similarity")


@query(f"""WITH {V.PAIRS}, near AS (SELECT * FROM pairs WHERE similarity >= {SIMILAR} - 1e-9), both_ways AS (SELECT id_a AS id, id_b AS neighbour, similarity FROM near UNION ALL SELECT id_b, id_a, similarity FROM near)
SELECT id, neighbour, round(similarity, 6) AS similarity, CAST(row_number() OVER (PARTITION BY id ORDER BY round(similarity, 9) DESC, neighbour) AS INT) AS "rank" FROM both_ways QUALIFY "rank" <= 3""")
def most_similar_all(spark, d):
    return r6(text.most_similar_texts(V.articles(spark, d), SIMILAR), "similarity")


@query(f"""WITH {V.PAIRS}, every AS (SELECT a.id AS id, b.id AS neighbour, coalesce(similarity, 0) AS similarity FROM articles a JOIN articles b ON a.id <> b.id LEFT JOIN pairs ON id_a = least(a.id, b.id) AND id_b = greatest(a.id, b.id))
SELECT id, neighbour, round(similarity, 6) AS similarity, CAST(row_number() OVER (PARTITION BY id ORDER BY round(similarity, 9) DESC, neighbour) AS INT) AS "rank" FROM every QUALIFY "rank" <= 3""")
def most_similar_each(spark, d):
    return r6(text.nearest_of_all(V.articles(spark, d)), "similarity")


@query(f"""WITH {V.PAIRS}, every AS (SELECT a.id AS id, b.id AS neighbour, coalesce(similarity, 0) AS similarity FROM articles a JOIN articles b ON a.id % 20 = 0 AND a.id <> b.id LEFT JOIN pairs ON id_a = least(a.id, b.id) AND id_b = greatest(a.id, b.id))
SELECT id, neighbour, round(similarity, 6) AS similarity, CAST(row_number() OVER (PARTITION BY id ORDER BY round(similarity, 9) DESC, neighbour) AS INT) AS "rank" FROM every QUALIFY "rank" <= 3""")
def most_similar_search(spark, d):
    return r6(text.nearest_of_all(V.articles(spark, d), wanted=F.col("id") % 20 == 0), "similarity")


@query(f"""WITH {V.ARTICLES}, one AS (SELECT ws AS w1 FROM words WHERE id = 2)
SELECT id, round(CASE WHEN len(ws) = 0 OR len(w1) = 0 THEN 0 ELSE len(list_intersect(ws, w1)) / sqrt(len(ws) * len(w1)) END, 6) AS similarity FROM words, one WHERE id <> 2 ORDER BY similarity DESC, id LIMIT 3""")
def most_similar(spark, d):
    return r6(text.most_similar(V.articles(spark, d), 2), "similarity").select("id", "similarity")


@query(SQL["most_similar"])
def most_similar_indexed(spark, d):
    docs, folder = V.articles(spark, d), new_folder(spark, "text_index")
    text_index.write_index(docs, folder)
    one = docs.where("id = 2").first()
    return r6(text_index.nearest(text_index.open_index(spark, folder), one["content"], 3, but=2), "similarity")


LOG = """lines AS (SELECT CASE WHEN event_id % 20 = 7 THEN '' WHEN event_id % 33 = 4 THEN 'junk ' || event_id
    ELSE '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] ' || upper(event_type) || CASE WHEN event_id % 2 = 0 THEN ': ' ELSE ' ' END || 'user=' || user_id END AS value FROM events)"""


@query(rf"""WITH {LOG}, parts AS (SELECT regexp_extract(value, '^\[([^\]]+)\]\s+([A-Za-z_]+):?\s*(.*)$', ['t', 'action', 'detail']) AS p FROM lines)
SELECT CAST(p.t AS TIMESTAMP) AS ts, p.action AS action, p.detail AS detail FROM parts WHERE p.action <> ''""")
def audit_log_parse(spark, d):
    return files.parse_audit(V.audit_lines(spark, d))[0].withColumn("ts", F.col("ts").cast("timestamp_ntz"))
