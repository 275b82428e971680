"""Test data in the shape of the operators' tables. Every view is derived from whole tables and grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEASURES = ("view", "signup", "click", "error", "purchase")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, d: str) -> DataFrame:
    """(ordinal, id, name, measures): a user's score per event type."""
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    cells = table(spark, d, "events").groupBy("user_id").pivot("event_type", list(MEASURES)).agg(cents)
    values = [F.coalesce((100 - F.pmod(F.col(m), F.lit(51))).cast("int"), F.lit(0)).alias(m) for m in MEASURES]
    return cells.select(F.col("user_id").alias("ordinal"), F.col("user_id").cast("string").alias("id"), F.concat(F.lit("User "), F.col("user_id")).alias("name"), *values)


SCORES = """scores AS (SELECT user_id AS ordinal, CAST(user_id AS VARCHAR) AS id, 'User ' || user_id AS name, {cells} FROM (
    SELECT user_id, event_type, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events GROUP BY 1, 2) GROUP BY user_id)""".format(
    cells=", ".join(f"coalesce(max(CASE WHEN event_type = '{m}' THEN CAST(100 - cents % 51 AS INT) END), 0) AS {m}" for m in MEASURES)
)


def raw_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores as texts, with bad cells, values out of range, blanks around names and repeated ids."""
    base = scores(spark, d)
    n = F.col("ordinal")
    cells = {m: F.when(F.pmod(n + i, F.lit(11)) == 3, "x").when(F.pmod(n + i, F.lit(13)) == 5, "").when(F.pmod(n + i, F.lit(37)) == 7, "120").otherwise(F.concat(F.lit(" "), F.col(m))) for i, m in enumerate(MEASURES)}
    raw = base.withColumns(cells | {"name": F.concat(F.lit("  "), "name", F.lit(" "))})
    again = raw.where(F.pmod(n, F.lit(10)) == 0).withColumn("ordinal", n + 1_000_000_000).withColumn("view", F.lit("77"))
    return raw.unionByName(again)


RAW_SCORES = (
    SCORES
    + ", raw_once AS (SELECT ordinal, id, '  ' || name || ' ' AS name, "
    + ", ".join(f"CASE WHEN (ordinal + {i}) % 11 = 3 THEN 'x' WHEN (ordinal + {i}) % 13 = 5 THEN '' WHEN (ordinal + {i}) % 37 = 7 THEN '120' ELSE ' ' || {m} END AS {m}" for i, m in enumerate(MEASURES))
    + " FROM scores), raw AS (SELECT * FROM raw_once UNION ALL SELECT ordinal + 1000000000, id, name, '77', "
    + ", ".join(MEASURES[1:])
    + " FROM raw_once WHERE ordinal % 10 = 0)"
)
PARSED = (
    RAW_SCORES
    + ", parsed AS (SELECT id, trim(name) AS name, ordinal, "
    + ", ".join(f"coalesce(TRY_CAST(CASE WHEN regexp_full_match(trim({m}), '[+-]?[0-9]+') THEN trim({m}) END AS INT), 0) AS {m}" for m in MEASURES)
    + " FROM raw)"
)
IN_RANGE = " AND ".join(f"{m} BETWEEN 0 AND 100" for m in MEASURES)


def sales(spark: SparkSession, d: str) -> DataFrame:
    """Line items as a dirty sales table of texts, some rows twice."""
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_size")
    rows = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    k = F.col("l_orderkey") + 3 * F.col("l_linenumber")

    def dirty(value, step: int):
        return F.when(k % step == 1, "ERROR").when(k % step == 2, "UNKNOWN").when(k % step == 3, "").otherwise(value.cast("string"))

    out = rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), dirty(F.col("p_type"), 17).alias("item"),
        dirty(F.col("l_quantity").cast("int"), 19).alias("quantity"), dirty(F.col("p_size"), 23).alias("price"), dirty((F.col("l_quantity") * F.col("p_size")).cast("int"), 29).alias("total"),
        dirty(F.col("l_returnflag"), 31).alias("payment"), dirty(F.col("l_linestatus"), 13).alias("location"), dirty(F.date_format("l_shipdate", "yyyy-MM-dd"), 37).alias("date"), k.alias("k"),
    )
    return out.unionByName(out.where(F.col("k") % 101 == 0)).drop("k")


def _dirty(value: str, step: int) -> str:
    return f"CASE k % {step} WHEN 1 THEN 'ERROR' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN '' ELSE CAST({value} AS VARCHAR) END"


SALES = f"""base AS (SELECT *, l_orderkey + 3 * l_linenumber AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
once AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, {_dirty('p_type', 17)} AS item, {_dirty('CAST(l_quantity AS INT)', 19)} AS quantity, {_dirty('p_size', 23)} AS price,
    {_dirty('CAST(l_quantity * p_size AS INT)', 29)} AS total, {_dirty('l_returnflag', 31)} AS payment, {_dirty('l_linestatus', 13)} AS location, {_dirty("strftime(l_shipdate, '%Y-%m-%d')", 37)} AS date, k FROM base),
sales AS (SELECT * EXCLUDE (k) FROM once UNION ALL SELECT * EXCLUDE (k) FROM once WHERE k % 101 = 0)"""


def _blank(c: str) -> str:
    return f"CASE WHEN {c} NOT IN ('ERROR', 'UNKNOWN', '') THEN {c} END AS {c}"


#: The steps of the cleaning chain, one table each.
COERCED = SALES + ", coerced AS (SELECT id, item, TRY_CAST(quantity AS DOUBLE) AS quantity, TRY_CAST(price AS DOUBLE) AS price, TRY_CAST(total AS DOUBLE) AS total, payment, location, TRY_CAST(date AS TIMESTAMP) AS date FROM sales)"
BLANKED = COERCED + f", blanked AS (SELECT {_blank('id')}, {_blank('item')}, quantity, price, total, {_blank('payment')}, {_blank('location')}, date FROM coerced)"
DERIVED = BLANKED + """, priced AS (SELECT * REPLACE (coalesce(price, total / nullif(quantity, 0)) AS price) FROM blanked),
derived AS (SELECT * REPLACE (coalesce(quantity, total / nullif(price, 0)) AS quantity) FROM priced)"""
IMPUTED = DERIVED + """, medians AS (SELECT median(quantity) AS mq, median(price) AS mp FROM derived),
imputed AS (SELECT * EXCLUDE (mq, mp) REPLACE (coalesce(quantity, mq) AS quantity, coalesce(price, mp) AS price) FROM derived, medians),
totalled AS (SELECT * REPLACE (coalesce(total, quantity * price) AS total) FROM imputed)"""
MODED = IMPUTED + """, pay AS (SELECT payment AS mpay FROM totalled WHERE payment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
loc AS (SELECT location AS mloc FROM totalled WHERE location IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
moded AS (SELECT * EXCLUDE (mpay, mloc) REPLACE (coalesce(payment, mpay) AS payment, coalesce(location, mloc) AS location) FROM totalled, pay, loc)"""
GROUPED = MODED + """, tallies AS (SELECT price, item, count(*) AS n FROM moded WHERE price IS NOT NULL AND item IS NOT NULL GROUP BY 1, 2),
group_modes AS (SELECT p.price, t.item FROM (SELECT DISTINCT price FROM moded WHERE price IS NOT NULL) p
    LEFT JOIN (SELECT price, item FROM tallies QUALIFY row_number() OVER (PARTITION BY price ORDER BY n DESC, item) = 1) t ON p.price = t.price),
cleaned AS (SELECT m.* REPLACE (coalesce(m.item, g.item) AS item) FROM moded m LEFT JOIN group_modes g ON m.price = g.price)"""


def users(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        n.alias("id"), F.when(n % 7 == 3, " ").otherwise(F.col("n_name")).alias("username"), F.when(n % 9 == 4, "shared@example.com").otherwise(F.concat(F.lower("n_name"), F.lit("@example.com"))).alias("email"),
        F.concat(F.lit("h"), n).alias("hashed_password"), F.when(n % 3 == 0, True).when(n % 3 == 1, False).alias("is_active"),
    )


def projects(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("id"), F.when(k % 41 == 5, "").otherwise(F.col("c_name")).alias("title"), F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, "").otherwise(F.col("c_mktsegment")).alias("description"),
        F.when(k % 10 == 9, F.lit(None)).otherwise(F.col("c_nationkey")).alias("owner_id"),
    )


def tasks(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        k.alias("id"), F.col("o_orderpriority").alias("title"), F.when(s == "P", "pending").when(s == "O", "in_progress").when((s == "F") & (k % 5 != 0), "completed").alias("status"),
        F.col("o_custkey").alias("project_id"), (k % 25).cast("int").alias("assigned_to"), F.when(k % 50 != 7, F.col("o_orderdate")).alias("ts"),
    )


TRACKER = """users AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 7 = 3 THEN ' ' ELSE n_name END AS username,
    CASE WHEN n_nationkey % 9 = 4 THEN 'shared@example.com' ELSE lower(n_name) || '@example.com' END AS email, 'h' || n_nationkey AS hashed_password,
    CASE n_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_active FROM nation),
projects AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 41 = 5 THEN '' ELSE c_name END AS title, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE c_mktsegment END AS description,
    CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE c_nationkey END AS owner_id FROM customer),
tasks AS (SELECT o_orderkey AS id, o_orderpriority AS title, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'O' THEN 'in_progress' WHEN o_orderstatus = 'F' AND o_orderkey % 5 <> 0 THEN 'completed' END AS status,
    o_custkey AS project_id, CAST(o_orderkey % 25 AS INT) AS assigned_to, CASE WHEN o_orderkey % 50 <> 7 THEN o_orderdate END AS ts FROM orders)"""


def articles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("content"))


def alpha_sql(text: str, kept: str = "a-z") -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower(coalesce({text}, '')), '[^{kept}\s]', '', 'g'), '\s+'), lambda x: x <> '')"


ARTICLES = f"articles AS (SELECT doc_id AS id, source AS title, text AS content FROM documents), words AS (SELECT id, list_distinct({alpha_sql('content')}) AS ws FROM articles)"
PAIRS = (
    ARTICLES
    + """, terms AS (SELECT id, unnest(ws) AS term FROM words), sizes AS (SELECT id, len(ws) AS n FROM words),
shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM terms a JOIN terms b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2),
pairs AS (SELECT id_a, id_b, c / sqrt(x.n * y.n) AS similarity FROM shared JOIN sizes x ON x.id = id_a JOIN sizes y ON y.id = id_b)"""
)


def audit_lines(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    line = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), F.upper("event_type"), F.when(n % 2 == 0, ": ").otherwise(" "), F.lit("user="), "user_id")
    return table(spark, d, "events").select(F.when(n % 20 == 7, "").when(n % 33 == 4, F.concat(F.lit("junk "), n)).otherwise(line).alias("value"))
