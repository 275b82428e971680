"""One ordered log of mixed changes, applied by its net effect.

A log has inserts, patches, toggles and deletes of any keys in one order. What comes out is what applying them one by one
would give, but no key's changes are gathered: whether a row exists before a change follows from the last insert or delete
of its key, which is found by chunks of the log (:func:`existing_before`), and the values of a key fold column by column in
maxima (an accepted insert sets every column, so it hides what was before it). A key may hold any share of the log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.ordering import numbered
from sparkloom.functions.staging import dropped, staged

#: Rows of the log that one window looks at together.
CHUNK = 1 << 16
INSERT, PATCH, TOGGLE, DELETE = OPERATIONS = ("insert", "patch", "toggle", "delete")


def existing_before(log: DataFrame, table: DataFrame, key: str, chunk: int = CHUNK) -> DataFrame:
    """``log`` (staged, with ``_at``, its position) with ``_exists``: whether the key has a row before the change. After an insert
    it has one, refused or not, and after a delete none; the last of them within the chunk decides, else the last of the
    chunks before, of which a key has one row each, else the table."""
    chunked = log.withColumn("_chunk", F.floor(F.col("_at") / chunk)).withColumn("_made", F.when(F.col("op") == INSERT, True).when(F.col("op") == DELETE, False))
    ends = chunked.where("_made is not null").groupBy(key, "_chunk").agg(F.max(F.struct("_at", "_made")).alias("end"))
    steps = chunked.select(key, "_chunk").distinct().join(ends, [key, "_chunk"], "left")
    so_far = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.select(F.col(key).alias("_key"), F.col("_chunk").alias("_c"), F.last("end._made", ignorenulls=True).over(so_far).alias("_carried"))
    within = Window.partitionBy(key, "_chunk").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = chunked.withColumn("_within", F.last("_made", ignorenulls=True).over(within))
    placed = placed.join(carried, (F.col(key) == F.col("_key")) & (F.col("_chunk") == F.col("_c"))).drop("_key", "_c")
    there = table.select(F.col(key).alias("_key"), F.lit(True).alias("_there"))
    placed = placed.join(there, F.col(key) == F.col("_key"), "left")
    return placed.withColumn("_exists", F.coalesce("_within", "_carried", "_there", F.lit(False))).drop("_key", "_there", "_within", "_carried", "_made", "_chunk")


def apply_log(
    table: DataFrame, log: DataFrame, order: str, key: str = "id", status: str = "status", done: str = "completed", undone: str = "pending",
    defaults: dict[str, object] | None = None, valid: dict[str, Column] | None = None, chunk: int = CHUNK,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(snapshot, rejects, deleted) of a table with unique keys and a log of (``order``, key, ``op``, ``set_fields``, columns of the
    table as far as they change). Changes that agree in the order are taken in an order that is fixed once.

    insert: a new row of the log's values, with ``defaults`` for nulls; refused as ``exists`` where the key has a row.
    patch: the columns of ``set_fields`` take the log's values, nulls too. toggle: ``status`` becomes ``undone`` if it is ``done``,
    else ``done``. delete: the row goes. The last three are refused as ``unknown`` where the key has no row. A patch that
    breaks a condition of ``valid`` on a column it sets, an operation of another name and a change without a key are refused as
    ``invalid``. ``deleted`` has the keys that lost a row at any time, whose children are orphans even if the key came back.
    """
    columns = [c for c in table.columns if c != key]
    sets = lambda c: F.coalesce(F.array_contains("set_fields", c), F.lit(False))
    fits = F.lit(True)
    for c, condition in (valid or {}).items():
        fits = fits & (~sets(c) | F.coalesce(condition, F.lit(False)))
    sound = F.coalesce(F.col("op").isin(*OPERATIONS), F.lit(False)) & F.col(key).isNotNull() & ((F.col("op") != PATCH) | fits)
    ordered = staged(numbered(log.withColumn("_sound", sound), order, *[c for c in log.columns if c != order], name="_at"), "log")
    judged = staged(existing_before(ordered.where("_sound"), table, key, chunk), "judged")
    accepted = judged.where((F.col("op") == INSERT) != F.col("_exists"))
    refused = judged.where((F.col("op") == INSERT) == F.col("_exists")).withColumn("reason", F.when(F.col("op") == INSERT, "exists").otherwise("unknown"))
    rejects = refused.select(*log.columns, "reason").unionByName(ordered.where("not _sound").select(*log.columns, F.lit("invalid").alias("reason")))

    made = F.col("op") == INSERT
    given = {c: F.col(c) if c in log.columns else F.lit(None).cast(table.schema[c].dataType) for c in columns}
    value = {c: F.when(made, F.coalesce(given[c], F.lit((defaults or {}).get(c)))).otherwise(given[c]).cast(table.schema[c].dataType) for c in columns}
    last = [F.max(F.when(made | ((F.col("op") == PATCH) & sets(c)), F.struct(F.col("_at").alias("o"), value[c].alias("v")))).alias(f"_new_{c}") for c in columns]
    end = F.max(F.when(F.col("op").isin(INSERT, DELETE), F.struct("_at", made.alias("alive")))).alias("_end")
    net = accepted.groupBy(F.col(key).alias("_key")).agg(end, *last)
    if status in columns:
        flips = accepted.where(F.col("op") == TOGGLE).select(F.col(key).alias("_k"), "_at")
        since = net.select("_key", F.col(f"_new_{status}.o").alias("_since"))
        counts = flips.join(since, F.col("_k") == F.col("_key")).where(F.coalesce(F.col("_at") > F.col("_since"), F.lit(True))).groupBy("_k").agg(F.count(F.lit(1)).alias("_flips"))
        net = net.join(counts, F.col("_key") == F.col("_k"), "left").drop("_k")
    net = staged(net, "net")
    joined = table.join(net, F.col(key) == F.col("_key"), "full")
    joined = joined.where(F.coalesce(F.col("_end.alive"), F.col(key).isNotNull()))
    out = joined.withColumns({c: F.when(F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}.v")).otherwise(F.col(c)) for c in columns} | {key: F.coalesce(key, "_key")})
    if status in columns:
        first = F.when(F.col(status) == done, undone).otherwise(done)
        again = F.when(first == done, undone).otherwise(done)
        flips = F.coalesce("_flips", F.lit(0))
        out = out.withColumn(status, F.when(flips == 0, F.col(status)).when(flips % 2 == 1, first).otherwise(again))
    gone = staged(accepted.where(F.col("op") == DELETE).select(key).distinct(), "deleted")
    return out.select(table.columns), rejects, gone


def applied(table: DataFrame, log: DataFrame, children: Sequence[tuple[DataFrame, str]], order: str, key: str = "id", **options) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """As :func:`apply_log`, with the children (table, name of the reference) of the rows: they lose the reference to a row that
    went at any time."""
    from sparkloom.operators.changes import orphaned

    out, rejects, gone = apply_log(table, log, order, key, **options)
    return out, rejects, [orphaned(df, column, gone, key) for df, column in children]
