"""Batches of inserts, patches and deletes: a snapshot and a frame of changes give a new snapshot and the rejects.

Each function takes changes of one kind; :mod:`sparkloom.operators.change_log` takes all kinds in one order.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.ordering import numbered
from sparkloom.functions.staging import dropped, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package
#: Undecided rows up to which one task finishes what the rounds have left.
LEFT = 100_000


def _values(batch: DataFrame, unique: Sequence[str]) -> DataFrame:
    """(_row, column, value) of the values of the unique columns; nulls are never equal, so they have none."""
    cells = [F.struct(F.lit(i).alias("column"), F.col(c).cast("string").alias("value")) for i, c in enumerate(unique)]
    return batch.select("_row", F.inline(F.array(*cells))).where("value is not null")


def _one_after_the_other(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Accepts rows in order unless one of their values is taken; ``parts`` are all undecided rows of a bounded number."""
    held = list(parts)
    if not held:
        return
    held = pd.concat(held)
    taken, good = set(), []
    for row, group in held.sort_values("_row").groupby("_row", sort=True):
        cells = set(zip(group["column"], group["value"], strict=True))
        if not cells & taken:
            taken |= cells
            good.append(row)
    yield pd.DataFrame({"_row": pd.Series(good, dtype="int64")})


def without_conflicts(values: DataFrame, left: int = LEFT) -> DataFrame:
    """(_row): the rows that stand if rows are taken in the order of ``_row`` and one goes where it shares a value with an earlier
    row that stands. ``values``: (_row, column, value), each row with one at least.

    In rounds: a row that is the first undecided one at all of its values stands, and who shares a value with it goes.
    Each round decides the first undecided row of every chain of conflicts, and those it refuses; chains that are longer than
    the rounds reach are, once ``left`` rows or fewer are undecided, settled by one task. Every round is staged."""
    open_, standing = staged(values, "undecided"), []
    while True:
        n = open_.select("_row").distinct().count()
        if n <= left:
            standing.append(staged(open_.coalesce(1).mapInPandas(_one_after_the_other, "_row long"), "standing"))
            break
        first = open_.groupBy("column", "value").agg(F.min("_row").alias("first"))
        marked = open_.join(first, ["column", "value"])
        good = staged(marked.groupBy("_row").agg(F.bool_and(F.col("_row") == F.col("first")).alias("stands")).where("stands").select("_row"), "standing")
        taken = first.join(good, F.col("first") == F.col("_row")).select("column", "value", "first")
        gone = open_.join(taken, ["column", "value"]).select("_row").distinct()  # those that stand too
        rest = staged(open_.join(gone, "_row", "left_anti"), "undecided")
        dropped(open_)
        open_ = rest
        standing.append(good)
    dropped(open_)
    return reduce(DataFrame.unionByName, standing)


def inserts(table: DataFrame, new: DataFrame, unique: str | Sequence[str] | None, order: str, defaults: dict[str, object] | None = None, key: str = "id", left: int = LEFT) -> tuple[DataFrame, DataFrame]:
    """(snapshot, rejects), as if the rows came one by one in the order of ``order`` (rows that agree in it, in an order that is
    fixed once): a row is refused if a value of one of its ``unique`` columns (one, several or none) is in the table or in
    an earlier row that was accepted; nulls are never equal. Ids go on from the table's largest in that order; nulls of the
    columns in ``defaults`` take the default."""
    names = [unique] if isinstance(unique, str) else list(unique or ())
    batch = staged(numbered(new, order, *[c for c in new.columns if c != order], name="_row"), "batch")
    bad = None
    if names:
        cells = _values(batch, names)
        known = reduce(DataFrame.unionByName, [table.select(F.lit(i).alias("column"), F.col(c).cast("string").alias("value")) for i, c in enumerate(names)])
        taken = staged(cells.join(known.distinct(), ["column", "value"], "left_semi").select("_row").distinct(), "taken")
        free = staged(cells.join(taken, "_row", "left_anti"), "free")
        # a value of one row alone is in no conflict
        shared = free.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        disputed = staged(free.join(free.join(shared, ["column", "value"], "left_semi").select("_row").distinct(), "_row", "left_semi"), "disputed")
        standing = without_conflicts(disputed, left)
        bad = staged(taken.unionByName(disputed.select("_row").distinct().join(standing, "_row", "left_anti")), "refused")
        dropped(taken, free, disputed)
    good = batch if bad is None else batch.join(bad, "_row", "left_anti")
    refused = batch.where("false") if bad is None else batch.join(bad, "_row", "left_semi")
    last = table.agg(F.coalesce(F.max(F.col(key).try_cast("bigint")), F.lit(0)).alias("_last"))
    added = numbered(good, "_row", name="_pos").join(F.broadcast(last))
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()}
    added = added.withColumn(key, (F.col("_last") + 1 + F.col("_pos")).cast(table.schema[key].dataType)).withColumns(filled)
    return table.unionByName(added.select(table.columns)), refused.select(new.columns)


def folded(changes: DataFrame, columns: Sequence[str], key: str, order: str) -> DataFrame:
    """One row per key: for each column ``_new_<column>``, null if no change sets it, else a structure whose ``v`` is the value
    of the last change that does; a value that is set to null is such a structure too. Of changes that agree in the order
    the largest value counts. Each column folds by itself in a maximum, so a key of any number of changes is reduced in
    parts before it is shuffled."""
    last = [F.max(F.when(F.array_contains("set_fields", c), F.struct(F.col(order).alias("o"), F.col(c).alias("v")))).alias(f"_new_{c}") for c in columns]
    return changes.groupBy(key).agg(*last)


def patches(table: DataFrame, changes: DataFrame, columns: Sequence[str], key: str = "id", valid: dict[str, Column] | None = None, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(snapshot, rejects). ``changes`` has rows of a key with ``set_fields``, the names of the columns that are set;
    a column that is set to null becomes null. ``valid``: conditions on new values (named as in ``changes``); a change
    that breaks one, or whose key is unknown, is refused. All changes of a key count, in the order of ``order``: each
    column takes the value of the last change that sets it. Without an order, changes of a key that set a column which
    another one sets too are refused as repeated."""
    ok = F.lit(True)
    for c, condition in (valid or {}).items():
        ok = ok & (~F.array_contains("set_fields", c) | F.coalesce(condition, F.lit(False)))
    judged = changes.withColumn("_ok", F.coalesce(ok, F.lit(True)))
    sent, repeated = judged.where("_ok"), judged.where("false")
    if order is None:
        often = sent.groupBy(key).agg(*[F.count_if(F.array_contains("set_fields", c)).alias(f"_n_{c}") for c in columns])
        again = reduce(Column.__or__, [F.array_contains("set_fields", c) & (F.col(f"_n_{c}") > 1) for c in columns], F.lit(False))
        sent = sent.join(often.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key"))).withColumn("_again", F.coalesce(again, F.lit(False)))
        repeated, sent = sent.where("_again"), sent.where("not _again")
    kept = sent.withColumn("_order", F.col(order) if order else F.lit(0))
    joined = table.join(folded(kept, columns, key, "_order"), key, "left")
    out = joined.withColumns({c: F.when(F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}.v").cast(table.schema[c].dataType)).otherwise(F.col(c)) for c in columns})
    unknown = sent.join(table.select(key), key, "left_anti").select(changes.columns).withColumn("reason", F.lit("unknown"))
    refused = judged.where("not _ok").select(changes.columns).withColumn("reason", F.lit("invalid"))
    return out.select(table.columns), unknown.unionByName(repeated.select(changes.columns).withColumn("reason", F.lit("repeated"))).unionByName(refused)


def measure_updates(scores: DataFrame, changes: DataFrame, measures: Sequence[str], order: str, key: str = "id", low: float = 0, high: float = 100) -> tuple[DataFrame, DataFrame]:
    """(snapshot, rejects) of single values: ``changes`` has (key, measure, value). A measure that isn't among ``measures``, a
    value that is null or not from ``low`` to ``high``, and an unknown key are refused, each with its reason. Of several
    values of one key and measure the last in ``order`` counts."""
    reason = F.when(~F.coalesce(F.col("measure").isin(*measures), F.lit(False)), "measure").when(~F.coalesce(F.col("value").between(low, high), F.lit(False)), "value")
    judged = changes.withColumn("reason", reason)
    latest = [F.max_by(F.when(F.col("measure") == m, F.col("value")), F.when(F.col("measure") == m, F.col(order))).alias(f"_new_{m}") for m in measures]
    wide = judged.where("reason is null").groupBy(key).agg(*latest)
    out = scores.join(wide, key, "left").withColumns({m: F.coalesce(F.col(f"_new_{m}").cast(scores.schema[m].dataType), F.col(m)) for m in measures})
    unknown = judged.where("reason is null").join(scores.select(key), key, "left_anti").select(*changes.columns, F.lit("unknown").alias("reason"))
    return out.select(scores.columns), judged.where("reason is not null").select(*changes.columns, "reason").unionByName(unknown)


def toggled(tasks: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Status flipped for the listed ids: completed becomes pending, all else completed."""
    hit = tasks.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    flipped = F.when(F.col("status") == "completed", "pending").otherwise("completed")
    return hit.withColumn("status", F.when(F.col("_hit"), flipped).otherwise(F.col("status"))).select(tasks.columns)


def deletes(table: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(snapshot, rejects): rows of the listed ids go; ids that don't exist are rejects."""
    asked = ids.select(key).distinct()
    return table.join(asked, key, "left_anti").select(table.columns), asked.join(table.select(key), key, "left_anti")


def orphaned(children: DataFrame, column: str, deleted: DataFrame, key: str = "id") -> DataFrame:
    """Children of deleted parents keep their row and lose the reference."""
    gone = deleted.select(F.col(key).alias(column)).distinct().withColumn("_gone", F.lit(True))
    out = children.join(gone, column, "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column)))
    return out.select(children.columns)
