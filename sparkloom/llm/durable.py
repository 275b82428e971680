"""Tables written to the cluster's shared folder, to cut lineage and to share work between jobs; joins by measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import staging
from sparkloom.functions.staging import dropped as discard
from sparkloom.functions.staging import is_small, new_folder, opened, remove, shared_folder
from sparkloom.functions.staging import staged as written

__all__ = ["discard", "discard_since", "is_small", "mark", "new_folder", "opened", "remove", "shared_folder", "sized_join", "written"]


def sized_join(df: DataFrame, keys: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join ``df`` with ``keys``, a frame from :func:`written`, on columns of both in which nulls are equal; the columns of
    ``df``, then the others of ``keys``. Small ``keys`` are sent to every task, so that the rows of ``df`` stay where they
    are; else both sides are shuffled."""
    on = [on] if isinstance(on, str) else on
    other = keys.withColumnsRenamed({c: f"{c}__" for c in on})
    match = [df[c].eqNullSafe(other[f"{c}__"]) for c in on]
    joined = df.join(F.broadcast(other) if is_small(keys) else other, match, how)
    return joined if how in ("left_anti", "left_semi") else joined.drop(*[f"{c}__" for c in on])


def mark() -> int:
    """What :func:`discard_since` takes: how much has been written so far."""
    return len(staging.FOLDERS)


def discard_since(spark: SparkSession, before: int, kept: DataFrame) -> None:
    """Delete all that was written since :func:`mark`, but for ``kept``. Only one thread of a driver may use these two."""
    for path in staging.FOLDERS[before:]:
        if path != staging.path_of(kept):
            remove(spark, path)
