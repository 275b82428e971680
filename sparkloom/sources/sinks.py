"""Writers. Each writes a folder of part files, one per task."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scores_csv(df: DataFrame, path: str, measures: Sequence[str], mode: str = "overwrite") -> None:
    """id, name and the measures in this order; an absent measure is written as 0."""
    columns = [F.coalesce(F.col(m) if m in df.columns else F.lit(None).cast("int"), F.lit(0)).alias(m) for m in measures]
    df.select("id", "name", *columns).write.mode(mode).option("header", True).csv(path)


def table_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def quoted_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Every value in quotes, inner quotes doubled, null as an empty text."""
    df.write.mode(mode).options(header=True, quoteAll=True, escape='"').csv(path)


def matrix_parquet(pairs: DataFrame, path: str, mode: str = "overwrite") -> None:
    pairs.select("id_a", "id_b", "similarity").write.mode(mode).parquet(path)


def audit_append(events: DataFrame, path: str, batch: str | int) -> None:
    """Adds the events of one batch to a table of events. A batch has an id of letters, digits, ``-`` and ``_`` and a folder of
    its own, so a batch that is written again, by a job that was retried, replaces itself. The streaming reader writes the
    same layout."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", str(batch)):
        raise ValueError("a batch is named by letters, digits, - and _")
    events.select("ts", "action", "detail").write.mode("overwrite").parquet(f"{path}/batch={batch}")


def documents_json(nested: DataFrame, path: str, mode: str = "overwrite") -> None:
    nested.write.mode(mode).json(path)
