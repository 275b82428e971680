"""Audit logs as a stream: log files that arrive in a folder become typed events in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sparkloom.sources.files import parse_audit
from sparkloom.sources.sinks import audit_append


def follow(spark: SparkSession, folder: str, table: str, checkpoint: str, available_now: bool = True, rejects: str | None = None) -> StreamingQuery:
    """Append the events of new files to a table of events, and the lines that can't be read to the table ``rejects``, by
    default ``<table>_rejects``. Each batch is named by its number and replaces itself if it is written again, so with the
    checkpoint folder both tables get each line once. Blank lines are neither."""
    bad_lines = rejects or f"{table.rstrip('/')}_rejects"

    def both(batch: DataFrame, number: int) -> None:
        good, bad = parse_audit(batch)
        audit_append(good, table, number)
        bad.write.mode("overwrite").parquet(f"{bad_lines}/batch={number}")

    writer = spark.readStream.text(folder).writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
