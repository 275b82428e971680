"""Intermediate tables in a folder that all executors share.

What several steps read, or what a step must not compute twice (positions that depend on how rows were dealt), is written
there as Parquet and read back, so nothing is held in executors' memory and a lost executor costs a task.
"""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders that are there to be deleted.
FOLDERS: list[str] = []
#: Rows, and bytes of files, up to which one side of a join is sent to every task.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one in the warehouse, which must not be a machine's own
    folder unless Spark runs on that machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_loom"
    if not re.match(r"local(\[.*\])?$", spark.sparkContext.master) and re.match(r"file:|/", folder):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one. It is deleted by :func:`remove`, or when the driver's Python ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not FOLDERS:
        atexit.register(_remove_all, spark)
    FOLDERS.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new folder and read back."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return opened(spark, path, schema)


def opened(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A Parquet table in the shared folder, as a frame that can be measured."""
    back = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    back._staged_at = path
    return back


def path_of(df: DataFrame) -> str | None:
    """Where a frame was staged; frames made from it have no such place."""
    return getattr(df, "_staged_at", None)


def is_small(df: DataFrame) -> bool:
    """Whether a staged frame may be sent to every task: measured, in bytes of its files and in rows."""
    files, target = _folder(df.sparkSession, path_of(df))
    return files.getContentSummary(target).getLength() <= BROADCAST_BYTES and df.count() <= BROADCAST_ROWS


def sized(df: DataFrame) -> DataFrame:
    """A staged frame as one side of a join: sent to every task if it is small, else left to a shuffle."""
    return F.broadcast(df) if is_small(df) else df


def dropped(*frames: DataFrame) -> None:
    """Delete what :func:`staged` has written for these frames; they must not be read again."""
    for df in frames:
        if path := path_of(df):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    files, target = _folder(spark, path)
    files.delete(target, True)
    if path in FOLDERS:
        FOLDERS.remove(path)


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _remove_all(spark: SparkSession) -> None:
    for path in list(FOLDERS):
        try:
            remove(spark, path)
        except Exception:  # the JVM may have ended first
            return
