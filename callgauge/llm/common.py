"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import callgauge
from callgauge.session import configure, scratch_path


ARROW_ROWS = 1000


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings of the library, its code sent to the Python workers."""
    context = spark.sparkContext
    if not getattr(context, "_callgauge_sent", False):
        root = os.path.dirname(callgauge.__file__)
        archive = os.path.join(tempfile.mkdtemp(prefix="callgauge-code-"), "callgauge-code.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(root):
                for name in sorted(n for n in names if n.endswith(".py")):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
        context.addPyFile(archive)
        context._callgauge_sent = True
    # Rows hold whole texts: batches of few rows keep the workers' memory low.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    configure(spark)
    # Here joins are with tables that were written before, so the planner knows what is small.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(frame: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back.

    Unlike a cached frame it survives a lost executor, and the planner knows its size,
    so that a join with it is broadcast exactly when it is small.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


BROADCAST_ROWS = 2_000_000


def small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``frame`` (written, of a few narrow columns) marked for broadcast if it has at most so many rows, else as it is.

    Rows of two longs take about 32 bytes in the broadcast table, so the bound is about 64 MB.
    """
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fresh(frame: DataFrame, stem: str) -> str:
    """A column name that ``frame`` does not hold yet, whatever its case."""
    taken, name = {c.lower() for c in frame.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name
