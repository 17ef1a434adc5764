"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The last of several equal JSON keys wins, as in most JSON readers.
SETTINGS = {
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Sizes guessed before a run are those of compressed files, and rows made by generators and aggregations are not in them: a
    # table of gigabytes may look like 10 MB. Only sizes measured in a shuffle, and tables counted and marked, are broadcast.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    # Streaming state off the heap; timers and lists need this store.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a session on one machine (``local[..]``, as in tests) makes a local folder; a cluster has to name one.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or spark.conf.get("callgauge.scratch.dir", None)
    if base is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="callgauge-")
        spark.conf.set("callgauge.scratch.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def saved(frame: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``frame`` to the shared folder and read it back.

    It survives a lost executor. Unlike after ``checkpoint``, which hands on the estimated size of the plan before it, the
    planner then knows the size; in a loop of joins the estimate would grow to numbers of thousands of digits.
    """
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def ship_code(spark: SparkSession) -> None:
    """Send this library to the Python workers, once for each session; a cluster's machines need not have it."""
    context = spark.sparkContext
    if getattr(context, "_callgauge_sent", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="callgauge-code-"), "callgauge-code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._callgauge_sent = True


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table written out in code, planned as a local relation in one partition."""
    fields = T._parse_datatype_string(schema).fields
    columns = [pa.array([row[i] for row in rows]) for i in range(len(fields))]
    plain = spark.createDataFrame(pa.table(columns, names=[f.name for f in fields]))
    return plain.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]).coalesce(1)
