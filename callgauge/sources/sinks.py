"""Writing harness stages and judge results; stages that belong together are published together."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFESTS = "_manifests"
MANIFEST = "version bigint, run_id string, format string, stages map<string, struct<folder: string, columns: string, n_rows: bigint>>"


def publish(stages: dict[str, DataFrame], root: str, fmt: str = "json") -> str:
    """Write all stages under a run of their own, then make them visible at once; returns the run's id.

    First phase: every stage is written under ``root``/<run id> and counted from what was written. Second phase: one manifest
    row, one file, that names them all is appended to ``root``/_manifests; Spark's committer moves the file there when its job
    commits. A run that ends before leaves files that no manifest names, so ``published`` never sees part of it, and an earlier
    run stays readable while a later one is written. Of runs published at the same time the one with the larger id counts as
    the later. Stages keep their column names; a stage without columns is an error.
    """
    spark = next(iter(stages.values())).sparkSession
    run_id = uuid.uuid4().hex
    named = []
    for name, rows in stages.items():
        folder = f"{run_id}/{name}"
        rows.write.mode("error").format(fmt).save(f"{root}/{folder}")
        n_rows = spark.read.schema(rows.schema).format(fmt).load(f"{root}/{folder}").count()
        named.append((name, (folder, rows.schema.json(), n_rows)))
    last = _latest(spark, root)
    row = (last.version + 1 if last else 1, run_id, fmt, dict(named))
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{root}/{MANIFESTS}")
    return run_id


def _latest(spark: SparkSession, root: str):
    """The manifest of the last published run, or None where nothing was published."""
    try:
        manifests = spark.read.schema(MANIFEST).json(f"{root}/{MANIFESTS}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return manifests.orderBy(F.desc("version"), F.desc("run_id")).limit(1).first()


def published(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The stages of the last published run, in the columns and types they were written with."""
    last = _latest(spark, root)
    if last is None:
        raise ValueError(f"nothing was published under {root}")
    return {
        name: spark.read.schema(_schema(stage.columns)).format(last.format).load(f"{root}/{stage.folder}")
        for name, stage in last.stages.items()
    }


def published_counts(spark: SparkSession, root: str) -> dict[str, int]:
    """Rows of each stage as counted when the last run was published."""
    last = _latest(spark, root)
    return {name: stage.n_rows for name, stage in last.stages.items()} if last else {}


def _schema(text: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(text))


def write_results(results: DataFrame, path: str, salts: int = 16) -> None:
    """Write judge results by server and run kind, scores rounded to four places.

    Rows are spread over ``salts`` tasks per folder, so that one server with most of
    the rows is neither one task nor thousands of small files.
    """
    rounded = [F.round(c, 4).alias(c) if kind == "double" else F.col(c) for c, kind in results.dtypes]
    salt = F.pmod(F.xxhash64(*[c for c, kind in results.dtypes if kind in ("bigint", "string")]), F.lit(salts))
    spread = results.select(*rounded).repartition("server", "enriched", salt)
    spread.write.mode("overwrite").partitionBy("server", "enriched").parquet(path)


def result_json(results: DataFrame, keys: list[str]) -> DataFrame:
    """Results as JSON text per row, scores rounded to four places."""
    rounded = [F.round(c, 4).alias(c) if kind == "double" else F.col(c) for c, kind in results.dtypes if c not in keys]
    return results.select(*keys, F.to_json(F.struct(*rounded)).alias("result"))
