"""Run history and response log: append-only tables and their latest views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from voxgauge import schemas

RUN_KEYS = ("model_name", "task_id", "eval_set")


def stamp(results: DataFrame, **metadata: str | None) -> DataFrame:
    """Attach run metadata (dataset version, evaluator version, model, task, eval set, samples file)."""
    return results.withColumns({name: F.lit(value).cast("string") for name, value in metadata.items()})


def append_run(results: DataFrame, path: str) -> None:
    """Append one run; earlier runs stay. Rows of a partition meet first, so that it gets few files."""
    keys = [*RUN_KEYS, "run_id"]
    results.repartition(*keys).write.mode("append").partitionBy(*keys).parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs. Models, eval sets and run ids may look like numbers but are text: their types are given, not inferred."""
    columns = spark.read.parquet(path).schema
    keys = {*RUN_KEYS, "run_id"}
    typed = StructType([StructField(c.name, StringType() if c.name in keys else c.dataType) for c in columns])
    return spark.read.schema(typed).parquet(path)


def latest_runs(runs: DataFrame, keys: Sequence[str] = RUN_KEYS, run: str = "run_id") -> DataFrame:
    """Rows of the newest run per key. Run ids sort by time, so the newest is the largest."""
    newest = runs.groupBy(*keys).agg(F.max(run).alias(run))
    return runs.join(newest, [*keys, run], "left_semi")


def append_responses(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response log; ``obj`` is kept as JSON text, unreadable lines come back with null keys."""
    return spark.read.schema(schemas.RESPONSE_LOG).json(path)
