"""Run digests: error messages, validation, run status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxgauge import fixed_values as fv
from voxgauge.functions.text import strip


def error_messages(details: DataFrame, groups: Sequence[str], error: str, order: str) -> DataFrame:
    """Count and first appearance of every non-empty error message; ``order`` numbers the rows."""
    return details.where(F.coalesce(F.col(error), F.lit("")) != "").groupBy(
        *groups, strip(F.col(error)).alias("message")).agg(
        F.count(F.lit(1)).alias("count"), F.min(order).alias("first_seen"))


def top_errors(details: DataFrame, groups: Sequence[str], error: str, order: str,
               k: int = fv.TOP_ERRORS) -> DataFrame:
    """The ``k`` most frequent messages per group, earlier ones first among equals."""
    counted = error_messages(details, groups, error, order)
    ranked = Window.partitionBy(*groups).orderBy(F.desc("count"), F.asc("first_seen"), F.asc("message"))
    return counted.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        *groups, "rank", "message", "count")


def validation_errors(total: Column, evaluated: Column, missing: Column, errors: Column,
                      strict: bool) -> Column:
    """Array of run-level complaints about one task's overall row."""
    checks = [F.when((total > 0) & (evaluated == 0), "no model outputs were evaluated")]
    if strict:
        checks.append(F.when(missing > 0, F.concat(F.lit("missing model outputs: "), missing.cast("string"))))
        checks.append(F.when(errors > 0, F.concat(
            F.lit("sample-level evaluation errors: "), errors.cast("string"))))
    return F.array_compact(F.array(*checks))


def run_status(task_runs: DataFrame) -> DataFrame:
    """One row per run from ``run_id, task, status, dataset_version, validation_count`` rows (one per task).

    A run fails when a task has a fatal status or any validation error. The maps have one entry per task that ran, in the
    registry or not; the rows of a run are its tasks, so its lists stay short.
    """
    fatal = F.col("status").isin(*fv.FATAL_STATUSES)
    invalid = F.coalesce(F.col("validation_count"), F.lit(0)) > 0

    def task_map(value: Column, keep: Column) -> Column:
        entries = F.collect_list(F.when(keep, F.struct(F.col("task").alias("key"), value.alias("value"))))
        return F.map_from_entries(F.array_sort(entries))

    return task_runs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count_if(F.col("status") == "ok").alias("ok_tasks"),
        task_map(F.col("status"), fatal).alias("failed_status_tasks"),
        task_map(F.col("dataset_version"), F.col("dataset_version").isNotNull()).alias("dataset_versions"),
        F.when(F.bool_or(fatal | invalid), "failed").otherwise("ok").alias("status"),
    )
