"""All tasks of a run side by side: common verdict columns, one summary, one overall row per task."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxgauge.operators.rollup import coverage_measures, mean, or_unknown, rate, summarise

COMMON = {
    "sample_id": "string", "language": "string", "source_dataset": "string", "has_output": "boolean",
    "target_success": "boolean", "content_preservation_pass": "boolean", "joint_success": "boolean",
    "utmos": "double", "error": "string",
}


def common_verdicts(scored: Mapping[str, DataFrame]) -> DataFrame:
    """Union of the tasks' scored tables on their common columns; a column a task lacks is null."""
    parts = []
    for task, df in scored.items():
        columns = [
            (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in COMMON.items()]
        parts.append(df.select(F.lit(task).alias("task"), *columns))
    return reduce(DataFrame.unionByName, parts)


def all_tasks_summary(verdicts: DataFrame) -> DataFrame:
    """The three headline rates by task, by language, by dataset and by task and language, in one pass."""
    done = F.col("has_output")
    dims = {
        "task": F.col("task"),
        "language": F.when(done, or_unknown(F.col("language"))),
        "dataset": F.when(done, or_unknown(F.col("source_dataset"))),
        "task_language": F.when(done, F.concat_ws("::", "task", or_unknown(F.col("language")))),
    }
    return summarise(verdicts, dims, {
        **coverage_measures(done, F.col("error")),
        "target_success_rate": rate(F.col("target_success")),
        "content_preservation_pass_rate": rate(F.col("content_preservation_pass")),
        "joint_success_rate": rate(F.col("joint_success")),
        "avg_utmos": mean(F.when(done, F.col("utmos"))),
    })


def overall_rows(summary: DataFrame) -> DataFrame:
    """One row per task (``task, total, outputs_evaluated, missing_outputs, error_count``), input of the run report."""
    return summary.where(F.col("dim") == "by_task").select(
        F.col("key").alias("task"), "total", "outputs_evaluated", "missing_outputs", "error_count")
