"""Run report: per-task status rows of a run, error digests and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxgauge.operators.digest import top_errors, validation_errors


def task_status(overall: DataFrame, preflight: DataFrame, strict: bool) -> DataFrame:
    """One row per task of a run.

    ``overall``: ``task, total, outputs_evaluated, missing_outputs, error_count``; ``preflight``: ``task, errors`` for
    the tasks that did not pass their checks (they are not evaluated).
    """
    joined = overall.join(preflight.select("task", F.col("errors").alias("preflight_errors")), "task", "full")
    blocked = F.size(F.coalesce("preflight_errors", F.array().cast("array<string>"))) > 0
    complaints = validation_errors(
        F.col("total"), F.col("outputs_evaluated"), F.col("missing_outputs"), F.col("error_count"), strict)
    return joined.withColumns({
        "status": F.when(blocked, "preflight_error").otherwise("ok"),
        "validation_errors": F.when(blocked, F.array().cast("array<string>")).otherwise(complaints),
    }).withColumn("validation_count", F.size("validation_errors"))


def selected_tasks(registry: DataFrame, wanted: str = "all", include_disabled: bool = False) -> DataFrame:
    """Registry rows ``task, enabled`` to run, with the reason for those skipped."""
    if wanted != "all":
        return registry.where(F.col("task") == wanted).withColumn("skipped", F.lit(None).cast("string"))
    skip = ~F.col("enabled") & F.lit(not include_disabled)
    return registry.withColumn("skipped", F.when(skip, "disabled in registry"))


def error_digest(details: DataFrame, order: str) -> DataFrame:
    """Top error messages of every task."""
    return top_errors(details, ["task"], "error", order)
