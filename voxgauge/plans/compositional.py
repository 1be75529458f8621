"""Compositional editing: component verdicts pooled per sample with three-valued logic."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERDICT_COLUMNS = ("parent_id", "component_index", "component_type", "success", "error")


def component_verdicts(components: DataFrame, judges: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Rows ``parent_id, component_index, component_type, success, error`` of all components.

    ``judges`` maps a component type to the verdict plan of its task; a type without a plan gets a null verdict and
    an error. Each plan sees only its own components (the filter reaches the scan of its scores).
    """
    parts = [
        plan(components.where(F.col("component_type") == kind)).select(
            "parent_id", "component_index", F.lit(kind).alias("component_type"),
            F.col("target_success").alias("success"), F.col("error"))
        for kind, plan in judges.items()
    ]
    known = F.coalesce(F.col("component_type").isin(*judges), F.lit(False))
    parts.append(components.where(~known).select(
        "parent_id", "component_index", "component_type", F.lit(None).cast("boolean").alias("success"),
        F.concat(F.lit("unknown component_type: "), F.coalesce("component_type", F.lit("None"))).alias("error")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pool_components(verdicts: DataFrame) -> DataFrame:
    """Per sample: component counts by outcome and whether a content component is present."""
    return verdicts.groupBy("parent_id").agg(
        F.count(F.lit(1)).alias("components_total"),
        F.count("success").alias("components_known"),
        F.count_if(F.col("success")).alias("components_passed"),
        F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("component_error_count"),
        F.coalesce(F.bool_or(F.col("component_type") == "content"), F.lit(False)).alias("has_content"),
    )


def compositional_verdicts(samples: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Samples (``sample_id, has_output, transcript, content_preservation_pass, preservation_error``) with the joint
    verdict.

    Preservation is checked only without a content component and with a transcript. Joint success is null when any
    component or the check is null; without a check it depends on the components alone; no component at all is
    success. Error texts are counted here and listed by ``component_errors``, so no list grows with a sample.
    """
    zero = F.lit(0).cast("bigint")
    pooled = samples.join(
        pool_components(verdicts).withColumnRenamed("parent_id", "sample_id"), "sample_id", "left")
    for name in ("components_total", "components_known", "components_passed", "component_error_count"):
        pooled = pooled.withColumn(name, F.when(F.col("has_output"), F.coalesce(name, zero)))
    checks = F.col("has_output") & ~F.coalesce("has_content", F.lit(False)) & (
        F.coalesce("transcript", F.lit("")) != "")
    preserved = F.when(checks, F.col("content_preservation_pass"))
    all_known = F.col("components_known") == F.col("components_total")
    all_passed = F.col("components_passed") == F.col("components_total")
    check_known = ~checks | F.col("content_preservation_pass").isNotNull()
    joint = F.when(F.col("has_output") & all_known & check_known,
                   all_passed & (~checks | F.col("content_preservation_pass")))
    check_error = F.when(checks, F.col("preservation_error"))
    return pooled.withColumns({
        "preservation_success": preserved,
        "joint_success": joint,
        "component_success_rate": F.round(F.try_divide(
            F.col("components_passed").cast("double"), F.col("components_known").cast("double")), 4),
        "preservation_error_count": F.when(
            F.col("has_output"), (F.coalesce(check_error, F.lit("")) != "").cast("bigint")),
    }).withColumn("error", F.when(
        F.col("component_error_count") + F.col("preservation_error_count") > 0,
        F.concat_ws("; ",
                    F.when(F.col("component_error_count") > 0, F.concat(
                        F.col("component_error_count").cast("string"), F.lit(" component errors"))),
                    check_error)))


def component_errors(verdicts: DataFrame) -> DataFrame:
    """The error texts themselves, one row each."""
    return verdicts.where(F.coalesce(F.col("error"), F.lit("")) != "").select(*VERDICT_COLUMNS)
