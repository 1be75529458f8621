"""Dataset audit: counters, duplicates, histograms, templates and lengths per task.

Input rows: ``task, sample_id, audio_path, instruction, transcript, language, source_dataset, anchor`` with the anchor
as JSON text, and ``duration`` in seconds (null when unknown).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxgauge import fixed_values as fv
from voxgauge.functions import text as tx
from voxgauge.operators.ranks import distribution, exact_median


def _count(condition: Column, name: str) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)


def _blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def counter_columns() -> list[Column]:
    """Counters that need one pass over the rows; ``_folded`` is the case-folded instruction."""
    folded = F.col("_folded")
    instruction = F.coalesce("instruction", F.lit(""))
    transcript = F.coalesce("transcript", F.lit(""))
    return [
        F.count(F.lit(1)).alias("samples"),
        _count(_blank(instruction), "empty_instruction_count"),
        _count(_blank(transcript), "empty_transcript_count"),
        _count(F.col("anchor").isNull(), "missing_anchor_count"),
        _count(tx.unbalanced_quotes(instruction), "instruction_unbalanced_quote_count"),
        _count(tx.unbalanced_quotes(transcript), "transcript_unbalanced_quote_count"),
        *[_count(tx.matches_pattern(folded, p), name) for name, p in fv.AUDIT_PATTERNS.items()],
    ]


def task_counters(rows: DataFrame) -> DataFrame:
    folded = rows.withColumn("_folded", tx.fold_case(F.coalesce("instruction", F.lit(""))))
    return folded.groupBy("task").agg(*counter_columns())


def with_audio_found(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Add ``audio_found``: whether ``audio_path`` is in the listing ``existing`` (``path``); false for no path."""
    listed = existing.select(F.col("path").alias("_listed")).distinct()
    return rows.join(listed, rows["audio_path"] == listed["_listed"], "left").withColumn(
        "audio_found", F.col("_listed").isNotNull()).drop("_listed")


def totals(rows: DataFrame) -> DataFrame:
    """Per-task counts with the cross-task total (``total`` true, task null) from one rollup.

    Needs ``audio_found``. ``duplicate_sample_id_count`` counts ids that occur more than once in their task, summed over
    tasks in the total; a missing task is a task.
    """
    per_id = rows.groupBy("task", "sample_id").agg(
        F.count(F.lit(1)).alias("n"), _count(_blank(F.col("instruction")), "blank"),
        _count(F.col("duration").isNull(), "unknown"), _count(~F.col("audio_found"), "lost"))
    return per_id.rollup("task").agg(
        (F.grouping("task") == 1).alias("total"),
        F.count_distinct(F.struct("task")).alias("tasks"),
        F.sum("n").alias("samples"), F.sum("blank").alias("empty_instruction_count"),
        F.sum("unknown").alias("missing_duration_count"), F.sum("lost").alias("missing_audio_count"),
        F.count_if(F.col("n") > 1).alias("duplicate_sample_id_count"))


def duplicate_values(rows: DataFrame, group: str, column: str, name: str) -> DataFrame:
    """Number of distinct values that occur more than once (null is a value), per group."""
    return rows.groupBy(group, column).agg(F.count(F.lit(1)).alias("_n")).groupBy(group).agg(
        F.count_if(F.col("_n") > 1).alias(name))


def distinct_texts(rows: DataFrame, group: str, column: str, name: str) -> DataFrame:
    """Exact number of different texts per group. Digests move instead of texts."""
    digests = rows.select(group, F.sha2(F.coalesce(column, F.lit("")), 256).alias("_d")).distinct()
    return digests.groupBy(group).agg(F.count(F.lit(1)).alias(name))


def histogram(rows: DataFrame, group: str, column: str) -> DataFrame:
    """Counts per value; null is shown as ``None``."""
    return rows.groupBy(group, F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("value")).agg(
        F.count(F.lit(1)).alias("count"))


def anchor_key_sets(rows: DataFrame, group: str, anchor: str) -> DataFrame:
    """Counts per set of anchor keys, keys sorted and joined by a bar; no anchor is the empty set."""
    keys = F.coalesce(F.json_object_keys(F.col(anchor)), F.array().cast("array<string>"))
    return rows.groupBy(group, F.array_join(F.array_sort(keys), "|").alias("key_set")).agg(
        F.count(F.lit(1)).alias("count"))


def label_histograms(rows: DataFrame, group: str, anchor: str,
                     keys: tuple[str, ...] = fv.AUDIT_LABEL_KEYS) -> DataFrame:
    """Counts per label of the audited anchor keys.

    A key is reported when at least one row of the group has it; rows without it count under ``None``.
    """
    present = F.coalesce(F.json_object_keys(F.col(anchor)), F.array().cast("array<string>"))
    cells = F.array(*[
        F.struct(
            F.lit(k).alias("label_key"), F.get_json_object(F.col(anchor), f"$.{k}").alias("value"),
            F.array_contains("_keys", k).alias("has"))
        for k in keys
    ])
    counted = (
        rows.select(group, anchor, present.alias("_keys"))
        .select(group, F.explode(cells).alias("c"))
        .groupBy(group, "c.label_key", "c.value").agg(
            F.count(F.lit(1)).alias("count"), F.bool_or("c.has").alias("has"))
    )
    used = counted.where("has").select(F.col(group).alias("_same"), F.col("label_key").alias("_used")).distinct()
    used = counted[group].eqNullSafe(used["_same"]) & (counted["label_key"] == used["_used"]), used
    return counted.join(used[1], used[0], "left_semi").groupBy(
        group, "label_key", F.coalesce("value", F.lit("None")).alias("value")).agg(F.sum("count").alias("count"))


def top_templates(rows: DataFrame, group: str, instruction: str, order: str,
                  k: int = fv.TOP_TEMPLATES) -> DataFrame:
    """Most frequent instruction templates per group, earlier ones first among equals."""
    counted = rows.groupBy(group, tx.template_of(F.coalesce(instruction, F.lit(""))).alias("template")).agg(
        F.count(F.lit(1)).alias("count"), F.min(order).alias("first_seen"))
    best = Window.partitionBy(group).orderBy(F.desc("count"), F.asc("first_seen"))
    return counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        group, "rank", "template", "count")


def instruction_lengths(rows: DataFrame, group: str, instruction: str) -> DataFrame:
    """Minimum, median and maximum text length per group."""
    sized = rows.select(group, F.length(F.coalesce(instruction, F.lit(""))).cast("double").alias("_len"))
    return distribution(sized, [group], "_len").select(group, "min", "median", "max")


def duration_summary(rows: DataFrame, group: str, duration: str) -> DataFrame:
    """Distribution of known durations and how many clips are short."""
    return distribution(rows, [group], duration, fv.SHORT_CLIP_SECONDS)


def beside(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with the columns of ``right`` of the same key; a null key is a key."""
    other = right.withColumnRenamed(key, "_same")
    return left.join(other, left[key].eqNullSafe(other["_same"]), "left").drop("_same")


def task_audit(rows: DataFrame) -> DataFrame:
    """All one-row-per-task results side by side; samples without a task are a task of their own.

    Needs ``audio_found``. What follows reads a narrow table: digests stand for texts, lengths for instructions.
    """
    lengths = rows.select("task", "sample_id", "audio_path", "duration", "audio_found",
                          F.sha2(F.coalesce("instruction", F.lit("")), 256).alias("_digest"),
                          F.length(F.coalesce("instruction", F.lit(""))).cast("double").alias("_len"))
    found = task_counters(rows)
    found = beside(found, lengths.groupBy("task").agg(
        _count(~F.col("audio_found"), "missing_audio_count"), F.min("_len").alias("instruction_length_min"),
        F.max("_len").alias("instruction_length_max")), "task")
    for column in ("sample_id", "audio_path"):
        found = beside(found, duplicate_values(lengths, "task", column, f"duplicate_{column}_count"), "task")
    found = beside(found, lengths.select("task", "_digest").distinct().groupBy("task").agg(
        F.count(F.lit(1)).alias("instruction_unique_count")), "task")
    found = beside(found, exact_median(lengths, ["task"], "_len", "instruction_length_median").drop("n"), "task")
    return beside(found, duration_summary(lengths, "task", "duration").withColumnRenamed("n", "durations"), "task")
