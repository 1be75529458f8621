"""Dataset readiness: manifest against files, required scorer groups against available ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxgauge import fixed_values as fv


def reconcile(manifest: DataFrame, sample_counts: DataFrame, declared: DataFrame, present: DataFrame,
              local_files: DataFrame) -> DataFrame:
    """One row per manifest task: expected, declared, present and missing counts.

    ``manifest``: ``task_id, samples, audio_files``; ``sample_counts``: ``task_id, n``; ``declared``: distinct
    ``task_id, path``; ``present``: distinct ``path``; ``local_files``: ``task_id, n`` files on disk.
    """
    found = present.select("path").distinct().withColumn("_here", F.lit(True))
    status = declared.join(found, "path", "left").groupBy("task_id").agg(
        F.count(F.lit(1)).alias("declared_audio_files"),
        F.count("_here").alias("audio_files"))
    zero = F.lit(0).cast("bigint")
    joined = (
        manifest.select("task_id", F.col("samples").alias("expected_samples"),
                        F.col("audio_files").alias("expected_audio_files"))
        .join(sample_counts.select("task_id", F.col("n").alias("samples")), "task_id", "left")
        .join(status, "task_id", "left")
        .join(local_files.select("task_id", F.col("n").alias("_local")), "task_id", "left")
        .withColumns({
            "declared_audio_files": F.coalesce("declared_audio_files", zero),
            "audio_files": F.coalesce("audio_files", zero),
        })
    )
    missing = F.col("declared_audio_files") - F.col("audio_files")
    manifest_ok = F.col("declared_audio_files") == F.col("expected_audio_files")
    return joined.select(
        "task_id", "samples", "expected_samples",
        F.coalesce(F.col("samples") == F.col("expected_samples"), F.lit(False)).alias("samples_ok"),
        "declared_audio_files", "audio_files", "expected_audio_files",
        manifest_ok.alias("audio_manifest_ok"),
        (manifest_ok & (missing == 0)).alias("audio_complete"),
        missing.alias("missing_audio_count"),
        F.greatest(zero, F.coalesce("_local", zero) - F.col("audio_files")).alias("extra_audio_files"),
    )


def missing_paths(declared: DataFrame, present: DataFrame) -> DataFrame:
    """Declared paths that do not exist: all of them."""
    return declared.join(present.select("path").distinct(), "path", "left_anti")


def first_missing_paths(missing: DataFrame, group: str, k: int = fv.MISSING_PATHS_SHOWN) -> DataFrame:
    """The first ``k`` missing paths per group in ascending order, for the report."""
    first = Window.partitionBy(group).orderBy("path")
    return missing.withColumn("position", F.row_number().over(first)).where(F.col("position") <= k)


def sample_languages(samples: DataFrame) -> DataFrame:
    """Distinct ``(task, language)`` of samples and components; English when a task names none."""
    own = samples.select("task", F.col("language"))
    parts = samples.select("task", F.explode("components").alias("c")).select(
        "task", F.col("c.source_language").alias("language"))
    named = own.union(parts).where(F.coalesce("language", F.lit("")) != "").distinct()
    silent = samples.select("task").distinct().join(named.select("task").distinct(), "task", "left_anti")
    return named.union(silent.select("task", F.lit("en").alias("language")))


def component_type(component: Column) -> Column:
    named = F.coalesce(F.nullif(component["component_type"], F.lit("")), component["edit_type"], F.lit(""))
    return F.replace(named, F.lit("_editing"), F.lit(""))


def _facts(samples: DataFrame) -> DataFrame:
    """Distinct combinations of the fields that decide the required groups: a short table."""
    def pick(anchor: Column) -> list[Column]:
        return [anchor[n].alias(n) for n in ("subtask", "env_type", "env_subtype", "prosody_type")]

    atomic = samples.where(F.col("task") != "compositional_editing").select(
        "task", F.replace(F.col("task"), F.lit("_editing"), F.lit("")).alias("kind"), *pick(F.col("anchor")))
    parts = samples.where(F.col("task") == "compositional_editing").select(
        "task", F.explode("components").alias("c"))
    composed = parts.select("task", component_type(F.col("c")).alias("kind"), *pick(F.col("c.anchor")))
    return atomic.union(composed).distinct()


def required_groups(samples: DataFrame) -> DataFrame:
    """Distinct ``(task, scorer_group)`` that the samples need.

    ``samples``: ``task, language, anchor`` (struct) and ``components``. A Chinese stress sample anywhere makes the
    timestamp group necessary only when the task has any Chinese sample.
    """
    languages = sample_languages(samples)
    asr = languages.select("task", F.when(F.col("language") == "zh", fv.GROUP_ASR_ZH).otherwise(
        fv.GROUP_ASR_EN).alias("scorer_group"))
    zh_tasks = languages.where(F.col("language") == "zh").select("task", F.lit(True).alias("_zh"))
    kind = F.col("kind")
    scene = (F.col("subtask") == "env_transfer") & (
        (F.col("env_type") == "noise") | F.col("env_subtype").isin(*fv.SCENE_LABELS))
    needs = F.array_compact(F.array(
        F.when(kind.isin("emotion", "style", "paralinguistic"), fv.GROUP_JUDGE),
        F.when(kind == "speaker", fv.GROUP_SPEAKER),
        F.when((kind == "prosody") & (F.col("prosody_type") == "stress") & F.col("_zh"), fv.GROUP_TIMESTAMP_ZH),
        F.when((kind == "acoustic") & (F.col("subtask") == "enhancement"), fv.GROUP_PERCEPTUAL),
        F.when((kind == "acoustic") & scene, fv.GROUP_SCENE),
    ))
    by_rule = _facts(samples).join(zh_tasks, "task", "left").select("task", F.explode(needs).alias("scorer_group"))
    return asr.union(by_rule).distinct()


def with_default_groups(required: DataFrame, tasks_with_samples: DataFrame) -> DataFrame:
    """Add the standing requirements of tasks that have no samples at all."""
    spark = required.sparkSession
    rows = [(task, group) for task, groups in fv.TASK_DEFAULT_GROUPS.items() for group in groups]
    standing = spark.createDataFrame(rows, "task string, scorer_group string")
    return required.union(standing.join(tasks_with_samples.select("task").distinct(), "task", "left_anti"))


def unexpected_languages(languages: DataFrame) -> DataFrame:
    """Languages outside English and Chinese, per task."""
    return languages.where(~F.col("language").isin("en", "zh")).distinct()


def task_readiness(required: DataFrame, available: DataFrame) -> DataFrame:
    """One row per task: required, missing and unknown groups, and whether it can run.

    ``available``: ``scorer_group, ok, auto_provision``, one row per group. A group that provisions itself counts as
    available; a group nobody knows is an error of its own. The lists hold distinct scorer groups only, of which
    there are a handful.
    """
    known = available.select(
        "scorer_group", (F.col("ok") | F.col("auto_provision")).alias("_ok"), F.lit(True).alias("_known"))
    judged = required.join(known, "scorer_group", "left")
    name = F.col("scorer_group")
    ok = F.coalesce("_ok", F.lit(False))
    return judged.groupBy("task").agg(
        F.array_sort(F.collect_set(name)).alias("required_groups"),
        F.array_sort(F.collect_set(F.when(~ok, name))).alias("missing_groups"),
        F.array_sort(F.collect_set(F.when(F.col("_known").isNull(), name))).alias("unknown_groups"),
        F.every(ok).alias("ready"),
    )
