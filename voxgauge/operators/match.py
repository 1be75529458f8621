"""Matching of samples to outputs and scores, path resolution, component materialisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxgauge.operators.lookup import spread_lookup


def best_outputs(candidates: DataFrame, key: str, priority: Sequence[Column], payload: Sequence[str]) -> DataFrame:
    """One candidate per key: the smallest ``priority`` tuple wins, the payload itself breaks ties.

    A minimum over a struct combines before the shuffle, so a key with very many candidates stays cheap.
    """
    ranked = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(priority)], *payload)
    best = candidates.groupBy(key).agg(F.min(ranked).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in payload])


def match_outputs(samples: DataFrame, candidates: DataFrame, key: str, priority: Sequence[Column],
                  payload: Sequence[str]) -> DataFrame:
    """Every sample with its best output (nulls when there is none) and a ``has_output`` flag."""
    best = best_outputs(candidates, key, priority, payload).withColumn("_found", F.lit(True))
    joined = samples.join(best, key, "left")
    return joined.withColumn("has_output", F.coalesce(F.col("_found"), F.lit(False))).drop("_found")


def missing_outputs(samples: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    return samples.join(candidates.select(key).distinct(), key, "left_anti")


def side_pairs(scores: DataFrame, key: str, side: str, values: Sequence[str]) -> DataFrame:
    """Source and output scores of a sample side by side: ``source_<v>`` and ``output_<v>`` per value.

    ``side`` holds ``source`` or ``output``. One aggregation instead of a self-join. A side may have several rows (takes
    of one recording): the largest value stands for them.
    """
    return scores.groupBy(key).agg(*[
        F.max(F.when(F.col(side) == which, F.col(v))).alias(f"{which}_{v}")
        for v in values for which in ("source", "output")
    ])


def require_one_row_per(df: DataFrame, key: str) -> DataFrame:
    """Key check that replaces strict positional pairing: raises when a key repeats, else gives the table as it is.

    A job of its own that reads and shuffles the keys alone.
    """
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(key).first()
    if repeated:
        raise ValueError(f"{key} is not unique: {repeated[0]}")
    return df


def resolve_paths(rows: DataFrame, key: str, path: str, existing: DataFrame, bases: Sequence[str],
                  fallback: str) -> DataFrame:
    """Add ``resolved``: absolute paths stay; else the first base below which the path exists; else the fallback.

    ``existing`` has one column ``path``. Existence is a join against that listing, not a call per row; a recording that
    very many rows share is spread over tasks.
    """
    relative = ~F.startswith(F.col(path), F.lit("/"))
    options = rows.where(relative).select(
        key,
        F.posexplode(F.array(*[F.concat(F.lit(b.rstrip("/") + "/"), F.col(path)) for b in bases])).alias(
            "_rank", "path"))
    found = (
        spread_lookup(options, existing.select("path").distinct(), "path", key, "inner")
        .groupBy(key).agg(F.min(F.struct("_rank", "path"))["path"].alias("_found"))
    )
    return rows.join(found, key, "left").withColumn(
        "resolved",
        F.when(~relative, F.col(path))
        .when(F.col(path).isNotNull() & (F.col(path) != ""),
              F.coalesce(F.col("_found"), F.concat(F.lit(fallback.rstrip("/") + "/"), F.col(path)))),
    ).drop("_found")


def materialise_components(samples: DataFrame) -> DataFrame:
    """One row per component, inheriting the sample's fields; the component's own dataset and taxonomy win.

    ``sample_id`` becomes ``<sample>::<component type>``; the parent stays in ``parent_id``.
    """
    exploded = samples.select("*", F.posexplode("components").alias("component_index", "component"))
    c = F.col("component")
    return exploded.select(
        F.concat_ws("::", "sample_id", c["component_type"]).alias("sample_id"),
        F.col("sample_id").alias("parent_id"),
        "component_index",
        c["component_type"].alias("component_type"),
        c["edit_type"].alias("task"),
        "audio_path", "instruction", "transcript",
        c["anchor"].alias("anchor"),
        "duration_tag",
        F.coalesce("language", F.lit("en")).alias("language"),
        F.coalesce(c["source_dataset"], "source_dataset", F.lit("unknown")).alias("source_dataset"),
        F.coalesce("subset", F.lit("compositional")).alias("subset"),
        F.coalesce(F.nullif(c["emotion_taxonomy"], F.lit("")), c["anchor"]["emotion_taxonomy"]).alias(
            "emotion_taxonomy"),
        "benchmark_version",
        c["reference_audio_path"].alias("reference_audio_path"),
    )


def expected_transcript(components: Column, transcript: Column) -> Column:
    """Target of the first content component when it has one, else the source transcript."""
    content = F.filter(components, lambda c: c["component_type"] == "content")
    target = F.get(content, 0)["anchor"]["transcript_target"]
    return F.coalesce(F.nullif(target, F.lit("")), transcript, F.lit(""))


def speaker_reference(reference_path: Column, anchor_reference: Column) -> tuple[Column, Column]:
    """The reference recording and the error message when neither place names one."""
    reference = F.coalesce(F.nullif(reference_path, F.lit("")), F.nullif(anchor_reference, F.lit("")))
    return reference, F.when(reference.isNull(), "missing reference_audio_path/reference_wav")
