"""Names inferred from paths, and path preferences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxgauge import fixed_values as fv


def slug(value: Column) -> Column:
    """Lower-case letters and digits joined by single underscores; ``default`` when nothing is left."""
    joined = F.btrim(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("default"))


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def last_part(path: Column) -> Column:
    return F.coalesce(F.try_element_at(path_parts(path), F.lit(-1)), F.lit(""))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(last_part(path), r"(?<=.)\.[^.]*$", "")


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(last_part(path), r".\.([^.]*)$", 1))


def model_name(output_path: Column) -> Column:
    """Slug of the part after the first ``model_output`` that has one, else of the last part."""
    parts = path_parts(output_path)
    at = F.array_position(parts, "model_output")
    follower = F.when(at > 0, F.try_element_at(parts, (at + 1).cast("int")))
    return slug(F.coalesce(follower, last_part(output_path)))


def dataset_version(relative_samples_path: Column) -> Column:
    """Version from the data root; the path is relative to the repository, absolute paths are foreign.

    ``data_v2_13`` reads ``vv2.13``: published results carry the doubled letter, so it is kept.
    """
    first = F.try_element_at(path_parts(relative_samples_path), F.lit(1))
    return (
        F.when(relative_samples_path.isNull(), "unknown")
        .when(F.startswith(relative_samples_path, F.lit("/")), "custom")
        .when(first == "data", fv.DATASET_VERSION)
        .when(first.rlike(r"^data_v\d+_\d+$"),
              F.replace(F.replace(first, F.lit("data_"), F.lit("v")), F.lit("_"), F.lit(".")))
        .otherwise("custom")
    )


def eval_set(task: Column, output_path: Column, samples_path: Column) -> Column:
    """Readable name of the evaluated set from the usual smoke and full layouts."""
    parts = F.transform(path_parts(output_path), lambda p: F.lower(p))
    stem = F.lower(file_stem(F.coalesce(samples_path, F.lit(""))))
    smoke = F.startswith(stem, F.lit("smoke")) | F.array_contains(parts, "test_model")
    source_copy = F.array_contains(parts, "source_copy")
    reference_copy = F.array_contains(parts, "reference_copy")
    default_samples = F.concat(F.lit("data/"), task, F.lit("/samples.jsonl"))
    copies_source = task.isin("prosody_editing", "acoustic_editing", "compositional_editing", "speaker_editing")
    judged = task.isin("emotion_editing", "style_editing", "paralinguistic_editing")
    return (
        F.when(smoke & (task == "content_editing"), "smoke_source_copy")
        .when(smoke & copies_source & source_copy, "smoke_source_copy")
        .when(smoke & (task == "speaker_editing") & reference_copy, "smoke_reference_copy")
        .when(smoke & (copies_source | judged), "smoke_copy")
        .when(samples_path == default_samples, "full")
        .when(stem != "", slug(stem))
        .otherwise("default")
    )


def extension_rank(extension: Column) -> Column:
    """0 for the preferred output extension, rising; null for anything else."""
    return F.coalesce(*[
        F.when(extension == e, F.lit(i)) for i, e in enumerate(fv.OUTPUT_EXTENSIONS)
    ])


def shown_with_rest(items: Column, limit: int) -> Column:
    """First items joined by commas, then how many more there are; a dash for none."""
    more = F.size(items) - limit
    shown = F.array_join(F.slice(items, 1, limit), ", ")
    return (
        F.when(F.size(items) == 0, "-")
        .when(more > 0, F.concat(shown, F.lit(", ... (+"), more.cast("string"), F.lit(" more)")))
        .otherwise(shown)
    )
