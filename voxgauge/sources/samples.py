"""Sample files: schema-bound scan, line validation and declared asset paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxgauge import fixed_values as fv
from voxgauge import schemas

# JSON text never holds raw control characters, so two of them can stand for the escaped backslash and quote
_BACKSLASH, _QUOTE = "\x01", "\x02"
_STRING_OR_KEY = r'"[^"]*"(?:\s*:)?'  # keys are consumed too, so quotes stay paired


def _hide_escapes(json_text: Column) -> Column:
    return F.replace(F.replace(json_text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))


def _show_escapes(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))


def load_samples(spark: SparkSession, path: str, schema: str = schemas.SAMPLES) -> DataFrame:
    """Samples of one or many JSON-Lines files; blank and bad lines give no sample, absent fields are null."""
    return valid_rows(read_lines(spark, path), schema)


def flatten_anchor(samples: DataFrame) -> DataFrame:
    """Anchor fields as columns of their own, named as the verdict plans expect them.

    The two fields that samples have as well keep both: ``anchor_transcript`` and ``anchor_taxonomy``.
    """
    renamed = {"transcript": "anchor_transcript", "emotion_taxonomy": "anchor_taxonomy"}
    fields = samples.schema["anchor"].dataType.fieldNames()
    return samples.withColumns({renamed.get(f, f): F.col(f"anchor.{f}") for f in fields})


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with the file they come from."""
    return spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")
    ).where(F.col("line").rlike(r"(?U)\S"))


def line_status(line: Column) -> Column:
    """``ok``, ``not valid JSON`` or ``not a JSON object``."""
    parsed = F.try_parse_json(line)
    return (
        F.when(parsed.isNull(), "not valid JSON")
        .when(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), "ok")
        .otherwise("not a JSON object")
    )


def with_line_status(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"status": line_status(F.col("line")), "line_sha1": F.sha1("line")})


def valid_rows(lines: DataFrame, schema: str = schemas.SAMPLES) -> DataFrame:
    """Parsed rows of the valid lines."""
    return lines.where(line_status(F.col("line")) == "ok").select(
        F.from_json("line", schema).alias("_r")).select("_r.*")


def line_errors(lines: DataFrame) -> DataFrame:
    """One error per bad line; ``no evaluable samples`` only when there is neither a row nor an error.

    Files are read in splits, so a bad line is identified by its hash, not by a line number.
    """
    checked = with_line_status(lines)
    bad = checked.where(F.col("status") != "ok").select(
        F.concat(F.lit("samples_file line "), F.col("line_sha1"), F.lit(" is "), F.col("status")).alias("error"))
    empty = checked.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0).select(
        F.lit("samples_file contains no evaluable samples").alias("error"))
    return bad.unionByName(empty)


def declared_paths(json_text: Column) -> Column:
    """Distinct asset paths among all string values of a JSON line, however deeply nested.

    A path starts with ``data/`` and ends with an audio suffix. Object keys are not values.
    """
    suffixes = "|".join(fv.DECLARED_SUFFIXES)
    strings = F.filter(
        F.regexp_extract_all(_hide_escapes(json_text), F.lit(_STRING_OR_KEY), F.lit(0)), lambda s: s.endswith('"'))
    values = F.transform(strings, lambda s: F.get_json_object(
        F.concat(F.lit("["), _show_escapes(s), F.lit("]")), "$[0]"))
    return F.array_distinct(F.filter(values, lambda v: v.rlike(rf"(?is)^data/.*\.({suffixes})$")
                                     & F.startswith(v, F.lit(fv.DECLARED_PREFIX))))


def declared_assets(lines: DataFrame, group: str, line: str = "line") -> DataFrame:
    """Distinct ``(group, path)`` declared by the samples."""
    # the outer form keeps the planner from repeating the extraction in an inferred "not empty" filter
    return lines.select(group, F.explode_outer(declared_paths(F.col(line))).alias("path")).where(
        F.col("path").isNotNull()).distinct()


def allow_patterns(sample_files: DataFrame, assets: DataFrame) -> DataFrame:
    """Sorted distinct download patterns: sample files and referenced assets, or everything when there is none."""
    patterns = sample_files.select(F.col("path").alias("pattern")).union(assets.select("path")).distinct()
    fallback = patterns.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0).select(
        F.lit(fv.FALLBACK_ALLOW_PATTERN).alias("pattern"))
    return patterns.union(fallback).orderBy("pattern")
