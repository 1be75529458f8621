"""File listings: model outputs, release assets, manifests."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxgauge import fixed_values as fv
from voxgauge import schemas
from voxgauge.functions.naming import extension_rank, file_extension, file_stem
from voxgauge.sources.listing import file_digests, is_mounted, register


def list_files(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """``path, length, modified`` of all files with one of the suffixes; file contents are not read.

    Folders that are mounted on all machines are listed by tasks (``FolderListing``). For other stores Spark lists, and
    the driver holds what it found.
    """
    if is_mounted(root):
        listing = spark.read.format(register(spark)).load(root)
    else:
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(
            "path", "length", F.col("modificationTime").alias("modified"))
    return listing.where(
        F.lower("path").rlike(r"\.(" + "|".join(suffixes) + ")$"))


def _place(path: Column) -> Column:
    """A path without scheme, host and repeated slashes: what is the same for a raw and a qualified path."""
    return F.regexp_replace(F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", ""), "/+", "/")


def below(path: Column, root: str) -> Column:
    """The part of a path below a root, null elsewhere. The root is taken literally; schemes and hosts may be left out.

    Listings escape blanks and other signs in paths, so both ways of writing the root are tried.
    """
    plain = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "", root)
    plain = re.sub("/+", "/", plain).rstrip("/") + "/"
    place, found = _place(path), F.lit(None).cast("string")
    for prefix in dict.fromkeys((plain, quote(plain, safe="/+:@&=$,;!*'()~"))):
        prefix = prefix if prefix.startswith("/") else "/" + prefix
        at = F.when(F.startswith(place, F.lit("/")), place).otherwise(F.concat(F.lit("/"), place))
        found = F.coalesce(found, F.when(F.startswith(at, F.lit(prefix)), F.substring(at, len(prefix) + 1, 1 << 30)))
    return found


def folder_rank(path: Column, root: str) -> Column:
    """0 directly below the root, 1 directly below ``audio/``, null elsewhere."""
    inside = below(path, root)
    return F.when(inside.rlike("^[^/]+$"), 0).when(inside.rlike("^audio/[^/]+$"), 1)


def usable_outputs(candidates: DataFrame) -> DataFrame:
    """Candidates in a folder and a format that count."""
    return candidates.where(F.col("dir_rank").isNotNull() & F.col("ext_rank").isNotNull())


def with_output_ranks(listing: DataFrame, root: str) -> DataFrame:
    """Candidate outputs ``sample_id, path, dir_rank, ext_rank`` of a listing; other files are left out."""
    return usable_outputs(listing.select(
        file_stem(F.col("path")).alias("sample_id"), "path",
        folder_rank(F.col("path"), root).alias("dir_rank"),
        extension_rank(file_extension(F.col("path"))).alias("ext_rank"),
        "length", "modified",
    ))


def list_outputs(spark: SparkSession, root: str) -> DataFrame:
    """Candidate outputs below a model's output folder."""
    return with_output_ranks(list_files(spark, root, fv.OUTPUT_EXTENSIONS), root)


def task_of(path: Column, root: str | None = None) -> Column:
    """Folder that holds the sample file or ``audio/``: below the data root if one is given, else the last such folder."""
    if root is not None:
        return F.regexp_extract(F.concat(F.lit("/"), below(path, root)), r"^/([^/]+)/(?:samples\.jsonl$|audio/)", 1)
    return F.regexp_extract(path, r"^.*/([^/]+)/(?:samples\.jsonl$|audio/)", 1)


def manifest_rows(sample_files: DataFrame, lines: DataFrame, files: DataFrame, root: str | None = None) -> DataFrame:
    """Per task: sample count, hash of the sample file, number and total size of the audio files.

    ``sample_files``: ``path, sha256``; ``lines``: ``path, line`` (blank lines do not count); ``files``:
    ``path, length`` of everything in the release. The task is the folder that holds the sample file or ``audio/``.
    """
    hashed = sample_files.select(
        task_of(F.col("path"), root).alias("task_id"), F.col("sha256").alias("samples_sha256"))
    counted = lines.where(F.col("line").rlike(r"(?U)\S")).groupBy(task_of(F.col("path"), root).alias("task_id")).agg(
        F.count(F.lit(1)).alias("samples"))
    audio = files.where(
        F.lower("path").rlike(r"/audio/.*\.(" + "|".join(fv.ASSET_SUFFIXES) + ")$")
    ).groupBy(task_of(F.col("path"), root).alias("task_id")).agg(
        F.count(F.lit(1)).alias("audio_files"), F.sum("length").alias("audio_bytes"))
    zero = F.lit(0).cast("bigint")
    return hashed.join(counted, "task_id", "left").join(audio, "task_id", "left").select(
        "task_id",
        F.coalesce("samples", zero).alias("samples"), "samples_sha256",
        F.coalesce("audio_files", zero).alias("audio_files"),
        F.coalesce("audio_bytes", zero).alias("audio_bytes"))


def asset_manifest(spark: SparkSession, data_root: str) -> DataFrame:
    """Manifest rows of a release folder. Audio contents are not read, only listed.

    Sample files of any size are hashed where the folder is mounted; in other stores they have to fit into a row.
    """
    options = {"recursiveFileLookup": "true", "pathGlobFilter": "samples.jsonl"}
    if is_mounted(data_root):
        sample_files = file_digests(list_files(spark, data_root, ("jsonl",)).where(F.endswith("path", F.lit("/samples.jsonl"))))
    else:
        sample_files = spark.read.format("binaryFile").options(**options).load(data_root).select(
            "path", F.sha2("content", 256).alias("sha256"))
    lines = spark.read.options(**options).text(data_root).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    return manifest_rows(sample_files, lines, list_files(spark, data_root, fv.ASSET_SUFFIXES), data_root)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Task rows of a release manifest (one JSON document)."""
    return spark.read.schema(schemas.MANIFEST).option("multiLine", "true").json(path).selectExpr("inline(tasks)")


def write_document(df: DataFrame, path: str) -> None:
    """A small report (audit, manifest, status) as JSON lines."""
    df.write.mode("overwrite").json(path)
