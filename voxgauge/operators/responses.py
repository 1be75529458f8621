"""Append-only response log: last answer per key, pending requests, cached results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxgauge.functions.labels import is_json_object
from voxgauge.functions.text import strip


def usable_responses(log: DataFrame, key: str = "key", obj: str = "obj") -> DataFrame:
    """Rows with a non-empty key and an answer that is a JSON object."""
    return log.where(
        (F.coalesce(strip(F.col(key)), F.lit("")) != "") & is_json_object(F.try_parse_json(F.col(obj)))
    ).withColumn(key, strip(F.col(key)))


def last_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """The last row of each key. A maximum over a struct: combined before the shuffle, no per-key sort."""
    newest = rows.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in payload if c not in order])).alias("_last"))
    return newest.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in payload])


def pending_requests(requests: DataFrame, log: DataFrame, key: str = "key") -> DataFrame:
    """Requests that the log does not answer yet."""
    return requests.join(log.select(key).distinct(), key, "left_anti")


def cache_key(backend: Column, language: Column, path: Column, size: Column, modified: Column) -> Column:
    """Key of a cached scorer result: changes when the file does."""
    return F.sha1(F.concat_ws("||", backend, language, path, size.cast("string"), modified.cast("string")))


def timestamp_backend(language: Column) -> Column:
    return F.when(language == "zh", "paraformer_zh_timestamp").otherwise("whisper_large_v3_word_timestamps")


def append_cache(scored: DataFrame, path: str, key: str) -> None:
    """Append new scorer results to the cache; keys that the cache has already, and repeats among the new, are left out."""
    fresh = scored.dropDuplicates([key])
    try:
        known = scored.sparkSession.read.schema(scored.schema).parquet(path).select(key)
    except AnalysisException as missing:  # the first append finds no cache
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    else:
        fresh = fresh.join(known.distinct(), key, "left_anti")
    fresh.write.mode("append").parquet(path)


def split_by_cache(files: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Files whose result is cached (with it), and files that still have to be scored; one cache row per key."""
    return files.join(cache, key, "inner"), files.join(cache.select(key).distinct(), key, "left_anti")
