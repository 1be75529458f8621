"""Gapless numbers within classes, without bringing a class together.

A task numbers its own rows per class while it writes them; afterwards only counts per task and class are summed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_numbers(classes: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Number of each row within its class, going on from ``seen``, which is brought up to date."""
    order = np.argsort(classes, kind="stable")
    ordered, places = classes[order], np.arange(len(classes))
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(classes) else np.zeros(0, bool)
    numbers = np.empty(len(classes), np.int64)
    numbers[order] = places - np.maximum.accumulate(np.where(first, places, 0))
    numbers += seen[classes]
    seen += np.bincount(classes, minlength=len(seen))
    return numbers


def numbered(written: DataFrame, by: str, part: str = "part", place: str = "place") -> DataFrame:
    """Add ``number``: gapless from 0 within ``by``, in the order of ``part``, then ``place``.

    ``written`` is a written table whose tasks stored their index and the row's number within the class and task.
    """
    counts = written.groupBy(part, by).agg(F.count("*").alias("here"))
    before = W.partitionBy(by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(part, by, F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"))
    return written.join(counts, [part, by]).withColumn("number", F.col("before") + F.col(place)).drop("before")
