"""Partials of a stream in merging levels: the state stays a few folders, however many batches have been.

``folder/data`` holds partials, ``folder/manifest`` which of them are live. Every batch adds a partial of level 0; ``fan`` partials
of one level become one of the next, as digits carry over, so after n batches at most ``fan - 1`` are live per level and there
are about log(n) levels. A batch ends with one new snapshot of the manifest, which names everything that is live: until it is
written, readers see the state before the batch, merged partials included, and what a crash leaves behind is never read. Names
follow from the batches, so a replayed batch writes over its own remains, and a batch that a live partial covers is not added
again. Data that neither the last nor the new snapshot names is deleted; a reader has a whole batch's time to finish.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

_ENTRY = "name string, level int, first long, last long"
Entry = tuple[str, int, int, int]


def _snapshots(spark: SparkSession, folder: str) -> dict[int, list[Entry]]:
    """The snapshots that are left, two at most, by number."""
    try:
        rows = spark.read.schema(f"{_ENTRY}, seq long").json(f"{folder}/manifest").collect()
    except AnalysisException as missing:  # before the first batch
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return {}
    found: dict[int, list[Entry]] = {}
    for r in rows:
        found.setdefault(r["seq"], []).append((r["name"], r["level"], r["first"], r["last"]))
    return found


def live_entries(spark: SparkSession, folder: str) -> list[Entry]:
    """``name, level, first, last`` of the live partials: the batches from first to last, once each."""
    found = _snapshots(spark, folder)
    return sorted(found[max(found)], key=lambda e: e[2]) if found else []


def live_partials(spark: SparkSession, folder: str) -> DataFrame:
    """All live partials; there has to be a batch."""
    return spark.read.parquet(*[f"{folder}/data/{name}" for name, *_ in live_entries(spark, folder)])


def _delete(spark: SparkSession, folder: str, keep: set[str]) -> None:
    """Delete the sub-folders of a folder, in whatever store it is, but for those named."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in store.listStatus(path):
        if status.getPath().getName() not in keep:
            store.delete(status.getPath(), True)


def add_partial(partial: DataFrame, batch: int, folder: str, merge: Callable[[DataFrame], DataFrame], fan: int = 8) -> None:
    """Add a batch's partial and carry full levels over. ``merge`` turns the union of partials into one of the same columns."""
    if fan < 2:
        raise ValueError("two partials at least make one of the next level")
    spark = partial.sparkSession
    snapshots = _snapshots(spark, folder)
    seq = max(snapshots, default=-1)
    before = snapshots.get(seq, [])
    live = list(before)
    if not any(first <= batch <= last for _, _, first, last in live):
        name = f"l0-{batch}-{batch}"
        partial.write.mode("overwrite").parquet(f"{folder}/data/{name}")
        live.append((name, 0, batch, batch))
    level = 0
    while any(e[1] >= level for e in live):
        own = sorted((e for e in live if e[1] == level), key=lambda e: e[2])
        while len(own) >= fan:
            full, own = own[:fan], own[fan:]
            name = f"l{level + 1}-{full[0][2]}-{full[-1][3]}"
            merge(spark.read.parquet(*[f"{folder}/data/{e[0]}" for e in full])).write.mode("overwrite").parquet(f"{folder}/data/{name}")
            live = [e for e in live if e not in full] + [(name, level + 1, full[0][2], full[-1][3])]
        level += 1
    if live == before:
        return
    rows = spark.createDataFrame(live, _ENTRY).coalesce(1)  # one file, so a snapshot is there as a whole or not at all
    rows.write.mode("overwrite").json(f"{folder}/manifest/seq={seq + 1}")
    _delete(spark, f"{folder}/data", {e[0] for e in [*before, *live]})
    _delete(spark, f"{folder}/manifest", {f"seq={seq}", f"seq={seq + 1}"})


def run_levels(stream: DataFrame, reduce: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame],
               folder: str, checkpoint: str, fan: int = 8) -> StreamingQuery:
    """Process everything available now; ``live_partials`` of the folder is the state."""
    return (
        stream.writeStream.foreachBatch(lambda batch, n: add_partial(reduce(batch), n, folder, merge, fan))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
