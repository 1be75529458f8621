"""Running summaries, last answers and first-seen keys over growing inputs.

Every micro-batch is reduced to a small additive (or latest-wins) partial and written under its own batch folder in
overwrite mode: a batch that is replayed after a failure replaces its own output and nothing is counted twice. The
current state is the merge of the partials.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxgauge.operators.responses import last_per_key
from voxgauge.operators.rollup import Measure, finish_summary, partial_sums


def run_batches(stream: DataFrame, reduce: Callable[[DataFrame], DataFrame], folder: str,
                checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available now; ``folder/batch=<id>`` holds each batch's reduced rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )


def stream_partial_sums(stream: DataFrame, dims: Mapping[str, Column], measures: Mapping[str, Measure], folder: str,
                        checkpoint: str) -> StreamingQuery:
    """Running summary: one partial per batch, same measures as the batch roll-up."""
    return run_batches(stream, lambda b: partial_sums(b, dims, measures), folder, checkpoint)


def running_summary(spark: SparkSession, folder: str, dims: Mapping[str, Column],
                    measures: Mapping[str, Measure]) -> DataFrame:
    """The summary over all batches so far."""
    return finish_summary(spark.read.parquet(folder), dims, measures)


def progress(summary: DataFrame, available: DataFrame) -> DataFrame:
    """``processed_outputs, available_outputs, done`` from the overall row and a one-row count ``n``."""
    done = summary.where(F.col("dim") == "overall").select(
        F.col("total").alias("processed_outputs"), F.lit(1).alias("_one"))
    return done.join(available.select(F.col("n").alias("available_outputs"), F.lit(1).alias("_one")), "_one").select(
        "processed_outputs", "available_outputs",
        (F.col("processed_outputs") >= F.col("available_outputs")).alias("done"))


def stream_last_per_key(stream: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str],
                        folder: str, checkpoint: str) -> StreamingQuery:
    """Last row wins: each batch keeps its own last rows."""
    return run_batches(stream, lambda b: last_per_key(b, keys, order, payload), folder, checkpoint)


def merged_last_per_key(spark: SparkSession, folder: str, keys: Sequence[str], order: Sequence[str],
                        payload: Sequence[str]) -> DataFrame:
    """Last row per key over all batches so far."""
    return last_per_key(spark.read.parquet(folder), keys, order, payload)


def stream_first_seen(stream: DataFrame, keys: Sequence[str], folder: str, checkpoint: str) -> StreamingQuery:
    """Keys seen for the first time, however late: requests worth sending, one batch folder after the other.

    Each batch leaves out the keys of the batches before it, read from their folders; there is no state to outgrow memory
    and no watermark that drops late rows. A replayed batch sees the same earlier batches and replaces its own folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.select(*keys).distinct()
        if batch_id:
            seen = batch.sparkSession.read.parquet(folder).where(F.col("batch") < batch_id).select(*keys)
            fresh = fresh.join(seen, list(keys), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_details(stream: DataFrame, evaluate: Callable[[DataFrame], DataFrame], dims: Mapping[str, Column],
                   measures: Mapping[str, Measure], folder: str, checkpoint: str) -> StreamingQuery:
    """Details and their partial sums per batch: ``folder/details/batch=<id>`` and ``folder/parts/batch=<id>``.

    ``evaluate`` turns a batch into details; they are written first and summed from what was written.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        evaluate(batch).write.mode("overwrite").parquet(f"{folder}/details/batch={batch_id}")
        details = batch.sparkSession.read.parquet(f"{folder}/details/batch={batch_id}")
        partial_sums(details, dims, measures).write.mode("overwrite").parquet(f"{folder}/parts/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
