"""Newest answer per key over an endless stream, in keyed state that forgets.

The state of a key is its newest row alone, so it is as large as the keys of the last ``keep``, however long the stream runs, and
a batch reads its own rows and the state beside their keys, never what earlier batches wrote. Keys are dealt by their hash into
``BUCKETS`` buckets, and one call of the state store brings or takes the newest rows of a whole bucket: calls grow with the
buckets that a batch touches, not with its keys. The state lives in the state store of the query and is restored from its
checkpoint.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, LongType, StructField, StructType

from voxgauge.streaming.incremental import run_batches

BUCKETS = 2048  # part of every checkpoint: a key stays in its bucket
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(value: object) -> object:
    """A key's value as Spark groups by it: hashable, and NaN equal to NaN."""
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    if isinstance(value, bytearray):
        return bytes(value)
    return "NaN" if isinstance(value, float) and value != value else value


def _unnamed(value: object) -> object:
    """Rows inside a value as tuples: the state store's client cannot write rows again that it has read."""
    if isinstance(value, (Row, list)):
        return (tuple if isinstance(value, Row) else list)(map(_unnamed, value))
    return value


class NewestAnswer(StatefulProcessor):
    """Emits the newest row of each key of a bucket when it is newer than what the state holds; a timer drops silent keys."""

    def __init__(self, keys: Sequence[str], order: Sequence[str], payload: Sequence[str], schema: StructType,
                 keep_ms: int) -> None:
        self._columns, self._keys, self._ordered = [*keys, *order, *payload], len(keys), len(order)
        self._output = [*self._columns, "fresh"]
        self._schema, self._keep_ms = schema, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._newest = handle.getValueState("newest", self._schema)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        before = self._held()
        held = {self._name(r): r for r in before if self._expiry(r) >= watermark}
        best, at = {}, None
        for row in rows:
            at = at or [row.__fields__.index(c) for c in self._columns]
            own = tuple([row[i] for i in at])
            time = own[self._keys]
            if time is None or time <= watermark * 1000:
                continue
            name = self._name(own)
            other = best.get(name) or held.get(name)
            if other is None or self._later(own, other):
                best[name] = own
        self._keep(before, [*(held | best).values()])
        for name, own in best.items():
            yield Row(**dict(zip(self._output, (*own, name not in held))))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark, before = timerValues.getCurrentWatermarkInMs(), self._held()
        self._keep(before, [r for r in before if self._expiry(r) >= watermark])
        return iter(())

    def _held(self) -> list[tuple]:
        state = self._newest.get()
        return [tuple(map(_unnamed, r)) for r in state[0]] if state else []

    def _keep(self, before: list[tuple], rows: list[tuple]) -> None:
        """Put ``rows`` in the place of ``before``; the timer is at the first expiry of what is held."""
        if rows == before:
            return
        old, new = (min(map(self._expiry, x), default=None) for x in (before, rows))
        if rows:
            self._newest.update((rows,))
        else:
            self._newest.clear()
        if old != new:
            if old is not None:
                self._handle.deleteTimer(old)
            if new is not None:
                self._handle.registerTimer(new)

    def _name(self, row: tuple) -> tuple:
        return _plain(row[:self._keys])

    def _expiry(self, row: tuple) -> int:
        return row[self._keys] // 1000 + self._keep_ms

    def _later(self, a: tuple, b: tuple) -> bool:
        """By the order columns, nulls first; of equal rows the one that is held stays."""
        first, last = self._keys, self._keys + self._ordered
        if a[first] != b[first]:
            return a[first] > b[first]
        rank = lambda x: [(v is not None, v if v is not None else 0) for v in x[first:last]]
        return rank(a) > rank(b)

    def close(self) -> None:
        pass


@contextlib.contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which timers need; the session's own choice comes back."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def _group_value(stream: DataFrame, key: str) -> Column:
    """Minus zero is zero, as in any grouping."""
    kind = stream.schema[key].dataType
    return (F.col(key) + F.lit(0).cast(kind)).alias(key) if isinstance(kind, (FloatType, DoubleType)) else F.col(key)


def newest_answers(stream: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str],
                   late: timedelta, keep: timedelta) -> DataFrame:
    """Stream of ``keys…, order…, payload…, fresh``: changes of the newest row per key.

    ``order[0]`` is the event time; the row with the largest ``order`` wins. A batch gives at most one row per key, and none if
    nothing newer came: repeated rows and rows out of order change nothing. A row is late, and left out, if its time is not
    after the watermark, the newest time of all earlier batches less ``late``; rows without a time are left out too. A key
    whose newest row is older than the watermark by more than ``keep`` is forgotten; ``fresh`` marks keys that are new or
    come back after that, which are the requests worth sending. Null keys are a key.
    """
    time, rest = order[0], [c for c in payload if c not in order]
    timed = stream.withColumn("_at", F.col(time).cast("timestamp"))
    chosen = timed.withWatermark("_at", f"{int(late.total_seconds() * 1000)} milliseconds").select(
        *[_group_value(stream, c) for c in keys], *order[1:], *rest, "_at", F.unix_micros("_at").alias("_micros"))
    chosen = chosen.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    ordered = ["_micros", *order[1:]]
    held = StructType([StructField(c, LongType() if c == "_micros" else chosen.schema[c].dataType) for c in [*keys, *ordered, *rest]])
    state = StructType([StructField("rows", ArrayType(held))])
    output = StructType([*held.fields, StructField("fresh", BooleanType())])
    keep_ms = int(keep.total_seconds() * 1000)
    changes = chosen.groupBy("_bucket").transformWithState(
        NewestAnswer(keys, ordered, rest, state, keep_ms), output, "Update", "EventTime")
    return changes.select(*keys, F.timestamp_micros("_micros").cast(stream.schema[time].dataType).alias(time), *order[1:], *rest, "fresh")


def stream_newest_answers(stream: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str],
                          late: timedelta, keep: timedelta, folder: str, checkpoint: str) -> StreamingQuery:
    """``newest_answers`` of everything available now, each batch's changes in ``folder/batch=<id>``.

    A replayed batch starts from the state of the batch before it and replaces its own folder. The newest answers of all
    time are ``merged_last_per_key`` of the folder.
    """
    with _rocks(stream.sparkSession):
        return run_batches(newest_answers(stream, keys, order, payload, late, keep), lambda b: b, folder, checkpoint, "update")
