"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``virtual_nodes`` places on a ring of 2^32 positions; a row belongs to the next place clockwise of its
id's hash. A shard takes rows until it is full; what overflows goes on clockwise to the next place whose shard has room.
With ``slack = 0`` the bounds are the even share, so counts differ by at most one; the shards that hold most rows of their
own get the larger bound. Most rows stay at home, and one more shard moves few others.

Only counts per arc of the ring (shards x virtual nodes) pass through the driver, where the overflow is worked out for
whole runs of rows. Rows are sorted by position over range partitions (a last key without meaning splits repeated rows),
numbered within their arc, and look up the run that they fall into. An id that a third of all rows share is one position,
its rows spread over the following shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxgauge.llm.numbering import numbered, running_numbers
from voxgauge.llm.shared import kept_table

VIRTUAL_NODES = 64
_RUN_BITS = 40  # an arc holds fewer than 2^40 rows


def ring(shards: int, virtual_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all virtual nodes in order, and their shards. A shard's places do not depend on the others."""
    places = sorted((xxhash.xxh64_intdigest(f"{s}/{v}".encode()) >> 32, s)
                    for s in range(shards) for v in range(virtual_nodes))
    return np.array([p for p, _ in places], np.int64), np.array([s for _, s in places], np.int64)


def bounds(home: np.ndarray, slack: float) -> np.ndarray:
    """How many rows each shard may take: the even share, or ``1 + slack`` times it; their sum is no less than all rows."""
    total, shards = int(home.sum()), len(home)
    if slack:
        return np.full(shards, -(-total * (1 + slack) // shards)).astype(np.int64)
    limits = np.full(shards, total // shards, np.int64)
    limits[np.argsort(-home, kind="stable")[:total % shards]] += 1
    return limits


def overflow(counts: np.ndarray, owners: np.ndarray, shards: int, slack: float) -> list[tuple[int, int, int, int]]:
    """``arc, first number in the arc, shard, first slot`` of every run of rows that goes to one shard."""
    home = np.bincount(owners, weights=counts, minlength=shards).astype(np.int64)
    room, slots = bounds(home, slack), np.zeros(shards, np.int64)
    runs, left = [], []
    for arc in np.flatnonzero(counts).tolist():  # rows at home come first everywhere
        shard, n = owners[arc], int(counts[arc])
        taken = min(n, int(room[shard]))
        if taken:
            runs.append((arc, 0, int(shard), int(slots[shard])))
            room[shard] -= taken
            slots[shard] += taken
        if taken < n:
            left.append((arc, taken, n))
    arcs, after = len(owners), {}

    def next_free(arc: int) -> int:
        """The first arc from here on whose shard has room; passed arcs are remembered."""
        path = []
        while room[owners[arc]] == 0:
            path.append(arc)
            arc = after.get(arc, (arc + 1) % arcs)
        for p in path:
            after[p] = arc
        return arc

    for arc, done, n in left:
        at = arc
        while done < n:
            at = next_free(at)
            shard = owners[at]
            taken = min(n - done, int(room[shard]))
            runs.append((arc, done, int(shard), int(slots[shard])))
            room[shard] -= taken
            slots[shard] += taken
            done += taken
    return sorted(runs)


def assign_shards(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text",
                  virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, home``, one row per input row.

    ``size`` is the text's UTF-8 bytes plus 16, a null text counts as empty; a null id hashes like the empty text. Slots
    are gapless from 0 within each shard. Rows that share an id come in the order of the text's checksum and size; rows
    equal in all of these are interchangeable. Other columns are ignored. An empty table gives none.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 32).alias("position"),
        F.monotonically_increasing_id().alias("spread"))
    order = ["position", "doc_id", "text_crc32", "size", "spread"]
    places, owners = ring(shards, virtual_nodes)
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(places), np.int64)
        for batch in batches:
            arcs = np.searchsorted(places, batch.column("position").to_numpy()) % len(places)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "size", "text_crc32", "part")), pa.array(arcs),
                 pa.array(running_numbers(arcs, seen))], ["doc_id", "size", "text_crc32", "part", "arc", "place"])

    written = kept_table(ordered.mapInArrow(
        number, "doc_id long, size long, text_crc32 long, part int, arc long, place long"), "ring-rows")
    counts = np.zeros(len(places), np.int64)
    for r in written.groupBy("arc").count().collect():  # as many rows as the ring has arcs
        counts[r["arc"]] = r["count"]
    runs = overflow(counts, owners, shards, slack)
    keys = np.array([arc << _RUN_BITS | first for arc, first, _, _ in runs], np.int64)
    firsts, targets, slots = (np.array([r[i] for r in runs], np.int64) for i in (1, 2, 3))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arcs, numbers = batch.column("arc").to_numpy(), batch.column("number").to_numpy()
            run = np.searchsorted(keys, arcs << _RUN_BITS | numbers, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "size", "text_crc32")), pa.array(targets[run].astype(np.int32)),
                 pa.array(slots[run] + numbers - firsts[run]), pa.array(owners[arcs].astype(np.int32))],
                ["doc_id", "size", "text_crc32", "shard", "slot", "home"])

    return numbered(written, "arc").mapInArrow(
        place, "doc_id long, size long, text_crc32 long, shard int, slot long, home int")
