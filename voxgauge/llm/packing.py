"""Documents packed into training sequences by best-fit after linear grouping.

Tasks encode whole texts, cut what is longer than a sequence, and number their pieces per length. Only the counts of
lengths (at most ``capacity`` rows) reach the driver, which works out the plan; pieces then look up their place by length
and number. No text and no id moves between tasks unless ids are asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxgauge.llm.numbering import numbered, running_numbers
from voxgauge.llm.packing_plan import Run, plan
from voxgauge.llm.shared import kept_table, small_batches
from voxgauge.llm.token_pieces import encoder

CAPACITY = 2048
_NUMBER_BITS = 44  # fewer than 2^44 pieces of one length


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """``start, length`` of a document's pieces: full ones, the remainder first."""
    first = n_ids % capacity or capacity
    return [(0, first), *((start, capacity) for start in range(first, n_ids, capacity))]


def encoded_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, doc_id: str, text: str,
                   with_ids: bool) -> DataFrame:
    """One row per piece with its length, checksum and number among the task's pieces of that length."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long, row long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(tokenizer).encode, np.zeros(capacity + 1, np.int64)
        part, end, rows = TaskContext.get().partitionId(), end_id.to_bytes(4, "little"), 0
        for batch in batches:
            out, bodies = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    body = ids[4 * start:4 * (start + length)]
                    out.append((doc, piece, start, length, zlib.crc32(body)))
                    if with_ids:
                        bodies.append(body)
            lengths = np.array([o[3] for o in out], np.int64)
            columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(
                (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            columns += [pa.array(np.full(len(out), part, np.int32)), pa.array(running_numbers(lengths, seen)),
                        pa.array(np.arange(rows, rows + len(out)))]
            rows += len(out)
            names = [c.split()[0] for c in schema.split(", ")]
            if with_ids:
                columns, names = [*columns, pa.array(bodies, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, schema + (", ids binary" if with_ids else ""))


def lookup(runs: list[Run]) -> np.ndarray:
    """Rows of the plan by length and first number: key, length, first number, copies, first sequence, offset."""
    numbers, rows, sequence = {}, [], 0
    for run in runs:
        offset = 0
        for length, copies in run.parts:
            first = numbers.get(length, 0)
            rows.append((length << _NUMBER_BITS | first, length, first, copies, sequence, offset))
            numbers[length] = first + copies * run.many
            offset += length * copies
        sequence += run.many
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, doc_id: str = "doc_id",
                   text: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, if asked for, ``ids``; one row per piece.

    A document is its ids and ``end_id``, so null and empty texts are one token long. Only documents longer than
    ``capacity`` are cut, into full pieces, the remainder first. ``ids`` are little-endian unsigned 32-bit integers.
    Offsets are gapless from 0 within each sequence. Repeated rows are packed as often as they occur, null ids stay null,
    other columns are ignored, an empty table gives no sequence.
    """
    written = kept_table(encoded_pieces(docs, tokenizer, end_id, capacity, doc_id, text, with_ids), "pieces")
    narrow = written.drop("ids")
    counts = {r["length"]: r["count"] for r in narrow.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = docs.sparkSession.sparkContext.broadcast(lookup(plan(counts, capacity)))  # bounded by the number of runs

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, _, firsts, copies, sequences, offsets = table.value.T
        for batch in batches:
            lengths, numbers = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            run = np.searchsorted(keys, lengths << _NUMBER_BITS | numbers, side="right") - 1
            bins, inside = np.divmod(numbers - firsts[run], copies[run])
            kept = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "row"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequences[run] + bins),
                 pa.array(offsets[run] + inside * lengths)], [*kept, "sequence_id", "offset"])

    placed = numbered(narrow, "length").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, row long,"
        " sequence_id long, offset long")
    if with_ids:
        placed = placed.join(written.select("part", "row", "ids"), ["part", "row"])
    return placed.drop("part", "row")
