"""Token ids in files of fixed-width packed bits.

One file holds whole documents in ascending id order, little-endian:

======== ======================================= ==========================================
bytes    field                                   type
======== ======================================= ==========================================
8        mark ``VXBITS01``
4, 4     bits of one id, ids of a block          unsigned 32-bit
8, 8, 8  documents, ids, blocks                  unsigned 64-bit
         document ids                            signed 64-bit each
         null marks                              one byte each, 1 for a null document id
         ids before each document, and all ids   unsigned 64-bit, one more than documents
         byte place of each block in the payload unsigned 64-bit, one more than blocks
         payload                                 blocks of packed ids, lowest bit first
======== ======================================= ==========================================

An id takes the bits that the largest id of the vocabulary needs. A block begins at a byte, so any block, and by it any
document, unpacks without the others. Files are rows of a Parquet table (``part``, ``file``, ``ids``, ``data``): Spark
writes them to any store and only whole tasks' files become visible; ``data`` is the file's content and can be saved as it
is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxgauge.llm.shared import small_batches
from voxgauge.llm.token_pieces import encoder

MARK = b"VXBITS01"
BLOCK_IDS = 1 << 14
FILE_IDS = 1 << 20  # a file closes with the document that reaches this many ids
BROADCAST_FILES = 1_000_000
FILES = "part int, file int, ids long, data binary"


def bits_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bit first, filled up to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(planes, bitorder="little").tobytes()


def unpack_bits(data: memoryview | bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a block: each is cut from the five bytes around it, all at once."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(5, np.uint8)])
    places = np.arange(n, dtype=np.int64) * bits
    first, words = places >> 3, np.zeros(n, np.uint64)
    for k in range(5):
        words |= raw[first + k].astype(np.uint64) << np.uint64(8 * k)
    return (words >> (places & 7).astype(np.uint64) & np.uint64((1 << bits) - 1)).astype("<u4")


def write_file(docs: list[tuple[int | None, bytes]], bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """The content of a file from (document id, ids as little-endian 32-bit bytes)."""
    before = np.concatenate([[0], np.cumsum([len(ids) // 4 for _, ids in docs], dtype=np.uint64)]).astype("<u8")
    ids = np.frombuffer(b"".join(ids for _, ids in docs), "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit into {bits} bits")
    blocks = [pack_bits(ids[i:i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    places = np.concatenate([[0], np.cumsum([len(b) for b in blocks], dtype=np.uint64)]).astype("<u8")
    return b"".join([
        MARK, np.array([bits, block_ids], "<u4").tobytes(), np.array([len(docs), len(ids), len(blocks)], "<u8").tobytes(),
        np.array([doc or 0 for doc, _ in docs], "<i8").tobytes(), bytes(doc is None for doc, _ in docs),
        before.tobytes(), places.tobytes(), *blocks])


class TokenFile:
    """Random access to a file's documents."""

    def __init__(self, data: bytes):
        if data[:8] != MARK:
            raise ValueError("not a token file")
        self.data = memoryview(data)
        self.bits, self.block_ids = np.frombuffer(data, "<u4", 2, 8).tolist()
        docs, self.ids, blocks = np.frombuffer(data, "<u8", 3, 16).astype(np.int64).tolist()
        at = 40
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.nulls = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        at += 9 * docs
        self.before = np.frombuffer(data, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        self.places = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        self.payload = at + 8 * (blocks + 1)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def block(self, i: int) -> np.ndarray:
        n = min(self.block_ids, self.ids - i * self.block_ids)
        return unpack_bits(self.data[self.payload + self.places[i]:self.payload + self.places[i + 1]], self.bits, n)

    def between(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` to ``end`` of the file; only their blocks are unpacked."""
        if start >= end:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        ids = np.concatenate([self.block(i) for i in range(first, last + 1)])
        return ids[start - first * self.block_ids:end - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.between(int(self.before[i]), int(self.before[i + 1]))

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order; each block is unpacked once."""
        at, have = 0, np.zeros(0, "<u4")
        block = 0
        for i in range(len(self)):
            need, parts = int(self.before[i + 1] - self.before[i]), []
            while need > len(have) - at:
                parts.append(have[at:])
                need -= len(have) - at
                have, at, block = self.block(block), 0, block + 1
            parts.append(have[at:at + need])
            at += need
            ids = np.concatenate(parts) if len(parts) > 1 else parts[0]
            yield None if self.nulls[i] else int(self.doc_ids[i]), ids


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id",
                      text: str = "text", file_ids: int = FILE_IDS) -> None:
    """Encode all documents and write them to ``folder`` in ascending id order, ``end_id`` after each.

    Null texts count as empty, null ids come first, rows that share an id come in the order of their texts' hashes.
    Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "spread": F.monotonically_increasing_id()})
    order = ["doc_id", "tie", "spread"]  # the last key has no meaning: it lets many equal rows go to several tasks
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        bits = bits_of(max(encode.vocabulary, end_id + 1))
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "file": pa.array([number], pa.int32()),
                "ids": pa.array([size], pa.int64()), "data": pa.array([write_file(held, bits)], pa.binary())})

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode.encode(text.as_py()) + end
                held.append((doc, ids))
                size += len(ids) // 4
                if size >= file_ids:
                    yield file()
                    number, held, size = number + 1, [], 0
        if held:
            yield file()

    ordered.mapInArrow(run, FILES).write.option("compression", "zstd").parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, ids`` of every document in the files; ``start`` counts the ids of all documents before it.

    ``ids`` are little-endian unsigned 32-bit integers.
    """
    files = spark.read.schema(FILES).parquet(folder)
    sizes = files.select("part", "file", "ids")
    parts = sizes.groupBy("part").agg(F.sum("ids").alias("all"))  # one row per writing task
    before_part = F.coalesce(F.sum("all").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before_file = F.coalesce(F.sum("ids").over(
        W.partitionBy("part").orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", "file", before_file.alias("inside")).join(
        parts.select("part", before_part.alias("outside")), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, data in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2)):
                file = TokenFile(data.as_py())
                found = list(file.documents())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(file), part, np.int32)), pa.array(np.full(len(file), number, np.int32)),
                    pa.array([doc for doc, _ in found], pa.int64()), pa.array(file.before[:-1]),
                    pa.array([ids.tobytes() for _, ids in found], pa.binary())],
                    ["part", "file", "doc_id", "start", "ids"])

    docs = files.select("part", "file", "data").mapInArrow(
        run, "part int, file int, doc_id long, start long, ids binary")
    if sizes.count() <= BROADCAST_FILES:  # two numbers a file; the documents then stay where they were unpacked
        starts = F.broadcast(starts)
    return docs.join(starts, ["part", "file"]).select(
        "doc_id", (F.col("start") + F.col("inside") + F.col("outside")).alias("start"), "ids")

