"""Media columns: texts stored as lossless 8-bit samples, read back, sniffed, corrected and carved."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxgauge.llm.media_formats import WIDTH, WRITERS, samples_of, sniff
from voxgauge.llm.shared import kept_table, small_batches

DECLARED = "audio/wav"  # what the column's producer claims for every row


def payload_of(text: str | None) -> bytes:
    """UTF-8 and blanks up to a positive multiple of the width; a null text counts as empty."""
    body = (text or "").encode()
    return body.ljust(max(WIDTH, -(-len(body) // WIDTH) * WIDTH))


def store_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", declared: str = DECLARED) -> DataFrame:
    """``doc_id, n_bytes, declared, media``: one file per row, its format chosen by the payload's checksum.

    So equal texts have equal files. Other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, files = [], []
            for value in batch.column(1):
                text = value.as_py()
                payload = payload_of(text)
                sizes.append(len((text or "").encode()))
                files.append(WRITERS[zlib.crc32(payload) % len(WRITERS)][1](payload))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array([declared] * len(files), pa.string()),
                 pa.array(files, pa.binary())], ["doc_id", "n_bytes", "declared", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, declared string, media binary")


ITEMS = "array<struct<media_type:string,start:long,length:long>>"


def sniff_media(files: DataFrame, media: str = "media", declared: str = "declared") -> DataFrame:
    """Add ``media_type, corrected, embedded`` to a table with a media column.

    ``media_type`` is the confirmed type of the whole file; null if no format is confirmed at its beginning (null and empty
    media too). ``corrected`` tells that it differs from the declared one. ``embedded`` lists confirmed items inside: type,
    first byte, length, ready for ``substring``. All rows and columns stay, columns of these names are replaced.
    """
    small_batches(files.sparkSession)
    kept = files.drop("media_type", "corrected", "embedded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types, inside = [], []
            for value in batch.column(media):
                items = sniff(value.as_py() or b"")
                types.append(next((i.media_type for i in items if i.start == 0), None))
                inside.append([i._asdict() for i in items if i.start])
            claims = batch.column(declared).to_pylist()
            kind = pa.list_(pa.struct([("media_type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(types, pa.string()),
                 pa.array([t is not None and t != c for t, c in zip(types, claims)]), pa.array(inside, kind)],
                [*batch.schema.names, "media_type", "corrected", "embedded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, media_type string, corrected boolean, embedded {ITEMS}")


def read_payloads(files: DataFrame) -> DataFrame:
    """Replace ``media_type`` known to the writers by ``payload`` and ``feature`` beside all other columns.

    The feature names type, rows, correction, embedded items, mean sample and the share of neighbours that are equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, features = [], []
            for value, kind, corrected, inside in zip(
                    batch.column("media"), *(batch.column(c).to_pylist() for c in ("media_type", "corrected", "embedded"))):
                payload = samples_of(value.as_py(), kind)
                samples = np.frombuffer(payload, np.uint8)
                payloads.append(payload)
                features.append(
                    f"{kind}|{WIDTH}x{len(payload) // WIDTH}|{'corrected' if corrected else 'as declared'}"
                    f"|embedded={len(inside)}|mean={samples.mean():.4f}|still={(samples[1:] == samples[:-1]).mean():.4f}")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(payloads, pa.binary()), pa.array(features, pa.string())],
                [*batch.schema.names, "payload", "feature"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{schema}, payload binary, feature string")


def media_round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text, read the stored files, sniff them and read their payloads; one row per input row.

    ``doc_id, n_bytes, declared, media, media_type, corrected, embedded, payload, feature``.
    """
    stored = kept_table(store_media(docs, doc_id, text), "media")
    return read_payloads(sniff_media(stored))
