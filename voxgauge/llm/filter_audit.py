"""How five document filters interact, over all orders in which they can be applied.

Words. Texts become shards of a sparse document-term matrix. A task cuts its texts into words, encodes those of about
``SHARD_BYTES`` of text with a dictionary of the shard, and stores the counts in blocks of compressed sparse rows. Then the
different words of all shards are dealt out by hash, put in order and numbered, and every shard's columns are replaced by these
global numbers. Every shard names a word once, so even the most frequent word is one row per shard and never a heavy key. Row
sums of the matrix are words, its nonzero counts are different words.

Flags. Capitals, code points and special characters are counted beside the words in one pass over the bytes. Equal texts meet
by digest; digests of more than a 512th of all rows (at most 512 of them) are looked up by broadcast, the others by a join,
so a large group of copies is spread over all tasks.

Orders. A document is reduced to its source, the set of filters it fails and its labels. The audit needs only the counts per
source and set (32 at most), combined before they are shuffled: in any order a document is removed by the first filter of
its set.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxgauge.llm.shared import byte_batches, kept_table

FILTERS = "ABCDE"
# Fixed values of the filters.
LEAST_WORDS = 200        # A: fewer words fail
DISTINCT_PERCENT = 50    # B: a smaller share of different words fails
CAPITALS_PERCENT = 2     # C: a larger share of capitals among code points fails
SPECIAL = b"#$%&*|"      # D: any of these fails

SHARD_BYTES = 48 << 20   # text that shares a dictionary, about
BATCH_BYTES = 4 << 20    # text of a block of rows, about; a longer text is a block of its own
DICTIONARY_ROWS = 1 << 16  # words of a shard's dictionary in one row
PACKED_ROWS = 1 << 19    # numbers of words that a task packs by shard at a time
HOT_DIGESTS = 512        # digests of more than one in so many rows are looked up by broadcast

_DOC = pa.struct([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("flags", pa.int32())])
_BLOCK = ("shard long, docs array<struct<doc_id:long,part:string,digest:binary,flags:int>>, "
          "starts binary, columns binary, counts binary")


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a byte mask within each text."""
    if len(offsets) < 2:
        return np.zeros(0, np.int64)
    sums = np.add.reduceat(np.append(mask, np.uint8(0)), offsets[:-1], dtype=np.int64)
    return np.where(offsets[1:] > offsets[:-1], sums, 0)


def character_flags(texts: pa.LargeStringArray) -> np.ndarray:
    """Bits of the filters C and D for texts without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    special = np.zeros(256, np.uint8)
    special[list(SPECIAL)] = 1
    capitals = _sums(((data >= 65) & (data <= 90)).view(np.uint8), offsets)
    points = _sums(((data & 0xC0) != 0x80).view(np.uint8), offsets)
    marked = _sums(special[data], offsets)
    return ((100 * capitals > CAPITALS_PERCENT * points) * _bit("C") + (marked > 0) * _bit("D")).astype(np.int32)


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def coded_words(texts: pa.LargeStringArray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of texts without nulls, dictionary-encoded, and the text of each word."""
    lists = pc.ascii_split_whitespace(texts)
    words, rows = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.not_equal(words, "")  # a blank at either end leaves an empty piece
    return words.filter(real).dictionary_encode(), rows.filter(real).to_numpy().astype(np.int32)


def sparse_rows(columns: np.ndarray, rows: np.ndarray, height: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, columns and counts of the words' matrix with ``height`` rows and ``width`` columns."""
    width = max(1, width)
    cells, counts = np.unique(rows.astype(np.int64) * width + columns, return_counts=True)
    starts = np.searchsorted(cells, np.arange(height + 1, dtype=np.int64) * width)
    return starts, (cells % width).astype(np.uint32), counts.astype(np.uint32)


def _local_shards(docs: DataFrame) -> DataFrame:
    """Blocks of rows of each shard over the shard's own dictionary, and the dictionary: ``words`` from place ``first`` on."""
    names = ["shard", "docs", "starts", "columns", "counts", "first", "words"]
    one = lambda values: pa.ListArray.from_arrays([0, len(values)], values)
    none = [pa.nulls(1, pa.list_(_DOC)), *[pa.nulls(1, pa.binary())] * 3]

    def shard_rows(shard: int, held: list[tuple[pa.Array, pa.DictionaryArray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        coded = pa.chunked_array([c for _, c, _ in held]).unify_dictionaries()
        words = coded.chunk(0).dictionary.cast(pa.string())
        for (rows, _, places), part in zip(held, coded.chunks):
            arrays = sparse_rows(part.indices.to_numpy(), places, len(rows), len(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard]), one(rows), *[pa.array([x.tobytes()], pa.binary()) for x in arrays],
                 pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.string()))], names)
        for first in range(0, len(words), DICTIONARY_ROWS):
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard]), *none, pa.array([first], pa.int32()), one(words.slice(first, DICTIONARY_ROWS))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text").cast(pa.large_string()).fill_null("")
            digests = [hashlib.sha256(t.as_buffer()).digest()[:16] for t in texts]
            rows = pa.StructArray.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(character_flags(texts))],
                fields=list(_DOC))
            held.append((rows, *coded_words(texts)))
            size += texts.nbytes
            if size >= SHARD_BYTES:
                yield from shard_rows(shard, held)
                shard, held, size = shard + 1, [], 0
        if held:
            yield from shard_rows(shard, held)

    return docs.mapInArrow(run, f"{_BLOCK}, first int, words array<string>")


def dictionary(words: DataFrame) -> DataFrame:
    """Numbers over the whole table for the words of every shard: ``shard, places, ids``.

    ``words`` has ``shard, place, word``. Equal words get the same number, different words different ones. They are dealt out
    by hash and put in order; a task numbers its own from its index in the upper bits on. The numbers come packed: 32-bit
    places and 64-bit numbers of part of a shard's words.
    """
    def packed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        shards, places, ids = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(shards, kind="stable")
        names, starts = np.unique(shards[order], return_index=True)
        cut = lambda x: pa.array([y.tobytes() for y in np.split(x[order], starts[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(names), cut(places), cut(ids)], ["shard", "places", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, held, size = (TaskContext.get().partitionId() << 40) - 1, None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("word")
            fresh = np.append(own[0].as_py() != last, pc.not_equal(own[1:], own[:-1]).to_numpy(zero_copy_only=False))
            ids = at + np.cumsum(fresh)
            at, last = int(ids[-1]), own[-1].as_py()
            held.append((batch.column("shard").to_numpy(), batch.column("place").to_numpy().astype(np.uint32), ids))
            size += len(ids)
            if size >= PACKED_ROWS:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return words.select("shard", "place", "word").repartition(parts, "word").sortWithinPartitions("word").mapInArrow(
        run, "shard long, places binary, ids binary")


def document_term_matrix(docs: DataFrame) -> DataFrame:
    """Blocks of rows of the matrix with globally numbered columns: ``shard, docs, starts, columns, counts``.

    ``docs`` has ``doc_id long, part string, text string``. ``starts`` and ``columns`` are 64-bit, ``counts`` 32-bit numbers.
    """
    with byte_batches(docs.sparkSession, BATCH_BYTES):
        shards = kept_table(_local_shards(docs), "matrix-shards")
    words = shards.filter("words IS NOT NULL").select("shard", "first", F.posexplode("words").alias("at", "word"))
    numbers = dictionary(words.select("shard", (F.col("first") + F.col("at")).alias("place"), "word"))
    numbers = numbers.groupBy("shard").agg(F.collect_list(F.struct("places", "ids")).alias("numbers"))  # one shard's words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, numbers = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("shard")[i].as_py() != shard:
                    shard, packs = batch.column("shard")[i].as_py(), batch.column("numbers")[i].values
                    numbers = np.zeros(sum(len(x.as_buffer()) // 4 for x in packs.field("places")) if packs else 0, np.int64)
                    for places, ids in zip(packs.field("places"), packs.field("ids")) if packs else ():
                        numbers[np.frombuffer(places.as_buffer(), np.uint32)] = np.frombuffer(ids.as_buffer(), np.int64)
                local = np.frombuffer(batch.column("columns")[i].as_buffer(), np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, 1) for c in ("shard", "docs", "starts")),
                     pa.array([numbers[local].tobytes()], pa.binary()), batch.column("counts").slice(i, 1)],
                    ["shard", "docs", "starts", "columns", "counts"])

    blocks = shards.filter("docs IS NOT NULL").drop("first", "words")
    return blocks.join(numbers, "shard", "left").mapInArrow(run, _BLOCK)  # shards without a word have no numbers


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, part, fails``: bit 0 for filter A up to bit 4 for filter E; one row per input row.

    Null texts are empty, null sources the empty string. A null id is not smaller than any other and has none smaller, so it
    never makes a text a copy nor is one. Rows that repeat id and text are no copies of each other.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("part"),
                       F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, starts, counts in zip(*(batch.column(c) for c in ("docs", "starts", "counts"))):
                starts, counts = np.frombuffer(starts.as_buffer(), np.int64), np.frombuffer(counts.as_buffer(), np.uint32)
                sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                words, different = np.diff(sums[starts]), np.diff(starts)
                own = docs.values
                flags = (own.field("flags").to_numpy() + (words < LEAST_WORDS) * _bit("A")
                         + (100 * different < DISTINCT_PERCENT * words) * _bit("B")).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(own.field(c) for c in ("doc_id", "part", "digest")), pa.array(flags)],
                                                 ["doc_id", "part", "digest", "flags"])

    with byte_batches(docs.sparkSession, BATCH_BYTES):
        flagged = kept_table(document_term_matrix(rows).mapInArrow(
            run, "doc_id long, part string, digest binary, flags int"), "filter-flags")
    firsts = kept_table(flagged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "first-ids")
    total = flagged.count()
    hot = F.broadcast(firsts.filter(F.col("n") * HOT_DIGESTS > total).select("digest", F.col("first").alias("hot")))
    known = flagged.join(hot, "digest", "left")
    copies = firsts.filter("n > 1").filter(F.col("n") * HOT_DIGESTS <= total).select("digest", "first")
    rest = known.filter("hot IS NULL").drop("hot").join(copies, "digest", "left")
    both = known.filter("hot IS NOT NULL").withColumnRenamed("hot", "first").unionByName(rest)
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return both.select("doc_id", "part", (F.col("flags") + F.when(copy, _bit("E")).otherwise(0)).alias("fails"))


def _over(cells: str, value: str, condition: str) -> Column:
    """Sum of a field of the cells that fulfil a condition on their set of failures."""
    return F.expr(f"aggregate(filter({cells}, c -> {condition}), 0L, (s, c) -> s + c.{value})")


def filter_interaction(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       source: str = "source") -> DataFrame:
    """Effect of every filter at every step of every order, per source.

    Returns ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``, 600 rows per
    source. ``labels`` has ``doc_id, quality, toxic``; an id that occurs more than once is good or toxic if one of its rows
    says so, ids without a row and null ids are neither. Nulls and copies: see ``failures``. Other columns are ignored. An
    empty table gives none.
    """
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = failures(docs, doc_id, text, source).join(known, "doc_id", "left")
    sets = marked.groupBy("part", "fails").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
                                               F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    cells = sets.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))  # 32 at most
    orders = ["".join(order) for order in itertools.permutations(FILTERS)]
    each = cells.select("part", "cells", F.explode(F.lit(orders)).alias("filter_order"))
    each = each.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = f"shiftleft(1, instr('{FILTERS}', substr(filter_order, {{}}, 1)) - 1)"
    each = each.withColumn("own", F.expr(bit.format("step"))).withColumn("before", F.expr(
        f"aggregate(filter(sequence(1, {len(FILTERS)}), i -> i < step), 0, (s, i) -> s | {bit.format('i')})"))
    removed = "(c.fails & own) <> 0 AND (c.fails & before) = 0"
    return each.select(
        "part", "filter_order", "step",
        _over("cells", "n", "(c.fails & (own | before)) = 0").alias("kept"),
        _over("cells", "n", removed).alias("removed"),
        _over("cells", "n", "(c.fails & own) <> 0 AND (c.fails & before) <> 0").alias("redundant"),
        _over("cells", "n", "c.fails = own").alias("unique_fails"),
        _over("cells", "good", removed).alias("good_lost"),
        _over("cells", "toxic", removed).alias("toxic_lost"),
        # of the orders of a set's filters, an equal share has each one first
        F.expr(f"aggregate(filter(cells, c -> (c.fails & own) <> 0), 0L, "
               f"(s, c) -> s + c.n * ({len(orders)} div bit_count(c.fails)))").alias("shapley"))
