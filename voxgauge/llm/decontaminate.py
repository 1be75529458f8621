"""Benchmark decontamination by winnowing: which words of the documents lie inside passages of benchmark items.

Fingerprints. Of every ``WINDOW`` consecutive words, winnowing keeps the ``GRAM``-word gram with the smallest hash (the last of
equal ones). A span of ``WINDOW`` words that a document shares with an item therefore has the same gram kept on both sides: no
shared span of that length is passed over. An item with fewer words is a single gram of its own length, and every gram of that
length in a document is compared with it.

Join. A kept gram travels with its context, the words that a window around it can reach, so a hit is decided from the row itself.
A filter of ``FILTER_BITS`` bits, whatever the size of the benchmark, keeps back grams that no item has, or whose windows no
item has; it only saves work. Each different context is joined with the items' contexts once, however many documents have it,
so a passage in a third of all documents is not paired with items document by document.

Extension. From the shared gram the hit grows word by word to both sides; a run of ``WINDOW`` words or more is a hit, all its words
are hit. As every window holds a kept gram, these runs cover all shared windows. Documents with the same contexts share one list
of items.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxgauge.llm.shared import LOWER_BYTES, byte_batches, kept_table

WINDOW = 10  # words of a shared passage
GRAM = 4     # words of a fingerprint
FILTER_BITS = 1 << 23
BATCH_BYTES = 4 << 20
SEED = 42

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True  # digits, small letters, everything beyond ASCII
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits, so that a comparison of values depends on all of them."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words:
    """Words of many texts one after the other: which text each is from, its hash, and its bytes."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = bytes(texts.buffers()[2] or b"")[offsets[0]:offsets[-1]].translate(LOWER_BYTES)
        data, offsets = np.frombuffer(data, np.uint8), offsets - offsets[0]
        inside = _LETTERS[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        padded = np.concatenate([[False], inside, [False]])
        starts = np.flatnonzero(inside & (~padded[:-2] | edge[:-1]))
        lengths = np.flatnonzero(inside & (~padded[2:] | edge[1:])) + 1 - starts
        self._places = np.concatenate([[0], np.cumsum(lengths)])
        self._bytes = data[inside].tobytes()
        self.text = np.searchsorted(offsets, starts, "right") - 1
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))  # first word of each text
        coded = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(self._places), pa.py_buffer(self._bytes)]).dictionary_encode()
        hashes = np.array([xxhash.xxh64_intdigest(w.as_buffer(), SEED) for w in coded.dictionary], np.uint64)
        self.hashes = hashes[coded.indices.to_numpy()] if len(starts) else np.zeros(0, np.uint64)

    def grams(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the gram that begins at each word, and whether all of it is in one text."""
        n = len(self.hashes) - words + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        value = np.full(n, words, np.uint64)
        for i in range(words):
            value = value * _FACTOR + self.hashes[i:i + n]
        return _mixed(value), self.text[:n] == self.text[words - 1:]

    def kept_grams(self) -> np.ndarray:
        """Places of the grams that winnowing keeps, ascending; texts with fewer words than a window have none."""
        hashes, _ = self.grams(GRAM)
        n = len(self.hashes) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        least, at = hashes[:n].copy(), np.arange(n)
        for i in range(1, WINDOW - GRAM + 1):
            lower = hashes[i:i + n] <= least
            least[lower] = hashes[i:i + n][lower]
            at[lower] = np.flatnonzero(lower) + i
        return np.unique(at[self.text[:n] == self.text[WINDOW - 1:]])

    def joined(self, first: int, end: int) -> bytes:
        return b" ".join(self._bytes[self._places[i]:self._places[i + 1]] for i in range(first, end))

    def context(self, at: int) -> tuple[int, bytes]:
        """Words of a kept gram before it that a window can reach, and all words that it can reach."""
        text, reach = self.text[at], WINDOW - GRAM
        first, end = max(self.first[text], at - reach), min(self.first[text + 1], at + GRAM + reach)
        return int(at - first), self.joined(first, end)


def extent(left: int, words: bytes, item_left: int, item_words: bytes, gram: int) -> tuple[int, int] | None:
    """Places before and after a gram's first word to which two contexts agree around it; none if the run is no hit.

    An item that is no longer than its gram agrees if the gram does.
    """
    a, b = words.split(b" "), item_words.split(b" ")
    if a[left:left + gram] != b[item_left:item_left + gram]:
        return None
    before = 0
    while before < min(left, item_left) and a[left - before - 1] == b[item_left - before - 1]:
        before += 1
    after = gram
    while left + after < len(a) and item_left + after < len(b) and a[left + after] == b[item_left + after]:
        after += 1
    return (before, after) if len(b) == gram or before + after >= WINDOW else None


_GRAM = "n int, hash long, left int, words binary"


def _item_rows(items: DataFrame) -> DataFrame:
    """Per item its id, its words' digest as ``class`` and their number up to a window; the grams of the class with their
    contexts; hashes of its windows, for the filter alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, rows = Words(batch.column("text")), []
            kept, (grams, _), (windows, whole) = words.kept_grams(), words.grams(GRAM), words.grams(WINDOW)
            in_text = np.searchsorted(kept, words.first)
            for i, item in enumerate(batch.column("item").to_pylist()):
                first, end = words.first[i], words.first[i + 1]
                if first == end:
                    continue
                name = hashlib.sha256(words.joined(first, end)).digest()[:16]
                rows.append((item, name, min(int(end - first), WINDOW), None, None, None))
                if end - first < WINDOW:
                    n = int(end - first)
                    rows.append((None, name, n, int(words.grams(n)[0][first].view(np.int64)), 0, words.joined(first, end)))
                for at in kept[in_text[i]:in_text[i + 1]].tolist():
                    rows.append((None, name, GRAM, int(grams[at].view(np.int64)), *words.context(at)))
                for value in windows[first:end][whole[first:end]].tolist() if end - first >= WINDOW else ():
                    rows.append((None, None, None, int(np.uint64(value).view(np.int64)), None, None))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("item", "class", "n", "hash", "left", "words"), r)) for r in rows],
                pa.schema([("item", pa.string()), ("class", pa.binary()), ("n", pa.int32()), ("hash", pa.int64()),
                           ("left", pa.int32()), ("words", pa.binary())]))

    return items.mapInArrow(run, f"item string, class binary, {_GRAM}")


def _bits(rows: DataFrame) -> np.ndarray:
    """The filter of all hashes: ``FILTER_BITS`` bits, whatever the number of rows."""
    place = F.shiftrightunsigned("hash", 65 - FILTER_BITS.bit_length()) + 1  # bitmaps count from one
    found = rows.filter("hash IS NOT NULL").groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    size = 32768  # bits of one bitmap
    bits = np.zeros(FILTER_BITS, bool)
    for r in found:
        own = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        bits[(r["bucket"] - 1) * size:][:size] = own
    return np.packbits(bits)


def _document_rows(docs: DataFrame, bits: np.ndarray, lengths: list[int]) -> DataFrame:
    """Per document ``row, doc_id, n_words``; per document and different context of the grams that the filter lets through
    ``row, n, hash, left, words, context, at``: the context's digest and the 32-bit places of its gram."""
    shift = np.uint64(65 - FILTER_BITS.bit_length())
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def known(hashes: np.ndarray) -> np.ndarray:
        place = hashes >> shift
        return (shared.value[(place >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)) & 1 == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, rows = Words(batch.column("text")), batch.column("row").to_numpy()
            none = lambda kind: pa.nulls(len(rows), kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(np.diff(words.first), pa.int64()), none(pa.int32()),
                 none(pa.int64()), none(pa.int32()), none(pa.binary()), none(pa.binary()), none(pa.binary())], names)
            found = {}
            windows, whole = words.grams(WINDOW)
            alike = np.concatenate([np.zeros(WINDOW - GRAM, bool), known(windows) & whole, np.zeros(WINDOW, bool)])
            hashes, kept = words.grams(GRAM)[0], words.kept_grams()
            if len(kept):
                near = np.lib.stride_tricks.sliding_window_view(alike, WINDOW - GRAM + 1)[kept].any(axis=1)
                kept = kept[near]
                for at in kept[known(hashes[kept])].tolist():
                    found.setdefault((words.text[at], GRAM, int(hashes[at].view(np.int64)), *words.context(at)), []).append(at)
            for n in lengths:
                hashes, whole = words.grams(n)
                for at in np.flatnonzero(known(hashes) & whole).tolist():
                    key = (words.text[at], n, int(hashes[at].view(np.int64)), 0, words.joined(at, at + n))
                    found.setdefault(key, []).append(at)
            if found:
                text, n, hashed, left, own = zip(*found)
                digests = [hashlib.sha256(b"%d %d " % (a, b) + c).digest()[:16] for a, b, c in zip(n, left, own)]
                places = [(np.array(at) - words.first[t]).astype(">i4").tobytes() for t, at in zip(text, found.values())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[list(text)]), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64()),
                     pa.array(n, pa.int32()), pa.array(hashed, pa.int64()), pa.array(left, pa.int32()),
                     pa.array(own, pa.binary()), pa.array(digests, pa.binary()), pa.array(places, pa.binary())], names)

    names = ["row", "doc_id", "n_words", "n", "hash", "left", "words", "context", "at"]
    return docs.mapInArrow(run, f"row long, doc_id long, n_words long, {_GRAM}, context binary, at binary")


def _verified(pairs: DataFrame) -> DataFrame:
    """``context, class, before, after`` of the pairs of contexts whose extended gram is a hit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            spans = [extent(r["left"], r["words"], r["item_left"], r["item_words"], r["n"]) for r in rows]
            hits = [(r["context"], r["class"], *s) for r, s in zip(rows, spans) if s]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*hits) if hits else [()] * 4, (pa.binary(), pa.binary(), pa.int32(), pa.int32()))],
                ["context", "class", "before", "after"])

    return pairs.mapInArrow(run, "context binary, class binary, before int, after int")


def _places(at: str) -> Column:
    """Array of the packed 32-bit numbers, high bytes first, of a binary column."""
    number = f"int(conv(hex(substring({at}, 4 * i + 1, 4)), 16, 10))"
    return F.expr(f"transform(sequence(0, int(octet_length({at}) / 4) - 1), i -> {number})")


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, items, contaminated``, one row per input row.

    ``items`` are the ids, as strings in ascending order, of the items of which the document has a window of ``WINDOW``
    words, or all words if they are fewer. Null and empty texts have no words; items without words are in no document. An
    id that several items have counts once; a missing item id is the empty string. Documents may repeat or lack ids. Other
    columns are ignored. An empty table of documents gives none, an empty benchmark finds nothing.
    """
    spark = docs.sparkSession
    item_rows = kept_table(_item_rows(benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))), "benchmark-grams")
    lengths = sorted(r["n"] for r in item_rows.filter(f"item IS NOT NULL AND n < {WINDOW}").select("n").distinct().collect())
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with byte_batches(spark, BATCH_BYTES):
        found = kept_table(_document_rows(rows, _bits(item_rows), lengths), "document-grams")
    grams = found.filter("context IS NOT NULL")
    contexts = grams.groupBy("context").agg(*[F.first(c).alias(c) for c in ("n", "hash", "left", "words")])
    own = item_rows.filter("words IS NOT NULL").select(
        "n", "hash", "class", F.col("left").alias("item_left"), F.col("words").alias("item_words")).distinct()
    matches = kept_table(_verified(contexts.join(own, ["n", "hash"])), "matches")
    reach = kept_table(matches.groupBy("context").agg(F.max("before").alias("before"), F.max("after").alias("after")), "reach")
    hits = kept_table(grams.select("row", "context", "at").join(reach, "context"), "hits")
    spans = hits.select("row", "before", "after", F.explode(_places("at")).alias("at"))
    spans = spans.select("row", (F.col("at") - F.col("before")).alias("start"), (F.col("at") + F.col("after")).alias("end"))
    earlier = F.max("end").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.distinct().withColumn("from", F.greatest(F.col("start"), F.coalesce(earlier, F.lit(0))))
    covered = spans.groupBy("row").agg(F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0))).alias("n_hit"))
    sets = hits.groupBy("row").agg(F.sort_array(F.collect_set("context")).alias("contexts"))  # of one document
    sets = kept_table(sets.withColumn("set", F.sha2(F.concat(F.lit(b""), F.array_join(F.transform("contexts", F.hex), "").cast("binary")), 256)),
                      "context-sets")
    names = item_rows.filter("item IS NOT NULL").select("class", "item").distinct()
    members = sets.groupBy("set").agg(F.first("contexts").alias("contexts")).select("set", F.explode("contexts").alias("context"))
    members = members.join(matches.select("context", "class").distinct(), "context").select("set", "class").distinct()
    items = members.join(names, "class").groupBy("set").agg(F.sort_array(F.collect_set("item")).alias("items"))
    per_row = covered.join(sets.select("row", "set"), "row").join(items, "set").select("row", "n_hit", "items")
    return found.filter("n_words IS NOT NULL").select("row", "doc_id", "n_words").join(per_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))
