"""Near duplicates: SimHash fingerprints linked by multi-index hashing, grouped by star contraction.

Fingerprints. Every shingle of words votes with the bits of its 64-bit hash; a bit is set if more than half the votes
have it. Whole texts are read, in blocks of words.

Links. Only different fingerprints are compared (copies share one, so a large group of copies is one node). Each
fingerprint is cut into two halves of 32 bits. Of two fingerprints with at most 3 differing bits, one half differs in at
most one bit, so every fingerprint is stored in one table per half and looks up the small Hamming ball (the half itself
and its 32 one-bit neighbours) in it; the complete distance of each match is verified. A half that more than
``hot_bucket`` fingerprints share is looked up by the half and, in addition, by the balls of the two 16-bit quarters of
the other half (again one of them differs in at most one bit), so crowded halves stay exact without all pairs of them.

Groups. Tasks contract the links they hold, and large-star and small-star steps turn what is left into stars as long as it is
more than a task may hold; every step is written to the shared folder, so lineage stays short and no links or groups pass
through the driver.

``near_dedup`` groups by fingerprints alone. ``similar_groups`` does without them and finds all pairs of documents whose sets
of shingles are as similar as asked for, by prefix filtering: with the shingles of all documents in one order, two sets of
Jaccard similarity t share one of their first ``n - ceil(t n) + 1`` shingles. The order is by how often a shingle's bucket
occurs in the whole table, rare ones first, so what many documents share hardly ever makes a candidate. Documents at one such
shingle are a run. First every document is compared with the lowest documents of its runs, ``STARS`` of them at most; that
settles most of a large group of near copies by a few comparisons per document. What it leaves in different groups is compared
inside the tasks, in blocks of ``BLOCK_MEMBERS`` documents: long runs with common members are one set of blocks, so documents
that share many shingles meet once. Parity bits decide (they differ in at most as many places as the sets), and only pairs that
pass become rows, to be compared by their complete sets. That goes in rounds: a document gives its ``PARTNERS`` lowest partners
in other groups, the pairs that are alike join groups, and as long as a pair was held back the next round compares what is
then still apart, with four times the partners. So pairs grow with the documents and not with the square of a group, and no
pair is passed over unless its two documents are in one group already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxgauge.llm.shared import LOWER_BYTES, kept_table, small_batches, word_blocks

MAX_DISTANCE = 3
HOT_BUCKET = 256
SEED = 42
BUCKETS, BLOCKS = 1 << 20, 64  # counts that order the shingles, and the rows in which they travel
PART_KEYS = 1 << 20  # shingles of prefixes that one call sees, about
TASK_LINKS = 100_000  # links that a task contracts at a time
STARS = 4  # lowest documents of its runs with which a document is compared first
PARTNERS = 2  # pairs that a document gives in the first round of blocks
LONG_RUN = 64  # longer runs are compared together with those that share members
BLOCK_MEMBERS = 1024  # documents of a block of comparisons, about
BLOCK_BYTES = 1 << 24  # parity bits compared at once
SLACK = 1e-9  # rounding errors never cost a candidate


def simhash(text: str | None, shingle: int, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint of a text; zero if it has no word."""
    votes, total, carry = np.zeros(64, np.int64), 0, []
    for words in word_blocks((text or "").encode().translate(LOWER_BYTES)):
        words = carry + words
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            spans = zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())
            hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in spans], ">u8")
            votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            total += len(hashes)
        carry = words[max(0, len(words) - shingle + 1):]
    if not total:
        return 0 if not carry else xxhash.xxh64_intdigest(b" ".join(carry), seed)
    return int.from_bytes(np.packbits(votes * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                 seed: int = SEED) -> DataFrame:
    """``doc_id, bits``: the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(t.as_py(), shingle, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "bits"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, bits long")


def _part(bits: Column, width: int, index: int) -> Column:
    """Part ``index`` of ``width`` bits, lowest first."""
    mask = (1 << width) - 1
    return F.shiftrightunsigned(bits, index * width).bitwiseAND(F.lit(mask).cast("long"))


def _keys(bits: Column, width: int, parts: int, ball: bool) -> Column:
    """Array of the parts' values, or of their one-bit balls, each with the part's index above its bits."""
    keys = []
    for index in range(parts):
        value, tag = _part(bits, width, index), F.lit(index << width).cast("long")
        keys.append(value.bitwiseOR(tag))
        if ball:
            keys += [value.bitwiseXOR(F.lit(1 << b).cast("long")).bitwiseOR(tag) for b in range(width)]
    return F.array(*keys)


def links(prints: DataFrame, max_distance: int = MAX_DISTANCE, hot_bucket: int = HOT_BUCKET,
          hashed: bool = False) -> DataFrame:
    """Pairs ``a < b`` of different fingerprints (column ``bits``, distinct) at ``max_distance`` or fewer bits, once each.

    Exact for distances up to 3: then one of two halves (and, within the other half, one of its quarters) is in the ball.
    ``hashed``: keep the table in hash maps per partition, whatever its size, instead of leaving the join to the planner.
    """
    if not 0 <= max_distance <= 3:
        raise ValueError("two parts with balls of one bit find distances up to 3")
    table = prints.select(F.col("bits").alias("b"), F.explode(_keys(F.col("bits"), 32, 2, ball=False)).alias("key"))
    if hashed:
        table = table.hint("shuffle_hash")
    probes = prints.select(F.col("bits").alias("a"), F.explode(_keys(F.col("bits"), 32, 2, ball=True)).alias("key"))
    crowded = table.groupBy("key").count().filter(F.col("count") > hot_bucket).select("key")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)
    if crowded.isEmpty():
        return probes.join(table, "key").filter(close).select("a", "b").distinct()
    crowded = kept_table(crowded, "crowded-halves")
    found = probes.join(table.join(crowded, "key", "left_anti"), "key").filter(close).select("a", "b")
    other = lambda name: F.when(F.shiftrightunsigned("key", 32) == 0, _part(F.col(name), 32, 1)).otherwise(
        _part(F.col(name), 32, 0))
    deep_table = table.join(crowded, "key", "left_semi").withColumn(
        "inner", F.explode(_keys(other("b"), 16, 2, ball=False)))
    deep_probes = probes.join(crowded, "key", "left_semi").withColumn(
        "inner", F.explode(_keys(other("a"), 16, 2, ball=True)))
    deep = deep_probes.join(deep_table, ["key", "inner"]).filter(close).select("a", "b")
    return found.unionByName(deep).distinct()


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of every node but the smallest of each group to that smallest node; groups are what the links connect."""
    parent: dict[int, int] = {}

    def root(node: int) -> int:
        while (above := parent.setdefault(node, node)) != node:
            parent[node] = node = parent[above]
        return node

    for x, y in zip(a.tolist(), b.tolist()):
        low, high = sorted((root(x), root(y)))
        parent[high] = low
    found = [(node, root(node)) for node in list(parent) if parent[node] != node]
    return tuple(np.array(found, np.int64).reshape(-1, 2).T)


def _contracted(edges: DataFrame, task_links: int) -> DataFrame:
    """The same groups by fewer links: tasks contract what they hold, ``task_links`` links at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(2)])
            rows += batch.num_rows
            if rows >= task_links:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in contracted(*map(np.concatenate, zip(*held)))], ["a", "b"])
                held, rows = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in contracted(*map(np.concatenate, zip(*held)))], ["a", "b"])

    return edges.filter("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "a long, b long")


def connected(pairs: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """``node, root`` for every node that occurs in ``pairs`` (``a, b``); the root is the smallest node reachable.

    Tasks contract the links they hold. Fewer than ``task_links`` that are left are contracted by one task, which ends it; as
    long as there are more, steps turn them into stars.
    """
    edges, before = kept_table(_contracted(pairs, task_links), "links"), None
    while True:
        count, total = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if not count or (count, total) == before:
            break
        if count < task_links:
            edges = kept_table(_contracted(edges.coalesce(1), task_links), "stars")
            break
        before = (count, total)
        for larger in (True, False):
            both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
            if larger:
                both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
            else:
                both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            lowest = both.groupBy("u").agg(F.min("v").alias("m"))
            joined = both.join(lowest.withColumn("m", F.least("m", "u")), "u")
            if larger:
                stars = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
            else:
                stars = joined.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
                                                        F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
                stars = stars.select("e.a", "e.b")
            edges = kept_table(stars.filter("a <> b").distinct(), "stars")
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
               max_distance: int = MAX_DISTANCE, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Fingerprint every text and group those that links connect.

    Returns ``doc_id, fingerprint, component_id``, one row per input row: 16 hex digits, and the smallest id that links
    reach (its own included; null ids are passed over, the id is null where a group has no other). Texts without a word
    (null and empty too) have fingerprint zero and link like any other; fewer words than a shingle count as one shingle.
    A-Z are lower-cased, words end at ASCII blanks. Other columns are ignored. An empty table gives none.
    """
    prints = kept_table(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    nodes = kept_table(prints.groupBy("bits").agg(F.min("doc_id").alias("lowest")), "nodes")
    roots = kept_table(connected(links(nodes.select("bits"), max_distance, hot_bucket)), "roots")
    rooted = nodes.join(roots.withColumnRenamed("node", "bits"), "bits", "left").withColumn(
        "root", F.coalesce("root", "bits"))
    groups = rooted.groupBy("root").agg(F.min("lowest").alias("component_id"))
    labels = rooted.select("bits", "root").join(groups, "root").select("bits", "component_id")
    return prints.join(labels, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted different hashes of a text's shingles; a text with fewer words is one shingle, without words none."""
    parts, carry, total = [], [], 0
    for words in word_blocks((text or "").encode().translate(LOWER_BYTES)):
        words = carry + words
        n = len(words) - shingle + 1
        if n > 0:
            parts.append(np.array([xxhash.xxh64_intdigest(b" ".join(words[i:i + shingle]), SEED) for i in range(n)], np.uint64))
            total += n
        carry = words[max(0, n):]
    if not total and carry:
        parts.append(np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; two empty ones are alike."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def parity(shingles: np.ndarray) -> bytes:
    """One bit per place, set if an odd number of shingles falls on it; some four places per shingle, a power of two."""
    places = max(64, 4 << len(shingles).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1 == 1).tobytes()


def may_be_alike(a: bytes, b: bytes, total: int, similarity: float) -> bool:
    """False only if two sets of ``total`` elements together differ in too many, by their parity bits."""
    a, b = (np.frombuffer(x, np.uint8) for x in (a, b))
    size = min(len(a), len(b))
    differ = np.bitwise_xor.reduce(a.reshape(-1, size)) ^ np.bitwise_xor.reduce(b.reshape(-1, size))
    return np.bitwise_count(differ).sum() <= (1 - similarity) / (1 + similarity) * total + SLACK


def _marks(docs: DataFrame, shingle: int) -> DataFrame:
    """Per document ``doc_id, digest, n, parity`` of its set; per task and block ``block, counts`` of all shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names = np.zeros(BUCKETS, np.uint32), ["doc_id", "digest", "n", "parity", "block", "counts"]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                own = shingle_set(text.as_py(), shingle)
                np.add.at(counts, _bucket(own), 1)
                rows.append((hashlib.sha256(own.tobytes()).digest()[:16], len(own), parity(own)))
            digests, sizes, bits = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()),
                 pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], names)
        if counts.any():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(BLOCKS, pa.int64()), pa.nulls(BLOCKS, pa.binary()), pa.nulls(BLOCKS, pa.int32()),
                 pa.nulls(BLOCKS, pa.binary()), pa.array(range(BLOCKS), pa.int32()),
                 pa.array([x.tobytes() for x in np.split(counts, BLOCKS)], pa.binary())], names)

    return docs.mapInArrow(run, "doc_id long, digest binary, n int, parity binary, block int, counts binary")


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)


def _bucket_counts(marks: DataFrame) -> np.ndarray:
    """Counts of the whole table; ``BUCKETS`` numbers whatever its size."""
    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS // BLOCKS, np.uint64)
        for counts in table.column("counts"):
            total += np.frombuffer(counts.as_buffer(), np.uint32)
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    found = marks.filter("block IS NOT NULL").select("block", "counts").groupBy("block").applyInArrow(
        add, "block int, counts binary").collect()
    return np.concatenate([np.frombuffer(r["counts"], np.uint64) for r in sorted(found, key=lambda r: r["block"])]
                          or [np.zeros(BUCKETS, np.uint64)])


def prefix(shingles: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles by count of the bucket, then hash; similar sets share one of them."""
    keep = len(shingles) - int(np.ceil(similarity * len(shingles) - SLACK)) + 1
    return shingles[np.lexsort((shingles, counts[_bucket(shingles)]))[:keep]]


def _runs(docs: DataFrame, shingle: int, similarity: float, counts: np.ndarray, parts: int) -> DataFrame:
    """``ids, sizes``: documents that share a shingle of their prefixes, in ascending order, and the sizes of their sets.

    Shingles travel packed, as 32 bits beside their part; two that agree in them only make a longer run.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def packed(held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        keys = np.concatenate([x for _, _, x in held])
        lengths = [len(x) for _, _, x in held]
        ids = np.repeat(np.array([i for i, _, _ in held], np.int64), lengths)
        sizes = np.repeat(np.array([n for _, n, _ in held], np.int32), lengths)
        part = (keys % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        names, starts = np.unique(part[order], return_index=True)
        cut = lambda x: pa.array([y.tobytes() for y in np.split(x[order], starts[1:])], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int32()), cut((keys >> np.uint64(32)).astype(np.uint32)), cut(ids), cut(sizes)],
            ["part", "key", "ids", "sizes"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = shingle_set(text.as_py(), shingle)
                if len(own):
                    held.append((doc_id, len(own), prefix(own, shared.value, similarity)))
                else:  # sets without an element meet at one key
                    held.append((doc_id, 0, np.zeros(1, np.uint64)))
                total += len(held[-1][2])
                if total >= PART_KEYS // 4:
                    yield packed(held)
                    held, total = [], 0
        if held:
            yield packed(held)

    def gather(table: pa.Table) -> pa.Table:
        keys, ids, sizes = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])
                            for name, kind in (("key", np.uint32), ("ids", np.int64), ("sizes", np.int32)))
        order = np.lexsort((sizes, ids, keys))
        keys, ids, sizes = keys[order], ids[order], sizes[order]
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]) | (sizes[1:] != sizes[:-1])])
        keys, ids, sizes = keys[fresh], ids[fresh], sizes[fresh]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        found = {}
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(keys)).tolist()):
            if b - a > 1:
                ordered = np.sort(sizes[a:b])
                if (ordered[:-1] >= similarity * ordered[1:] - SLACK).any():
                    found[ids[a:b].tobytes()] = (a, b)
        return pa.table({"ids": pa.array([ids[a:b] for a, b in found.values()], pa.list_(pa.int64())),
                         "sizes": pa.array([sizes[a:b] for a, b in found.values()], pa.list_(pa.int32()))})

    rows = docs.mapInArrow(emit, "part int, key binary, ids binary, sizes binary")
    return rows.groupBy("part").applyInArrow(gather, "ids array<long>, sizes array<int>").distinct()


def _alike(pairs: DataFrame, docs: DataFrame, marks: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of different ``pairs`` (``a < b``) whose sets are similar: screened by parity bits, then by complete sets."""
    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            same = [p["digest"] == q["digest"] for p, q in zip(x, y)]
            stays = [e or may_be_alike(p["parity"], q["parity"], p["n"] + q["n"], similarity) for e, p, q in zip(same, x, y)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(same, pa.bool_())],
                                             ["a", "b", "same"]).filter(pa.array(stays, pa.bool_()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle).tobytes() for t in batch.column(1)]
            digests = [hashlib.sha256(x).digest()[:16] for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())],
                                             ["doc_id", "digest", "shingles"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = [jaccard(*(np.frombuffer(x.as_py(), np.uint64) for x in two)) >= similarity
                     for two in zip(batch.column("x"), batch.column("y"))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(close, pa.bool_()))

    def both(pairs: DataFrame, table: DataFrame, value: Column) -> DataFrame:
        side = lambda name, to: table.select(F.col("doc_id").alias(name), value.alias(to))
        return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")

    screened = kept_table(both(pairs, marks, F.struct("digest", "n", "parity")).mapInArrow(
        screen, "a long, b long, same boolean"), "screened")
    open_pairs = screened.filter("NOT same").select("a", "b")
    involved = open_pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = docs.join(involved, "doc_id", "left_semi").mapInArrow(hashed, "doc_id long, digest binary, shingles binary")
    sets = kept_table(sets.groupBy("doc_id").agg(F.min(F.struct("digest", "shingles")).alias("s")).select(
        "doc_id", "s.shingles"), "shingle-sets")
    found = both(open_pairs, sets, F.col("shingles")).mapInArrow(verify, "a long, b long")
    return kept_table(found.unionByName(screened.filter("same").select("a", "b")), "alike")


def close_pairs(left: dict[str, list], right: dict[str, list], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids ``a < b`` of documents of both sides with different roots whose sizes and parity bits allow the similarity.

    A side has ``doc_id, n, root, parity`` of its documents.
    """
    found, ratio = [], (1 - similarity) / (1 + similarity)

    def by_width(side: dict[str, list]) -> dict[int, tuple[np.ndarray, ...]]:
        widths = np.array([len(p) for p in side["parity"]])
        out = {}
        for width in np.unique(widths):
            own = np.flatnonzero(widths == width)
            bits = np.frombuffer(b"".join(side["parity"][i] for i in own), np.uint64).reshape(len(own), -1)
            out[int(width) // 8] = (bits, *(np.array(side[c], np.int64)[own] for c in ("doc_id", "n", "root")))
        return out

    def folded(bits: np.ndarray, width: int) -> np.ndarray:
        return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, width), axis=1)

    for one, (x, ids, sizes, roots) in by_width(left).items():
        for two, (y, other_ids, other_sizes, other_roots) in by_width(right).items():
            if min(sizes.max(), other_sizes.max()) < similarity * max(sizes.min(), other_sizes.min()) - SLACK:
                continue
            width = min(one, two)
            p, q = folded(x, width), folded(y, width)
            step = max(1, BLOCK_BYTES // (8 * width * len(q)))
            for at in range(0, len(p), step):
                cut = slice(at, at + step)
                n, m = sizes[cut, None], other_sizes[None, :]
                fits = np.minimum(n, m) >= similarity * np.maximum(n, m) - SLACK
                fits &= (roots[cut, None] != other_roots[None, :]) & (ids[cut, None] != other_ids[None, :])
                differ = np.zeros(fits.shape, np.int64)
                for word in range(width):
                    differ += np.bitwise_count(p[cut, word, None] ^ q[None, :, word])
                i, j = np.nonzero(fits & (differ <= ratio * (n + m) + SLACK))
                found.append((ids[cut][i], other_ids[j]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(z) for z in zip(*found))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def lowest_partners(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Places of those of different pairs that are among the ``most`` lowest partners of one of their documents."""
    ends, others = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((others, ends))
    ends = ends[order]
    place = np.arange(len(ends)) - np.searchsorted(ends, ends)
    return np.unique(order[place < most] % max(1, len(a)))


def _close_in_blocks(sets: DataFrame, marks: DataFrame, similarity: float, most: int) -> DataFrame:
    """``a, b, more``: ``close_pairs`` of the members of each set (``kind, set, doc_id, root``), ``most`` of a document.

    A set is dealt into blocks by its documents' hashes and every two of its blocks meet in one place, so a task holds two
    blocks at most, however large the set; only pairs that pass leave the task. ``more`` says that others were held back.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []

        def compared() -> pa.RecordBatch:
            first = place[2]
            side = lambda own: {c: [r[c] for r in own] for c in ("doc_id", "n", "root", "parity")}
            left, right = (side([r for r in held if (r["block"] == first) == is_first]) for is_first in (True, False))
            a, b = close_pairs(left, right if place[3] != first else left, similarity)
            given = lowest_partners(a, b, most)
            more = np.full(len(given), len(given) < len(a))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[given], b[given], more)], ["a", "b", "more"])

        for batch in batches:
            for r in batch.to_pylist():
                at = (r["kind"], r["set"], r["low"], r["high"])
                if at != place and held:
                    yield compared()
                    held = []
                place = at
                held.append(r)
        if held:
            yield compared()

    sizes = sets.groupBy("kind", "set").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("blocks"))
    large = F.broadcast(sizes.filter("blocks > 1"))  # one row per BLOCK_MEMBERS documents at most
    dealt = sets.join(large, ["kind", "set"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn(
        "block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    dealt = dealt.join(marks.select("doc_id", "n", "parity"), "doc_id")
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "kind", "set", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "doc_id", "n", "root", "parity")
    key, parts = ["kind", "set", "low", "high"], int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long, more boolean")


def _sets(rooted: DataFrame) -> DataFrame:
    """``kind, set, doc_id, root``: documents to be compared, of runs (``run, first, doc_id, root``) with several roots."""
    unsettled = rooted.groupBy("run").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"))
    rooted = rooted.join(unsettled.filter("low <> high").select("run", "size"), "run")
    linked = rooted.filter(F.col("size") > LONG_RUN).select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    clusters = connected(linked.distinct()).withColumnRenamed("node", "doc_id").withColumnRenamed("root", "cluster")
    long_runs = rooted.filter(F.col("size") > LONG_RUN).select("doc_id", "root").distinct().join(clusters, "doc_id").select(
        F.lit("cluster").alias("kind"), F.col("cluster").alias("set"), "doc_id", "root")
    sets = rooted.filter(F.col("size") <= LONG_RUN).select(F.lit("run").alias("kind"), F.col("run").alias("set"), "doc_id", "root")
    return sets.unionByName(long_runs)


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5,
                   similarity: float = 0.8, known: DataFrame | None = None) -> DataFrame:
    """``doc_id, component_id``: documents of groups with more than one member; the smallest id of the group.

    Groups are what all pairs connect whose sets of ``shingle``-word shingles, over whole texts, have a Jaccard similarity
    of at least ``similarity``, and ``known`` pairs (``a, b``) that are linked anyway. Null ids are never grouped; of rows that repeat an id any one stands for it. Two texts
    without a word are alike. An empty table gives none.
    """
    if not 0 < similarity <= 1:
        raise ValueError("prefixes find similarities above 0 and up to 1")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL")
    marks = kept_table(_marks(rows, shingle), "marks")
    counts = _bucket_counts(marks)
    own = marks.filter("block IS NULL").groupBy("doc_id").agg(F.min(F.struct("digest", "n", "parity")).alias("m"))
    own = kept_table(own.select("doc_id", "m.*"), "own-marks")
    parts = 1 + int((1 - similarity) * int(counts.sum()) / PART_KEYS)
    runs = kept_table(_runs(rows, shingle, similarity, counts, parts), "runs")
    runs = kept_table(runs.withColumn("run", F.monotonically_increasing_id()), "numbered-runs")
    fits = f"least({{0}}, {{1}}) >= {similarity} * greatest({{0}}, {{1}}) - {SLACK}"
    stars = runs.select(F.expr("ids[0]").alias("a"), F.expr("sizes[0]").alias("m"), F.inline(F.arrays_zip("ids", "sizes")))
    stars = stars.filter("ids > a").filter(fits.format("sizes", "m")).select("a", F.col("ids").alias("b")).distinct()
    lowest = F.row_number().over(Window.partitionBy("b").orderBy("a"))
    stars = stars.withColumn("place", lowest).filter(F.col("place") <= STARS).select("a", "b")
    tested = kept_table(stars, "stars-of-runs")
    alike, roots, most = _alike(tested, rows, own, shingle, similarity), None, PARTNERS
    if known is not None:
        alike = alike.unionByName(known.select("a", "b"))
    settled = runs.filter("size(ids) = 2").select("run", F.expr("ids[0]").alias("a"), F.expr("ids[1]").alias("b")).join(
        tested, ["a", "b"], "left_semi")
    members = runs.join(settled, "run", "left_anti").select(
        "run", F.expr("ids[0]").alias("first"), F.explode("ids").alias("doc_id"))
    members = kept_table(members.distinct(), "members-of-runs")
    while True:
        if roots is None:
            roots = kept_table(connected(alike), "roots").withColumnRenamed("node", "doc_id")
        rooted = kept_table(members.join(roots, "doc_id", "left").select(
            "run", "first", "doc_id", F.coalesce("root", "doc_id").alias("root")), "members")
        sets = kept_table(_sets(rooted), "sets")
        rest = kept_table(_close_in_blocks(sets, own, similarity, most), "rest-of-runs")
        fresh = kept_table(rest.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "fresh-pairs")
        if not fresh.isEmpty():
            alike = alike.unionByName(_alike(fresh, rows, own, shingle, similarity))
            roots = None
        if rest.filter("more").isEmpty():
            break
        tested, most = tested.unionByName(fresh), 4 * most
    roots = connected(alike).withColumnRenamed("node", "doc_id") if roots is None else roots
    return roots.select("doc_id", F.col("root").alias("component_id"))
