"""Exact duplicates: Patricia tries over length-and-hash partitions own the identifiers of equal texts.

A key is the text's 64-bit hash, its length and all its bytes, so the root has a subtree for each first byte of the hash. Rows are dealt by length and hash, which spreads different
texts evenly and brings equal ones together. Before they are dealt, a trie in each map task merges the copies it meets, so
a text that makes up a third of all rows travels once per task. After that a trie per partition compares whole byte
strings; its terminal nodes hold the identifier that stays and the number of rows.

Memory: a trie holds at most ``trie_bytes`` of edges. Beyond that, subtrees leave it as rows: before the shuffle subtree
after subtree until half is left (the partial owners meet again after it), and after it every subtree but that of the current
key, since rows come sorted by length and hash and all earlier keys are complete. Rows leave in batches of a few megabytes.
Nothing is written to a local folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxgauge.llm.shared import lower_ascii, small_batches

TRIE_BYTES = 32 << 20
#: Bytes of texts in one batch of rows that leave a trie; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20
_PARTIAL = "size long, digest long, body binary, owner long, members long"
_OWNERS = "size long, digest long, text_sha256 string, owner long, members long"


class Node:
    """An edge label, the subtrees by first byte, and at a terminal the owner and the number of rows."""

    __slots__ = ("label", "children", "owner", "members")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.members = label, {}, None, 0


class PatriciaTrie:
    """A radix trie with compressed edges whose terminals own identifiers."""

    def __init__(self, keep: str = "largest"):
        self.better = max if keep == "largest" else min
        self.root, self.held = Node(b""), 0

    def insert(self, key: bytes, owner: int | None, members: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.held += len(key) - at + 200
                node = child
                break
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = shared_length(label, key, at)
            fork = node.children[key[at]] = Node(label[:same])
            child.label = label[same:]
            fork.children[child.label[0]] = child
            self.held += 200
            node, at = fork, at + same
        node.members += members
        if owner is not None:
            node.owner = owner if node.owner is None else self.better(node.owner, owner)

    def drain(self, until: int = 0, current: bytes | None = None) -> Iterator[tuple[bytes, int | None, int]]:
        """Remove subtrees of the root, one by one, until at most ``until`` bytes are held; ``current`` stays in the trie.

        A subtree is taken apart while its rows are read, so read all of them before the next insertion.
        """
        stays = None
        for first in sorted(self.root.children):
            if self.held <= until:
                break
            stack = [(self.root.children.pop(first), b"")]
            while stack:
                node, prefix = stack.pop()
                key = prefix + node.label
                self.held -= len(node.label) + 200
                if node.members:
                    if key == current:
                        stays = (key, node.owner, node.members)
                    else:
                        yield key, node.owner, node.members
                stack.extend((child, key) for child in node.children.values())
        if stays:
            self.insert(*stays)


def shared_length(label: bytes, key: bytes, at: int) -> int:
    """How many bytes of the label the key has at this place, found by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


def _key(size: int, digest: int, body: bytes) -> bytes:
    return (digest & (1 << 64) - 1).to_bytes(8, "big") + size.to_bytes(8, "big") + body


def _columns(found: list[tuple[bytes, int | None, int]], partial: bool) -> pa.RecordBatch:
    bodies = [key[16:] for key, _, _ in found]
    digests = [int.from_bytes(key[:8], "big") for key, _, _ in found]
    third = (pa.array(bodies, pa.binary()) if partial
             else pa.array([hashlib.sha256(b).hexdigest() for b in bodies], pa.string()))
    return pa.RecordBatch.from_arrays([
        pa.array([int.from_bytes(key[8:16], "big") for key, _, _ in found], pa.int64()),
        pa.array([d - (1 << 64) if d >> 63 else d for d in digests], pa.int64()),
        third,
        pa.array([owner for _, owner, _ in found], pa.int64()),
        pa.array([members for _, _, members in found], pa.int64()),
    ], ["size", "digest", "body" if partial else "text_sha256", "owner", "members"])


def _batches(found: Iterator[tuple[bytes, int | None, int]], partial: bool) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for row in found:
        if rows and held + len(row[0]) > BATCH_BYTES:
            yield _columns(rows, partial)
            rows, held = [], 0
        rows.append(row)
        held += len(row[0])
    if rows:
        yield _columns(rows, partial)


def _merge(keep: str, trie_bytes: int, partial: bool):
    """An Arrow function that merges rows of equal bodies; ``partial`` rows need not come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, key = PatriciaTrie(keep), None
        for batch in batches:
            for size, digest, body, owner, members in zip(*(batch.column(i).to_pylist() for i in range(5))):
                key = _key(size, digest, body)
                trie.insert(key, owner, members)
                if trie.held > trie_bytes:
                    until = trie_bytes // 2 if partial else 0
                    yield from _batches(trie.drain(until, None if partial else key), partial)
        yield from _batches(trie.drain(), partial)

    return run


def exact_owners(bodies: DataFrame, keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per different body: ``size, digest, text_sha256, owner, members``.

    ``bodies`` has ``doc_id`` (long) and ``body`` (string, not null). Null ids count as members and never own a text that
    has another id; the owner is null where all ids are.
    """
    small_batches(bodies.sparkSession)
    rows = bodies.select(
        F.octet_length("body").cast("long").alias("size"), F.xxhash64("body").alias("digest"),
        F.col("body").cast("binary").alias("body"), F.col("doc_id").alias("owner"), F.lit(1).cast("long").alias("members"))
    merged = rows.mapInArrow(_merge(keep, trie_bytes, partial=True), _PARTIAL)
    dealt = merged.repartition("size", "digest").sortWithinPartitions("size", "digest")
    return dealt.mapInArrow(_merge(keep, trie_bytes, partial=False), _OWNERS)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest",
                trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Group rows of equal text and name the one that stays.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``, one row per input row. Texts are equal when they are the
    same after lower-casing A-Z; a null text counts as empty, empty texts are one group. Of equal texts the largest id
    stays (``keep="smallest"``: the smallest); a row that repeats the staying id is ``kept`` as well, and a null id is
    kept only if its group has no other id. Other columns are ignored, whatever their names. An empty table gives none.
    """
    bodies = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                         lower_ascii(F.coalesce(F.col(text), F.lit(""))).alias("body"))
    digests = bodies.select(
        "doc_id", F.octet_length("body").cast("long").alias("size"), F.xxhash64("body").alias("digest"),
        F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"))
    owners = exact_owners(bodies, keep, trie_bytes)
    return digests.join(owners, ["size", "digest", "text_sha256"]).select(
        "doc_id", F.col("owner").alias("keep_id"), F.col("members").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("owner")).alias("kept"), "text_sha256")
