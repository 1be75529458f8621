"""Language-model scores of texts by a hierarchical Pitman-Yor model over all training tokens.

1. Tasks cut texts into tokens and write, per chunk of documents, the chunk's different words with their training counts
   and the documents as numbers of those words. Nothing larger than a chunk is held.
2. Counts are summed per word over all chunks (words are merged within chunks before they travel).
3. Pairs of neighbouring words are counted per chunk first, then per part: a part holds the pairs of many contexts (the word
   before; the end before a text's first word), and one context's pairs lie in several parts. Words are named by 64-bit hashes
   there; words with equal ones would share their contexts. A pair that training has once always has one table; only its
   numbers travel, not the pair.
4. Gibbs sweeps: word parts answer each pair part what the word restaurant gives to its words and how many tables their
   contexts have; pair parts seat the customers of their pairs and send back the tables. Tables of a context are customers
   of the word restaurant. Word parts seat those and send back how often each symbol follows two bytes, weighted by tables;
   spelling restaurants (at most 257^3 pairs whatever the corpus, in practice some ten thousand) are seated on the driver.
   After the burn-in each sweep is a snapshot of the model.
5. What the model gives to words, contexts and pairs, averaged over the snapshots, goes back to the chunks that have them,
   where whole texts are summed up. As in the base score, words that training has not seen are one event: its probability
   is what the restaurant and its spelling parent leave to all unseen words together.

Tables kept between these steps are removed as soon as no later step reads them.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxgauge.llm.pitman_yor import State, Strength, discount_from, seat, spelling, symbols_of
from voxgauge.llm.shared import LOWER_BYTES, id_remainder, kept_table, remove_tables, small_batches, word_blocks

CHUNK_TOKENS = 4_000_000  # a chunk closes with the document that reaches this many tokens
BURN_IN, SNAPSHOTS = 2, 3
SEED = 20
HASH_SEED = 42  # as in Spark's xxhash64
_WORDS = 200_000  # words of a chunk in one batch
_PAIRS = 1 << 16  # numbers of the seatings of pairs, apart from those of words
_PART = 180  # parts are the root of the training tokens over this: messages between any two of them grow with the tokens
_SPREAD = 16  # parts over which the pairs of one context are dealt
_TABLES, _ONCE, _TWICE = -1, -2, -3  # keys of the numbers of tables, and of words with one customer and with two
_VALUES, _STEPS, _NAMES = 0, 1, 2  # forms of packed arrays
_BLOCK = 1 << 18  # tokens of a chunk for which intermediate numbers are held

_CHUNKS = ("chunk long, word binary, number long, train long, docs binary, nulls binary, held binary, ends binary,"
           " tokens binary, hashes binary")


def tokens(text: str | None, numbers: dict[bytes, int]) -> np.ndarray:
    """Numbers of a text's words and of the end, the empty word."""
    parts = [np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
             for words in word_blocks((text or "").encode().translate(LOWER_BYTES))]
    return np.concatenate([*parts, np.array([numbers[b""]], np.uint32)])


def _chunk_rows(chunk: int, numbers: dict[bytes, int], docs: list[tuple], ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row per word of the chunk, then the row with its documents."""
    all_ids, ends = np.concatenate(ids), np.cumsum([len(x) for x in ids])
    held = np.array([h for _, h in docs])
    train = np.bincount(all_ids[np.repeat(~held, [len(x) for x in ids])], minlength=len(numbers))
    names = [c.split()[0] for c in _CHUNKS.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), *[pa.binary()] * 6]
    words = list(numbers)
    for at in range(0, len(words), _WORDS):
        part = words[at:at + _WORDS]
        columns = [[chunk] * len(part), part, np.arange(at, at + len(part)), train[at:at + len(part)]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)] + [pa.nulls(len(part), pa.binary())] * 6, names)
    values = [[chunk], [None], [None], [None], [np.array([d or 0 for d, _ in docs], np.int64).tobytes()],
              [np.array([d is None for d, _ in docs]).tobytes()], [held.tobytes()], [ends.astype(np.int64).tobytes()],
              [packed(all_ids)], [packed(np.fromiter((xxhash.xxh64_intdigest(w, HASH_SEED) for w in words), np.uint64))]]
    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)


def chunks(docs: DataFrame, held: str, doc_id: str, text: str, chunk_tokens: int) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32

        def empty() -> tuple[dict[bytes, int], list, list]:
            numbers: dict[bytes, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            return numbers, [], []

        (numbers, known, ids), size = empty(), 0
        for batch in batches:
            for doc, out, value in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2)):
                ids.append(tokens(value.as_py(), numbers))
                known.append((doc, out))
                size += len(ids[-1])
                if size >= chunk_tokens:
                    yield from _chunk_rows(chunk, numbers, known, ids)
                    (numbers, known, ids), size, chunk = empty(), 0, chunk + 1
                    _release()
        if known:
            yield from _chunk_rows(chunk, numbers, known, ids)
        del numbers, known, ids
        _release()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(held).alias("held"), F.col(text).alias("text"))
    return rows.mapInArrow(run, _CHUNKS)


def _random(data: np.ndarray, sweep: int) -> np.random.Generator:
    """The same numbers when a task is run again."""
    return np.random.default_rng([SEED, sweep, zlib.crc32(data.tobytes())])


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Like Spark's pmod of its signed hash."""
    return (hashes.view(np.int64) % parts).astype(np.int32)


def packed(values: np.ndarray) -> bytes:
    """What travels between tasks, in few bytes: ascending numbers as their steps; of whole numbers the first bytes of all
    values, then the second ones and so on; compressed, with the form and the size in front."""
    whole = values.dtype.kind in "iu"
    ascending = whole and bool((values[1:] >= values[:-1]).all())
    if ascending:
        values = np.diff(values, prepend=values.dtype.type(0))
    data = (values.view(np.uint8).reshape(-1, values.itemsize).T if whole else values).tobytes()
    return bytes([_STEPS if ascending else _VALUES]) + len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def packed_names(values: np.ndarray) -> bytes:
    """The different values and their places: for values that come again and again, like hashes of words in pairs."""
    if (values[1:] >= values[:-1]).all():
        fresh = np.append(True, values[1:] != values[:-1])[:len(values)]
        different, place = values[fresh], np.cumsum(fresh) - 1
    else:
        different, place = np.unique(values, return_inverse=True)
    first = packed(different)
    return bytes([_NAMES]) + len(first).to_bytes(8, "little") + first + packed(place.astype(np.int32))


def unpacked(data: bytes, kind: type) -> np.ndarray:
    form, size, data = data[0], int.from_bytes(data[1:9], "little"), memoryview(data)[9:]
    if form == _NAMES:
        return unpacked(data[:size], kind)[unpacked(data[size:], np.int32)]
    values, kind = np.frombuffer(pa.decompress(data, size, "zstd"), np.uint8), np.dtype(kind)
    if kind.kind in "iu":
        values = np.ascontiguousarray(values.reshape(kind.itemsize, -1).T).reshape(-1)
    return np.cumsum(values.view(kind), dtype=kind) if form == _STEPS else values.view(kind)


def _length(data: bytes, kind: type) -> int:
    """Number of values of ``packed`` ones."""
    return int.from_bytes(data[1:9], "little") // np.dtype(kind).itemsize


def _release() -> None:
    """Give back what Arrow keeps for later: two workers and their executor share its memory."""
    pa.default_memory_pool().release_unused()


def _joined(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(unpacked(x, kind) for x in table.column(column).to_pylist())])


def chunk_pairs(ids: np.ndarray, hashes: np.ndarray, parts: int) -> Iterator[tuple]:
    """Per part in turn: the part, its tokens, the place of each token's pair, and the words' hashes of the different pairs.

    The end is the word before a text; it is also the last token of the text before. One part's pairs are sorted at a time.
    """
    by_hash = np.argsort(hashes, kind="stable")
    rank = np.empty(len(hashes), np.uint32)
    rank[by_hash] = np.arange(len(hashes), dtype=np.uint32)
    ids, hashes, spread = rank[ids], hashes[by_hash], hashes[by_hash] % np.uint64(_SPREAD)
    part = np.empty(len(ids), np.min_scalar_type(parts))
    for at in range(0, len(ids), _BLOCK):
        w = ids[at:at + _BLOCK]
        part[at:at + _BLOCK] = _part_of(hashes[np.append(ids[at - 1], w[:-1])] + spread[w], parts)
    order = np.argsort(part, kind="stable").astype(np.int32)
    sizes = np.bincount(part)
    names, sizes = np.flatnonzero(sizes), sizes[sizes > 0]
    ends = np.cumsum(sizes)
    for name, start, end in zip(names.tolist(), ends - sizes, ends):
        tokens = order[start:end]
        keys, place = np.unique(ids[tokens - 1].astype(np.uint64) << np.uint64(32) | ids[tokens], return_inverse=True)
        yield name, tokens, place, hashes[(keys >> np.uint64(32)).astype(np.uint32)], hashes[keys.astype(np.uint32)]


def _sent_pairs(texts: DataFrame, parts: int, held: bool) -> DataFrame:
    """``chunk, part, u, w, n``: a row per chunk and part with its pairs and their training counts; all or those in training."""
    names, kinds = ["chunk", "part", "u", "w", "n"], [pa.int64(), pa.int32(), *[pa.binary()] * 3]

    def rows_of(text: dict) -> Iterator[tuple]:
        train = np.repeat(~np.frombuffer(text["held"], bool), np.diff(np.frombuffer(text["ends"], np.int64), prepend=0))
        for part, own, place, u, w in chunk_pairs(unpacked(text["tokens"], np.uint32), unpacked(text["hashes"], np.uint64), parts):
            n = np.bincount(place[train[own]], minlength=len(u)).astype(np.int32)
            if not held:
                u, w, n = (x[n > 0] for x in (u, w, n))
            if len(n):
                yield text["of_chunk"], part, packed_names(u), packed_names(w), packed(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                for row in rows_of(batch.slice(at, 1).to_pylist()[0]):
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)
                _release()

    return texts.select("of_chunk", "tokens", "ends", "hashes", "held").mapInArrow(
        run, "chunk long, part int, u binary, w binary, n binary")


def _asked(u: np.ndarray, w: np.ndarray, parts: int) -> tuple[np.ndarray, ...]:
    """Different words of pairs in the order of their parts, where a part begins, the parts, places of contexts and words."""
    words, place = np.unique(np.concatenate([u, w]), return_inverse=True)
    part = _part_of(words, parts)
    order = np.argsort(part, kind="stable")
    moved = np.empty(len(order), np.int32)
    moved[order] = np.arange(len(order))
    to_parts, starts = np.unique(part[order], return_index=True)
    return words[order], starts, to_parts, moved[place[:len(u)]], moved[place[len(u):]]


_MESSAGE = "kind int, part int, to_part int, u binary, w binary, n binary, total long"


def _messages(part: int, kind: int, starts: np.ndarray, to_parts: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """A row for each part of the words, with what a pair part says of them."""
    cut = lambda x: pa.array([packed(y) for y in np.split(x, starts[1:])][:len(starts)], pa.binary())
    own = {c: cut(x) for c, x in columns.items()}
    empty = pa.nulls(len(starts), pa.binary())
    total = np.add.reduceat(columns["w"], starts) if "w" in columns and len(starts) else np.zeros(len(starts))
    return pa.table([pa.array(np.full(len(starts), kind, np.int32)), pa.array(np.full(len(starts), part, np.int32)),
                     pa.array(to_parts, pa.int32()), *(own.get(c, empty) for c in "uwn"),
                     pa.array(total.astype(np.int64))], [c.split()[0] for c in _MESSAGE.split(", ")])


def _tables_of(n: int, u: np.ndarray, w: np.ndarray, tables: np.ndarray) -> dict[str, np.ndarray]:
    """Tables of pairs summed by their second word (``w``) and by their context (``n``), of ``n`` words."""
    return {c: np.bincount(x, tables, n).astype(np.int32) for c, x in (("w", w), ("n", u))}


def pair_parts(texts: DataFrame, parts: int) -> DataFrame:
    """Kinds of rows: 0 pairs seen more than once, 1 numbers of the others, 2 words of the former, 3 their first tables.

    Pairs of kind 0 name their words by their places among those of kind 2.
    """
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        u, w, n = (_joined(table, c, kind) for c, kind in (("u", np.uint64), ("w", np.uint64), ("n", np.int32)))
        order = np.lexsort((w, u))
        u, w, n = u[order], w[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])]))
        u, w, n = u[starts], w[starts], np.add.reduceat(n, starts, dtype=np.int64)
        out, many = [], n > 1
        if not many.all():
            words, starts, to_parts, before, after = _asked(u[~many], w[~many], parts)
            out.append(_messages(part, 1, starts, to_parts, u=words, **_tables_of(len(words), before, after, n[~many])))
        if many.any():
            words, starts, to_parts, before, after = _asked(u[many], w[many], parts)
            n = n[many].astype(np.int32)
            out.append(pa.table([pa.array([x], k) for x, k in zip(
                (0, part, None, packed(before), packed(after), packed(n), int((n == 2).sum())),
                (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()))],
                [c.split()[0] for c in _MESSAGE.split(", ")]))
            out.append(_messages(part, 2, starts, to_parts, u=words))
            out.append(_messages(part, 3, starts, to_parts, **_tables_of(len(words), before, after, np.ones(len(n)))))
        return pa.concat_tables(out)

    return _sent_pairs(texts, parts, held=False).groupBy("part").applyInArrow(run, _MESSAGE)


def word_parts(words: DataFrame, pairs: DataFrame, parts: int) -> DataFrame:
    """A row per part (no ``asker``) with its words of the training texts in the order of their hashes; and a row per part of
    pairs that asks, with the steps between the places of the words it asks for.

    ``alone`` and ``after`` are a word's pairs seen once, as the second word and as the context.
    """
    names = [c.split()[0] for c in _WORD_PARTS.split(", ")]
    kinds = [pa.binary() if "binary" in c else pa.int32() for c in _WORD_PARTS.split(", ")]

    def run(words: pa.Table, known: pa.Table) -> pa.Table:
        texts, part = words.column("word").to_pylist(), words.column("to_part")[0].as_py()
        hashes = np.fromiter((xxhash.xxh64_intdigest(x, HASH_SEED) for x in texts), np.uint64)
        order = np.argsort(hashes, kind="stable")
        hashes, texts, seen = hashes[order], [texts[i] for i in order], words.column("count").to_numpy()[order]
        alone, after = np.zeros((2, len(hashes)), np.int64)
        rows = []
        for r in known.to_pylist():
            place = np.searchsorted(hashes, unpacked(r["u"], np.uint64))
            if r["kind"] == 1:
                np.add.at(alone, place, unpacked(r["w"], np.int32))
                np.add.at(after, place, unpacked(r["n"], np.int32))
            else:
                rows.append([part, r["part"], packed(np.diff(place, prepend=0).astype(np.int32)), *[None] * 5])
        rows.append([part, None, None, b"".join(texts), packed(np.fromiter(map(len, texts), np.int64)),
                     packed(alone.astype(np.int32)), packed(after.astype(np.int32)), packed(seen)])
        return pa.table([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], names)

    named = words.filter("count > 0").select(F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int").alias("to_part"), "word", "count")
    return named.groupBy("to_part").cogroup(pairs.filter("kind IN (1, 2)").groupBy("to_part")).applyInArrow(run, _WORD_PARTS)


_WORD_PARTS = "to_part int, asker int, places binary, data binary, lengths binary, alone binary, after binary, seen binary"
_ANSWERS = "kind int, part int, to_part int, p binary, after binary, key long, n long, mass double"


def _seat_words(dictionary: DataFrame, tables: DataFrame, state: State | None, sweep: int, customers: int,
                told: bool) -> DataFrame:
    """Word restaurant of a sweep. Kinds of rows: 0 answers to pair parts, 1 (if ``told``) what all words get, 2 symbols."""
    shared = dictionary.sparkSession.sparkContext.broadcast(state)
    names = [c.split()[0] for c in _ANSWERS.split(", ")]
    kinds = [pa.int32()] * 3 + [pa.binary()] * 2 + [pa.int64()] * 2 + [pa.float64()]

    def run(known: pa.Table, tables: pa.Table) -> pa.Table:
        rows = known.to_pylist()
        own = next(r for r in rows if r["asker"] is None)
        data, lengths = np.frombuffer(own["data"], np.uint8), unpacked(own["lengths"], np.int64)
        count, after = (unpacked(own[c], np.int32).astype(np.int64) for c in ("alone", "after"))
        asked = {r["asker"]: np.cumsum(unpacked(r["places"], np.int32)) for r in rows if r["asker"] is not None}
        for r in tables.to_pylist():
            np.add.at(count, asked[r["part"]], unpacked(r["w"], np.int32))
            np.add.at(after, asked[r["part"]], unpacked(r["n"], np.int32))
        count = np.maximum(count, 1)
        if shared.value:
            parent = shared.value.parent(data, lengths)
            seated = shared.value.seat(parent, count, _random(data, sweep))
            mass, p = float(parent.sum()), shared.value.predict(parent, count, None, seated)
        else:
            seated, mass, p = np.minimum(count, 1), 0.0, count / customers
        keys, _ = symbols_of(data, lengths)
        different, place = np.unique(keys, return_inverse=True)
        sums = np.bincount(place, np.repeat(seated, lengths + 1)).astype(np.int64)
        part = own["to_part"]
        out = [[0, a, part, packed(p[x].astype(np.float32)), packed(after[x].astype(np.int32)), None, None, None]
               for a, x in asked.items()]
        if told:
            out.append([1, None, part, packed(p.astype(np.float32)), packed(after.astype(np.int32)), None, None, None])
        out += [[2, None, part, None, None, key, int(x.sum()), m] for key, x, m in (
            (_TABLES, seated, mass), (_ONCE, count == 1, 0.0), (_TWICE, count == 2, 0.0))]
        answers = pa.table([pa.array(list(x), k) for x, k in zip(zip(*out), kinds)], names)
        n = len(different)
        symbols = pa.table([pa.array(np.full(n, 2, np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                            pa.nulls(n, pa.binary()), pa.array(different), pa.array(sums), pa.array(np.zeros(n))], names)
        return pa.concat_tables([answers, symbols])

    return dictionary.groupBy("to_part").cogroup(tables.groupBy("to_part")).applyInArrow(run, _ANSWERS)


def _seat_pairs(pairs: DataFrame, answers: DataFrame, strength: Strength, sweep: int) -> DataFrame:
    """Contexts of a sweep: rows of kind 3 with the tables by word, and of kind 4 with the tables of the part's pairs."""
    def run(pairs: pa.Table, answers: pa.Table) -> pa.Table:
        row = pairs.to_pylist()[0]
        u, w, n = (unpacked(row[c], np.int32) for c in "uwn")
        answers = answers.sort_by("to_part")
        p, after = _joined(answers, "p", np.float32).astype(float), _joined(answers, "after", np.int32)
        starts = np.cumsum([0, *(_length(x, np.int32) for x in answers.column("after").to_pylist())])[:-1]
        pull = (strength.concentration + strength.discount * after[u]) * p[w]
        tables = seat(n.astype(np.int64), pull, strength.discount, _random(w, _PAIRS + sweep))
        own = pa.table([pa.array([x], k) for x, k in zip(
            (4, row["part"], sweep, None, None, packed(tables.astype(np.int32)), 0),
            (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()))],
            [c.split()[0] for c in _MESSAGE.split(", ")])
        to_parts = answers.column("to_part").to_numpy()
        return pa.concat_tables([own, _messages(row["part"], 3, starts, to_parts, **_tables_of(len(p), u, w, tables))])

    return pairs.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(run, _MESSAGE)


def _symbols(answers: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[int, int], float]:
    """Symbol keys with their counts, the numbers under other keys, the parent's probability of all words."""
    rows = answers.filter("kind = 2").groupBy("key").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"))
    found = rows.filter("n > 0").toArrow().sort_by("key")  # at most 257^3 + 3 rows
    keys, n, mass = (found.column(c).to_numpy() for c in ("key", "n", "mass"))
    return keys[keys >= 0], n[keys >= 0], {k: int(n[keys == k].sum()) for k in (_TABLES, _ONCE, _TWICE)}, float(mass.sum())


def snapshots(dictionary: DataFrame, pairs: DataFrame, burn_in: int = BURN_IN,
              keep: int = SNAPSHOTS) -> tuple[list[tuple[DataFrame, DataFrame, State]], Strength]:
    """After the burn-in the tables with what words get (kind 1) and with the tables of pairs (kind 4), and the model; and the
    strength of the contexts. Tables of the sweeps before are removed."""
    once, twice = pairs.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("total"))), F.lit(0)) for k in (1, 0)]).first()
    contexts, state, found, seated = Strength(discount_from(once, twice)), None, [], pairs
    own = pairs.filter("kind = 0").select("part", "u", "w", "n")
    for sweep in range(burn_in + keep + 1):  # the last sweep only tells the last snapshot
        tables = seated.filter("kind = 3")
        customers = once + (tables.agg(F.sum("total")).first()[0] or 0)
        if state:
            state.customers = customers
        answers = kept_table(_seat_words(dictionary, tables.select("to_part", "part", "w", "n"), state, sweep, customers,
                                          sweep > burn_in), "lm-answers")
        keys, counts, numbers, mass = _symbols(answers)
        if state:
            state.unseen = max(1 - mass, 1e-12)
            state.total = (customers - state.strength.discount * numbers[_TABLES] + state.share) / (
                customers + state.strength.concentration)
        if sweep > burn_in:
            found.append((answers, seated, state))
        if sweep < burn_in + keep:
            strength = state.strength if state else Strength(discount_from(numbers[_ONCE], numbers[_TWICE]))
            state = State(spelling(keys, counts, np.random.default_rng([SEED, sweep])), numbers[_TABLES], strength, customers)
            earlier = [] if sweep > burn_in else [answers, seated][:2 if sweep else 1]  # the first tables lie in ``pairs``
            seated = kept_table(_seat_pairs(own, answers.filter("kind = 0").select("part", "to_part", "p", "after"), contexts,
                                            sweep), "lm-tables")
            remove_tables(*earlier)
    return found, contexts


def word_scores(entries: DataFrame, dictionary: DataFrame, answers: list[tuple[DataFrame, float]], contexts: Strength,
                unseen: float, parts: int) -> DataFrame:
    """``chunk, numbers, counts, p, share``: per chunk and part its words, found by their bytes.

    ``p`` is a word's probability, ``share`` what its context leaves to the word restaurant; means of the snapshots.
    """
    def run(entries: pa.Table, known: pa.Table) -> pa.Table:
        rows = known.to_pylist()
        own = [r for r in rows if r["seen"] is not None]
        words, counts, p, share = pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        if own:
            counts = unpacked(own[0]["seen"], np.int64)
            told = [(unpacked(r["p"], np.float32) / r["total"], unpacked(r["after"], np.int32)) for r in rows if r["seen"] is None]
            p, after = (np.mean(x, axis=0, dtype=float) for x in zip(*told))
            ends = np.cumsum(unpacked(own[0]["lengths"], np.int64))
            words = pa.array([own[0]["data"][a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())], pa.binary())
            share = (contexts.concentration + contexts.discount * after) / (counts + contexts.concentration)
        place = pa.compute.index_in(entries.column("word").combine_chunks(), value_set=words).fill_null(len(words)).to_numpy()
        chunk, numbers = entries.column("chunk").to_numpy(), entries.column("number").to_numpy()
        order = np.lexsort((numbers, chunk))
        names, starts = np.unique(chunk[order], return_index=True)
        cut = lambda x: pa.array([packed(y) for y in np.split(x[order], starts[1:])][:len(names)], pa.binary())
        return pa.table({
            "chunk": names, "numbers": cut(numbers.astype(np.uint32)), "counts": cut(np.append(counts, 0)[place]),
            "p": cut(np.append(p, unseen)[place].astype(np.float32)), "share": cut(np.append(share, 1.0)[place].astype(np.float32))})

    rows = dictionary.filter("asker IS NULL").select("to_part", "data", "lengths", "seen", F.lit(None).cast("binary").alias("p"),
                                                     F.lit(None).cast("binary").alias("after"))
    for x, total in answers:
        told = x.filter("kind = 1").select("to_part", "p", "after", F.lit(total).alias("total"))
        rows = rows.unionByName(told, allowMissingColumns=True)
    named = entries.select("chunk", "word", "number", F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int").alias("of_part"))
    return named.groupBy("of_part").cogroup(rows.groupBy("to_part")).applyInArrow(
        run, "chunk long, numbers binary, counts binary, p binary, share binary")


def pair_scores(texts: DataFrame, pairs: DataFrame, tables: list[DataFrame], contexts: Strength, parts: int) -> DataFrame:
    """``chunk, part, own``: of each pair of a chunk its customers less discounts, by the mean tables of the snapshots."""
    def run(sent: pa.Table, told: pa.Table) -> pa.Table:
        u, w, n = (_joined(sent, c, kind) for c, kind in (("u", np.uint64), ("w", np.uint64), ("n", np.int32)))
        lengths = [_length(x, np.int32) for x in sent.column("n").to_pylist()]
        order = np.lexsort((w, u))
        u, w = u[order], w[order]
        fresh = np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
        count = np.add.reduceat(n[order], np.flatnonzero(fresh), dtype=np.int64)
        mean = np.minimum(count, 1).astype(float)
        if len(told):  # pairs seen more than once, in the same order
            mean[count > 1] = np.mean([unpacked(x, np.int32) for x in told.column("n").to_pylist()], axis=0)
        own = np.empty(len(u), np.float32)
        own[order] = (count - contexts.discount * mean)[np.cumsum(fresh) - 1]
        cut = [packed_names(x) for x in np.split(own, np.cumsum(lengths)[:-1])]
        return pa.table({"chunk": sent.column("chunk"), "part": sent.column("part"), "own": pa.array(cut, pa.binary())})

    rows = pairs.select("part", "n").limit(0)
    for x in tables:
        rows = rows.unionByName(x.filter("kind = 4").select("part", "n"))
    return _sent_pairs(texts, parts, held=True).groupBy("part").cogroup(rows.groupBy("part")).applyInArrow(
        run, "chunk long, part int, own binary")


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = 10, remainder: int = 0,
                burn_in: int = BURN_IN, keep: int = SNAPSHOTS, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``, one row per input row.

    Documents whose id has crc32 remainder ``remainder`` are held out, the others train the model; a null id counts as the
    empty text. Tokens are words between ASCII blanks with A-Z lower-cased, and one end per text; null texts are empty.
    ``base_score`` is the add-0.1 unigram score, ``score`` the model's log10 probability of the text, ``perplexity`` its
    per-token perplexity. Other columns are ignored. Without training texts every word is unseen, with probability 1.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                       (id_remainder(doc_id, modulus) == remainder).alias("held"))
    written = kept_table(chunks(rows, "held", "doc_id", "text", chunk_tokens), "lm-chunks")
    entries = written.filter("word IS NOT NULL").select("chunk", "word", "number", "train")
    words = kept_table(entries.groupBy("word").agg(F.sum("train").alias("count")).filter("count > 0"), "lm-words")
    total, vocabulary = words.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    parts = 1 + int(total**0.5 / _PART)
    texts = written.filter("word IS NULL").select(
        F.col("chunk").alias("of_chunk"), "docs", "nulls", "held", "ends", "tokens", "hashes")
    pairs = kept_table(pair_parts(texts, parts), "lm-pairs")
    dictionary = kept_table(word_parts(words, pairs, parts), "lm-dictionary")
    remove_tables(words)
    found, contexts = snapshots(dictionary, pairs, burn_in, keep)
    remove_tables(pairs)
    own = kept_table(pair_scores(texts, pairs, [t for _, t, _ in found], contexts, parts), "lm-own")
    remove_tables(*[t for _, t, _ in found])
    unseen = float(np.mean([s.share * s.unseen / (s.customers + s.strength.concentration) / s.total for _, _, s in found]))
    known = kept_table(word_scores(entries, dictionary, [(a, s.total) for a, _, s in found], contexts, unseen, parts), "lm-known")
    remove_tables(dictionary, *[a for a, _, _ in found])
    known = known.unionByName(own, allowMissingColumns=True)
    floor = np.log10(total + 0.1 * (vocabulary + 1))

    def run(known: pa.Table, texts: pa.Table) -> pa.Table:
        _release()
        words, pairs = (known.filter(pa.compute.is_valid(known[c])) for c in ("numbers", "part"))
        numbers = _joined(words, "numbers", np.uint32)
        counts, p, share = np.zeros(len(numbers), np.int64), np.zeros(len(numbers)), np.zeros(len(numbers))
        for to, name, kind in ((counts, "counts", np.int64), (p, "p", np.float32), (share, "share", np.float32)):
            to[numbers] = _joined(words, name, kind)
        row = texts.to_pylist()[0]
        ids, ends = unpacked(row["tokens"], np.uint32), np.frombuffer(row["ends"], np.int64)
        starts, n = np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)
        base = np.add.reduceat((np.log10(counts + 0.1) - floor)[ids], starts)
        n_known = np.add.reduceat((counts > 0)[ids], starts, dtype=np.int64)
        own, of_part = np.empty(len(ids), np.float32), dict(zip(pairs["part"].to_pylist(), pairs["own"].to_pylist()))
        for part, tokens, place, _, _ in chunk_pairs(ids, unpacked(row["hashes"], np.uint64), parts):
            own[tokens] = unpacked(of_part.pop(part), np.float32)[place]
        log_p = np.empty(len(ids))
        for at in range(0, len(ids), _BLOCK):
            w, here = ids[at:at + _BLOCK], own[at:at + _BLOCK].astype(float)
            before = np.append(ids[at - 1], w[:-1])
            log_p[at:at + _BLOCK] = np.log10(here / (counts[before] + contexts.concentration) + share[before] * p[w])
        score = np.add.reduceat(log_p, starts)
        return pa.table({
            "doc_id": pa.array(np.frombuffer(row["docs"], np.int64), mask=np.frombuffer(row["nulls"], bool)),
            "held_out": pa.array(np.frombuffer(row["held"], bool)), "n_tokens": pa.array(n),
            "n_known": pa.array(n_known),
            "train_tokens": pa.array(np.full(len(n), total, np.int64)), "base_score": pa.array(base),
            "score": pa.array(score), "perplexity": pa.array(10 ** (-score / n))})

    return known.groupBy("chunk").cogroup(texts.groupBy("of_chunk")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double,"
        " score double, perplexity double")
