"""How the words of each source differ from those of its language and of the language's other sources.

Counting. A task takes the terms of about ``SHARD_BYTES`` of text, batch by batch. Terms of up to 8 bytes are one 64-bit word, up
to 16 bytes two; they are sorted by radix passes over 16 bits each (numpy's stable sort of 16-bit numbers) and counted in runs.
Longer terms have a bucket of their own, whose different terms are counted and sorted as bytes. The passes are stable, so within
a run documents come one after the other and the run also tells in how many documents the term is. A batch has whole documents,
so runs of batches add up. The runs of a shard are written packed, per language, in rows and pages of a fraction of a MB, and
read few rows at a time: two Python workers and the executor share one memory.

Vocabulary. Per shard and language each term is one row for the count of documents. The terms in enough documents are marked in
a filter of ``FILTER_BITS`` bits, whatever their number; only runs that pass it are shuffled by term, and an exact join with the
vocabulary follows.

Divergence. Shares are integers, by exact decimal division. For pairs of sources the terms of a language are dealt into blocks; a
block holds a matrix of the shares of its terms in all sources and gives one sum for each pair, which is what the report has
anyway; no pair of rows is ever formed. Terms that a source lacks have the same share everywhere in it, so only counts above
zero travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxgauge.llm.shared import LOWER_BYTES, byte_batches, kept_table, read_batches, release_memory

LEAST_DOCUMENTS = 30       # documents of its language that a kept term is in
SCALE, SMOOTHING = 1_000_000_000, 5
TERM_RANKS = 50
SHARD_BYTES = 24 << 20     # text whose terms are counted together, about
BATCH_BYTES = 4 << 20      # text of a batch, and of a piece of a longer text
ROW_RUNS = 1 << 13         # runs in one packed row
READ_ROWS = 16             # packed rows that a reader decodes at once
FILTER_BITS = 1 << 24
BLOCK_ROWS = 1 << 14       # counts of one block of terms, about
MATRIX_CELLS = 1 << 20     # shares held at once while a block is summed
#: Sizes of pages of packed rows are looked at from the first row on: else a hundred rows make one page.
PAGES = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4"}

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(97, 123), *range(128, 256)]] = True  # capitals are small by then
#: Masks that keep the first n of 8 bytes, the first byte highest.
_FIRST = np.array([0, *[(1 << 64) - (1 << 8 * (8 - n)) for n in range(1, 9)]], np.uint64)


def radix_order(keys: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """``order`` sorted by unsigned ``keys``, least significant first, in stable passes over 16 bits."""
    for key in keys:
        for shift in range(0, key.dtype.itemsize * 8, 16):
            digit = (key >> key.dtype.type(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def packed_terms(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased UTF-8: place and length of each term, its first 8 and next 8 bytes as numbers; and the bytes."""
    padded = np.frombuffer(data + bytes(16), np.uint8)
    inside = _LETTERS[padded]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate([[0], edges])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    one, two = (np.ascontiguousarray(words[starts + at]).view(">u8").ravel().astype(np.uint64)
                if len(starts) else np.zeros(0, np.uint64) for at in (0, 8))
    return starts, lengths, one & _FIRST[np.minimum(lengths, 8)], two & _FIRST[np.clip(lengths - 8, 0, 8)], padded


class Shard:
    """Terms of one language, as they come in, and their runs.

    Terms are counted as soon as their documents are complete, so a shard holds the runs of its batches of text, not all terms.
    """

    def __init__(self) -> None:
        self.sources: dict[str, int] = {}
        self._held: list[tuple[np.ndarray, ...]] = []  # first and second word, source, document, count
        self._long: list[pa.Table] = []  # term, source, document, count
        self._counted: tuple[list, list] = [], []  # of terms of one word and of two: words, source, occurrences, documents
        self._long_counted: list[pa.Table] = []

    def add(self, data: bytes, sources: np.ndarray, documents: np.ndarray, offsets: np.ndarray) -> None:
        """Terms of texts that lie one after the other, each ended by a byte outside terms."""
        starts, lengths, one, two, padded = packed_terms(data)
        of = np.searchsorted(offsets, starts, "right") - 1
        short = lengths <= 16
        rows = of[short]
        self._held.append((one[short], two[short], sources[rows].astype(np.uint32), documents[rows].astype(np.uint32),
                           np.ones(len(rows), np.uint32)))
        if len(rows) < len(of):
            rows = of[~short]
            self._long.append(pa.table({"term": _cut(padded, starts[~short], lengths[~short]), "source": sources[rows].astype(np.uint32),
                                        "document": documents[rows].astype(np.uint32), "n": np.ones(len(rows), np.int64)}))

    def reduce(self) -> None:
        """Replace what is held by its runs per term, source and document; used between the pieces of one long text."""
        one, two, source, document, count = self._columns()
        order = radix_order([document, source, two, one], np.arange(len(one)))
        one, two, source, document, count = (x[order] for x in (one, two, source, document, count))
        begin = np.flatnonzero(_changes(one, two, source, document))
        self._held = [(one[begin], two[begin], source[begin], document[begin], _sums(count, begin).astype(np.uint32))]
        if self._long:
            self._long = [_summed(self._long, ["term", "source", "document"], ["n"])]

    def settle(self) -> None:
        """Replace what is held by its runs per term and source; no more terms of its documents come."""
        one, two, source, document, count = self._columns()
        self._held = []
        for bucket, words in zip(self._counted, ([one], [one, two])):
            own = np.flatnonzero((two == 0) == (len(words) == 1))
            order = radix_order([document, source, *words[::-1]], own)
            words, (source_of, document_of) = [w[order] for w in words], (x[order] for x in (source, document))
            run = _changes(*words, source_of)
            begin = np.flatnonzero(run)
            if len(begin):
                bucket.append((*[w[begin] for w in words], source_of[begin], _sums(count[order], begin).astype(np.uint32),
                               _sums(run | _changes(document_of), begin).astype(np.uint32)))
        if self._long:
            own = _summed(self._long, ["term", "source", "document"], ["n"])
            own = own.append_column("documents", pa.array(np.ones(len(own), np.int64)))
            self._long, self._long_counted = [], [*self._long_counted, _summed([own], ["term", "source"], ["n", "documents"])]

    def _columns(self) -> tuple[np.ndarray, ...]:
        return _joined(self._held, (np.uint64, np.uint64, np.uint32, np.uint32, np.uint32))

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
        """First and second word, further bytes, source, occurrences and documents of each run, by term, then source.

        One bucket for terms of one word, one for two words, one for longer terms. The shard is empty afterwards.
        """
        self.settle()
        for bucket, width in zip(self._counted, (1, 2)):
            *words, source, count, documents = _joined(bucket, (*[np.uint64] * width, np.uint32, np.uint32, np.uint32))
            bucket.clear()
            order = radix_order([source, *words[::-1]], np.arange(len(source)))
            words, source = [w[order] for w in words], source[order]
            begin = np.flatnonzero(_changes(*words, source))
            count, documents = (_sums(x[order], begin) for x in (count, documents))
            words, source = [w[begin] for w in words], source[begin]
            yield words[0], words[1] if width == 2 else np.zeros(len(begin), np.uint64), [b""] * len(begin), source, count, documents
        if self._long_counted:
            found = _summed(self._long_counted, ["term", "source"], ["n", "documents"]).sort_by([("term", "ascending"), ("source", "ascending")])
            self._long_counted = []
            terms = found.column("term").to_pylist()
            words = np.frombuffer(b"".join(t[:16] for t in terms), ">u8").astype(np.uint64)
            yield words[::2], words[1::2], [t[16:] for t in terms], *(
                found.column(name).to_numpy() for name in ("source", "n", "documents"))


def _cut(padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The bytes at these places."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    place = np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(padded[place])])


def _summed(tables: list[pa.Table], keys: list[str], values: list[str]) -> pa.Table:
    """Sums of ``values`` per different ``keys``, under their names."""
    table = pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([(v, "sum") for v in values])
    return table.rename_columns([c.removesuffix("_sum") for c in table.column_names])


def _joined(rows: list[tuple[np.ndarray, ...]], kinds: tuple[type, ...]) -> tuple[np.ndarray, ...]:
    """Columns of ``rows`` one after the other."""
    return tuple(np.concatenate([np.zeros(0, kind), *x]).astype(kind, copy=False)
                 for kind, x in zip(kinds, zip(*rows) if rows else ([],) * len(kinds)))


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sum of each run of ``values``; the runs begin at ``begin``."""
    return np.add.reduceat(values, begin, dtype=np.int64) if len(begin) else np.zeros(0, np.int64)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first does."""
    change = np.ones(len(columns[0]), bool)
    if len(change):
        change[1:] = False
        for x in columns:
            change[1:] |= x[1:] != x[:-1]
    return change


def _packed_runs(docs: DataFrame) -> DataFrame:
    """Runs of all shards, packed per language; ``sources`` names all sources of the language in the shard."""
    def rows(shards: dict[str, Shard]) -> Iterator[pa.RecordBatch]:
        for lang in list(shards):
            shard = shards.pop(lang)  # its memory goes when its runs are written
            for one, two, rest, source, counts, documents in shard.runs():
                for at in range(0, max(1, len(one)), ROW_RUNS):
                    cut = slice(at, at + ROW_RUNS)
                    binary = [pa.array([x[cut].astype(kind).tobytes()], pa.binary()) for x, kind in (
                        (one, np.uint64), (two, np.uint64), (source, np.uint32), (counts, np.int64), (documents, np.int64))]
                    long_terms = rest[cut] if any(rest[cut]) else []
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]), pa.array([list(shard.sources)], pa.list_(pa.string())), *binary,
                         pa.array([long_terms], pa.list_(pa.binary()))],
                        ["lang", "sources", "one", "two", "source", "counts", "documents", "rest"])
            del shard, one, two, rest, source, counts, documents
        release_memory()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, size, seen = {}, 0, 0
        for batch in batches:
            langs, sources = np.array(batch.column("lang").to_pylist(), object), batch.column("source").to_pylist()
            texts = batch.column("text")
            for lang in dict.fromkeys(langs):
                shard = shards.setdefault(lang, Shard())
                own = np.flatnonzero(langs == lang)
                codes = np.array([shard.sources.setdefault(sources[i], len(shard.sources)) for i in own], np.uint32)
                bodies = [texts[int(i)].as_buffer().to_pybytes().translate(LOWER_BYTES) for i in own]
                whole = [len(b) <= BATCH_BYTES for b in bodies]
                ends = np.cumsum([len(b) + 1 for b, w in zip(bodies, whole) if w], dtype=np.int64)
                shard.add(b"\n".join([*(b for b, w in zip(bodies, whole) if w), b""]), codes[whole],
                          (seen + own[whole]).astype(np.uint32), np.concatenate([[0], ends]))
                shard.settle()
                for i, body, code in ((i, b, c) for i, b, c, w in zip(own, bodies, codes, whole) if not w):
                    at = 0
                    while at < len(body):  # a long text in pieces that end outside terms
                        end = min(at + BATCH_BYTES, len(body))
                        while end < len(body) and _LETTERS[body[end]]:
                            end += 1
                        shard.add(body[at:end], np.array([code]), np.array([seen + i], np.uint32), np.array([0, len(body)]))
                        shard.reduce()
                        at = end
                    shard.settle()
            seen += batch.num_rows
            size += texts.nbytes
            if size >= SHARD_BYTES:
                yield from rows(shards)
                shards, size, seen = {}, 0, 0
        yield from rows(shards)

    return docs.mapInArrow(run, "lang string, sources array<string>, one binary, two binary, source binary, counts binary, "
                                "documents binary, rest array<binary>")


def _unpacked(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    one, two, source, counts, documents = (
        np.frombuffer(batch.column(name)[i].as_buffer(), kind) for name, kind in (
            ("one", np.int64), ("two", np.int64), ("source", np.uint32), ("counts", np.int64), ("documents", np.int64)))
    rest = batch.column("rest")[i].values
    return one, two, rest if len(rest) else pa.array([b""] * len(one), pa.binary()), source, counts, documents


def _document_counts(runs: DataFrame) -> DataFrame:
    """``lang, one, two, rest, n``: documents of each term, summed over the sources of a packed row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one, two, rest, _, _, documents = _unpacked(batch, i)
                term = _changes(one, two)
                if len(batch.column("rest")[i].values):
                    own = np.array(rest.to_pylist(), object)
                    term[1:] |= own[1:] != own[:-1]
                begin = np.flatnonzero(term)
                if len(begin):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column("lang")[i].as_py()] * len(begin)), pa.array(one[begin]), pa.array(two[begin]),
                         rest.take(pa.array(begin)), pa.array(np.add.reduceat(documents, begin))],
                        ["lang", "one", "two", "rest", "n"])

    return runs.mapInArrow(run, "lang string, one long, two long, rest binary, n long")


def _place(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Place in the filter of a term's first 16 bytes; languages share it."""
    mixed = (one.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ two.view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(65 - FILTER_BITS.bit_length())).astype(np.int64)


def _marked(terms: DataFrame) -> np.ndarray:
    """The filter: ``FILTER_BITS`` bits with the places of all ``terms`` set; its 32-bit words are joined in tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[_place(batch.column("one").to_numpy(), batch.column("two").to_numpy())] = True
        words = np.packbits(bits, bitorder="little").view(np.uint32)
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(words[used].astype(np.int64))], ["word", "bits"])

    found = terms.select("one", "two").mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    words = np.zeros(FILTER_BITS // 32, np.uint32)
    for batch in found.toArrow().to_batches():  # at most FILTER_BITS / 32 rows
        words[batch.column("word").to_numpy()] = batch.column("bits").to_numpy()
    return words


def _counts(runs: DataFrame, words: np.ndarray) -> DataFrame:
    """``lang, source, one, two, rest, n`` of the runs whose term passes the filter."""
    shared = runs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one, two, rest, source, counts, _ = _unpacked(batch, i)
                place = _place(one, two)
                stays = np.flatnonzero((shared.value[place >> 5] >> (place & 31).astype(np.uint32)) & 1)
                names = batch.column("sources")[i].values
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("lang")[i].as_py()] * len(stays), pa.string()),
                     names.take(pa.array(source[stays])), pa.array(one[stays]), pa.array(two[stays]),
                     rest.take(pa.array(stays)), pa.array(counts[stays])], ["lang", "source", "one", "two", "rest", "n"])

    return runs.mapInArrow(run, "lang string, source string, one long, two long, rest binary, n long")


def _term() -> Column:
    """Text of a packed term; no term has a zero byte."""
    words = "regexp_replace(concat(lpad(hex(one), 16, '0'), lpad(hex(two), 16, '0')), '(00)+$', '')"
    return F.expr(f"decode(concat(unhex({words}), rest), 'utf-8')")


def term_counts(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """``lang, source, term, n`` of the kept terms, counts above zero; and ``lang, source`` of all groups.

    ``docs`` has ``lang, source, text``, no nulls.
    """
    with byte_batches(docs.sparkSession, BATCH_BYTES), read_batches(docs.sparkSession, READ_ROWS):
        runs = kept_table(_packed_runs(docs), "term-runs", **PAGES)
        key = ["lang", "one", "two", "rest"]
        kept = _document_counts(runs.select("lang", "one", "two", "source", "counts", "documents", "rest")).groupBy(*key).agg(
            F.sum("n").alias("documents")).filter(F.col("documents") >= least_documents)
        kept = kept_table(kept.select(*key), "kept-terms")
        counts = _counts(runs, _marked(kept)).groupBy("source", *key).agg(F.sum("n").alias("n"))
        counts = kept_table(counts.join(kept, key, "left_semi").select("lang", "source", _term().alias("term"), "n"), "term-counts")
    return counts, kept_table(runs.select("lang", F.explode("sources").alias("source")).distinct(), "groups")


def _share(n: str, total: str, terms: str) -> Column:
    """Exact integer share; counts and totals of any size."""
    number = "cast({} as decimal(20,0))"
    return F.expr(f"1 + ({number.format(f'coalesce({n}, 0)')} + {SMOOTHING}BD) * {SCALE}BD "
                  f"div ({number.format(f'coalesce({total}, 0)')} + {SMOOTHING}BD * {number.format(terms)})")


def _pair_sums(cells: DataFrame) -> DataFrame:
    """``lang, source, item, value``: sums over a block's terms; rows without a term carry a source's share of terms it lacks."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        base = table.filter(pc.is_null(table.column("term")))
        sources, lacking = base.column("source").to_pylist(), base.column("p").to_numpy()
        place = {s: i for i, s in enumerate(sources)}
        own = table.filter(pc.is_valid(table.column("term")))
        row = own.column("term").combine_chunks().dictionary_encode().indices.to_numpy() if len(own) else np.zeros(0, np.int64)
        column, share = np.array([place[s] for s in own.column("source").to_pylist()], np.int64), own.column("p").to_numpy()
        order = np.argsort(row, kind="stable")
        row, column, share = row[order], column[order], share[order]
        sums, height = np.zeros((len(sources), len(sources)), np.int64), max(1, MATRIX_CELLS // max(1, len(sources)))
        for first in range(0, int(row[-1]) + 1 if len(row) else 0, height):
            a, b = np.searchsorted(row, [first, first + height])
            matrix = np.repeat(lacking[None, :], min(height, int(row[-1]) + 1 - first), axis=0)
            matrix[row[a:b] - first, column[a:b]] = share[a:b]
            for i in range(len(sources)):
                sums[i] += np.abs(matrix - matrix[:, i:i + 1]).sum(axis=0)
        x, y = np.nonzero(~np.eye(len(sources), dtype=bool))
        names, lang = np.array(sources, object), table.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(x), pa.string()), "source": pa.array(names[x].tolist(), pa.string()),
                         "item": pa.array(names[y].tolist(), pa.string()), "value": pa.array(sums[x, y])})

    parts = cells.groupBy("lang", "block").applyInArrow(run, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                      least_documents: int = LEAST_DOCUMENTS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: for every other source of the language, how far the shares of all kept terms differ, summed. Part ``term``: the
    kept terms of the source with a larger share than in the language, the first ``term_ranks``. Ranks count from 1 by value
    descending, then item in byte order. Nulls are empty strings and empty strings are ordinary languages and sources; a group
    without terms has pairs alone, the only source of a language none. Repeated rows are documents of their own. Other columns
    are ignored. An empty table gives none.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    counts, groups = term_counts(docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).alias("text")),
                                 least_documents)
    per_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.count("*").alias("cells"))
    langs = per_term.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"), F.sum("cells").alias("cells"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    facts = kept_table(groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", "total", "lang_total", F.coalesce("terms", F.lit(0)).alias("terms"),
        F.ceil(F.coalesce("cells", F.lit(0)) / BLOCK_ROWS).cast("int").alias("blocks")), "group-totals")
    in_lang = Window.partitionBy("lang", "term")  # a row for each source at most
    shares = kept_table(counts.withColumn("lang_n", F.sum("n").over(in_lang)).join(facts, ["lang", "source"]).select(
        "lang", "source", "term", _share("n", "total", "terms").alias("p"), _share("lang_n", "lang_total", "terms").alias("q"),
        F.pmod(F.xxhash64("term"), F.greatest("blocks", F.lit(1))).cast("int").alias("block")), "term-shares")
    lacking = F.when(F.col("terms") > 0, _share("0", "total", "greatest(terms, 1)")).otherwise(F.lit(0))
    bases = facts.select("lang", "source", F.lit(None).cast("string").alias("term"), lacking.alias("p"),
                         F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1)).alias("block"))
    pairs = _pair_sums(shares.select("lang", "source", "term", "p", "block").unionByName(bases))
    over = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranks = lambda rows, part: rows.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    return ranks(pairs, "pair").unionByName(ranks(over, "term").filter(F.col("rank") <= term_ranks))
