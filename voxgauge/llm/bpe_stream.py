"""BPE as a streaming transducer with bounded lookahead, and decoding as an incremental byte-to-text machine.

Why a bounded lookahead is enough. Compare the merges inside a prefix with those inside the whole text, rank by rank. Both
agree to the left of a common token boundary, at first the prefix's end. Only a merge across that boundary moves it, by the
length of the merge's left part, and the next merge across it has a higher rank and a right part that begins with the left
part of the one before. So no boundary ever moves farther than the heaviest such chain of merges is long, which one pass
over the merge list finds. Tokens of a window that end at least that far before its end are final.

The transducer fills a window with symbols, merges it, emits the final tokens and goes on with the symbols of the others:
memory is one window however long the text is. Pieces shorter than a window are encoded at once and remembered.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxgauge.llm.shared import small_batches
from voxgauge.llm.token_pieces import byte_letters, text_blocks

MEMO_PIECES = 250_000
DECODE_IDS = 1 << 14  # ids that go through the decoder at a time

# Letters and numbers up to U+017F, where composition and lower-casing never leave one character's place.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
_UNUSUAL = re.compile("[^\t-\r -~¡-įı-ſ]")
# Fixed value: the cutting pattern of word-end files, after lower-casing.
_PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols after a boundary that decide whether it is final: the weight of the heaviest chain of merges.

    ``heaviest[s]`` is the heaviest chain so far whose last merge has ``s`` as its left part; a later merge goes on with it
    if its right part begins with ``s``. Lengths count characters, at least as many as symbols.
    """
    heaviest: dict[str, int] = {}
    most = 0
    for left, right in merges:
        before = max((heaviest.get(right[:n], 0) for n in range(1, len(right) + 1)), default=0)
        weight = len(left) + before
        most = max(most, weight)
        if weight > heaviest.get(left, 0):
            heaviest[left] = weight
    return most


class Merges:
    """The merge list by pairs of ids: rank and id of the result."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.pairs = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(merges)}
        self.lookahead = sufficient_lookahead(merges)
        self.longest = max((len(a) + len(b) for a, b in merges), default=1)
        self.window = max(64, 2 * self.lookahead + self.longest)

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges, lowest rank first and leftmost first."""
        if len(symbols) > 48:
            return self._merge_long(symbols)[0]
        pairs, nothing = self.pairs, (1 << 60, 0)
        symbols = list(symbols)
        ranks = [pairs.get(p, nothing) for p in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best is nothing or best[0] == nothing[0]:
                break
            i = ranks.index(best)
            symbols[i:i + 2] = [best[1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = pairs.get((symbols[i], symbols[i + 1]), nothing)
            if i:
                ranks[i - 1] = pairs.get((symbols[i - 1], symbols[i]), nothing)
        return symbols

    def _merge_long(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """The same with a heap of pairs; also gives where each token ends."""
        n, pairs, ids = len(symbols), self.pairs, list(symbols)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(p[0], i, p[1]) for i in range(n - 1) if (p := pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i] if live[i] else n
            if j >= n or pairs.get((ids[i], ids[j])) != (rank, new):
                continue
            ids[i], live[j], after[i] = new, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if p := pairs.get((new, ids[after[i]])):
                    heapq.heappush(heap, (p[0], i, p[1]))
            if before[i] >= 0 and (p := pairs.get((ids[before[i]], new))):
                heapq.heappush(heap, (p[0], before[i], p[1]))
        tokens = [i for i in range(n) if live[i]]
        return [ids[i] for i in tokens], [after[i] for i in tokens]

    def stream(self, symbols: Iterable[int], window: int | None = None) -> Iterator[int]:
        """Tokens of a run of symbols, each emitted once no later symbol can change it."""
        window = max(window or self.window, self.lookahead + self.longest + 1)
        held: list[int] = []
        for symbol in symbols:
            held.append(symbol)
            if len(held) == window:
                ids, ends = self._merge_long(held)
                final = [k for k, end in enumerate(ends) if end <= window - self.lookahead]
                yield from (ids[k] for k in final)
                held = held[ends[final[-1]]:] if final else held
                window = len(held) + window if not final else window
        yield from self.merge(held)


class StreamEncoder(dict):
    """Texts to ids for a BPE file whose pieces are words with an end mark; pieces to ids as it goes."""

    def __init__(self, path: str, memo: int = MEMO_PIECES):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout"):
            raise ValueError("only byte-level BPE files without fallback and dropout")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.vocabulary, self.memo = model["vocab"], memo
        self.end = model.get("end_of_word_suffix") or ""
        self.rules = Merges(self.vocabulary, merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.library = Tokenizer.from_file(path)  # for normalising and cutting unusual texts, and for the decoder's kind
        self.letters = byte_letters()

    def _symbols(self, letters: str) -> Iterator[int]:
        for ch in letters[:-1]:
            yield self.vocabulary[ch]
        yield self.vocabulary[letters[-1] + self.end]

    def piece(self, letters: str) -> list[int]:
        """Ids of a piece written in byte letters."""
        if len(letters) < self.rules.window:
            return self.rules.merge(list(self._symbols(letters)))
        return list(self.rules.stream(self._symbols(letters)))

    def __missing__(self, piece: str) -> array:
        ids = array("i", self.piece(piece.encode().decode("latin-1").translate(self.letters)))
        if len(self) < self.memo:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> array:
        ids, text, at = array("i"), text or "", 0
        for found in self.specials.finditer(text):
            self._plain(text[at:found.start()], ids)
            ids.append(self.special[found[0]])
            at = found.end()
        self._plain(text[at:] if at else text, ids)
        return ids

    def _plain(self, text: str, ids: array) -> None:
        for block in text_blocks(text):
            if _UNUSUAL.search(block):
                norm = self.library.normalizer.normalize_str(block)
                for letters, _ in self.library.pre_tokenizer.pre_tokenize_str(norm):
                    ids.extend(self.piece(letters))
            else:
                for part in map(self.__getitem__, _PIECES.findall(block.lower())):
                    ids.extend(part)


class StreamDecoder:
    """Ids to text, a few at a time. The state is the unfinished character and whether a token has been written.

    With a byte-level decoder in the file, tokens are bytes and unfinished characters wait for the next ids; without a
    decoder, tokens are written as they stand with a blank between them.
    """

    def __init__(self, encoder: StreamEncoder):
        names = {i: t for t, i in (encoder.vocabulary | encoder.special).items()}
        self.joined = encoder.library.decoder is None
        back = {letter: byte for byte, letter in encoder.letters.items()}
        specials = set(encoder.special.values())
        self.bytes = [b""] * (max(names) + 1)
        for i, name in names.items():
            plain = self.joined or i in specials or any(ch not in back for ch in name)
            self.bytes[i] = name.encode() if plain else bytes(back[ch] for ch in name)
        self.reset()

    def reset(self) -> None:
        self.machine, self.first = codecs.getincrementaldecoder("utf-8")("replace"), True

    def feed(self, ids: Iterable[int]) -> str:
        data = (b" " if self.joined else b"").join(map(self.bytes.__getitem__, ids))
        if self.joined and not self.first:
            data = b" " + data
        self.first = False
        return self.machine.decode(data)

    def finish(self) -> str:
        rest = self.machine.decode(b"", final=True)
        self.reset()
        return rest

    def decode(self, ids: array) -> str:
        parts = [self.feed(ids[i:i + DECODE_IDS]) for i in range(0, len(ids), DECODE_IDS)]
        return "".join([*parts, self.finish()])


@lru_cache(maxsize=2)
def coder(path: str) -> tuple[StreamEncoder, StreamDecoder]:
    encoder = StreamEncoder(path)
    return encoder, StreamDecoder(encoder)


def encode_texts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids, decoded``: the ids of every whole text and what they decode to, one row per input row.

    Ids are those of the tokenizers library without special tokens added; the strings of added tokens inside a text give
    their ids, as there. Null texts count as empty (no id, empty decoded text). Other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coder(tokenizer)
        for batch in batches:
            ids = [encoder.encode(t.as_py()) for t in batch.column(1)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
            flat = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x, np.int32) for x in ids if x)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)),
                 pa.array([decoder.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>, decoded string")
