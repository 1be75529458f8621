"""Token ids of texts by the tokenizers library, with a memo of pre-token pieces.

A byte-level BPE file cuts a text into pieces by a fixed pattern and encodes each piece for itself, so the ids of a text
are those of its pieces in a row. Texts of the letters below are cut here and each different piece is encoded once per
worker; any other text, any text that contains an added token, and any other kind of tokenizer file goes to the library as
a whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

from tokenizers import Tokenizer

#: Pieces that a worker remembers, about 150 bytes each.
MEMO_PIECES = 400_000
#: Characters that are handled at a time.
BLOCK = 1 << 20

# Letters, numbers and other characters on which every version of the Unicode tables agrees.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
UNUSUAL = re.compile("[^\t-\r -~¡-ɏ]")
# Fixed value: the cutting pattern of byte-level files.
PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
_CUT = re.compile(r"[A-Za-z0-9](?= [A-Za-z0-9])")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level files write for each byte: visible bytes stand for themselves, others from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)}


def text_blocks(text: str, block: int = BLOCK) -> Iterator[str]:
    """Parts of a text, cut before a blank between two words, where a piece always begins."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + block) if len(text) - at > block else None
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


class PieceEncoder(dict):
    """Pieces to ids as little-endian unsigned 32-bit bytes; misses go to the library."""

    def __init__(self, path: str, memo: int = MEMO_PIECES):
        super().__init__()
        self.tokenizer, self.memo = Tokenizer.from_file(path), memo
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cutting = spec["pre_tokenizer"] or {}
        self.plain = (spec["normalizer"] is None and cutting.get("type") == "ByteLevel" and cutting["use_regex"]
                      and not cutting["add_prefix_space"] and spec["model"]["type"] == "BPE")
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.letters, self.model = byte_letters(), self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def __missing__(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        ids = array("I", [t.id for t in tokens]).tobytes()
        if len(self) < self.memo:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; none for null and empty texts."""
        return b"".join(map(self._block, text_blocks(text or "")))

    def _block(self, text: str) -> bytes:
        if not self.plain or UNUSUAL.search(text) or any(t in text for t in self.added):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, PIECES.findall(text)))


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of a file; its memo serves all tasks of the worker."""
    return PieceEncoder(path)
