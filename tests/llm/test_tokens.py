import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voxgauge.llm import packing, packing_plan, token_files
from voxgauge.llm.bpe_stream import StreamEncoder, coder, encode_texts, sufficient_lookahead
from voxgauge.llm.numbering import running_numbers
from voxgauge.llm.token_pieces import PieceEncoder

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE_LIBRARY, WORD_LIBRARY = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
PIECES = PieceEncoder(BYTE, memo=50)

MIXED = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n'sdtlvermaAZéßİſΣ²3!?<|endoftext|>\x1c\x85\xa0")))


def ids_of(text, library=BYTE_LIBRARY):
    return library.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return array("I", ids).tobytes()


@settings(max_examples=400, deadline=None)
@given(MIXED)
def test_pieces_are_the_library(text):
    for t in (text, text + "<|endoftext|>x", "it's " + text + "  \n x"):
        assert PIECES.encode(t) == packed(ids_of(t))


def test_long_texts_in_blocks(monkeypatch):
    from voxgauge.llm import token_pieces

    rng = random.Random(2)
    text = " ".join(rng.choice(["the", "don't", "ça", " x", "\n\n", "12,5", "漢", "end."]) for _ in range(3000))
    whole, blocks = packed(ids_of(text)), token_pieces.text_blocks
    monkeypatch.setattr(token_pieces, "text_blocks", lambda t: blocks(t, 40))
    assert len(list(blocks(text, 40))) > 100 and PIECES.encode(text) == whole


@settings(max_examples=400, deadline=None)
@given(MIXED)
def test_own_coder_is_the_library(text):
    encoder, decoder = coder(WORD)
    want = ids_of(text, WORD_LIBRARY)
    assert list(encoder.encode(text)) == want
    assert decoder.decode(array("i", want)) == WORD_LIBRARY.decode(want, skip_special_tokens=False)


def test_stream_emits_what_whole_pieces_give():
    """Long runs without a break go through the window; the library sees them whole."""
    encoder, _ = coder(WORD)
    rng = random.Random(4)
    for letters in ("ab", "etaoinshrdlu", "a", "aeiou", "xyz"):
        text = "".join(rng.choice(letters) for _ in range(9_000))
        assert list(encoder.encode(text)) == ids_of(text, WORD_LIBRARY)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=14), st.text("abc", max_size=120), st.integers(0, 6))
def test_lookahead_suffices_for_any_merge_list(choices, text, extra):
    from voxgauge.llm.bpe_stream import Merges

    tokens, merges = ["a", "b", "c"], []
    for i, j in choices:
        pair = tokens[i % len(tokens)], tokens[j % len(tokens)]
        if pair[0] + pair[1] not in tokens:
            merges.append(pair)
            tokens.append(pair[0] + pair[1])
    rules = Merges({t: k for k, t in enumerate(tokens)}, merges)
    symbols = [tokens.index(ch) for ch in text]
    whole = rules.merge(symbols)
    assert list(rules.stream(symbols, window=rules.lookahead + rules.longest + 1 + extra)) == whole
    assert rules._merge_long(symbols)[0] == whole


def test_lookahead_of_a_small_list():
    assert sufficient_lookahead([("b", "c"), ("a", "b")]) == 2  # whether a takes b depends on c
    assert sufficient_lookahead([]) == 0


def test_byte_level_decoder_keeps_unfinished_characters():
    from voxgauge.llm.bpe_stream import StreamDecoder

    decoder = StreamDecoder(StreamEncoder(BYTE))
    text = "naïve 漢字 🙂 " * 20
    ids = ids_of(text)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == text
    assert decoder.decode(array("i", ids[:-2])) == BYTE_LIBRARY.decode(ids[:-2], skip_special_tokens=False)


def test_round_trip_of_tables(docs, doc_rows, odd, odd_rows, none):
    for df, rows in ((docs, list(doc_rows.items())), (odd, [r[:2] for r in odd_rows])):
        found = sorted((r["doc_id"] or -1, list(r["ids"]), r["decoded"]) for r in encode_texts(df, WORD).collect())
        want = [(i or -1, ids_of(t, WORD_LIBRARY)) for i, t in rows]
        assert found == sorted((i, x, WORD_LIBRARY.decode(x, skip_special_tokens=False)) for i, x in want)
    assert encode_texts(none, WORD).collect() == []


# token files


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=100))
def test_bits(bits, values):
    ids = np.array([v & (1 << bits) - 1 for v in values], "<u4")
    data = token_files.pack_bits(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert token_files.unpack_bits(data, bits, len(ids)).tolist() == ids.tolist()


def test_file_gives_any_document():
    rng = np.random.default_rng(1)
    docs = [(i if i % 3 else None, rng.integers(0, 50257, n).astype("<u4").tobytes()) for i, n in enumerate((5, 0, 1, 40, 7, 0, 99))]
    for bits in (16, 17):
        file = token_files.TokenFile(token_files.write_file(docs, bits, block_ids=8))
        assert [(i, x.tobytes()) for i, x in file.documents()] == docs
        assert [file.document(i).tobytes() for i in range(len(file))] == [x for _, x in docs]
    with pytest.raises(ValueError):
        token_files.write_file(docs, 9)
    with pytest.raises(ValueError):
        token_files.TokenFile(b"something else")
    assert token_files.bits_of(50257) == 16 and token_files.bits_of(1) == 1


def test_files_hold_all_documents_in_order(spark, docs, doc_rows, odd, odd_rows, none, tmp_path):
    for k, (df, rows) in enumerate(((docs, list(doc_rows.items())), (odd, [r[:2] for r in odd_rows]), (none, []))):
        folder = f"{tmp_path}/{k}"
        token_files.write_token_files(df, folder, BYTE, 2, file_ids=5000)
        found = sorted((tuple(r) for r in token_files.read_token_files(spark, folder).collect()), key=lambda r: r[1])
        ids = [np.frombuffer(r[2], "<u4").tolist() for r in found]
        assert [r[1] for r in found] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
        assert [-1 if r[0] is None else r[0] for r in found] == sorted(-1 if i is None else i for i, _ in rows)
        assert sorted((r[0] or -1, x) for r, x in zip(found, ids)) == sorted((i or -1, [*ids_of(t), 2]) for i, t in rows)


# packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30), st.integers(1, 12))
def test_plan_packs_everything_once(counts, groups):
    runs = packing_plan.plan(counts, 64, groups)
    held = {}
    for run in runs:
        assert run.many > 0 and run.room == 64 - sum(length * n for length, n in run.parts) >= 0
        for length, n in run.parts:
            held[length] = held.get(length, 0) + n * run.many
    assert held == counts
    exact = sum(r.many for r in packing_plan.plan(counts, 64))  # as many groups as there may be lengths: no rounding
    plain = sum(r.many for r in packing_plan.best_fit([], counts, 64))  # at most 11/9 of the fewest
    assert exact <= 1.25 * plain + 1


def test_plan_beats_plain_best_fit_where_it_matters():
    rng = np.random.default_rng(3)
    lengths, n = np.unique(rng.integers(500, 800, 20_000), return_counts=True)
    counts = dict(zip(lengths.tolist(), n.tolist()))
    ours = sum(r.many for r in packing_plan.plan(counts, 2048))
    plain = sum(r.many for r in packing_plan.best_fit([], counts, 2048))
    assert ours < 0.97 * plain
    with pytest.raises(ValueError):
        packing_plan.plan({2049: 1}, 2048)


def check_packing(rows, texts, capacity):
    """Every document whole, every sequence gapless and within the capacity."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    repeated = {}
    for doc, text in texts:
        repeated[doc] = repeated.get(doc, 0) + 1
    for doc, text in texts:
        pieces = sorted(docs[doc], key=lambda r: r["piece"])
        if repeated[doc] == 1:
            assert b"".join(p["ids"] for p in pieces) == packed([*ids_of(text), 0])
            assert [p["piece"] for p in pieces] == list(range(len(pieces)))
            assert [p["start"] for p in pieces] == np.cumsum([0, *(p["length"] for p in pieces)])[:-1].tolist()
            assert all(p["length"] == capacity for p in pieces[1:])
    return len(sequences)


def test_documents_are_packed(docs, doc_rows, odd, odd_rows, none):
    rows = packing.pack_documents(docs, BYTE, with_ids=True).collect()
    used = check_packing(rows, list(doc_rows.items()), 2048)
    assert used <= 1.02 * -(-sum(r["length"] for r in rows) // 2048) + 1
    texts = [r[:2] for r in odd_rows]
    found = packing.pack_documents(odd, BYTE, capacity=256, with_ids=True).collect()
    check_packing(found, texts, 256)
    plain = packing.pack_documents(odd, BYTE, capacity=256).collect()
    assert sorted(r["ids_crc32"] for r in plain) == sorted(r["ids_crc32"] for r in found)
    assert packing.pack_documents(none, BYTE).collect() == []


def test_running_numbers():
    seen = np.zeros(3, np.int64)
    assert running_numbers(np.array([2, 0, 2, 2, 0]), seen).tolist() == [0, 0, 1, 2, 1]
    assert running_numbers(np.array([0, 1, 2]), seen).tolist() == [2, 0, 3]
    assert running_numbers(np.zeros(0, np.int64), seen).tolist() == [] and seen.tolist() == [3, 1, 4]
