import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voxgauge.llm import lm_score, shared
from voxgauge.llm.lm_score import score_texts
from voxgauge.llm.pitman_yor import END, SYMBOLS, Spelling, State, Strength, seat, spelling, symbols_of
from voxgauge.llm.shared import LOWER_BYTES, kept_table


def words_of(text):
    return [*(text or "").encode().translate(LOWER_BYTES).split(), b""]


def base(rows):
    """n_tokens, n_known, train_tokens and base score of every row, straight from the definition."""
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter(w for i, t in rows if not out(i) for w in words_of(t))
    total, vocabulary = sum(counts.values()), len(counts)
    found = []
    for i, t in rows:
        words = words_of(t)
        score = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (vocabulary + 1))) for w in words)
        found.append((-1 if i is None else i, out(i), len(words), sum(counts[w] > 0 for w in words), total, round(score, 5)))
    return sorted(found)


def got(rows):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                   round(r["base_score"], 5)) for r in rows)


def test_whole_table(docs, doc_rows):
    rows = score_texts(docs).collect()
    assert got(rows) == base(list(doc_rows.items()))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 and abs(r["perplexity"] - 10 ** (-r["score"] / r["n_tokens"])) < 1e-6 * r["perplexity"] for r in rows)


def test_chunks_change_nothing(docs, doc_rows):
    """Scores depend on the sampled seating, which goes by batches of words; the counts are the same to the last digit."""
    whole, small = (score_texts(docs, burn_in=1, keep=1, chunk_tokens=n).collect() for n in (10**9, 500))
    assert got(whole) == got(small)
    a, b = ({r["doc_id"]: r["score"] for r in rows} for rows in (whole, small))
    assert max(abs(a[i] / b[i] - 1) for i in a) < 0.02


def test_odd_rows(odd, odd_rows, none, spark):
    assert got(score_texts(odd, burn_in=1, keep=1).collect()) == base([r[:2] for r in odd_rows])
    assert score_texts(none).collect() == []
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    untrained = score_texts(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert all(r["train_tokens"] == 0 and r["score"] == 0 and abs(r["base_score"]) < 1e-12 for r in untrained)


def scores(spark, rows, **options):
    table = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r for r in score_texts(table, **options).collect()}


def test_words_follow_words(spark):
    """A unigram model gives the same score to any order of the same words."""
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    rows = [(i, "red green blue") for i in range(500) if zlib.crc32(str(i).encode()) % 10]
    got_rows = scores(spark, [*rows, (held[0], "red green blue"), (held[1], "green red blue")])
    assert got_rows[held[0]]["score"] > got_rows[held[1]]["score"] + 2
    assert got_rows[held[0]]["perplexity"] < 1.1


def test_every_context_adds_up_to_one(docs):
    """Customers less discounts of a context's pairs, and what it leaves to the word restaurant."""
    rows = docs.coalesce(1).select("doc_id", "text", (F.col("doc_id") % 10 == 0).alias("held"))
    written = kept_table(lm_score.chunks(rows, "held", "doc_id", "text", 10**9), "chunks")
    words = written.filter("train > 0").select("word", F.col("train").alias("count"))
    texts = written.filter("word IS NULL").select(F.col("chunk").alias("of_chunk"), "tokens", "ends", "hashes", "held")
    pairs = kept_table(lm_score.pair_parts(texts, 3), "pairs")
    dictionary = kept_table(lm_score.word_parts(words, pairs, 3), "words")
    found, contexts = lm_score.snapshots(dictionary, pairs, 1, 2)
    own, sent = lm_score.pair_scores(texts, pairs, [t for _, t, _ in found], contexts, 3), lm_score._sent_pairs(texts, 3, True)
    given, left = Counter(), {r["part"]: lm_score.unpacked(r["own"], np.float32) for r in own.collect()}
    for r in sent.collect():
        for u, value in zip(lm_score.unpacked(r["u"], np.uint64).tolist(), left[r["part"]].tolist()):
            given[u] += value
    entries = written.filter("word IS NOT NULL").select("chunk", "word", "number", "train")
    scored = {n: values for r in lm_score.word_scores(entries, dictionary, [(a, s.total) for a, _, s in found], contexts, 0.5, 3).collect()
              for n, *values in zip(*(lm_score.unpacked(r[c], k).tolist() for c, k in (
                  ("numbers", np.uint32), ("counts", np.int64), ("p", np.float32), ("share", np.float32))))}
    rows = entries.collect()
    assert len(found) == 2 and len(scored) == len(rows)
    for r in rows:
        count, p, share = scored[r["number"]]
        total = given[xxhash.xxh64_intdigest(bytes(r["word"]), 42)] + share * (count + 1)
        assert count == r["train"] and math.isclose(total, count + 1, rel_tol=1e-4) and (count or p == 0.5)
    unseen = np.mean([s.share * s.unseen / (s.customers + 1) / s.total for _, _, s in found])
    assert abs(sum(p for count, p, _ in scored.values() if count) + unseen - 1) < 0.001


def test_scores_do_not_depend_on_chunks_or_partitions(docs):
    one, two = ({r["doc_id"]: r["score"] for r in score_texts(d, burn_in=1, keep=1, chunk_tokens=n).collect()}
                for d, n in ((docs.coalesce(1), 10**9), (docs.repartition(5), 700)))
    assert one.keys() == two.keys() and all(math.isclose(one[i], two[i], rel_tol=1e-6) for i in one)


def test_parts_change_little(docs, monkeypatch):
    """Parts draw from seeds of their own; counts and messages between parts are whole."""
    one = {r["doc_id"]: r["score"] for r in score_texts(docs).collect()}
    monkeypatch.setattr(lm_score, "_PART", 20)
    rows = score_texts(docs).collect()
    many = {r["doc_id"]: r["score"] for r in rows}
    assert max(abs(many[i] / one[i] - 1) for i in one) < 0.05


def example():
    words = [b"", b"the", b"then", b"cat", b"cats", b"at", b"\xc3\xa9t\xc3\xa9"]
    counts = np.array([50, 40, 3, 7, 1, 1, 2])
    return words, np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]), counts


def spelled():
    _, data, lengths, _ = example()
    keys, n = np.unique(symbols_of(data, lengths)[0], return_counts=True)
    return spelling(keys, n, np.random.default_rng(1))


def test_spelling_is_a_distribution_after_every_context():
    s = spelled()
    dense = s.shares[:, None] * s.one[np.arange(SYMBOLS**2) % SYMBOLS]
    dense[s.keys // SYMBOLS, s.keys % SYMBOLS] += s.own
    assert np.allclose(dense.sum(axis=1), 1) and (dense > 0).all()


def test_words_are_spelled_symbol_by_symbol():
    s = spelled()
    words, data, lengths, _ = example()
    for word, log in zip(words, s.log(data, lengths)):
        p, before = 1.0, (END, END)
        for symbol in [*word, END]:
            key = (before[0] * SYMBOLS + before[1]) * SYMBOLS + symbol
            here = s.shares[key // SYMBOLS] * s.one[before[1], symbol]
            where = np.flatnonzero(s.keys == key)
            p *= here + (s.own[where[0]] if len(where) else 0)
            before = before[1], symbol
        assert math.isclose(log, math.log(p))


def test_seen_and_unseen_words_add_up_to_one(monkeypatch):
    _, data, lengths, counts = example()
    seated = np.array([3, 2, 1, 2, 1, 1, 1])
    monkeypatch.setattr(State, "seat", lambda self, parent, counts, rng: seated[:len(counts)])
    state = State(spelled(), int(seated.sum()), Strength(0.6, 2.0), int(counts.sum()))
    parent = state.parent(data, lengths)
    state.unseen = 1 - parent.sum()
    seen = state.predict(parent, counts, None).sum()
    unseen = state.predict(parent[:1], np.array([0]), None)[0]
    assert math.isclose(seen + unseen, 1)


def test_seating_has_the_right_mean():
    """Against customers seated one by one in plain Python."""
    rng, discount, pull = np.random.default_rng(5), 0.5, 0.8

    def one(c):
        tables = 1
        for k in range(1, c):
            tables += rng.random() < pull / (k - discount * tables + pull)
        return tables

    for c in (1, 2, 5, 16, 40, 300):
        ours = seat(np.full(4000, c), np.full(4000, pull), discount, rng)
        plain = [one(c) for _ in range(4000)]
        assert ours.min() >= 1 and ours.max() <= c
        assert abs(ours.mean() - np.mean(plain)) < 0.05 * np.mean(plain) + 0.02


def test_empty_spelling():
    s = spelling(np.zeros(0, np.int64), np.zeros(0, np.int64), np.random.default_rng(0))
    assert isinstance(s, Spelling) and np.allclose(s.log(np.zeros(0, np.uint8), np.array([0])), -math.log(SYMBOLS))


def test_packed_arrays_come_back():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**64, 5000, np.uint64)
    for values in (hashes, np.sort(hashes), hashes[:0], hashes[:1], np.array([2**64 - 1, 0, 2**64 - 1], np.uint64),
                   rng.integers(-2**31, 2**31, 999, np.int64).astype(np.int32), np.sort(rng.integers(-9, 9, 99)),
                   np.array([-2**63, 2**63 - 1]), rng.random(77).astype(np.float32), np.zeros(0, np.int32)):
        for pack in (lm_score.packed, lm_score.packed_names):
            back = lm_score.unpacked(pack(values), values.dtype.type)
            assert back.dtype == values.dtype and back.tolist() == values.tolist()


def test_packed_arrays_are_small():
    rng = np.random.default_rng(4)
    hashes = np.sort(rng.integers(0, 2**64, 20_000, np.uint64))
    assert len(lm_score.packed(hashes)) < 7 * 20_000  # 8 bytes each
    drawn = hashes[(20_000 * rng.random(60_000) ** 3).astype(int)]
    assert len(lm_score.packed_names(drawn)) < 4 * 60_000
    small = rng.geometric(0.01, 50_000).astype(np.uint32)
    assert len(lm_score.packed(small)) < 1.3 * 50_000


def test_tables_that_nothing_reads_are_removed(docs, monkeypatch, tmp_path):
    """What the result reads is left; when a table is begun, no more than one of each kind lies there."""
    most, before = Counter(), shared.scratch_folder
    kind = lambda path: path.name[:-33]

    def folder(spark, purpose):
        for name, n in Counter(map(kind, tmp_path.iterdir())).items():
            most[name] = max(most[name], n)
        return str(tmp_path / before(spark, purpose).rsplit("/", 1)[1])

    monkeypatch.setattr(shared, "scratch_folder", folder)
    scored = score_texts(docs, burn_in=3, keep=1)
    assert sorted(map(kind, tmp_path.iterdir())) == ["lm-chunks", "lm-known", "lm-own"]
    assert most["lm-answers"] == most["lm-tables"] == most["lm-pairs"] == 1
    assert scored.count() == docs.count()


def test_only_kept_tables_are_removed(docs):
    with pytest.raises(KeyError):
        shared.remove_tables(docs)
