import re
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from voxgauge.llm import source_divergence as sd
from voxgauge.llm.shared import LOWER_BYTES, documents, read_batches
from voxgauge.llm.source_divergence import Shard, packed_terms, radix_order, source_divergence

ROWS = "doc_id long, text string, lang string, source string"


def terms_of(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER_BYTES).decode())


def share(count, total, terms):
    return 1 + 10 ** 9 * (count + 5) // (total + 5 * terms)


def brute(rows, least=30, ranks=50):
    """Rows are (text, lang, source)."""
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, own = lang or "", source or "", terms_of(text)
        groups[lang].add(source)
        counts[lang, source].update(own)
        seen[lang].update(set(own))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        p = {s: {t: share(counts[lang, s][t], total[s], len(kept)) for t in kept} for s in sources}
        q = {t: share(whole[t], sum(whole.values()), len(kept)) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            over = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", over, ranks)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def got(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_whole_table(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    rows = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
    want = brute(rows)
    assert got(source_divergence(docs)) == want and {w[2] for w in want} == {"pair", "term"}


def test_odd_rows_in_small_shards(spark, odd, odd_rows, monkeypatch):
    """Nulls, ties, repeated rows, one source alone in its language, long terms that differ late, a text in many pieces."""
    for name, size in (("SHARD_BYTES", 3000), ("BATCH_BYTES", 1000), ("ROW_RUNS", 50), ("BLOCK_ROWS", 40), ("MATRIX_CELLS", 16)):
        monkeypatch.setattr(sd, name, size)
    long_terms = ["y" * 40 + end for end in ("a", "b", "é")] + ["z" * 16, "z" * 17, "z" * 8, "z" * 9, "ß" * 8, "漢字漢字漢字"]
    more = [(i, " ".join(long_terms[j] for j in range(len(long_terms)) if (i * 7 + j) % 3), "de", f"s{i % 3}") for i in range(100, 130)]
    more += [(i, "ALPHA beta-gamma DELTA1delta", None, None if i % 2 else "") for i in range(130, 140)]
    more += [(200, "alone", "fr", "one"), (201, None, "fr", None), (202, "12 34", "it", "x"), (203, "Ünï", "it", "ÿ")]
    docs = odd.select("doc_id", "text", "lang", "source", "part", "key").unionByName(
        spark.createDataFrame(more, ROWS), allowMissingColumns=True)
    rows = [*[(r[1], r[2], r[3]) for r in odd_rows], *[m[1:] for m in more]]
    for least, ranks in ((2, 3), (1, 50), (10, 50)):
        assert got(source_divergence(docs, least_documents=least, term_ranks=ranks)) == brute(rows, least, ranks)


def test_hot_source(spark):
    docs = spark.range(9_000).selectExpr(
        "concat('the common word', IF(id % 3 = 0, ' hot hot', ''), ' w', chr(97 + id % 26)) AS text", "'en' AS lang",
        "IF(id % 3 = 0, 'big', concat('s', id % 5)) AS source").repartition(8)
    rows = [tuple(r) for r in docs.select("text", "lang", "source").collect()]
    assert got(source_divergence(docs)) == brute(rows)


def test_empty_table(none):
    assert source_divergence(none).collect() == []


def test_shares_are_exact(spark):
    numbers = [(3, 10 ** 18, 10 ** 15), (10 ** 18, 3 * 10 ** 18, 10 ** 12), (0, 0, 1), (7, 9, 3), (None, None, 10 ** 10)]
    rows = spark.createDataFrame(numbers, "n long, total long, terms long")
    assert [r[0] for r in rows.select(sd._share("n", "total", "terms")).collect()] == [
        share(a or 0, b or 0, c) for a, b, c in numbers]


@settings(deadline=None)
@given(st.lists(st.tuples(st.lists(st.text("abAÉé漢", min_size=1, max_size=12), max_size=8), st.integers(0, 2)), max_size=12), st.integers(0, 3))
def test_runs(texts, reduced):
    """Occurrences and documents per term and source, also when what is held is reduced in between."""
    shard, want, used = Shard(), Counter(), defaultdict(set)
    for i, (words, source) in enumerate(texts):
        data = " ".join(words).encode().translate(LOWER_BYTES)
        shard.add(data, np.array([source], np.uint32), np.array([i], np.uint32), np.array([0, len(data) + 1]))
        if i < reduced:
            shard.reduce()
        for term in terms_of(" ".join(words)):
            want[term, source] += 1
            used[term, source].add(i)
    found, order = {}, []
    for one, two, rest, source, counts, docs in shard.runs():
        terms = [(int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")).rstrip(b"\0") + r for a, b, r in zip(one, two, rest)]
        order.append(terms == sorted(terms))
        for t, s, n, d in zip(terms, source.tolist(), counts.tolist(), docs.tolist()):
            assert (t.decode(), s) not in found
            found[t.decode(), s] = (n, d)
    assert found == {k: (n, len(used[k])) for k, n in want.items()} and all(order)


@given(st.lists(st.tuples(st.integers(0, 2 ** 64 - 1), st.integers(0, 3))))
def test_radix_order(rows):
    one, two = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.uint32)
    order = radix_order([two, one], np.arange(len(rows)))
    assert order.tolist() == sorted(range(len(rows)), key=lambda i: rows[i])


def test_packed_terms():
    starts, lengths, one, two, _ = packed_terms("ab 1é2 abcdefgh abcdefghi".encode())
    assert starts.tolist() == [0, 4, 8, 17] and lengths.tolist() == [2, 2, 8, 9]
    assert [int(x).to_bytes(8, "big").rstrip(b"\0") for x in one] == [b"ab", "é".encode(), b"abcdefgh", b"abcdefgh"]
    assert [int(x).to_bytes(8, "big").rstrip(b"\0") for x in two] == [b"", b"", b"", b"i"]
    assert len(packed_terms(b"")[0]) == 0


@settings(deadline=None)
@given(st.lists(st.tuples(st.lists(st.text("abAÉé漢", min_size=1, max_size=12), max_size=8), st.integers(0, 2)), max_size=12))
def test_runs_of_settled_documents(texts):
    """Counting after every document gives the runs of counting once."""
    runs = []
    for settled in (False, True):
        shard = Shard()
        for i, (words, source) in enumerate(texts):
            data = " ".join(words).encode().translate(LOWER_BYTES)
            shard.add(data, np.array([source], np.uint32), np.array([i], np.uint32), np.array([0, len(data) + 1]))
            if settled:
                shard.settle()
        runs.append([[x if isinstance(x, list) else x.tolist() for x in bucket] for bucket in shard.runs()])
    assert runs[0] == runs[1]


def test_memory_of_a_task():
    """A task holds runs of its text, not all terms (the finding: over 3,000 MB of an executor at 6 GB)."""
    words = [f"{a}{b}{c}{d}" for a in "abcdefgh" for b in "klmnop" for c in ("", "ou", "tion") for d in ("", "y" * 4)]
    texts = [" ".join(words[(i * j) % len(words)] for j in range(700)) for i in range(1, 20)]
    batch = pa.record_batch({"lang": ["en"] * 380, "source": [f"s{i % 4}" for i in range(380)], "text": [texts[i % 19] for i in range(380)]})
    run = sd._packed_runs(SimpleNamespace(mapInArrow=lambda function, schema: function))
    n = sd.SHARD_BYTES // batch.column("text").nbytes
    assert batch.column("text").nbytes < sd.BATCH_BYTES and n > 5
    tracemalloc.start()
    try:
        rows = list(run(batch for _ in range(n)))
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    counts = sum(int(sd._unpacked(r, 0)[4].sum()) for r in rows)
    assert counts == n * sum(len(terms_of(t)) for t in texts) * 20
    assert held < 4 * sd.SHARD_BYTES  # numpy and Python; before 20.6 times


def test_packed_rows_are_small(spark):
    """What a reader of packed rows decodes at once stays far below the memory of a task; the setting comes back."""
    assert sd.ROW_RUNS * 36 * sd.READ_ROWS < 8 << 20
    setting = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(setting)
    with read_batches(spark, 7):
        assert spark.conf.get(setting) == "7"
    assert spark.conf.get(setting) == before
