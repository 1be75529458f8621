import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from voxgauge.llm import decontaminate
from voxgauge.llm.decontaminate import GRAM, WINDOW, Words, extent, find_contamination
from voxgauge.llm.shared import LOWER_BYTES, documents

ITEMS = "item_id long, text string"
DOCS = "doc_id long, text string"


def words_of(text):
    lower = (text or "").encode().translate(LOWER_BYTES).decode()
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        own = words_of(text)
        n = min(len(own), WINDOW)
        for i in range(len(own) - n + 1) if own else ():
            windows[tuple(own[i:i + n])].add("" if item is None else str(item))
    sizes, out = {len(w) for w in windows}, []
    for doc_id, text in docs:
        own, hit, found = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(own) - n + 1):
                if tuple(own[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(own[i:i + n])]
        out.append((doc_id, len(own), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in df.collect()), key=repr)


def test_whole_table(spark):
    docs = documents(spark, "/root/testdata/sf0.001").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute(map(tuple, docs.collect()), [(r["item_id"], r["text"]) for r in items.collect()])
    assert got(find_contamination(docs, items)) == want and any(w[4] for w in want)


def test_odd_rows_short_items_and_repeats(spark, odd, odd_rows):
    """Items of one to nine words, of four (the length of a gram), equal items, an id twice, nulls, a long passage."""
    passage = " ".join(f"w{i}" for i in range(40))
    items = [(1, "a"), (2, "some words"), (3, "wörd5 5 wörd6 6"), (4, "SAME row"), (4, "漢字 text"), (5, None), (6, "..."),
             (7, passage), (8, passage.upper()), (9, " ".join(passage.split()[5:25])), (None, "äö ü"), (10, "x " * 12),
             (11, " ".join(f"wörd{i % 977} {i}" for i in range(2000, 2030))), (12, "a b c d e f g h i"), (13, " ".join("abcabcabcabc"))]
    more = [(100, f"Before {passage}, after"), (101, " ".join(passage.split()[:9])), (102, " ".join(passage.split()[3:13])),
            (103, "x " * 30), (104, "a b c a b c a b c a"), (105, "a-b-c.d_e f\x00g,h;i j"), (106, "-- " + passage + " . " + passage)]
    rows = [*[r[:2] for r in odd_rows], *more]
    docs = odd.select("doc_id", "text", "key", "row").unionByName(spark.createDataFrame(more, DOCS), allowMissingColumns=True)
    benchmark = spark.createDataFrame(items, ITEMS).selectExpr("item_id", "text", "1 AS n", "2 AS hash")
    assert got(find_contamination(docs, benchmark)) == brute(rows, items)


def test_a_filter_that_lets_everything_through(spark, monkeypatch):
    """Wrong passes of the filter cost time, not results."""
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 1 << 16)
    items = [(i, " ".join(f"t{(i * 37 + j * j) % 50}" for j in range(400))) for i in range(300)]
    rows = [(i, " ".join(f"t{(i * 11 + j * j) % 50}" for j in range(60))) for i in range(40)]
    monkeypatch.setattr(decontaminate, "_bits", lambda rows: np.full((1 << 16) // 8, 255, np.uint8))
    found = find_contamination(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS))
    assert got(found) == brute(rows, items)


def test_a_passage_in_a_third_of_all_documents(spark):
    passage = " ".join(f"common{i}" for i in range(30))
    docs = spark.range(9_000).selectExpr(
        "id AS doc_id", f"IF(id % 3 = 0, concat('start', id, ' {passage} end', id), concat_ws(' ', transform(sequence(1, 20), x -> concat(id, 'u', x)))) AS text")
    items = spark.createDataFrame([(1, passage), (2, passage), (3, passage + " more words than the others have here")], ITEMS)
    found = find_contamination(docs.repartition(8), items)
    assert found.filter("contaminated AND n_hit = 30 AND items = array('1', '2', '3')").count() == 3000
    assert found.filter("NOT contaminated AND n_hit = 0").count() == 6000


def test_empty_tables(spark, none):
    items = spark.createDataFrame([(1, "some words here")], ITEMS)
    assert find_contamination(none, items).collect() == []
    docs = spark.createDataFrame([(1, "some words here"), (2, None)], DOCS)
    assert got(find_contamination(docs, spark.createDataFrame([], ITEMS))) == [(1, 3, 0, [], False), (2, 0, 0, [], False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=WINDOW, max_size=30), st.lists(st.integers(0, 3), max_size=8),
       st.lists(st.integers(0, 3), max_size=8), st.integers(0, 20))
def test_a_shared_window_shares_a_gram(span, before, after, start):
    """The guarantee: of a shared span of a window or more, both sides keep one gram at the same place, and it grows back."""
    start = min(start, len(span) - WINDOW)
    shared = span[start:start + WINDOW]
    one, two = Words(pa.array([" ".join(map(str, span))])), Words(pa.array([" ".join(map(str, before + shared + after))]))
    kept = {int(at) - start for at in one.kept_grams()} & {int(at) - len(before) for at in two.kept_grams()}
    inside = [at for at in kept if 0 <= at <= WINDOW - GRAM]
    assert inside
    (left, a), (right, b) = one.context(inside[0] + start), two.context(inside[0] + len(before))
    reach = extent(left, a, right, b, GRAM)
    assert reach and reach[0] >= inside[0] and reach[1] >= WINDOW - inside[0]


def test_words_of_several_texts():
    words = Words(pa.array(["Ab c", None, "", "c-ab", "É1 é1"]))
    assert words.first.tolist() == [0, 2, 2, 2, 4, 6]
    assert words.hashes[0] == words.hashes[3] and words.hashes[1] == words.hashes[2] and words.hashes[4] != words.hashes[5]
    assert words.joined(0, 6) == "ab c c ab É1 é1".encode()
    assert words.grams(2)[1].tolist() == [True, False, True, False, True]
