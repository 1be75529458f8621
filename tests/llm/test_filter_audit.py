import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from voxgauge.llm import filter_audit
from voxgauge.llm.filter_audit import coded_words, dictionary, document_term_matrix, failures, filter_interaction, sparse_rows
from voxgauge.llm.shared import documents

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute_fails(rows):
    """Per row (doc_id, text, source): the letters of the filters it fails."""
    ids = defaultdict(list)
    for doc_id, text, _ in rows:
        if doc_id is not None:
            ids[text or ""].append(doc_id)
    out = []
    for doc_id, text, source in rows:
        body = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", body)
        fails = ("A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
                 + "C" * (100 * len(re.findall("[A-Z]", body)) > 2 * len(body)) + "D" * bool(re.search(r"[#$%&*|]", body))
                 + "E" * (doc_id is not None and any(i < doc_id for i in ids[body])))
        out.append((doc_id, source or "", fails))
    return out


def brute(rows, good, toxic):
    fails, out = brute_fails(rows), []
    for part in {p for _, p, _ in fails}:
        own, removed_in_all = [(i, f) for i, p, f in fails if p == part], Counter()
        steps = {}
        for order in itertools.permutations("ABCDE"):
            alive = own
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in alive if name in f]
                alive = [(i, f) for i, f in alive if name not in f]
                failing = sum(name in f for _, f in own)
                steps["".join(order), step] = (len(alive), len(gone), failing - len(gone), sum(f == name for _, f in own),
                                               sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                removed_in_all[name] += len(gone)
        out += [(part, order, step, *row, removed_in_all[order[step - 1]]) for (order, step), row in steps.items()]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def letters(fails):
    return "".join(c for i, c in enumerate("ABCDE") if fails >> i & 1)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_whole_table(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    known = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    marks = known.collect()
    want = brute([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()],
                 {r["doc_id"] for r in marks if r["quality"] == 1}, {r["doc_id"] for r in marks if r["toxic"] == 1})
    assert got(filter_interaction(docs, known)) == want


def test_odd_rows_over_many_shards(spark, odd, odd_rows, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 40)
    monkeypatch.setattr(filter_audit, "BATCH_BYTES", 5000)
    monkeypatch.setattr(filter_audit, "DICTIONARY_ROWS", 5000)
    monkeypatch.setattr(filter_audit, "PACKED_ROWS", 3000)
    rows = [(r[0], r[1], r[3]) for r in odd_rows]
    marks = [(4, 1, 0), (4, None, 1), (5, 1, None), (None, 1, 1), (14, 1, 0), (999, 1, 1)]
    want = brute(rows, {4, 5, 14}, {4})
    assert got(filter_interaction(odd, labels(spark, marks))) == want
    found = sorted(((r["doc_id"], r["part"], letters(r["fails"])) for r in failures(odd).collect()), key=repr)
    assert found == sorted(brute_fails(rows), key=repr)


def test_limits_are_exact(spark):
    """Texts at and one beside each limit, and one that fails everything."""
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[:200]), " ".join(words[:199]), " ".join(words[:100] * 2), " ".join(words[:99] * 2 + ["w0", "w1"]),
             "A" * 2 + "b" * 98, "A" * 3 + "b" * 97, "A" * 2 + "é" * 98, "A" * 2 + "é" * 97, "a|b", "a^b", "# A A", "# A A"]
    rows = [(i, t, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted((r["doc_id"], r["part"], letters(r["fails"])) for r in failures(docs).collect()) == sorted(brute_fails(rows))


def test_a_large_group_of_copies(spark):
    docs = spark.range(30_000).selectExpr(
        "id AS doc_id", "IF(id % 3 = 0, 'One hot text', concat('text number ', id)) AS text", "'s' AS source").repartition(8)
    found = failures(docs).filter("fails >= 16").agg({"doc_id": "min", "*": "count"}).first()
    assert tuple(found) == (9999, 3) or set(found) == {9999, 3}


def test_numbers_are_global(spark, monkeypatch):
    """Equal words of different shards share a number, different words never do."""
    monkeypatch.setattr(filter_audit, "PACKED_ROWS", 2)
    rows = [(0, 0, "b"), (0, 1, "a"), (0, 2, "c"), (1, 0, "c"), (1, 1, "d"), (3, 0, "a")]
    found = dictionary(spark.createDataFrame(rows, "shard long, place int, word string")).collect()
    ids = {(r["shard"], p): i for r in found
           for p, i in zip(np.frombuffer(r["places"], np.uint32).tolist(), np.frombuffer(r["ids"], np.int64).tolist())}
    assert sorted(ids) == sorted((s, p) for s, p, _ in rows)
    assert len({(w, ids[s, p]) for s, p, w in rows}) == len({ids[s, p] for s, p, _ in rows}) == 4


def test_matrix(spark, odd):
    """Columns of the matrix stand for words: every document's counts by global number, over shards of one block each."""
    docs = odd.filter("doc_id <> 14").selectExpr("doc_id", "source AS part", "text")
    counts, numbers = {}, defaultdict(set)
    for r in document_term_matrix(docs).collect():
        starts, columns, cells = (np.frombuffer(r[c], t) for c, t in (("starts", np.int64), ("columns", np.int64), ("counts", np.uint32)))
        for d, a, b in zip(r["docs"], starts, starts[1:]):
            counts[d["doc_id"]] = dict(zip(columns[a:b].tolist(), cells[a:b].tolist()))
    for r in docs.collect():
        want = Counter(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert sorted(counts[r["doc_id"]].values()) == sorted(want.values())
        for word in want if len(want) < 100 else ():
            numbers[word].add(frozenset(counts[r["doc_id"]]))
    shared = {w: frozenset.intersection(*n) for w, n in numbers.items() if len(n) > 1}
    assert "here" in shared and all(shared.values())


def test_sparse_rows():
    coded, rows = coded_words(pa.array(["b a\x0bb", "", " \t", "a\x1ca a"], pa.large_string()))
    words = coded.dictionary.to_pylist()
    starts, columns, counts = sparse_rows(coded.indices.to_numpy(), rows, 4, len(words))
    cells = [{words[c]: n for c, n in zip(columns[a:b], counts[a:b].tolist())} for a, b in zip(starts, starts[1:])]
    assert cells == [{"a": 1, "b": 2}, {}, {}, {"a\x1ca": 1, "a": 1}]
    assert [len(x) for x in sparse_rows(np.zeros(0, np.int32), np.zeros(0, np.int32), 0, 0)] == [1, 0, 0]


def test_empty_tables(spark, none):
    assert filter_interaction(none, labels(spark, [])).collect() == []
    docs = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert got(filter_interaction(docs, labels(spark, []))) == brute([(1, None, None)], set(), set())
