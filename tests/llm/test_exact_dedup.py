import hashlib
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from voxgauge.llm import exact_dedup as module
from voxgauge.llm.exact_dedup import PatriciaTrie, exact_dedup
from voxgauge.llm.shared import LOWER_BYTES


def brute(rows, better=max):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").encode().translate(LOWER_BYTES)].append(doc_id)
    out = []
    for body, ids in groups.items():
        keep = better([i for i in ids if i is not None], default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(body).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_whole_table(docs, doc_rows):
    assert got(exact_dedup(docs)) == brute(doc_rows.items())


def test_odd_rows_and_spilling_tries(odd, odd_rows):
    want = brute([r[:2] for r in odd_rows])
    assert got(exact_dedup(odd)) == want
    assert got(exact_dedup(odd, trie_bytes=500)) == want
    assert got(exact_dedup(odd, keep="smallest")) == brute([r[:2] for r in odd_rows], min)


def test_empty_table(none):
    assert exact_dedup(none).collect() == []


def test_hot_text(spark):
    rows = spark.range(30_000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'Hot Text', concat('t', id)) AS text")
    found = exact_dedup(rows.repartition(8))
    assert found.filter("group_size = 10000 AND keep_id = 29997").count() == 10_000
    assert found.filter("kept").count() == 20_001


@given(st.lists(st.tuples(st.binary(min_size=1, max_size=6), st.integers(0, 9))))
def test_trie_is_a_map(pairs):
    trie, want = PatriciaTrie(), {}
    for key, owner in pairs:
        trie.insert(key, owner, 1)
        best, members = want.get(key, (owner, 0))
        want[key] = (max(best, owner), members + 1)
    assert {k: (o, m) for k, o, m in trie.drain()} == want
    assert trie.held <= 0 or not trie.root.children


def test_spill_leaves_whole_subtrees_behind():
    """Subtrees leave until half is held; the rest of the trie goes on owning its texts."""
    trie, keys = PatriciaTrie(), {}
    for i in range(5000):
        body = f"text {i}".encode() * (1 + i % 5)
        digest = int.from_bytes(hashlib.sha256(body).digest()[:8], "big", signed=True)
        keys[module._key(len(body), digest, body)] = i
    for key, i in keys.items():
        trie.insert(key, i, 1)
    before = trie.held
    gone = {key: owner for key, owner, _ in trie.drain(before // 2)}
    assert 2000 < len(gone) < 3000 and before // 3 < trie.held <= before // 2
    assert {key[0] for key in gone}.isdisjoint(trie.root.children)
    for key, i in keys.items():
        trie.insert(key, i + 1, 1)
    rest = {key: (owner, members) for key, owner, members in trie.drain()}
    assert rest == {key: (i + 1, 1 if key in gone else 2) for key, i in keys.items()} and trie.held == 0


def test_rows_leave_in_small_batches(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(module, "BATCH_BYTES", 64)
    rows = [(bytes(16) + bytes([i]) * 30, i, 1) for i in range(10)]
    assert [b.num_rows for b in module._batches(iter(rows), True)] == [1] * 10
    monkeypatch.setattr(module, "BATCH_BYTES", 100)
    assert [b.num_rows for b in module._batches(iter(rows), False)] == [2] * 5
    assert list(module._batches(iter([]), True)) == []
