from collections import Counter

import numpy as np
import xxhash

from voxgauge.llm.near_dedup import close_pairs, connected, jaccard, links, near_dedup, parity, shingle_set, similar_groups, simhash
from voxgauge.llm.shared import LOWER_BYTES


def fingerprint(text, k=3, seed=42):
    words = (text or "").encode().translate(LOWER_BYTES).split()
    if not words:
        return 0
    shingles = [words[i:i + k] for i in range(len(words) - k + 1)] or [words]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(b" ".join(s), seed)
        for bit in range(64):
            votes[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if votes[bit] * 2 > len(shingles))


def brute(rows, k=3):
    prints = [fingerprint(t, k) for _, t in rows]
    different = sorted(set(prints))
    parent = {p: p for p in different}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(different):
        for b in different[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    lowest = {}
    for (doc_id, _), p in zip(rows, prints):
        if doc_id is not None:
            r = find(p)
            lowest[r] = min(lowest.get(r, doc_id), doc_id)
    return sorted(((i, f"{p:016x}", lowest.get(find(p))) for (i, _), p in zip(rows, prints)), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_whole_table(docs, doc_rows):
    assert got(near_dedup(docs)) == brute(list(doc_rows.items()))
    assert got(near_dedup(docs, shingle=5)) == brute(list(doc_rows.items()), 5)


def test_odd_rows(odd, odd_rows):
    assert got(near_dedup(odd)) == brute([r[:2] for r in odd_rows])


def test_empty_table(none):
    assert near_dedup(none).collect() == []


def test_blocks_of_words_change_nothing(monkeypatch):
    from voxgauge.llm import near_dedup as module
    from voxgauge.llm.shared import word_blocks

    text = " ".join(f"w{i * i % 101}" for i in range(400))
    monkeypatch.setattr(module, "word_blocks", lambda data: word_blocks(data, 50))
    assert simhash(text, 3) == fingerprint(text) and simhash(text, 5, 43) == fingerprint(text, 5, 43)


def test_links_are_complete_also_in_crowded_halves(spark):
    rng = np.random.default_rng(7)
    prints = set()
    for centre in rng.integers(0, 1 << 63, 6):
        for _ in range(60):
            bits = rng.choice(64, rng.integers(0, 4), replace=False)
            prints.add(int(centre) ^ sum(1 << int(b) for b in bits))
    prints = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    table = spark.createDataFrame([(p,) for p in prints], "bits long")
    for hot in (1, 8, 10_000):
        found = [tuple(r) for r in links(table, hot_bucket=hot, hashed=hot == 8).collect()]
        assert len(found) == len(set(found)) and set(found) == want


def test_long_chains_are_one_group(spark):
    rng = np.random.default_rng(3)
    names = rng.permutation(300).tolist()
    pairs = [(names[i], names[i + 1]) for i in range(199)] + [(names[200], names[i]) for i in range(201, 300)]
    df = spark.createDataFrame([(min(p), max(p)) for p in pairs], "a long, b long")
    roots = dict(map(tuple, connected(df).collect()))
    assert {roots[n] for n in names[:200]} == {min(names[:200])}
    assert {roots[n] for n in names[200:]} == {min(names[200:])}


def test_few_links_take_few_tables(spark, monkeypatch):
    """Every table is as many small files and tasks as there are partitions; long chains took two per star step before."""
    from voxgauge.llm import near_dedup as module
    from voxgauge.llm.shared import kept_table

    written = []
    monkeypatch.setattr(module, "kept_table", lambda df, purpose: written.append(purpose) or kept_table(df, purpose))
    rng = np.random.default_rng(5)
    names = (rng.permutation(400) - 200).tolist()  # fingerprints may be negative
    pairs = [(names[i], names[i + 1]) for i in range(199)] + [(names[300], names[i]) for i in range(301, 400)]
    df = spark.createDataFrame([(*p,) for p in [*pairs, *pairs, (7, 7), (None, 3)]], "a long, b long").repartition(6)
    want = {n: min(names[:200]) for n in names[:200]} | {n: min(names[300:]) for n in names[300:]}
    for task_links, most in ((100_000, 2), (1, 40), (50, 40)):
        written.clear()
        rows = [tuple(r) for r in connected(df, task_links).collect()]
        assert len(rows) == len(set(rows)) and dict(rows) == want and len(written) <= most


def words_of(text):
    return (text or "").encode().translate(LOWER_BYTES).split()


def shingles(text, k=5):
    words = words_of(text)
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def test_similar_groups(docs, doc_rows, odd, odd_rows, none):
    for df, rows in ((docs, list(doc_rows.items())), (odd, [r[:2] for r in odd_rows if r[0] != 14] + [odd_rows[14][:2]])):
        assert dict(map(tuple, similar_groups(df).collect())) == all_pairs(rows)
    assert similar_groups(none).collect() == []


def test_small_edits_are_caught_and_others_left(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, edited = [], []
    for n in range(40):
        words = list(rng.choice(vocabulary, 800))
        rows.append((2 * n, " ".join(words)))
        words[int(rng.integers(800))] = "edited"
        rows.append((2 * n + 1, " ".join(words)))
        edited.append(2 * n)
    got = dict(map(tuple, similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert all(got[i] == i - i % 2 for i in got)
    assert len(got) >= 2 * 34


def test_shingle_sets(monkeypatch):
    from voxgauge.llm import near_dedup as module
    from voxgauge.llm.shared import word_blocks

    text = " ".join(f"w{i * i % 101}" for i in range(300))
    whole = shingle_set(text, 5)
    assert len(whole) == len(shingles(text)) and jaccard(whole, whole) == 1
    monkeypatch.setattr(module, "word_blocks", lambda data: word_blocks(data, 40))
    assert (shingle_set(text, 5) == whole).all()
    assert len(shingle_set("a b", 5)) == 1 and len(shingle_set(None, 5)) == 0
    assert jaccard(shingle_set("", 5), shingle_set(" ", 5)) == 1.0 and jaccard(whole, shingle_set("a", 5)) == 0.0


def all_pairs(rows, similarity=0.8):
    """Smallest id per document of groups with more than one member: all pairs compared, no fingerprint looked at."""
    sets, root = {i: shingles(t) for i, t in rows if i is not None}, {}
    find = lambda i: i if root.get(i, i) == i else find(root[i])
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    counts = Counter(map(find, sets))
    return {i: find(i) for i in sets if counts[find(i)] > 1}


def groups_of(spark, rows, **kw):
    return dict(map(tuple, similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect()))


def test_all_pairs_of_the_similarity_are_found(spark):
    rng = np.random.default_rng(5)
    rows = []
    for n in range(30):
        words = [f"w{w}" for w in rng.integers(0, 400, int(rng.integers(60, 300)))]
        for copy in range(3):
            edited = list(words)
            for at in rng.choice(len(words), max(1, len(words) * copy // 60), replace=False):
                edited[at] = f"e{rng.integers(0, 400)}"
            rows.append((3 * n + copy, " ".join(edited)))
    want = all_pairs(rows)
    assert groups_of(spark, rows) == want and 45 <= len(want) < 90
    assert groups_of(spark, rows, similarity=0.6) == all_pairs(rows, 0.6)


def test_whole_tables_against_all_pairs(docs, doc_rows, odd, odd_rows):
    assert dict(map(tuple, similar_groups(docs).collect())) == all_pairs(list(doc_rows.items()))
    assert dict(map(tuple, similar_groups(odd).collect())) == all_pairs([r[:2] for r in odd_rows])


def test_frequent_lines_hide_no_pair(spark):
    """A line repeated often gives all three the same fingerprint; only two of them are near copies."""
    line = " ".join(f"stock{i}" for i in range(11))
    unique = lambda seed: [f"u{seed}x{i}" for i in range(150)]
    body = unique(2)
    edited = [*body[:149], "edited"]
    rows = [(1, f"{line} " * 150 + " ".join(unique(1))), (2, f"{line} " * 150 + " ".join(body)),
            (3, f"{line} " * 150 + " ".join(edited))]
    assert len({simhash(t, 2) for _, t in rows}) == 1
    assert groups_of(spark, rows) == all_pairs(rows) == {2: 2, 3: 2}


def test_large_groups_of_near_copies(spark):
    """Runs of many documents: a chain of copies of copies, and copies of another text that share a passage with it."""
    rng = np.random.default_rng(9)
    passage, rows = [f"p{i}" for i in range(60)], []
    for group in range(2):
        words = passage + [f"g{group}x{i}" for i in range(40)]
        for n in range(80):
            rows.append((2 * n + group, " ".join(words)))
            words[int(rng.integers(len(words)))] = f"e{group}x{n}"
    assert groups_of(spark, rows) == all_pairs(rows)


def test_blocks_and_clusters_lose_no_pair(spark, monkeypatch):
    """Copies around the limit of similarity, in runs longer than a block: some in the group, some just outside of it."""
    from voxgauge.llm import near_dedup as module

    monkeypatch.setattr(module, "LONG_RUN", 5)
    monkeypatch.setattr(module, "BLOCK_MEMBERS", 16)
    monkeypatch.setattr(module, "BLOCK_BYTES", 4096)
    rng = np.random.default_rng(21)
    rows = []
    for group in range(3):
        words = [f"g{group}x{i}" for i in range(80 + 60 * group)]
        for n in range(50):
            edited = list(words[int(rng.integers(0, 8)):])
            for at in rng.choice(len(edited), int(rng.integers(0, 5)), replace=False):
                edited[at] = f"e{rng.integers(0, 10 ** 6)}"
            rows.append((3 * n + group, " ".join(edited)))
    want = all_pairs(rows)
    assert groups_of(spark, rows) == want and 0 < len(want) < len(rows)


def test_close_pairs():
    """Every pair that is similar passes, whatever the widths of the parity bits; equal roots and the document itself do not."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 600).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[:n], rng.integers(0, 1 << 63, n // 12).astype(np.uint64)])) for n in (90, 120, 250, 260, 500, 510, 600, 1, 0, 0)]
    side = {"doc_id": list(range(len(sets))), "n": [len(x) for x in sets], "root": list(range(len(sets))), "parity": [parity(x) for x in sets]}
    found = set(zip(*(x.tolist() for x in close_pairs(side, side, 0.8))))
    want = {(i, j) for j in range(len(sets)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8}
    assert want <= found and len(found) <= len(want) + 6 and (8, 9) in found
    assert not set(zip(*(x.tolist() for x in close_pairs(side | {"root": [0] * len(sets)}, side | {"root": [0] * len(sets)}, 0.8))))


def test_pairs_grow_with_the_documents_and_not_with_the_square_of_a_group(spark, monkeypatch):
    """Copies with edits of their own: hardly two runs have the same lowest document, and most pairs are alike."""
    from voxgauge.llm import near_dedup as module

    compared, plain = [], module._alike

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(module, "_alike", counted)
    rng = np.random.default_rng(4)
    words, rows = [f"w{i}" for i in range(150)], []
    for n in range(240):
        edited = list(words)
        for at in rng.choice(len(words), 1 + n % 3, replace=False):
            edited[at] = f"e{rng.integers(0, 20)}"
        rows.append((n, " ".join(edited)))
    assert groups_of(spark, rows) == all_pairs(rows)
    assert sum(compared) <= 8 * len(rows)


def test_every_document_gives_its_lowest_partners():
    from voxgauge.llm.near_dedup import lowest_partners

    a, b = np.array([(i, j) for i in range(6) for j in range(i + 1, 6)]).T
    given = {(a[i], b[i]) for i in lowest_partners(a, b, 1).tolist()}
    assert given == {(0, 1), (0, 2), (0, 3), (0, 4), (0, 5)}
    assert len(lowest_partners(a, b, 5)) == len(a) and not len(lowest_partners(a[:0], b[:0], 2))
