import zlib

import numpy as np
from pyspark.sql import functions as F

from voxgauge.llm import language_id
from voxgauge.llm.language_id import PLACES, fit, has_letter, identify, kernel, mark, train
from voxgauge.llm.queries import op2_language_id


def marks_of(*texts):
    rows = np.zeros((len(texts), sum(PLACES)), np.float32)
    for row, text in zip(rows, texts):
        mark(text, row)
    return rows


def grams(text):
    """Sets of hashed n-grams, character by character."""
    small = "".join(c if "a" <= c <= "z" or ord(c) >= 192 and c not in "×÷" else " " for c in text.lower())
    while "  " in small:
        small = small.replace("  ", " ")
    out = []
    for n, places in enumerate(PLACES, 1):
        found = set()
        for i in range(len(small) - n + 1):
            h = 0
            for ch, factor in zip(small[i:i + n], (2654435761, 2246822519, 3266489917)):
                h = (h + ord(ch)) * factor & 0xFFFFFFFF
            found.add(h >> 33 - places.bit_length())
        out.append(found)
    return out


def test_marks_and_kernel_against_sets():
    texts = ["The cat, the CAT 12!", "le chât été", "a", "çà et là — où?", "x" * 50]
    marks, sets = marks_of(*texts), [grams(t) for t in texts]
    start = 0
    for n, places in enumerate(PLACES):
        for row, found in zip(marks, sets):
            assert set(np.flatnonzero(row[start:start + places]).tolist()) == found[n]
        start += places
    want = [[np.mean([len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1)) for a, b in zip(x, y)]) for y in sets] for x in sets]
    assert np.allclose(kernel(marks, marks), want, atol=1e-6)


def test_blocks_lose_no_ngram(monkeypatch):
    text = "Ünder the brïdge, over 12 hills. " * 9
    whole = marks_of(text)
    monkeypatch.setattr(language_id, "BLOCK", 7)
    parts = marks_of(text)
    assert (parts >= whole).all() and (parts - whole).sum() <= 2  # a blank that a block begins with may count anew


def test_one_product_is_the_ridge_on_landmark_features():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list(letters), 60)) for letters in ("abcd ", "wxyz ") for _ in range(20)]
    labels = ["p"] * 20 + ["q"] * 20
    marks = marks_of(*texts)
    model = fit(marks, labels, landmarks=10)
    centres = marks[[*range(5), *range(20, 25)]]
    values, vectors = np.linalg.eigh(kernel(centres, centres))
    features = kernel(marks, centres) @ (vectors / np.sqrt(values))
    y = np.array([[1, -1]] * 20 + [[-1, 1]] * 20)
    centred = features - features.mean(axis=0)
    w = np.linalg.solve(centred.T @ centred + 1e-4 * 40 * np.eye(10), centred.T @ (y - y.mean(axis=0)))
    assert np.allclose(model.margins(marks), centred @ w + y.mean(axis=0), atol=1e-3)
    assert model.predict(["abba cad", "zyx wx", "12", None])[0] == ["p", "q", "und", "und"]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = op2_language_id(spark, sf).alias("f").join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(found) == 1000
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not has_letter(r["text"]))
    held = [r for r in found if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97


def test_held_out_labels_are_not_used(spark, docs):
    other = F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "xx").otherwise(F.col("lang"))
    assert "xx" not in train(docs.withColumn("lang", other)).languages


def test_odd_rows(odd, odd_rows, none, docs):
    model = train(docs)
    rows = identify(odd.withColumn("lang_pred", F.lit(1)), model).collect()
    assert len(rows) == len(odd_rows)
    assert all((r["lang_pred"] == "und" and r["score"] == 0) == (not has_letter(r["text"])) for r in rows)
    by_text = {}
    assert all(by_text.setdefault(r["text"], r["score"]) == r["score"] for r in rows)
    assert train(none).languages == [] and identify(none, model).collect() == []
    assert {r["lang_pred"] for r in identify(odd, train(none)).collect()} == {"und"}
    assert train(odd).languages == ["en"]


def test_copies_leave_no_language_out(spark):
    """Each language is one text many times over; the sample takes different texts, however many rows they fill."""
    rows = spark.range(36_000).selectExpr("id AS doc_id", "concat('l', id % 6) AS lang",
                                          "concat('the words of ', repeat(char(97 + id % 6), 5)) AS text")
    model = train(rows)
    assert model.languages == [f"l{i}" for i in range(6)]
    assert model.predict([f"the words of {c * 5}" for c in "abcdef"])[0] == model.languages


def test_sample_is_the_smallest_hashes_of_different_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "fit", lambda marks, labels, *rest: seen.append(labels) or fit(marks, labels, *rest))
    rows = spark.range(9_000).selectExpr("id AS doc_id", "'en' AS lang", "concat('text ', repeat('ab', 1 + int(id % 40))) AS text")
    train(rows)
    train(rows, per_language=25)
    assert [len(labels) for labels in seen] == [40, 25]
