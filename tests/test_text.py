import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxgauge.functions import text as tx


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = row
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[j - 1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_error_rates_golden(spark):
    df = spark.createDataFrame([
        ("the cat sat on the mat", "the dog sat the mat"), ("今天天气很好", "今日天气很好"), ("", ""), ("", "x"),
    ], "r string, h string")
    got = rows(df.select(F.round(tx.wer(F.col("r"), F.col("h")), 4), F.round(tx.cer(F.col("r"), F.col("h")), 4)))
    assert got == [(0.3333, 0.2727), (1.0, 0.1667), (0.0, 0.0), (1.0, 1.0)]


def test_distances_equal_brute_force(spark):
    rng = random.Random(7)
    pairs = []
    for _ in range(150):
        size = rng.choice([0, 1, 3, 20, 60, 150])
        a = [rng.choice("abcdefgh天é") for _ in range(size)]
        b = list(a)
        for _ in range(rng.choice([0, 1, 4, size])):
            at = rng.randrange(len(b) + 1)
            what = rng.random()
            if what < 0.4:
                b.insert(at, rng.choice("abcxyz地"))
            elif b and at < len(b):
                if what < 0.7:
                    del b[at]
                else:
                    b[at] = rng.choice("abcxyz地")
        pairs.append(("".join(a), "".join(b), [c * 3 for c in a], [c * 3 for c in b]))
    df = spark.createDataFrame(pairs, "a string, b string, aw array<string>, bw array<string>")
    got = df.select(
        "a", "b", tx.edit_distance(F.col("a"), F.col("b")).alias("chars"),
        tx.word_distance(F.col("aw"), F.col("bw")).alias("words")).collect()
    for r in got:
        assert r.chars == brute_distance(r.a, r.b) == r.words, (r.a, r.b)


def test_word_distance_with_colliding_hashes(spark):
    """A vocabulary far beyond the collision-free range takes the exact fallback."""
    a = [f"w{i}" for i in range(2500)]
    b = a[5:1000] + ["new"] + a[1001:] + ["tail"] * 3
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    got = df.select(
        tx.word_distance(F.col("a"), F.col("b")),
        F.size(F.array_distinct(tx._hash_codes(F.col("a")))) < 2500).first()
    assert got[0] == 9 and got[1]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=30), st.text(max_size=30)), min_size=5, max_size=20))
def test_normalise_matches_definition(spark, texts):
    def clean(t):
        return "".join(c for c in t if c not in "\x00" and not 0xD800 <= ord(c) <= 0xDFFF)

    data = [(clean(a) + clean(b), lang) for a, b in texts for lang in ("en", "zh")]
    df = spark.createDataFrame(data, "t string, lang string")
    for t, lang, got in rows(df.select("t", "lang", tx.normalize(F.col("t"), F.col("lang")))):
        folded = unicodedata.normalize("NFKC", t).strip()
        if lang == "en":
            want = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", folded.lower())).strip()
        else:
            want = re.sub("[^一-鿿0-9a-zA-Z]", "", folded)
        assert got == want, (t, lang)


def test_nfkc_composes(spark):
    df = spark.createDataFrame([("ＡＢ１ ﬁ ² é",), ("étre",), (None,)], "t string")
    assert [r[0] for r in rows(df.select(tx.nfkc(F.col("t"))))] == ["AB1 fi 2 é", "étre", None]


def test_preservation_threshold_applies_after_rounding(spark):
    ref = " ".join(f"w{i}" for i in range(9996))
    hyp = " ".join(["x"] * 1000 + [f"w{i}" for i in range(1000, 9996)])  # 0.10004 rounds to 0.1
    worse = " ".join(["x"] * 1001 + [f"w{i}" for i in range(1001, 9996)])
    df = spark.createDataFrame([(ref, hyp, "en"), (ref, worse, "en"), ("", "", "zh"), ("a b", None, "en")],
                               "t string, p string, language string")
    got = tx.with_preservation(df, "t", "p").select(
        "content_preservation_error", "content_preservation_pass", "content_preservation_metric").collect()
    assert [tuple(r) for r in got] == [(0.1, True, "wer"), (0.1001, False, "wer"), (0.0, True, "cer"), (None, None, None)]
    normed = df.where("p is not null").select(
        "language", tx.normalize(F.col("t"), F.col("language")).alias("t"),
        tx.normalize(F.col("p"), F.col("language")).alias("p"))
    quick = normed.select(tx.within_error_budget(F.col("t"), F.col("p"), F.col("language")))
    assert [r[0] for r in rows(quick)] == [True, False, True]


@pytest.mark.parametrize("kind, original, target, after, hyp, want", [
    ("replace", "cat", "dog", "", "the dog sat", (True, "replace_target_present_original_absent")),
    ("replace", "cat", "dog", "", "dog concatenate", (False, "replace_target_present=True;original_absent=False")),
    ("replace", "cat", "", "", "x", (False, "replace_missing_edit_target")),
    ("insert", "", "very", "is", "it is very good", (True, "insert_target_present_after_anchor")),
    ("insert", "", "very", "is", "very it is good", (False, "insert_target_present=True;after_before_target=False")),
    ("insert", "", "very", "", "so good", (False, "insert_target_absent")),
    ("delete", "", "", "", "x", (False, "delete_missing_edit_original")),
    ("delete", "um", "", "", "well then", (True, "delete_original_absent")),
    ("swap", "", "", "", "x", (False, "unsupported_edit_type=swap")),
    (None, "", "", "", "x", (False, "unsupported_edit_type=unknown")),
])
def test_edit_success(spark, kind, original, target, after, hyp, want):
    df = spark.createDataFrame([(kind, original, target, after, hyp)], "k string, o string, t string, a string, h string")
    got = df.select(tx.edit_success(*[F.col(c) for c in "kota"], F.col("h")).alias("r")).first()["r"]
    assert (got["success"], got["reason"]) == want


def test_quotes_and_templates(spark):
    df = spark.createDataFrame([('say "a" b', False), ('say "a', True), ("“x", True), ("“x”", False), ("it‘s", True)],
                               "t string, want boolean")
    assert all(r.got == r.want for r in df.select("want", tx.unbalanced_quotes(F.col("t")).alias("got")).collect())
    tpl = spark.createDataFrame([('Make "x" ANGRY and public broadcast, unhappy, 很happy的',)], "t string")
    assert tpl.select(tx.template_of(F.col("t"))).first()[0] == (
        'Make "<q>" <label> and <label>, unhappy, 很happy的')


def test_case_folding_matches_python(spark):
    texts = ["Aſk", "KKy", "Worıd", "PAUSE", "pauses!", "été before", "nobefore"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in (r"\b(ask|pause|before|worid)\b", "kky"):
        got = [r[0] for r in rows(df.select(tx.matches_pattern(tx.fold_case(F.col("t")), pattern)))]
        assert got == [bool(re.search(pattern, t, re.I)) for t in texts], pattern
