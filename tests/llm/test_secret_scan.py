import base64
import hashlib
import random
import re

from pyspark.sql import functions as F

from voxgauge.llm.queries import op1_secret_scan
from voxgauge.llm.secret_scan import find_secrets, mask_secrets, span_list

KINDS = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.ASCII), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def base(text):
    spans = [(m.start(), rank, m.end(), kind) for rank, (kind, (pattern, good)) in enumerate(KINDS.items())
             for m in pattern.finditer(text or "") if good(m)]
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans))


TRICKY = [
    'token: token: abcdefgh', "token=token=abcdef", "PassWord = 'abc' passwd:'abcdef1' api_key==zz12345", "AKIAAKIA" + "Z" * 14,
    "AKIA" + "1" * 16 + " AKIA" + "1" * 15, "0123456789abcdef01234567", "ſecret=abcdefg toKen=abcdefgh", "🙂 secret = 漢字",
    "🙂é token = \"abcdefgh\" x", "secret\x20\x20:\x20\x20abcdef", "apikey=" + "a" * 24, "", None, "token=",
]


def test_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    found = {r[0]: r[1] for r in find_secrets(df).select("doc_id", span_list(
        F.filter("spans", lambda s: s["kind"] != "random"))).collect()}
    assert found == {i: base(t) for i, t in enumerate(TRICKY)}


def test_whole_table(spark, doc_rows):
    rows = op1_secret_scan(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(doc_rows)
    for r in rows:
        want = base(doc_rows[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("random")] == [s for s in want.split(",") if s]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(want.count(k) for k in KINDS)


def test_battery_finds_keys_and_leaves_words(spark):
    rng = random.Random(5)
    keys = [base64.b64encode(rng.randbytes(36)).decode() for _ in range(40)]
    words = ["internationalisation" * 2 + "2", "AAAAAAAAAAAAAAAAAAAAAAAA1", "aB" * 30, "version-1-of-the-long-name-of-a-file",
             "abcdefghijklmnopqrstuvwxyz0123456789", "/usr/share/doc/package1/examples/readme", "camelCaseNamesAreLongSometimes"]
    texts = [f"see {k} there" for k in keys] + [f"see {w} there" for w in words]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in find_secrets(df).collect()}
    assert sum("random" in found[i] for i in range(40)) >= 36
    assert not any("random" in found[i] for i in range(40, len(texts)))


def test_masks(spark):
    texts = ['a token = "abcdefgh" b', "no secrets", None, "", "0123456789abcdef01234567 and AKIA" + "Q" * 16,
             "🙂 secret=0123456789abcdef01234567🙂"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    out = mask_secrets(df)
    assert out.columns == df.columns
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == [
        'a [SECRET]" b', "no secrets", None, "", "[SECRET] and [SECRET]", "🙂 [SECRET]🙂"]


def test_odd_rows(odd, odd_rows, none):
    rows = find_secrets(odd, spans="spans").collect()
    assert len(rows) == len(odd_rows)
    assert all(span_kinds(r) <= set(KINDS) | {"random"} for r in rows)
    assert find_secrets(none).collect() == [] and mask_secrets(none).collect() == []


def span_kinds(row):
    return {s["kind"] for s in row["spans"]}


def test_battery_finds_keys_after_an_equals_sign(spark):
    rng = random.Random(6)
    keys = [base64.b64encode(rng.randbytes(36 - i % 2)).decode() for i in range(40)]  # every second one ends in padding
    forms = ["aws_secret_access_key={}", "GET https://host/a?v=1&sig={}&x=2", "MODE=fast\nPRIVATE_VALUE={}\nLEVEL=3", "a=b={} there"]
    texts = [form.format(key) for form in forms for key in keys]
    words = ["the_name_of_option_number_1=internationalisation" * 2, "path=/usr/share/doc/package1/examples/readme", "=" * 30 + "1",
             "camelCaseNamesAreLongSometimes=camelCaseNamesAreLongSometimes"]
    df = spark.createDataFrame(list(enumerate(texts + words)), "doc_id long, text string")
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "random"] for r in find_secrets(df).collect()}
    for n, _ in enumerate(forms):
        places = [(texts[i].index(keys[i - 40 * n]), i) for i in range(40 * n, 40 * n + 40)]
        assert sum((start, start + len(keys[i - 40 * n])) in found[i] for start, i in places) >= 36
    assert not any(found[i] for i in range(len(texts), len(texts + words)))
    masked = {r["doc_id"]: r["text"] for r in mask_secrets(df).collect()}
    assert sum(masked[40 + i] == "GET https://host/a?v=1&sig=[SECRET]&x=2" for i in range(40)) >= 36
