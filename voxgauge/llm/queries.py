"""Registered queries: each operator with production parameters on the whole of its table, and DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from voxgauge.llm import (
    bpe_stream, decontaminate, exact_dedup, filter_audit, language_id, lm_score, media, near_dedup, packing, secret_scan, sharding, source_divergence,
    token_files,
)
from voxgauge.llm.shared import documents, id_remainder
from voxgauge.session import scratch_folder, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SHARDS = 40
END_OF_PIECES, END_OF_DOCUMENT = 0, 2


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(documents(spark, sf_dir), columns=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secret_scan.span_list(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.span_list(F.col("spans")).alias("spans"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language_id.identify(docs.select("doc_id", "text"), language_id.train(docs))
    return found.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per shard differ by at most one: the bounded loads are the even share."""
    placed = sharding.assign_shards(documents(spark, sf_dir), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "home")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), BYTE_BPE, END_OF_PIECES)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_stream.encode_texts(documents(spark, sf_dir), WORD_BPE)
    decimals = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(decimals.cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "token-files")
    token_files.write_token_files(documents(spark, sf_dir), folder, BYTE_BPE, END_OF_DOCUMENT)
    return token_files.read_token_files(spark, folder).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_round_trip(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
        "media_type", "declared", "corrected", F.size("embedded").alias("n_embedded"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(documents(spark, sf_dir))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_interaction(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_language_id, op3_simhash_near_dedup, op4_lm_score, op5_sharding, op6_best_fit_packing, op7_bpe_round_trip, op8_token_files,
    op9_exact_dedup, op10_media_columns, op11_source_divergence, op12_decontamination, op13_filter_interaction)}

#: DuckDB's lower() also changes letters beyond A-Z; translate changes A-Z alone.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES = {
    "op9_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, {_LOWER} AS body FROM documents) WINDOW same AS (PARTITION BY body)
""",
    "op11_source_divergence": f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
l AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY ALL),
ln AS (SELECT lang, sum(c) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c,
        1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (coalesce(n.n, 0) + 5 * v.v) AS p,
        1 + (1000000000::HUGEINT * (l.c + 5)) // (ln.n + 5 * v.v) AS q
    FROM g JOIN kept USING (lang) JOIN v USING (lang) JOIN l ON l.lang = g.lang AND l.term = kept.term JOIN ln ON ln.lang = g.lang
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
    LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
    WHERE x.term IS NOT DISTINCT FROM y.term GROUP BY ALL
    UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM f)
WHERE part = 'pair' OR rank <= 50
""",
    "op12_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS body
    FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS body
    FROM d, lengths, unnest(range(1, len(w) - n + 2)) u(i) WHERE len(w) >= n),
found AS (SELECT r, i, n, item FROM places JOIN windows USING (n, body)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, i, n FROM found), unnest(range(i, i + n)) u(p) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
""",
    "op13_filter_interaction": """
WITH rows AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents),
words AS (SELECT *, list_filter(regexp_split_to_array(body, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS l FROM rows),
fails AS (SELECT part, doc_id, (len(l) < 200)::INT + 2 * (100 * len(list_distinct(l)) < 50 * len(l))::INT
        + 4 * (100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body))::INT
        + 8 * regexp_matches(body, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY body))::INT AS f FROM words),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
cells AS (SELECT part, f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM fails LEFT JOIN known USING (doc_id) GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, s::INT AS step, (1 << (instr('ABCDE', filter_order[s]) - 1)) AS own,
        coalesce(list_sum([1 << (instr('ABCDE', filter_order[i]) - 1) for i in range(1, s)]), 0)::INT AS before
    FROM orders, range(1, 6) r(s)),
each AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER ((f & (own | before)) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER ((f & own) <> 0 AND (f & before) = 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER ((f & own) <> 0 AND (f & before) <> 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (f = own), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER ((f & own) <> 0 AND (f & before) = 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER ((f & own) <> 0 AND (f & before) = 0), 0)::BIGINT AS toxic_lost
    FROM cells, steps GROUP BY ALL)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM each
""",
}
