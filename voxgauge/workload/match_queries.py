"""Matching, lookups, similarity, names and paths on the driver tables."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from voxgauge.functions import naming as nm
from voxgauge.functions.numeric import duration_seconds, gain, round4
from voxgauge.operators import match as mt
from voxgauge.operators.lookup import spread_lookup
from voxgauge.operators.rollup import coverage_measures, mean, or_unknown, rate, summarise
from voxgauge.operators.similarity import needed_paths, pair_similarity, speaker_preserved, speaker_target
from voxgauge.session import scratch_folder, table
from voxgauge.sources.files import below, list_outputs, usable_outputs, with_output_ranks
from voxgauge.sources.listing import local_folder
from voxgauge.workload import duck_text as dt
from voxgauge.workload.standins import CANDIDATES, TURNS, duck, spark_table

# orders are samples, line items are files in several formats and folders; small ones lie in a folder that does not count,
# some have a format that does not count
CANDIDATE_FILES = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'A' THEN 1 ELSE 2 END AS ext_rank,
  CASE WHEN l_quantity <= 30 THEN NULL WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS dir_rank
FROM {lineitem}
"""
_USABLE_FILES = f"SELECT * FROM ({duck(CANDIDATE_FILES)}) WHERE dir_rank IS NOT NULL AND ext_rank IS NOT NULL"


def _candidates(spark, sf):
    return usable_outputs(spark_table(spark, sf, CANDIDATE_FILES))


def _matched(spark, sf):
    samples = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    candidates = _candidates(spark, sf)
    return mt.match_outputs(
        samples, candidates, "l_orderkey", [F.col("dir_rank"), F.col("ext_rank"), F.col("l_linenumber")],
        ["l_partkey", "l_suppkey"])


def output_match(spark, sf):
    """Best candidate per sample; samples without one stay with nulls."""
    return _matched(spark, sf).select("l_orderkey", "l_partkey", "l_suppkey", "has_output")


def missing_outputs(spark, sf):
    samples = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return mt.missing_outputs(samples, _candidates(spark, sf), "l_orderkey")


def coverage(spark, sf):
    """Totals, missing outputs and coverage, overall and per dimension of all samples."""
    return summarise(
        _matched(spark, sf),
        {"priority": F.col("o_orderpriority"), "status": or_unknown(F.col("o_orderstatus"))},
        coverage_measures(F.col("has_output"), F.lit(None).cast("string")))


def score_lookup(spark, sf):
    """Scores by sample id: one lookup per sample and the source/output pair of each."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    scores = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    sides = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.when(F.col("l_linestatus") == "F", "source").otherwise("output").alias("side"),
        F.col("l_extendedprice").alias("price"))
    pairs = mt.side_pairs(sides, "o_orderkey", "side", ["price"])
    return (
        spread_lookup(orders, scores, "o_custkey", "o_orderkey")
        .join(pairs, "o_orderkey", "left")
        .select("o_orderkey", "c_acctbal", "source_price", "output_price",
                F.round(gain(F.col("output_price"), F.col("source_price")), 4).alias("gain"))
    )


def multi_dim_summary(spark, sf):
    """Three-valued target and plain preservation over three dimensions in one pass."""
    target = F.when(F.col("l_tax") != 0, F.col("l_discount") >= 0.05)
    preserved = F.col("l_quantity") <= 25
    rows = table(spark, sf, "lineitem")
    dims = {"returnflag": F.col("l_returnflag"), "linestatus": F.col("l_linestatus"),
            "linenumber": F.col("l_linenumber"),
            "flag_status": F.concat_ws("/", "l_returnflag", "l_linestatus")}
    return summarise(rows, dims, {
        "target_success_rate": rate(target),
        "content_preservation_pass_rate": rate(preserved),
        "joint_success_rate": rate(F.when(target.isNotNull(), target & preserved)),
        "avg_quantity": mean(F.col("l_quantity")),
        "avg_discount_returned": mean(F.col("l_discount"), F.col("l_returnflag") == "R"),
    })


# --- embeddings ----------------------------------------------------------------------------------------------

PAIRS = """
SELECT vec_id AS sample_id, concat('v', CAST(vec_id AS STRING)) AS output_path,
  CASE WHEN vec_id % 2 = 0 THEN concat('v', CAST(vec_id + 1 AS STRING))
       ELSE concat('v', CAST(label AS STRING)) END AS reference_path
FROM {embeddings}
"""


def speaker_similarity(spark, sf):
    """Half of the outputs are compared with one of ten shared references, the others with their neighbour."""
    recordings = table(spark, sf, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("path"), "embedding")
    scored = pair_similarity(spark_table(spark, sf, PAIRS), recordings, "sample_id", "output_path", "reference_path",
                             "speaker_similarity")
    similarity = F.col("speaker_similarity")
    return scored.select("sample_id", "speaker_similarity", speaker_target(similarity).alias("target_success"),
                         speaker_preserved(similarity).alias("speaker_preserved"))


def embedding_requests(spark, sf):
    """Distinct recordings that have to be embedded for the pairs."""
    return needed_paths(spark_table(spark, sf, PAIRS), "output_path", "reference_path")


# --- names and paths -----------------------------------------------------------------------------------------

PATHS = """
SELECT page_id,
  CASE page_id % 8 WHEN 0 THEN 'acoustic_editing' WHEN 1 THEN 'content_editing' WHEN 2 THEN 'compositional_editing'
    WHEN 3 THEN 'emotion_editing' WHEN 4 THEN 'paralinguistic_editing' WHEN 5 THEN 'prosody_editing'
    WHEN 6 THEN 'speaker_editing' ELSE 'style_editing' END AS task,
  concat(CASE length(html) % 4 WHEN 0 THEN 'outputs/model_output/' WHEN 1 THEN 'test_model/' WHEN 2 THEN 'results/'
         ELSE 'model_output/' END, split_part(url, '/', 3),
         CASE length(html) % 5 WHEN 0 THEN '/source_copy' WHEN 1 THEN '/Reference_Copy' ELSE '' END) AS output_path,
  CASE length(html) % 7 WHEN 0 THEN 'cache/smoke_samples.jsonl' WHEN 1 THEN '/data/all/samples.jsonl'
    WHEN 2 THEN 'data_v2_13/x/My Set.v2.jsonl' WHEN 3 THEN 'data/prosody_editing/samples.jsonl'
    WHEN 4 THEN 'data/speaker_editing/samples.jsonl' WHEN 5 THEN 'data_vX/samples.jsonl' END AS samples_path,
  length(html) AS frames, page_id % 3 * 8000 AS sample_rate, url
FROM {pages}
"""


def names_and_paths(spark, sf):
    p = spark_table(spark, sf, PATHS)
    return p.select(
        "page_id",
        nm.slug(F.col("url")).alias("slug"),
        nm.model_name(F.col("output_path")).alias("model_name"),
        nm.dataset_version(F.col("samples_path")).alias("dataset_version"),
        nm.eval_set(F.col("task"), F.col("output_path"), F.col("samples_path")).alias("eval_set"),
        round4(duration_seconds(F.col("frames"), F.col("sample_rate"))).alias("seconds"),
    )


def slugs(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", nm.slug(F.col("c_name")).alias("slug"))


# pages as sample rows with relative paths; some exist beside the samples, some at the root, some nowhere
RELATIVE = """
SELECT page_id, CASE WHEN page_id % 11 = 0 THEN concat('/abs/', CAST(page_id AS STRING))
    WHEN page_id % 13 = 0 THEN '' ELSE concat('audio/', CAST(page_id AS STRING), '.wav') END AS path,
  length(html) AS n FROM {pages}
"""
EXISTING = """
SELECT concat('repo/samples/audio/', CAST(page_id AS STRING), '.wav') AS path FROM {pages} WHERE url LIKE 'https:%'
UNION ALL SELECT concat('repo/audio/', CAST(page_id AS STRING), '.wav') FROM {pages} WHERE length(html) > 2500
"""


def resolve_paths(spark, sf):
    rows = spark_table(spark, sf, RELATIVE)
    existing = spark_table(spark, sf, EXISTING)
    return mt.resolve_paths(rows, "page_id", "path", existing, ["repo/samples", "repo"], "repo").select(
        "page_id", "resolved")


def audit_paths(spark, sf):
    """The audit's order of bases: root, samples folder, its parent."""
    rows = spark_table(spark, sf, RELATIVE)
    existing = spark_table(spark, sf, EXISTING)
    return mt.resolve_paths(rows, "page_id", "path", existing, ["repo", "repo/samples", "repo/other"], "repo").select(
        "page_id", "resolved")


LISTING = """
SELECT concat('file:/out/m1/', CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN 'audio/' ELSE 'old/' END, 'a.',
    CAST(l_orderkey AS STRING), '.', CASE l_returnflag WHEN 'R' THEN 'wav' WHEN 'A' THEN 'FLAC' ELSE 'txt' END) AS path,
  l_suppkey AS length, l_partkey AS modified
FROM {lineitem}
"""
_USABLE_FILES = f"SELECT * FROM ({duck(CANDIDATE_FILES)}) WHERE dir_rank IS NOT NULL AND ext_rank IS NOT NULL"


def output_listing(spark, sf):
    """Candidate outputs of a listing: stem, folder rank and extension rank."""
    return with_output_ranks(spark_table(spark, sf, LISTING), "/out/m1").groupBy("dir_rank", "ext_rank").agg(
        F.count(F.lit(1)).alias("files"), F.countDistinct("sample_id").alias("samples"),
        F.sum("length").alias("bytes"))


# the candidate outputs, files of another kind, hidden ones, and some in a folder that does not count
TREE = f"""
SELECT substr(path, 5) AS place, length(sample_id) AS size FROM ({CANDIDATES}) t
UNION ALL SELECT concat('deeper/still/', sample_id, '.wav'), 1 FROM ({TURNS}) t
UNION ALL SELECT concat('audio/', sample_id, '.txt'), 2 FROM ({TURNS}) t
UNION ALL SELECT concat('audio/_', sample_id, '.wav'), 3 FROM ({TURNS}) t
"""


def _write_files(root: str):
    """Tasks write the files of a tree; a file that a lost task wrote is written again."""
    def run(batches):
        for batch in batches:
            for place, size in zip(batch["place"], batch["size"]):
                path = f"{root}/{place}"
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as out:
                    out.write(bytes(size))
            yield batch
    return run


def written_outputs(spark, sf):
    """Files of a written tree, listed by tasks: the candidates with their ranks, and which of them is the output."""
    root = local_folder(scratch_folder(spark, "outputs +1"))
    tree = spark_table(spark, sf, TREE).select("place", F.col("size").cast("bigint").alias("size"))
    tree.mapInPandas(_write_files(root), tree.schema).write.format("noop").mode("overwrite").save()
    listed = list_outputs(spark, root)
    best = mt.best_outputs(listed, "sample_id", [F.col("dir_rank"), F.col("ext_rank")], ["path"]).select(
        "path", F.lit(True).alias("chosen"))
    return listed.join(best, "path", "left").select(
        "sample_id", below(F.col("path"), root).alias("place"), F.col("dir_rank").cast("bigint").alias("dir_rank"),
        F.col("ext_rank").cast("bigint").alias("ext_rank"), F.col("length").cast("bigint").alias("length"),
        F.coalesce("chosen", F.lit(False)).alias("chosen"))


def score_alignment(spark, sf):
    """Scores keyed by sample, with the one-row-per-key check that replaces positional pairing."""
    scores = mt.require_one_row_per(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    return scores.select("c_custkey", "c_acctbal")


_TARGET = "CASE WHEN l_tax <> 0 THEN l_discount >= 0.05 END"
_BEST = f"""best AS (SELECT l_orderkey, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (
    PARTITION BY l_orderkey ORDER BY dir_rank, ext_rank, l_linenumber, l_partkey, l_suppkey) AS rn
    FROM ({_USABLE_FILES})) WHERE rn = 1),
matched AS (SELECT o.*, b.l_partkey, b.l_suppkey, b.l_orderkey IS NOT NULL AS has_output, NULL::VARCHAR AS error
    FROM orders o LEFT JOIN best b ON b.l_orderkey = o.o_orderkey)"""


def _slug_sql(value: str) -> str:
    return (f"coalesce(nullif(trim(regexp_replace(lower(trim({value})), '[^a-z0-9]+', '_', 'g'), '_'), ''),"
            " 'default')")


_PARTS = "list_filter(string_split(output_path, '/'), lambda x: x <> '')"


def _resolve_sql(first: str, second: str) -> str:
    return f"""WITH r AS ({duck(RELATIVE)}), e AS (SELECT DISTINCT path FROM ({duck(EXISTING)}))
SELECT page_id, CASE WHEN r.path LIKE '/%' THEN r.path WHEN r.path = '' THEN NULL
    WHEN '{first}/' || r.path IN (SELECT path FROM e) THEN '{first}/' || r.path
    WHEN '{second}/' || r.path IN (SELECT path FROM e) THEN '{second}/' || r.path
    ELSE 'repo/' || r.path END AS resolved FROM r"""


QUERIES = {
    "output_match": output_match,
    "missing_outputs": missing_outputs,
    "coverage": coverage,
    "score_lookup": score_lookup,
    "score_alignment": score_alignment,
    "multi_dim_summary": multi_dim_summary,
    "speaker_similarity": speaker_similarity,
    "embedding_requests": embedding_requests,
    "names_and_paths": names_and_paths,
    "slugs": slugs,
    "resolve_paths": resolve_paths,
    "audit_paths": audit_paths,
    "output_listing": output_listing,
    "written_outputs": written_outputs,
}

ORACLES = {
    "output_match": f"WITH {_BEST} SELECT o_orderkey AS l_orderkey, l_partkey, l_suppkey, has_output FROM matched",
    "missing_outputs": f"""SELECT o_orderkey AS l_orderkey, o_orderpriority FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM ({_USABLE_FILES}))""",
    "coverage": f"WITH {_BEST} " + dt.summary(
        "matched", {"priority": "o_orderpriority", "status": "o_orderstatus"}, dt.COVERAGE),
    "score_lookup": f"""WITH p AS (SELECT l_orderkey, max(l_extendedprice) FILTER (WHERE l_linestatus = 'F') AS s,
    max(l_extendedprice) FILTER (WHERE l_linestatus <> 'F') AS o FROM lineitem GROUP BY 1)
SELECT o_orderkey, c_acctbal, s AS source_price, o AS output_price, {dt.r4('o - s')} AS gain
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN p ON l_orderkey = o_orderkey""",
    "score_alignment": "SELECT c_custkey, c_acctbal FROM customer",
    "multi_dim_summary": f"""WITH d AS (SELECT *, {_TARGET} AS t, l_quantity <= 25 AS p,
    CASE WHEN l_tax <> 0 THEN l_discount >= 0.05 AND l_quantity <= 25 END AS j FROM lineitem) """ + dt.summary(
        "d", {"returnflag": "l_returnflag", "linestatus": "l_linestatus", "linenumber": "l_linenumber",
              "flag_status": "l_returnflag || '/' || l_linestatus"}, {
            "target_success_rate": dt.rate("t"), "content_preservation_pass_rate": dt.rate("p"),
            "joint_success_rate": dt.rate("j"), "avg_quantity": dt.mean("l_quantity"),
            "avg_discount_returned": dt.mean("l_discount", "l_returnflag = 'R'")}),
    "speaker_similarity": f"""WITH p AS ({duck(PAIRS)}),
v AS (SELECT 'v' || vec_id::VARCHAR AS path, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT sample_id, {dt.r4("list_dot_product(a.e, b.e)"
    " / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))")} AS c
  FROM p LEFT JOIN v a ON a.path = p.output_path LEFT JOIN v b ON b.path = p.reference_path)
SELECT sample_id, c AS speaker_similarity, c >= 0.5 AS target_success, c >= 0.75 AS speaker_preserved FROM s""",
    "embedding_requests": f"""SELECT output_path AS path FROM ({duck(PAIRS)})
UNION SELECT reference_path FROM ({duck(PAIRS)})""",
    "names_and_paths": f"""WITH p AS (SELECT *, {_PARTS} AS parts,
    list_transform({_PARTS}, lambda x: lower(x)) AS low,
    lower(regexp_replace(coalesce(list_extract(string_split(samples_path, '/'), -1), ''), '(.)\\.[^.]*$', '\\1')) AS stem
  FROM ({duck(PATHS)})),
q AS (SELECT *, (starts_with(stem, 'smoke') OR list_contains(low, 'test_model')) AS smoke FROM p)
SELECT page_id, {_slug_sql('url')} AS slug,
  {_slug_sql("CASE WHEN list_position(parts, 'model_output') < len(parts) THEN parts[list_position(parts, 'model_output') + 1] ELSE parts[-1] END")}
    AS model_name,
  CASE WHEN samples_path IS NULL THEN 'unknown' WHEN samples_path LIKE '/%' THEN 'custom'
    WHEN samples_path LIKE 'data/%' THEN 'v1.1' WHEN regexp_full_match(split_part(samples_path, '/', 1),
      'data_v\\d+_\\d+') THEN replace(replace(split_part(samples_path, '/', 1), 'data_', 'v'), '_', '.')
    ELSE 'custom' END AS dataset_version,
  CASE WHEN smoke AND task = 'content_editing' THEN 'smoke_source_copy'
    WHEN smoke AND task IN ('speaker_editing', 'prosody_editing', 'acoustic_editing', 'compositional_editing')
      AND list_contains(low, 'source_copy') THEN 'smoke_source_copy'
    WHEN smoke AND task = 'speaker_editing' AND list_contains(low, 'reference_copy') THEN 'smoke_reference_copy'
    WHEN smoke THEN 'smoke_copy'
    WHEN samples_path = 'data/' || task || '/samples.jsonl' THEN 'full'
    WHEN stem <> '' THEN {_slug_sql('stem')} ELSE 'default' END AS eval_set,
  CASE WHEN sample_rate <> 0 THEN {dt.r4('frames::DOUBLE / sample_rate')} END AS seconds FROM q""",
    "slugs": f"SELECT c_custkey, {_slug_sql('c_name')} AS slug FROM customer",
    "resolve_paths": _resolve_sql("repo/samples", "repo"),
    "audit_paths": _resolve_sql("repo", "repo/samples"),
    "output_listing": f"""WITH l AS (SELECT *, regexp_extract(path, '^file:/out/m1/(.*)$', 1) AS rel FROM ({duck(LISTING)})),
r AS (SELECT *, CASE WHEN rel NOT LIKE '%/%' THEN 0 WHEN regexp_full_match(rel, 'audio/[^/]+') THEN 1 END AS dir_rank,
    CASE lower(regexp_extract(rel, '\\.([^.]*)$', 1)) WHEN 'wav' THEN 0 WHEN 'flac' THEN 1 WHEN 'mp3' THEN 2 END AS ext_rank,
    regexp_replace(regexp_extract(rel, '([^/]*)$', 1), '\\.[^.]*$', '') AS sample_id FROM l)
SELECT dir_rank, ext_rank, count(*) AS files, count(DISTINCT sample_id) AS samples, sum(length)::BIGINT AS bytes
FROM r WHERE dir_rank IS NOT NULL AND ext_rank IS NOT NULL GROUP BY ALL""",
    "written_outputs": f"""SELECT sample_id, substr(path, 5) AS place, dir_rank, ext_rank, length(sample_id) AS length,
    row_number() OVER (PARTITION BY sample_id ORDER BY dir_rank, ext_rank) = 1 AS chosen FROM ({duck(CANDIDATES)})""",
}
