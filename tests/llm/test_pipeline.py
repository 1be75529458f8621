import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_exact_dedup import brute as exact_brute
from test_near_dedup import all_pairs
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from voxgauge.llm.language_id import has_letter
from voxgauge.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def survivors(rows):
    """Ids that the filtering stages keep, from brute force."""
    rows = [(i, t) for i, t in rows if has_letter(t)]
    kept = {r[0] for r in exact_brute(rows) if r[3]}
    rows = [(i, t) for i, t in rows if i in kept]
    groups = all_pairs(rows)
    return [i for i, _ in rows if groups.get(i, i) == i]


def test_run_against_brute_force(spark, docs, doc_rows):
    rows = corpus_pipeline.run(spark, SF).collect()
    want = survivors(list(doc_rows.items()))
    assert {r["doc_id"] for r in rows} == set(want) and 0 < len(want) < len(doc_rows)
    masked = corpus_pipeline.mask_secrets(spark, docs.filter(F.col("doc_id").isin(want)), SF)
    assert masked.columns == docs.columns
    texts = {r["doc_id"]: r for r in masked.collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values())
    pieces = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        pieces.setdefault(r["doc_id"], []).append(bytes(r["ids"]))
    for i, parts in pieces.items():
        ids = np.frombuffer(b"".join(parts), "<u4").tolist()
        assert ids == [*LIBRARY.encode(texts[i]["text"], add_special_tokens=False).ids, 0]


def test_masking_changes_secrets_alone(spark, docs, doc_rows):
    from test_secret_scan import base

    for r in corpus_pipeline.mask_secrets(spark, docs, SF).collect():
        text = doc_rows[r["doc_id"]]
        assert base(r["text"]) == ""
        if not base(text):
            assert r["text"] == text or "[SECRET]" in r["text"]


def test_stages_on_odd_and_empty_tables(spark, odd, none, docs):
    for table in (odd, none, docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == table.columns and [t for _, t in out.dtypes] == [t for _, t in table.dtypes]
            assert out.count() <= table.count()
        corpus_pipeline.STAGES[-1][1](spark, table, SF).count()


def test_labels_missing_altogether(spark, docs):
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.keep_languages(spark, unlabelled, SF).count() == docs.count()


def test_registered_queries():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert {*QUERIES, "pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_oracles(spark):
    """Queries that SQL can express, against DuckDB."""
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, SF)
        result = con.execute(sql)
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        want = sorted(result.fetchall(), key=repr)
        assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


def test_near_copies_are_linked_by_fingerprints_too(spark):
    """Three scattered edits leave less than 0.8 of the different five-word shingles, but nearly the whole fingerprint, as the
    texts have a line that comes again and again."""
    from test_near_dedup import brute

    rows = []
    for n in range(12):
        line, words = [f"l{n}x{i}" for i in range(11)] * 12, [f"w{n}x{i}" for i in range(60)]
        rows.append((2 * n, " ".join(line + words)))
        words[10], words[30], words[50] = "some", "other", "words"
        rows.append((2 * n + 1, " ".join(line + words)))
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, table, SF).collect()}
    copies = {i for i, _, c in brute(rows) if i != c}
    assert not all_pairs(rows) and copies and left == {i for i, _ in rows} - copies


def test_written_tables_leave_no_shuffle_files(spark, docs):
    """Small tables in many partitions: their shuffle files would fill a disk before the driver collects its garbage."""
    import time

    from voxgauge.llm.shared import kept_table

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    ids = lambda: {str(f) for f in str(disk.getAllFiles().mkString("\n")).split("\n") if "shuffle_" in f}
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, files = spark.conf.get(setting), ids()
    table = kept_table(docs.repartition(7, "doc_id").groupBy("lang").agg(F.count("*").alias("n")), "counts")
    until = time.time() + 20
    while ids() - files and time.time() < until:
        time.sleep(0.2)
    assert not ids() - files and spark.conf.get(setting) == before
    assert sum(r["n"] for r in table.collect()) == docs.count()
