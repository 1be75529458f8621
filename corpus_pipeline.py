"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxgauge.llm import exact_dedup, language_id, near_dedup, packing, secret_scan
from voxgauge.llm.shared import documents, free_name, kept_table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
SHINGLE, SIMILARITY = 5, 0.8


def _only(docs: DataFrame, decisions: DataFrame, kept: Column) -> DataFrame:
    """Rows of ``docs`` whose id has a kept decision, with the columns of ``docs``."""
    name = free_name(docs, "kept_id")
    ids = decisions.filter(kept).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids[name]), "left_semi")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null texts and texts without a letter.

    The model learns from the labels of these documents; without any label nothing is judged and all documents stay.
    """
    model = language_id.train(docs)
    if not model.languages:
        return docs
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    return language_id.identify(docs, model, pred=pred, score=score).filter(
        F.col(pred) != language_id.UNKNOWN).drop(pred, score)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the largest id of equal texts (A-Z and a-z count as equal)."""
    return _only(docs, exact_dedup.exact_dedup(docs), F.col("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest id of each group of near copies.

    Near copies are what SimHash fingerprints link (``near_dedup``), and what fingerprints miss: texts that share at least 0.8
    of their five-word shingles; all such pairs are found. Rows without an id stay.
    """
    prints = near_dedup.near_dedup(docs).filter("doc_id <> component_id")
    linked = kept_table(prints.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).distinct(), "linked")
    groups = near_dedup.similar_groups(docs, shingle=SHINGLE, similarity=SIMILARITY, known=linked)
    copies = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(free_name(docs, "copy_id")))
    return docs.join(copies, docs["doc_id"] == copies[copies.columns[0]], "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mask in place of every secret; all documents stay, ``n_chars`` follows the new text."""
    masked = secret_scan.mask_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids, sequence and place in it."""
    return packing.pack_documents(docs, TOKENIZER, END_ID, with_ids=True)


#: Each function takes (spark, docs, sf_dir); its result is written and read again as the docs of the next. All but the
#: last return the columns of the documents. Every stage accepts nulls in any column, empty and very long texts, repeated
#: rows and empty tables; extra columns travel along.
STAGES = [
    ("language ID", keep_languages),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("secret scan", mask_secrets),
    ("best-fit packing", pack),
]

#: Language models, fingerprints, randomness tests and tokenizers are not SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; between stages the table is written to the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = kept_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
