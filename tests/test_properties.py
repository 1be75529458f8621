"""Invariants: an output that copies its source changes nothing."""

from pyspark.sql import functions as F

from voxgauge.functions import acoustic as ac
from voxgauge.functions import prosody as pr
from voxgauge.functions import text as tx
from voxgauge.functions.numeric import cosine, gain, norm
from voxgauge.operators import stress as st
from voxgauge.session import table
from voxgauge.workload import signal_queries as sq

SF = "/root/testdata/sf0.001"


def test_source_copy_keeps_the_text(spark):
    turns = table(spark, SF, "conversations").withColumn("language", F.when(F.col("turn") % 2 == 0, "en").otherwise("zh"))
    copied = tx.with_preservation(turns, "text", "text")
    assert copied.where("wer <> 0 or cer <> 0 or not content_preservation_pass").count() == 0


def test_source_copy_scores(spark):
    e = table(spark, SF, "embeddings").select(
        cosine(F.col("embedding"), F.col("embedding"), norm(F.col("embedding")), norm(F.col("embedding"))).alias("c"))
    assert e.where(F.abs(F.col("c") - 1) > 1e-9).count() == 0
    one = spark.range(1).select(
        pr.speed_verdict(F.lit(2.0), F.lit(2.0), F.lit("faster"))["passed"].alias("speed"),
        pr.pitch_verdict(F.lit(200.0), F.lit(200.0), F.lit("higher"))["passed"].alias("pitch"),
        ac.enhancement_verdict(gain(F.lit(3.0), F.lit(3.0)), gain(F.lit(2.0), F.lit(2.0))).alias("enhanced")).first()
    assert tuple(one) == (False, False, False)


def test_source_copy_has_no_prominence_gain(spark):
    tokens = sq._tokens(spark, SF).where("side = 'source'")
    both = tokens.union(tokens.withColumn("side", F.lit("output")))  # same path, same frames
    targets = sq._targets(spark, SF)
    frames = sq._frames(tokens)
    verdicts = st.stress_verdicts(both, targets, frames)
    assert verdicts.where("input_found <> output_found").count() == 0
    assert verdicts.where("passed or coalesce(prominence_delta, 0) <> 0").count() == 0
