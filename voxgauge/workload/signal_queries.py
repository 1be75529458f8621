"""Signals, segments, scenes, tokens and stress windows on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxgauge import fixed_values as fv
from voxgauge.functions import acoustic as ac
from voxgauge.functions import labels as lb
from voxgauge.functions import timing as tm
from voxgauge.functions.text import words
from voxgauge.operators import signal as sg
from voxgauge.operators import stress as st
from voxgauge.session import spread, stage, table
from voxgauge.workload import duck_text as dt
from voxgauge.workload.standins import TURNS, duck, spark_table

IMPULSE_RATE = 400  # 64 values play an impulse response of 0.16 s


def _impulses(spark, sf):
    return sg.explode_signal(table(spark, sf, "embeddings"), ["vec_id"], "embedding")


def _sources_and_outputs(spark, sf):
    """Array signals side by side; every third output copies its source."""
    source = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select(
        "vec_id", source.alias("source"),
        F.when(F.col("vec_id") % 3 == 0, source).otherwise(F.transform(source, lambda x: x * 0.9)).alias("output"))


def decay_time(spark, sf):
    """Decay time of every impulse response and its verdict against a range that depends on the label.

    Every third output is a copy of its source and has the shortest decay time.
    """
    responses = _sources_and_outputs(spark, sf)
    same = sg.is_unchanged(sg.mean_square_difference(F.col("source"), F.col("output")))
    times = sg.impulse_decay(responses, "vec_id", "source", IMPULSE_RATE, same)
    targets = table(spark, sf, "embeddings").select(
        "vec_id", F.array(F.lit(0.02) * F.col("label"), F.lit(0.05) * F.col("label")).alias("target"))
    return times.join(targets, "vec_id").select(
        "vec_id", "tail_samples", F.round("decay_seconds", 4).alias("decay_seconds"), "error",
        ac.reverb_verdict(F.col("decay_seconds"), F.col("target")).alias("target_success"))


def backward_energy(spark, sf):
    """Energy from each position to the end, per impulse response."""
    energy = sg.backward_sum(_impulses(spark, sf).withColumn("e", F.col("x") * F.col("x")), "vec_id", "idx", "e",
                             "energy", block=10)
    return energy.select("vec_id", F.col("idx").cast("bigint").alias("idx"), F.round("energy", 4).alias("energy"))


def unchanged_outputs(spark, sf):
    """Sources against outputs: every third output copies its source."""
    compared = _sources_and_outputs(spark, sf).withColumn(
        "mean_square", sg.mean_square_difference(F.col("source"), F.col("output")))
    return compared.select("vec_id", F.round("mean_square", 4).alias("mean_square"),
                           sg.is_unchanged(F.col("mean_square")).alias("unchanged"))


# all event values in order of their id form one signal
EVENT_SIGNAL = "SELECT 'events' AS clip, event_id AS idx, value AS x FROM {events}"


def framed_rms(spark, sf):
    """Frames of one long signal with the standard frame length and hop."""
    return sg.framed_rms(spark_table(spark, sf, EVENT_SIGNAL), "clip").select(
        F.col("frame").cast("bigint").alias("frame"), F.round("t", 4).alias("t"), F.round("rms", 4).alias("rms"))


def framed_rms_short(spark, sf):
    """Short clips, odd hop: frames reach over both ends."""
    return sg.framed_rms(_impulses(spark, sf), "vec_id", frame=24, hop=10, sample_rate=100).select(
        "vec_id", F.col("frame").cast("bigint").alias("frame"), F.round("t", 4).alias("t"),
        F.round("rms", 4).alias("rms"))


# events as frames of clips (a thousand successive events, by type); one third of the pitch values is unvoiced
TRACKS = """
SELECT concat(event_type, '-', CAST(event_id - event_id % 1000 AS STRING)) AS path, event_id, value AS rms,
  CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE value + 50 END AS f0
FROM {events}
"""


def track_statistics(spark, sf):
    """Mean energy, median pitch and voiced share per clip; a clip has a thousand frames at most, however long the table."""
    return sg.clip_statistics(spark_table(spark, sf, TRACKS), ["path"]).select(
        "path", "frames", F.round("mean_rms", 6).alias("mean_rms"), F.round("median_f0", 4).alias("median_f0"),
        F.round("voiced_ratio", 4).alias("voiced_ratio"))


CLIPS = "SELECT doc_id, n_chars * 160 AS samples FROM {documents}"


def segment_plan(spark, sf):
    """Scored windows of clips of 0.01 s to some minutes."""
    return sg.segment_plan(spark_table(spark, sf, CLIPS), "samples").select(
        "doc_id", F.col("segment").cast("bigint").alias("segment"), "start", "end")


def segment_scores(spark, sf):
    """Calibrated means per clip over its planned windows; clips without a window carry an error."""
    clips = spark_table(spark, sf, CLIPS)
    plan = sg.segment_plan(clips, "samples")
    raw = plan.select(
        "doc_id",
        ((F.col("doc_id") + F.col("segment")) % 40 / 10).alias("sig_raw"),
        ((F.col("doc_id") + F.col("segment") * 3) % 30 / 8).alias("bak_raw"),
        ((F.col("doc_id") * 7 + F.col("segment")) % 50 / 16).alias("ovr_raw"),
        (F.col("segment") % 5 / 4).alias("p808"))
    return sg.with_segment_errors(clips.select("doc_id"), sg.segment_means(raw, "doc_id"), "doc_id")


GROUPED_SCENES = [x for labels in fv.SCENE_LABELS.values() for x in labels]
#: A label for each of the 64 values; those after the scene labels belong to no group.
SCENE_NAMES = GROUPED_SCENES + [f"Other {i}" for i in range(64 - len(GROUPED_SCENES))]


def _scenes():
    """All embedding values as label scores: the scene labels, then labels outside every group."""
    return F.map_from_arrays(
        F.array(*[F.lit(x) for x in SCENE_NAMES]), F.transform("embedding", lambda x: x.cast("double")))


def scene_groups(spark, sf):
    """Group scores, predicted scene and verdict; the source is the same vector turned around."""
    rows = table(spark, sf, "embeddings").select(
        "vec_id", _scenes().alias("scenes"),
        F.element_at(F.array(*[F.lit(g) for g in fv.SCENE_LABELS]), (F.col("label") % 3 + 1).cast("int")).alias(
            "target"),
        F.get("embedding", 63).cast("double").alias("source_score"))
    groups = ac.scene_group_scores(F.col("scenes"))
    scored = rows.select(
        "vec_id", "target", "source_score", lb.argmax_label(groups).alias("predicted"),
        *[score.alias(g) for g, score in groups.items()])
    of_target = F.coalesce(*[F.when(F.col("target") == g, F.col(g)) for g in groups])
    return scored.select(
        "vec_id", "predicted", *[F.round(g, 4).alias(g) for g in groups],
        ac.scene_verdict(F.col("predicted"), F.col("target"), of_target, F.col("source_score")).alias(
            "target_success"))


def scene_topk(spark, sf):
    """Five best labels per recording."""
    rows = table(spark, sf, "embeddings").select("vec_id", ac.top_scene_labels(_scenes()).alias("top"))
    return rows.select("vec_id", F.posexplode("top").alias("position", "t")).select(
        "vec_id", F.col("position").cast("bigint").alias("position"), "t.label", "t.score")


# --- timestamped tokens -----------------------------------------------------------------------------------------

def _word_chunks(spark, sf):
    """Turns as word chunks: seconds up to 100, milliseconds above, some spans empty or reversed."""
    turns = spark_table(spark, sf, TURNS)
    spoken = F.filter(F.split("text", " "), lambda w: w != "")
    chunk = F.transform(spoken, lambda w, i: F.struct(
        F.concat(F.lit(" "), w).alias("text"),
        F.when(i % 11 == 10, F.array(i * 0.5)).otherwise(F.array(
            F.when(i % 5 == 4, i * 500.0).otherwise(i * 0.5),
            F.when(i % 7 == 6, i * 0.5).when(i % 5 == 4, i * 500.0 + 400.0).otherwise(i * 0.5 + 0.4)))
        .alias("timestamp")))
    return turns.select("sample_id", chunk.alias("chunks"))


def word_tokens(spark, sf):
    tokens = _word_chunks(spark, sf).select("sample_id", tm.parse_word_chunks(F.col("chunks")).alias("tokens"))
    return tokens.select("sample_id", F.posexplode_outer("tokens").alias("position", "t")).where(
        F.col("position").isNotNull()).select(
        "sample_id", F.col("position").cast("bigint").alias("position"), "t.text", "t.normalized", "t.start", "t.end")


#: Turns; in those of conversations with even numbers, letters become ideographs and blanks become wide ones.
WIDE_TURNS = f"""
SELECT sample_id, n, CASE WHEN conv_id % 2 = 0 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz ',
  '一二三四五六七八九十百千万人口日月山水火木金土天地上　') ELSE text END AS text
FROM ({TURNS}) t
"""


def character_tokens(spark, sf):
    """Blank-separated pieces when they match the spans, single characters otherwise.

    Every other text has ideographs and wide blanks. Texts of odd length have a span per character, two fewer to two more;
    some spans have three values.
    """
    turns = spark_table(spark, sf, WIDE_TURNS)
    n_words = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))
    n_spans = F.when(F.col("n") % 2 == 0, n_words).otherwise(
        F.greatest(F.lit(1), F.length(F.regexp_replace("text", r"(?U)\s+", "")) + F.col("n") % 5 - 2))
    spans = F.transform(F.sequence(F.lit(1), n_spans.cast("int")), lambda i: F.when(
        i % 13 == 0, F.array(i * 90.0, i * 90.0 + 60.0, F.lit(1.0))).otherwise(
        F.array(i * 90.0, i * 90.0 + F.when(i % 6 == 0, 0.0).otherwise(60.0))))
    return turns.where(F.length("text") > 0).select(
        "sample_id", F.posexplode_outer(tm.parse_spaced_text(F.col("text"), spans)).alias("position", "t")).where(
        F.col("position").isNotNull()).select(
        "sample_id", F.col("position").cast("bigint").alias("position"), "t.text", "t.normalized", "t.start", "t.end")


# --- stress ------------------------------------------------------------------------------------------------------
# The output of a turn is the same words spoken from the second one on (two in three turns) or the following turn.

#: Turns; the Chinese ones (the assistant's) have ideographs for letters.
STRESS_TURNS = f"""
SELECT conv_id, turn, role, n, sample_id, CASE WHEN role = 'assistant' THEN translate(text, 'abcdefghijklmnopqrstuvwxyz',
  '一二三四五六七八九十百千万人口日月山水火木金土天地上') ELSE text END AS text
FROM ({TURNS}) t
"""
SPOKEN = f"""
SELECT s.sample_id, 'source' AS side, s.text FROM ({STRESS_TURNS}) s
UNION ALL
SELECT s.sample_id, 'output', CASE WHEN s.n % 3 = 0 THEN o.text ELSE s.text END
FROM ({STRESS_TURNS}) s JOIN ({STRESS_TURNS}) o ON o.conv_id = s.conv_id AND o.turn = s.turn + 1
"""


def _tokens(spark, sf):
    """One token per word: 0.4 s each on the source side; on the output side longer words take longer."""
    spoken = spread(spark_table(spark, sf, SPOKEN), "sample_id").withColumn("w", words(F.col("text")))
    step = F.when(F.col("side") == "source", F.lit(0.4)).otherwise(F.lit(0.5))
    tokens = F.transform("w", lambda w, i: F.struct(
        w.alias("text"), F.regexp_replace(F.lower(w), "[^a-z0-9']+", "").alias("normalized"),
        (i * step).alias("start"), (i * step + 0.3).alias("end")))
    return spoken.select(
        "sample_id", "side", F.concat_ws("/", "side", "sample_id").alias("path"),
        (F.size("w") * step).alias("duration"), tokens.alias("tokens"))


def _targets(spark, sf):
    """Stress words of a sample, as far as it has them: its second word, its third with the fourth, a word nobody says."""
    listed = spread(spark_table(spark, sf, STRESS_TURNS), "sample_id").withColumn("w", words(F.col("text"))).withColumn("targets", F.array_compact(F.array(
        F.get("w", 1), F.when(F.size("w") >= 3, F.concat_ws(" ", F.get("w", 2), F.get("w", 3))),
        F.when(F.col("n") % 4 == 0, "xylophone"))))
    return listed.select(
        "sample_id", F.when(F.col("role") == "assistant", "zh").otherwise("en").alias("language"),
        F.posexplode("targets").alias("word_index", "word"))


def _frames(tokens):
    """Four frames per word; energy and pitch depend on the word, some frames are unvoiced."""
    word = tokens.select("path", "side", F.explode_outer("tokens").alias("k")).where(F.col("k").isNotNull())
    size = F.length(F.col("k.text"))
    return word.select(
        "path", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"), F.col("k.start").alias("s"), size.alias("size"),
        F.when(F.col("side") == "source", 1.0).otherwise(1.25).alias("boost"),
    ).select(
        "path", (F.col("s") + F.col("i") * 0.08 + 0.01).alias("t"),
        (F.col("size") * F.col("boost") / 16).alias("rms"),
        F.when((F.col("size") + F.col("i")) % 3 != 0, F.col("size") * 8.0 + F.col("i") + 100.0).alias("f0"))


def stress_windows(spark, sf):
    windows = st.word_windows(_tokens(spark, sf), _targets(spark, sf))
    return windows.select(
        "sample_id", "side", F.col("word_index").cast("bigint").alias("word_index"), "found",
        F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "matched_text")


def _verdicts(spark, sf):
    tokens = stage(_tokens(spark, sf), "tokens")
    return st.stress_verdicts(tokens, _targets(spark, sf), _frames(tokens))


def stress_words(spark, sf):
    return _verdicts(spark, sf).select(
        "sample_id", F.col("word_index").cast("bigint").alias("word_index"), "input_found", "output_found",
        "input_prominence", "output_prominence", "prominence_delta", "passed", "error")


def stress_rollup(spark, sf):
    return st.stress_rollup(_verdicts(spark, sf))


# --- checks ----------------------------------------------------------------------------------------------------

_X = "x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS idx FROM embeddings)"

_DECAY = f"""WITH {_X},
pk AS (SELECT vec_id, arg_min(idx, (-abs(x), idx)) AS peak FROM x GROUP BY 1),
tail AS (SELECT x.vec_id, idx - peak AS i, x FROM x JOIN pk USING (vec_id) WHERE idx >= peak),
en AS (SELECT vec_id, i, sum(x * x) OVER (PARTITION BY vec_id ORDER BY i DESC) AS e FROM tail),
db AS (SELECT vec_id, i / {IMPULSE_RATE}::DOUBLE AS t, 10 * log10(greatest(e, 1e-12) / max(e) OVER (PARTITION BY vec_id)) AS d
    FROM en),
f AS (SELECT vec_id, count(*) AS n, count(*) FILTER (WHERE d BETWEEN -25 AND -5) AS n1,
    regr_slope(d, t) FILTER (WHERE d BETWEEN -25 AND -5) AS s1,
    count(*) FILTER (WHERE d BETWEEN -15 AND -3) AS n2, regr_slope(d, t) FILTER (WHERE d BETWEEN -15 AND -3) AS s2
    FROM db GROUP BY 1),
g AS (SELECT *, CASE WHEN n1 >= 10 THEN s1 WHEN n2 >= 6 THEN s2 END AS s FROM f),
h AS (SELECT *, CASE WHEN vec_id % 3 = 0 THEN 0.03::DOUBLE WHEN n < 20 THEN NULL WHEN s IS NULL OR s >= -3 THEN 0.03::DOUBLE
    ELSE least(greatest(-60 / s, 0.03::DOUBLE), 4.0::DOUBLE) END AS sec FROM g)"""


def _frames_sql(source: str, key: str, frame: int, hop: int, rate: int) -> str:
    half = frame // 2
    return f"""len AS (SELECT {key}, max(idx) + 1 AS n FROM {source} GROUP BY 1),
fr AS (SELECT {key}, unnest(range(0, n // {hop} + 1)) AS frame FROM len)
SELECT {{cols}}frame, {dt.r4(f'frame * {hop} / {rate}::DOUBLE')} AS t,
    {dt.r4(f'sqrt(coalesce(sum(x * x), 0) / {frame}::DOUBLE)')} AS rms
FROM fr LEFT JOIN {source} s USING ({key}) WHERE s.idx >= frame * {hop} - {half} AND s.idx < frame * {hop} - {half} + {frame}
GROUP BY {key}, frame"""


def plan_sql(key: str) -> str:
    """CTEs from ``c(key, samples)`` to ``plan``: the scored windows of clips."""
    last = "least(trunc((segment::DOUBLE + 9.01::DOUBLE) * 16000)::BIGINT, n)"
    return f"""grown AS (SELECT {key}, samples, list_min(list_filter([(samples * (2::BIGINT ** k)::BIGINT) FOR k IN range(0, 24)],
    lambda v: v >= 144160)) AS n FROM c WHERE samples > 0),
hops AS (SELECT *, trunc(floor(n / 16000::DOUBLE) - 9.01::DOUBLE)::BIGINT + 1 AS h FROM grown),
seg AS (SELECT {key}, n, unnest(range(0, h)) AS segment FROM hops),
plan AS (SELECT {key}, segment, segment * 16000 AS start, {last} AS "end" FROM seg WHERE {last} - segment * 16000 >= 144160)"""


_PLAN = f"c AS ({duck(CLIPS)}),\n{plan_sql('doc_id')}"


def _calibrated(name: str, raw: str) -> str:
    a, b, c = fv.CALIBRATION[name]
    return f"(({a}::DOUBLE * ({raw}) + {b}::DOUBLE) * ({raw}) + {c}::DOUBLE)"


def _scene_max(labels) -> str:
    return "greatest(" + ", ".join(f"embedding[{SCENE_NAMES.index(x) + 1}]::DOUBLE" for x in labels) + ")"


_CHUNKS = f"""w AS (SELECT sample_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM (
    SELECT sample_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM ({duck(TURNS)}))),
c AS (SELECT sample_id, i, regexp_replace(word, '^\\s+|\\s+$', '', 'g') AS text,
    regexp_replace(lower(word), '[^a-z0-9'']+', '', 'g') AS normalized,
    CASE WHEN i % 5 = 4 THEN i * 500.0::DOUBLE ELSE i * 0.5::DOUBLE END AS a,
    CASE WHEN i % 7 = 6 THEN i * 0.5::DOUBLE WHEN i % 5 = 4 THEN i * 500.0::DOUBLE + 400 ELSE i * 0.5::DOUBLE + 0.4::DOUBLE
    END AS b FROM w WHERE i % 11 <> 10),
t AS (SELECT *, CASE WHEN a > 100 THEN a / 1000 ELSE a END AS s, CASE WHEN b > 100 THEN b / 1000 ELSE b END AS e FROM c)"""

_CHARS = rf"""k AS (SELECT sample_id, n, list_filter(string_split(regexp_replace(text, '[\s　]+', ' ', 'g'), ' '),
    lambda x: x <> '') AS ws, regexp_replace(text, '[\s　]+', '', 'g') AS solid FROM ({duck(WIDE_TURNS)}) WHERE text <> ''),
j AS (SELECT *, CASE WHEN n % 2 = 0 THEN len(ws) ELSE greatest(1, length(solid) + n % 5 - 2) END AS spans FROM k),
p AS (SELECT sample_id, CASE WHEN len(ws) = spans THEN ws ELSE string_split(solid, '') END AS pieces, spans FROM j),
z AS (SELECT sample_id, unnest(pieces[1:spans]) AS text, unnest(range(1, least(len(pieces), spans) + 1)) AS i FROM p),
t AS (SELECT sample_id, text, i, regexp_replace(text, '[^\x{{4e00}}-\x{{9fff}}0-9a-zA-Z]', '', 'g') AS normalized,
    CASE WHEN i * 90 > 100 THEN i * 90 / 1000::DOUBLE ELSE i * 90::DOUBLE END AS s,
    CASE WHEN i * 90 + 60 > 100 THEN (i * 90 + 60) / 1000::DOUBLE ELSE i * 90 + 60::DOUBLE END AS e,
    i % 6 <> 0 AND i % 13 <> 0 AS open FROM z)"""

_STRESS = rf"""sp AS ({duck(SPOKEN)}),
sw AS (SELECT *, list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda x: x <> '') AS ws,
    CASE WHEN side = 'source' THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END AS step FROM sp),
tok AS (SELECT sample_id, side, step, len(ws) AS total, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS i FROM sw),
tk AS (SELECT *, regexp_replace(lower(text), '[^a-z0-9'']+', '', 'g') AS en,
    i * step AS s, i * step + 0.3::DOUBLE AS e FROM tok),
sides AS (SELECT sample_id, side, any_value(step) AS step, any_value(total) AS total, list(en ORDER BY i) AS en,
    list(text ORDER BY i) AS texts,
    list(CASE WHEN en <> '' THEN regexp_replace(en, '[^\x{{4e00}}-\x{{9fff}}0-9a-zA-Z]', '', 'g')
         ELSE regexp_replace(text, '[^\x{{4e00}}-\x{{9fff}}0-9a-zA-Z]', '', 'g') END ORDER BY i) AS zh
    FROM tk GROUP BY 1, 2),
tg AS (SELECT sample_id, language, unnest(ts) AS word, generate_subscripts(ts, 1) - 1 AS word_index FROM (
    SELECT sample_id, CASE WHEN role = 'assistant' THEN 'zh' ELSE 'en' END AS language,
      list_filter([ws[2], CASE WHEN len(ws) >= 3 THEN concat_ws(' ', ws[3], ws[4]) END,
        CASE WHEN n % 4 = 0 THEN 'xylophone' END], lambda x: x IS NOT NULL) AS ts
    FROM (SELECT *, list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda x: x <> '') AS ws
        FROM ({duck(STRESS_TURNS)})))),
pr AS (SELECT s.*, t.language, t.word_index, t.word,
    list_filter(string_split(regexp_replace(lower(t.word), '[^a-z0-9'']+', ' ', 'g'), ' '), lambda x: x <> '') AS tw,
    regexp_replace(t.word, '[^\x{{4e00}}-\x{{9fff}}0-9a-zA-Z]', '', 'g') AS tz FROM sides s JOIN tg t USING (sample_id)),
hit AS (SELECT *, CASE WHEN language = 'en' THEN
      CASE WHEN len(tw) > 0 THEN list_min([k FOR k IN range(1, len(en) - len(tw) + 2) IF en[k:k + len(tw) - 1] = tw]) END
    ELSE CASE WHEN tz <> '' AND contains(array_to_string(zh, ''), tz)
      THEN (SELECT min(k) FROM (SELECT unnest(range(1, len(zh) + 1)) AS k)
            WHERE length(array_to_string(zh[1:k], '')) >= strpos(array_to_string(zh, ''), tz)) END END AS first,
    FROM pr),
win AS (SELECT *, CASE WHEN language = 'en' THEN first + len(tw) - 1 ELSE
    (SELECT min(k) FROM (SELECT unnest(range(1, len(zh) + 1)) AS k)
     WHERE length(array_to_string(zh[1:k], '')) >= strpos(array_to_string(zh, ''), tz) + length(tz) - 1) END AS last
    FROM hit),
wd AS (SELECT sample_id, side, step, total, word_index, first IS NOT NULL AS found,
    CASE WHEN first IS NOT NULL THEN (first - 1) * step END AS start,
    CASE WHEN first IS NOT NULL THEN (last - 1) * step + 0.3::DOUBLE END AS "end",
    CASE WHEN first IS NOT NULL THEN CASE WHEN language = 'en' THEN array_to_string(texts[first:last], ' ')
      ELSE array_to_string([texts[k] FOR k IN range(first, last + 1) IF zh[k] <> ''], ' ') END END AS matched_text
    FROM win)"""

_PROMINENCE = f"""fr AS (SELECT sample_id, side, s + j * 0.08::DOUBLE + 0.01::DOUBLE AS t,
    length(text) * (CASE WHEN side = 'source' THEN 1 ELSE 1.25::DOUBLE END) / 16 AS rms,
    CASE WHEN (length(text) + j) % 3 <> 0 THEN length(text) * 8.0::DOUBLE + j + 100 END AS f0
    FROM tk CROSS JOIN (SELECT unnest(range(0, 4)) AS j)),
cl AS (SELECT sample_id, side, avg(rms) FILTER (WHERE rms > 0) AS cr, median(f0) FILTER (WHERE f0 > 0) AS cf
    FROM fr GROUP BY 1, 2),
wb AS (SELECT *, total * step AS dur, greatest(0, least(start, total * step)) AS ws,
    greatest(greatest(0, least(start, total * step)) + 0.02::DOUBLE, least("end", total * step)) AS we
    FROM wd WHERE found),
sg AS (SELECT b.sample_id, b.side, b.word_index, avg(rms) FILTER (WHERE rms > 0) AS sr,
    median(f0) FILTER (WHERE f0 > 0) AS sf FROM wb b JOIN fr f
    ON f.sample_id = b.sample_id AND f.side = b.side AND f.t BETWEEN b.ws AND b.we GROUP BY 1, 2, 3),
sc AS (SELECT b.sample_id, b.side, b.word_index,
    0.5::DOUBLE * ln(coalesce(sr, 1e-8) / (coalesce(cr, 1e-8) + 1e-8) + 1e-8)
    + 0.3::DOUBLE * CASE WHEN sf IS NOT NULL AND cf IS NOT NULL THEN log2((sf + 1e-8) / (cf + 1e-8)) ELSE 0 END
    + 0.2::DOUBLE * ln((we - ws) / greatest(dur, 1e-8) + 1e-8) AS score
    FROM wb b LEFT JOIN sg USING (sample_id, side, word_index) JOIN cl ON cl.sample_id = b.sample_id AND cl.side = b.side),
vd AS (SELECT d.sample_id, d.word_index, coalesce(bool_or(found) FILTER (WHERE side = 'source'), FALSE) AS input_found,
    coalesce(bool_or(found) FILTER (WHERE side = 'output'), FALSE) AS output_found,
    max(score) FILTER (WHERE side = 'source') AS a, max(score) FILTER (WHERE side = 'output') AS b
    FROM wd d LEFT JOIN sc USING (sample_id, side, word_index) GROUP BY 1, 2),
vw AS (SELECT *, input_found AND output_found AND coalesce(b - a > 0, FALSE) AS passed FROM vd)"""

QUERIES = {
    "decay_time": decay_time,
    "backward_energy": backward_energy,
    "unchanged_outputs": unchanged_outputs,
    "framed_rms": framed_rms,
    "framed_rms_short": framed_rms_short,
    "track_statistics": track_statistics,
    "segment_plan": segment_plan,
    "segment_scores": segment_scores,
    "scene_groups": scene_groups,
    "scene_topk": scene_topk,
    "word_tokens": word_tokens,
    "character_tokens": character_tokens,
    "stress_windows": stress_windows,
    "stress_words": stress_words,
    "stress_rollup": stress_rollup,
}

ORACLES = {
    "decay_time": f"""{_DECAY} SELECT vec_id, n AS tail_samples, {dt.r4('sec')} AS decay_seconds,
    CASE WHEN n < 20 AND vec_id % 3 <> 0 THEN 'impulse response too short for RT60 estimate' END AS error,
    sec BETWEEN 0.02::DOUBLE * label * 0.8::DOUBLE AND 0.05::DOUBLE * label * 1.2::DOUBLE AS target_success
    FROM h JOIN embeddings USING (vec_id)""",
    "backward_energy": f"""WITH {_X} SELECT vec_id, idx,
    {dt.r4('sum(x * x) OVER (PARTITION BY vec_id ORDER BY idx DESC)')} AS energy FROM x""",
    "unchanged_outputs": f"""WITH {_X} SELECT vec_id,
    {dt.r4('avg(CASE WHEN vec_id % 3 = 0 THEN 0 ELSE (x - x * 0.9::DOUBLE) ** 2 END)')} AS mean_square,
    avg(CASE WHEN vec_id % 3 = 0 THEN 0 ELSE (x - x * 0.9::DOUBLE) ** 2 END) <= 1e-8 AS unchanged FROM x GROUP BY 1""",
    "framed_rms": f"WITH e AS ({duck(EVENT_SIGNAL)}), " + _frames_sql("e", "clip", 1024, 256, 16000).format(cols=""),
    "framed_rms_short": f"WITH {_X}, " + _frames_sql("x", "vec_id", 24, 10, 100).format(cols="vec_id, "),
    "track_statistics": f"""WITH t AS ({duck(TRACKS)}) SELECT path, count(*) AS frames,
    round(avg(rms) FILTER (WHERE rms > 0), 6) AS mean_rms, {dt.r4('median(f0) FILTER (WHERE f0 > 0)')} AS median_f0,
    {dt.r4('(count(*) FILTER (WHERE f0 > 0))::DOUBLE / count(*)')} AS voiced_ratio FROM t GROUP BY 1""",
    "segment_plan": f"""WITH {_PLAN} SELECT doc_id, segment, start, "end" FROM plan""",
    "segment_scores": f"""WITH {_PLAN}, m AS (SELECT doc_id, count(*) AS segments,
    {dt.r4(f"avg({_calibrated('sig', '((doc_id + segment) % 40 / 10::DOUBLE)')})")} AS sig,
    {dt.r4(f"avg({_calibrated('bak', '((doc_id + segment * 3) % 30 / 8::DOUBLE)')})")} AS bak,
    {dt.r4(f"avg({_calibrated('ovr', '((doc_id * 7 + segment) % 50 / 16::DOUBLE)')})")} AS ovrl,
    {dt.r4("avg(segment % 5 / 4::DOUBLE)")} AS p808_mos FROM plan GROUP BY 1)
    SELECT c.doc_id, m.* EXCLUDE (doc_id), CASE WHEN m.doc_id IS NULL THEN 'unable to compute perceptual segments' END AS error
    FROM c LEFT JOIN m USING (doc_id)""",
    "scene_groups": f"""WITH g AS (SELECT vec_id, label % 3 AS t, embedding[64]::DOUBLE AS src,
    {", ".join(f"{_scene_max(labels)} AS {g}" for g, labels in fv.SCENE_LABELS.items())} FROM embeddings),
    p AS (SELECT *, CASE greatest(outdoor, crowd, music) WHEN outdoor THEN 'outdoor' WHEN crowd THEN 'crowd' ELSE 'music' END
        AS predicted, CASE t WHEN 0 THEN 'outdoor' WHEN 1 THEN 'crowd' ELSE 'music' END AS target,
        CASE t WHEN 0 THEN outdoor WHEN 1 THEN crowd ELSE music END AS ts FROM g)
    SELECT vec_id, predicted, {", ".join(f"{dt.r4(g)} AS {g}" for g in fv.SCENE_LABELS)},
        predicted = target AND ts >= 0.1::DOUBLE AND ts - src >= 0.03::DOUBLE AS target_success FROM p""",
    "scene_topk": f"""WITH e AS (SELECT vec_id, unnest([{", ".join(f"'{x}'" for x in SCENE_NAMES)}])
        AS label, unnest(embedding)::DOUBLE AS s FROM embeddings),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) - 1 AS position FROM e)
    SELECT vec_id, position, label, {dt.r4('s')} AS score FROM r WHERE position < 5""",
    "word_tokens": f"""WITH {_CHUNKS} SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY i) - 1 AS position,
    text, normalized, {dt.r4('s')} AS start, {dt.r4('e')} AS "end" FROM t WHERE e > s AND normalized <> ''""",
    "character_tokens": f"""WITH {_CHARS} SELECT sample_id,
    row_number() OVER (PARTITION BY sample_id ORDER BY i) - 1 AS position, text, normalized, {dt.r4('s')} AS start,
    {dt.r4('e')} AS "end" FROM t WHERE open AND e > s""",
    "stress_windows": f"""WITH {_STRESS} SELECT sample_id, side, word_index, found, {dt.r4('start')} AS start,
    {dt.r4('"end"')} AS "end", matched_text FROM wd""",
    "stress_words": f"""WITH {_STRESS}, {_PROMINENCE} SELECT sample_id, word_index, input_found, output_found,
    {dt.r4('a')} AS input_prominence, {dt.r4('b')} AS output_prominence,
    CASE WHEN input_found AND output_found THEN {dt.r4('b - a')} END AS prominence_delta, passed,
    CASE WHEN NOT (input_found AND output_found) THEN 'target_not_found_in_timestamp_asr' END AS error FROM vw""",
    "stress_rollup": f"""WITH {_STRESS}, {_PROMINENCE}, r AS (SELECT sample_id, count(*) AS stress_words_total,
    count(*) FILTER (WHERE passed) AS stress_words_passed, bool_and(input_found AND output_found) AS target_found_all
    FROM vw GROUP BY 1)
    SELECT *, {dt.r4('stress_words_passed::DOUBLE / stress_words_total')} AS rpg,
        target_found_all AND stress_words_passed = stress_words_total AS passed FROM r""",
}
