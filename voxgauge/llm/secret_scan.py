"""Secrets in texts, with DataFrame functions alone: fixed patterns, and a randomness battery for everything else.

Patterns. Places of all matches come from cutting the text at the pattern: pieces and matches alternate, and running sums
of their lengths (by doubling steps, so a text with very many matches stays cheap) are the places.

Battery. Candidates are unbroken runs of at least ``MIN_RUN`` key characters (padding at the end included) that hold a digit
or change from small to capital letters inside. Each gets the narrowest encoding that fits it (hex, base32, base64) and three tests against
random symbols of that alphabet: chi-squared on symbol counts, runs above and below the middle of the alphabet, and serial
correlation of neighbours. A run that one of them refuses (Bonferroni over the three) is no secret. For the others the
chi-squared value is compared with what ordinary text of that length would give; ordinary text repeats symbols, and the
longer it is the farther it lies from uniform, so short runs get weak evidence. These p-values go through a
false-discovery procedure in four strata of length, each over the candidates of all documents: a histogram of p-values
(at most ``BINS`` bins per stratum) gives each stratum's threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxgauge.llm.shared import free_name, kept_table

# The patterns of the contract, in the order in which kinds at one place are listed.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")

MIN_RUN = 20
_KEY = "[A-Za-z0-9+/_-]"
#: An equals sign belongs to a run only as padding at its end, so what follows ``name=`` is a run of its own.
CANDIDATE = (rf"(?<!{_KEY})(?=[A-Za-z+/_-]*(?:[0-9]|[a-z][A-Z]))"
             rf"(?:{_KEY}{{{MIN_RUN},}}+(?:=++(?!{_KEY}))?|(?=[A-Za-z0-9+/_=-]{{{MIN_RUN}}}){_KEY}++=++(?!{_KEY}))")
#: Pattern of each encoding, its alphabet, and how often two symbols of ordinary text in that alphabet agree.
ENCODINGS = (
    ("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.13),
    ("^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.075),
    ("^[A-Za-z0-9+/_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.06),
)
REFUSE = 0.001  # level at which the battery calls a run not random
FALSE_DISCOVERIES = 0.01  # expected share of ordinary text among the runs that the battery adds
STRATA = (24, 32, 48)  # lengths at which a new stratum begins
BINS, BINS_PER_DECADE = 400, 20

_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
MASK = "[SECRET]"


def _running_sums(lengths: Column) -> Column:
    """Sums up to and with each place, in about log2(n) passes over the array."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(lengths) + 1)).cast("int"))
    return F.aggregate(steps, lengths, lambda sums, step: F.transform(
        sums, lambda x, i: x + F.coalesce(F.get(sums, i - F.pow(F.lit(2), step).cast("int")), F.lit(0))))


def _matches(text: Column, pattern: str) -> Column:
    """``start, end, text`` of every match; code points, end exclusive; null if there is none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    ends = _running_sums(F.zip_with(pieces, found, lambda p, m: F.length(p) + F.length(m)))
    return F.when(text.rlike(pattern), F.zip_with(ends, found, lambda end, m: F.struct(
        (end - F.length(m)).alias("start"), end.alias("end"), m.alias("text"))))


def _kind(spans: Column, kind: str) -> Column:
    return F.coalesce(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"),
        F.lit(kind).alias("kind"))), F.array().cast(_SPANS))


def _base_spans(text: Column) -> Column:
    """Spans of the fixed patterns by start, then kind."""
    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assigned = F.zip_with(_matches(text, ASSIGN), value, lambda s, v: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), (F.length(v) >= ASSIGN_LEAST).alias("long")))
    assigned = F.when(text.rlike(ASSIGN), F.filter(assigned, lambda s: s["long"]))
    return F.array_sort(F.concat(
        _kind(assigned, "assign"), _kind(_matches(text, ACCESS), "access"), _kind(_matches(text, HEX), "hex")))


def _with_battery(df: DataFrame, runs: str) -> DataFrame:
    """Replace candidate runs by ``start, end, stratum, p`` of those that pass the three tests.

    p is the probability that ordinary text of this length looks as uniform as the run. Normal tails come from the usual
    logistic approximation, the chi-squared tail from the cube-root transformation.
    """
    which = " ".join(f"WHEN s.text RLIKE '{pattern}' THEN {i}" for i, (pattern, _, _) in enumerate(ENCODINGS))
    pick = lambda k: "CASE s.which " + " ".join(f"WHEN {i} THEN {e[k]!r}" for i, e in enumerate(ENCODINGS)) + " END"
    stratum = "CASE " + " ".join(f"WHEN s.n < {least} THEN {i}" for i, least in enumerate(STRATA)) + f" ELSE {len(STRATA)} END"
    upper = lambda z: f"(1 / (1 + exp(least(700, 1.5976 * ({z}) + 0.07056 * pow({z}, 3)))))"
    steps = [
        f"filter(transform({{}}, s -> struct(s.start, s.end, s.text, CASE {which} END AS which)), s -> s.which IS NOT NULL)",
        "transform({}, s -> struct(s.start, s.end, s.which, CASE WHEN s.which = 0 THEN lower(s.text)"
        " ELSE translate(rtrim('=', s.text), '-_', '+/') END AS body))",
        f"transform({{}}, s -> struct(s.start, s.end, s.body, {pick(1)} AS alphabet, {pick(2)} AS agree))",
        "transform({}, s -> struct(s.start, s.end, s.agree, CAST(length(s.body) AS DOUBLE) AS n,"
        " CAST(length(s.alphabet) AS DOUBLE) AS k,"
        " aggregate(split(s.alphabet, ''), 0D, (a, c) -> a + IF(c = '', 0,"
        " pow(length(s.body) - length(replace(s.body, c, '')), 2))) AS squares,"
        " transform(filter(split(s.body, ''), c -> c <> ''), c -> locate(c, s.alphabet) - 1) AS codes))",
        "transform({}, s -> struct(s.start, s.end, s.agree, s.n, s.k, s.k / s.n * s.squares - s.n AS chi,"
        " CAST(size(filter(s.codes, c -> c >= s.k / 2)) AS DOUBLE) AS high,"
        " zip_with(slice(s.codes, 1, size(s.codes) - 1), slice(s.codes, 2, size(s.codes) - 1), (a, b) ->"
        " struct(IF((a >= s.k / 2) = (b >= s.k / 2), 0, 1) AS turn,"
        " (a - (s.k - 1) / 2) * (b - (s.k - 1) / 2) AS product)) AS pairs))",
        "transform({}, s -> struct(s.start, s.end, s.agree, s.n, s.k, s.chi,"
        " 2 * s.high * (s.n - s.high) AS mixed, 1 + aggregate(s.pairs, 0D, (a, p) -> a + p.turn) AS turns,"
        " aggregate(s.pairs, 0D, (a, p) -> a + p.product) AS products))",
        "transform({}, s -> struct(s.start, s.end, s.n,"
        " (pow(s.chi / (s.k - 1), 1 / 3D) - 1 + 2 / (9 * (s.k - 1))) / sqrt(2 / (9 * (s.k - 1))) AS z_chi,"
        " CASE WHEN s.mixed <= s.n THEN 99D ELSE (s.turns - 1 - s.mixed / s.n)"
        " / sqrt(s.mixed * (s.mixed - s.n) / (s.n * s.n * (s.n - 1))) END AS z_runs,"
        " s.products / ((s.k * s.k - 1) / 12) / sqrt(s.n - 1) AS z_serial,"
        " (s.chi - (s.k - 1 + s.n * (s.k * s.agree - 1))) / sqrt(2 * (s.k - 1 + 2 * s.n * (s.k * s.agree - 1))) AS z_text))",
        f"transform({{}}, s -> struct(s.start, s.end, {stratum} AS stratum, 3 * least({upper('s.z_chi')},"
        f" 2 * {upper('abs(s.z_runs)')}, 2 * {upper('abs(s.z_serial)')}) AS fit, {upper('-s.z_text')} AS p))",
        f"transform(filter({{}}, s -> s.fit >= {REFUSE}), s -> struct(s.start, s.end, s.stratum, s.p,"
        f" CAST(least({BINS - 1}, floor(-log10(greatest(s.p, 1e-300)) * {BINS_PER_DECADE})) AS INT) AS bin))",
    ]
    for step in steps:
        df = df.withColumn(runs, F.expr(step.format(f"`{runs}`")))
    return df


def _thresholds(scanned: DataFrame, runs: str, level: float) -> list[int]:
    """Per stratum the lowest bin that is still accepted (``BINS`` if none): Benjamini-Hochberg on the histogram.

    A bin counts with its largest p. The histogram has at most ``BINS`` rows per stratum, the result one row per stratum.
    """
    histogram = scanned.select(F.explode(runs).alias("s")).groupBy("s.stratum", "s.bin").count()
    below = W.partitionBy("stratum").orderBy(F.desc("bin"))
    whole = W.partitionBy("stratum")
    ranked = histogram.select("stratum", "bin", F.sum("count").over(below).alias("accepted"),
                              F.sum("count").over(whole).alias("candidates"))
    good = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE) * F.col("candidates")
                         <= level * F.col("accepted"))
    found = {r["stratum"]: r["bin"] for r in good.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}
    return [found.get(i, BINS) for i in range(len(STRATA) + 1)]


def find_secrets(docs: DataFrame, text: str = "text", spans: str = "spans", columns: list[str] | None = None,
                 false_discoveries: float = FALSE_DISCOVERIES) -> DataFrame:
    """``columns`` of the table (all by default) and ``spans``: array of ``start, rank, end, kind`` by start, then kind
    (assign, access, hex, random).

    Places count code points, ends are exclusive. A null or empty text has no span; spans of one kind never overlap, those
    of different kinds may. Every row stays, a column named like ``spans`` is replaced, and repeated rows get the same
    spans. The columns asked for are written once, since the thresholds need all candidates first.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    runs = free_name(docs, "runs")
    kept = [c for c in docs.columns if c != spans and (columns is None or c in columns)]
    scanned = docs.select(*[F.col(f"`{c}`") for c in kept], _matches(body, CANDIDATE).alias(runs),
                          _base_spans(body).alias(spans))
    scanned = kept_table(_with_battery(scanned, runs), "secret-scan")
    lowest = _thresholds(scanned, runs, false_discoveries)
    accepted = F.filter(F.col(runs), lambda s: s["bin"] >= F.get(F.array(*map(F.lit, lowest)), s["stratum"]))
    return scanned.withColumn(spans, F.array_sort(F.concat(spans, _kind(accepted, "random")))).drop(runs)


def span_list(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def mask_secrets(docs: DataFrame, text: str = "text", mask: str = MASK) -> DataFrame:
    """The same rows and columns with every span of ``find_secrets`` replaced by ``mask``; overlapping spans become one.

    Null texts stay null, texts without a span stay as they are.
    """
    spans = free_name(docs, "spans")
    found = find_secrets(docs, text, spans)
    # spans come by start, so one that begins after all ends so far begins a new stretch
    merged = F.expr(
        f"aggregate(`{spans}`, struct(CAST(array() AS ARRAY<STRUCT<start:INT,end:INT>>) AS done, -1 AS a, -1 AS b),"
        " (m, s) -> IF(s.start <= m.b, struct(m.done AS done, m.a AS a, greatest(m.b, s.end) AS b),"
        " struct(IF(m.b < 0, m.done, concat(m.done, array(struct(m.a AS start, m.b AS end)))) AS done, s.start AS a,"
        " s.end AS b)), m -> IF(m.b < 0, m.done, concat(m.done, array(struct(m.a AS start, m.b AS end)))))")
    found = found.withColumn(spans, merged)
    own = F.col(text)
    before = F.transform(F.col(spans), lambda s, i: F.concat(
        own.substr(F.coalesce(F.get(F.col(spans), i - 1)["end"], F.lit(0)) + 1,
                   s["start"] - F.coalesce(F.get(F.col(spans), i - 1)["end"], F.lit(0))), F.lit(mask)))
    after = own.substr(F.element_at(spans, -1)["end"] + 1, F.length(own))
    masked = F.when(F.size(spans) > 0, F.concat(F.concat_ws("", before), after)).otherwise(own)
    return found.withColumn(text, masked).select(*docs.columns)
