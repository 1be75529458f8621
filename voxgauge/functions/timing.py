"""Timestamped-token parsing and target-window search, all on array columns of one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxgauge.functions.numeric import let
from voxgauge.functions.text import clean_token_en, stress_text_zh, stress_words_en, strip


def seconds(value: Column) -> Column:
    """Values above 100 are milliseconds; decided per value."""
    value = value.cast("double")
    return F.when(value > 100.0, value / 1000.0).otherwise(value)


def _span(timestamp: Column) -> tuple[Column, Column]:
    """Begin and end in seconds; a timestamp with other than two values has neither."""
    pair = F.size(timestamp) == 2
    return tuple(F.when(pair, seconds(F.get(timestamp, i))) for i in (0, 1))


def _token(text: Column, normalized: Column, start: Column, end: Column) -> Column:
    return F.struct(
        text.alias("text"), normalized.alias("normalized"),
        F.round(start, 4).alias("start"), F.round(end, 4).alias("end"),
        (start.isNotNull() & end.isNotNull() & (end > start)).alias("usable"),
    )


def _drop_unusable(tokens: Column, extra=lambda t: F.lit(True)) -> Column:
    kept = F.filter(tokens, lambda t: t["usable"] & extra(t))
    return F.transform(kept, lambda t: F.struct(
        t["text"].alias("text"), t["normalized"].alias("normalized"),
        t["start"].alias("start"), t["end"].alias("end")))


def parse_word_chunks(chunks: Column) -> Column:
    """Tokens from ``array<struct<text, timestamp: array<double>>>`` word chunks (English)."""
    tokens = F.transform(chunks, lambda c: _token(strip(c["text"]), clean_token_en(c["text"]), *_span(c["timestamp"])))
    return _drop_unusable(tokens, lambda t: F.coalesce(t["normalized"], F.lit("")) != "")


def parse_spaced_text(text: Column, timestamps: Column) -> Column:
    """Tokens from a text and ``array<array<double>>`` spans (Chinese).

    Pieces are the blank-separated words when their number equals the number of spans, else single characters;
    the shorter side decides the length.
    """
    spaced = F.filter(F.split(text, r"(?U)\s+"), lambda p: p != "")
    characters = F.filter(F.split(F.regexp_replace(text, r"(?U)\s+", ""), ""), lambda p: p != "")
    pieces = F.when(F.size(spaced) == F.size(timestamps), spaced).otherwise(characters)

    def pair(both: Column) -> Column:
        shortest = F.least(F.size(both["p"]), F.size(both["t"]))
        zipped = F.slice(F.arrays_zip(both["p"].alias("p"), both["t"].alias("t")), F.lit(1), shortest)
        return F.transform(zipped, lambda z: _token(
            z["p"], stress_text_zh(z["p"]), *_span(z["t"])))

    return _drop_unusable(let(F.struct(pieces.alias("p"), timestamps.alias("t")), pair))


def _window(matched: Column) -> Column:
    return let(matched, lambda m: F.when(F.size(m) > 0, F.struct(
        F.array_min(F.transform(m, lambda t: t["start"])).alias("start"),
        F.array_max(F.transform(m, lambda t: t["end"])).alias("end"),
        F.array_join(F.transform(m, lambda t: t["text"]), " ").alias("matched_text"),
    )))


def _window_en(tokens: Column, target: Column) -> Column:
    def search(p: Column) -> Column:
        n = F.size(p["target"])
        starts = F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(p["spoken"]) - n + 1, F.lit(1))),
            lambda i: F.slice(p["spoken"], i, n) == p["target"])
        return F.when(n > 0, let(F.array_min(starts), lambda first: F.when(
            first.isNotNull(), _window(F.slice(tokens, F.coalesce(first, F.lit(1)), n)))))

    spoken = F.transform(tokens, lambda t: F.lower(F.coalesce(t["normalized"], F.lit(""))))
    return let(F.struct(spoken.alias("spoken"), stress_words_en(target).alias("target")), search)


def _window_zh(tokens: Column, target: Column) -> Column:
    def search(p: Column) -> Column:
        size = F.length(p["target"])

        def matched(at: Column) -> Column:
            # token number of every character, cut down to the matched characters
            owner = F.flatten(F.transform(p["spoken"], lambda s, i: F.array_repeat(i, F.length(s))))
            owners = F.array_distinct(F.slice(owner, F.greatest(at, F.lit(1)), F.greatest(size, F.lit(1))))
            return _window(F.transform(owners, lambda i: F.get(tokens, i)))

        return F.when(size > 0, let(F.instr(F.array_join(p["spoken"], ""), p["target"]), lambda at: F.when(
            at > 0, matched(at))))

    spoken = F.transform(tokens, lambda t: stress_text_zh(F.coalesce(F.nullif(t["normalized"], F.lit("")), t["text"])))
    return let(F.struct(spoken.alias("spoken"), stress_text_zh(target).alias("target")), search)


def target_window(tokens: Column, target: Column, language: Column) -> Column:
    """First place where the target is spoken: struct ``(start, end, matched_text)``, null when not found.

    English matches a contiguous word n-gram; Chinese matches characters and maps them back to their tokens.
    """
    return F.when(language == "zh", _window_zh(tokens, target)).otherwise(_window_en(tokens, target))
