"""Text normalisation, error rates, edit checks and quote/template audits."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxgauge import fixed_values as fv
from voxgauge.functions.numeric import let

_HAS_NON_ASCII = r"[^\x00-\x7F]"
_KEEP_ZH = "[^一-鿿0-9a-zA-Z]"
_WHITE_SPACE = "".join(chr(c) for c in (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
    0x3000))
_CODE_BASE = 0x10000
_CODE_SPACE = 1 << 20


@F.arrow_udf(returnType=T.StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    # pyarrow's own utf8_normalize leaves NFKC decomposed
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """Compatibility normal form. Only text with non-ASCII characters is sent to the Arrow worker."""
    return F.coalesce(_nfkc(F.when(text.rlike(_HAS_NON_ASCII), text)), text)


def normalize(text: Column, language: Column) -> Column:
    """English: lower-case words and digits, single spaces. Otherwise: CJK, digits and Latin letters only."""
    folded = nfkc(F.coalesce(text, F.lit("")))
    english = F.trim(F.regexp_replace(F.lower(folded), "[^a-z0-9]+", " "))
    return F.when(language == "en", english).otherwise(F.regexp_replace(folded, _KEEP_ZH, ""))


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(_WHITE_SPACE))


def words(text: Column) -> Column:
    """Whitespace split without empty pieces."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def stress_words_en(text: Column) -> Column:
    """Lower-case word list that keeps apostrophes."""
    return words(F.regexp_replace(F.lower(text), r"[^a-z0-9'\s]+", " "))


def stress_text_zh(text: Column) -> Column:
    return F.regexp_replace(text, _KEEP_ZH, "")


def clean_token_en(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9']+", "")


def _hash_codes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.pmod(F.xxhash64(w), F.lit(_CODE_SPACE)))


def _position_codes(ws: Column, vocabulary: Column) -> Column:
    return F.transform(ws, lambda w: F.array_position(vocabulary, w))


def _as_code_points(codes: Column) -> Column:
    """One supplementary code point per number, so the built-in edit distance counts words."""
    hexed = F.transform(codes, lambda c: F.lpad(F.hex(c + F.lit(_CODE_BASE)), 8, "0"))
    return F.decode(F.unhex(F.array_join(hexed, "")), "UTF-32")


def _common_prefix(a: Column, b: Column, shorter: Column) -> Column:
    """Length of the common prefix, found by halving steps (equality of prefixes is monotone)."""
    steps = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda have, step: F.when(
        (have + step <= shorter) & (F.substring(a, have + 1, step) == F.substring(b, have + 1, step)), have + step
    ).otherwise(have))


def edit_distance(a: Column, b: Column, budget: Column | None = None) -> Column:
    """Exact edit distance in code points; -1 beyond the ``budget`` when one is given.

    Equal ends are cut off first, then the distance is looked for within the budget or a tenth of the length (a narrow
    band of the table); without a budget, texts that differ more than that pay for the whole table.
    """
    def middle(p: Column, head: Column, tail: Column) -> Column:
        return F.struct(
            F.substring(p["a"], head + 1, F.length(p["a"]) - head - tail).alias("a"),
            F.substring(p["b"], head + 1, F.length(p["b"]) - head - tail).alias("b"))

    def measure(p: Column) -> Column:
        if budget is not None:
            return F.call_function("levenshtein", p["a"], p["b"], budget)
        limit = F.floor(F.greatest(F.length(p["a"]), F.length(p["b"])) / 10).cast("int") + 4
        near = F.call_function("levenshtein", p["a"], p["b"], limit)
        return let(near, lambda d: F.when(d >= 0, d).otherwise(F.levenshtein(p["a"], p["b"])))

    def trimmed(p: Column) -> Column:
        shorter = F.least(F.length(p["a"]), F.length(p["b"]))

        def cut(head: Column) -> Column:
            ends = F.struct(F.reverse(p["a"]).alias("a"), F.reverse(p["b"]).alias("b"))
            tail = let(ends, lambda r: _common_prefix(r["a"], r["b"], shorter - head))
            return let(tail, lambda t: let(middle(p, head, t), measure))

        return let(_common_prefix(p["a"], p["b"], shorter), cut)

    return F.when(a == b, F.lit(0)).otherwise(let(F.struct(a.alias("a"), b.alias("b")), trimmed))


def _word_strings(ref: Column, hyp: Column) -> Column:
    """Struct ``(r, h)`` of strings with one code point per word: equal words, equal code points.

    A 20-bit hash is used when it is collision-free on the pair's vocabulary (checked per pair); otherwise the word's
    position in the vocabulary is used. One pair may have up to 1,048,576 different words, more than any recording holds;
    beyond that the job fails with a message that says so.
    """
    def encode(vocabulary: Column) -> Column:
        collision_free = F.size(F.array_distinct(_hash_codes(vocabulary))) == F.size(vocabulary)
        too_many = F.raise_error(F.lit(f"a pair of texts has more than {_CODE_SPACE} different words"))
        return F.when(F.size(vocabulary) > _CODE_SPACE, too_many).when(collision_free, F.struct(
            _as_code_points(_hash_codes(ref)).alias("r"), _as_code_points(_hash_codes(hyp)).alias("h"),
        )).otherwise(F.struct(
            _as_code_points(_position_codes(ref, vocabulary)).alias("r"),
            _as_code_points(_position_codes(hyp, vocabulary)).alias("h"),
        ))

    return let(F.array_union(ref, hyp), encode)


def word_distance(ref: Column, hyp: Column) -> Column:
    """Exact word-level edit distance of two word arrays, without a UDF."""
    return F.when(ref == hyp, F.lit(0)).otherwise(
        let(_word_strings(ref, hyp), lambda c: edit_distance(c["r"], c["h"])))


def _rate(distance: Column, ref_size: Column, hyp_size: Column) -> Column:
    return F.when(ref_size > 0, distance / ref_size).otherwise(F.when(hyp_size > 0, 1.0).otherwise(0.0))


def wer(ref_norm: Column, hyp_norm: Column) -> Column:
    """Word error rate of two normalised texts."""
    return let(
        F.struct(words(ref_norm).alias("r"), words(hyp_norm).alias("h")),
        lambda p: _rate(word_distance(p["r"], p["h"]), F.size(p["r"]), F.size(p["h"])),
    )


def cer(ref_norm: Column, hyp_norm: Column) -> Column:
    """Character error rate of two normalised texts (code points)."""
    return _rate(edit_distance(ref_norm, hyp_norm), F.length(ref_norm), F.length(hyp_norm))


def error_threshold(language: Column) -> Column:
    return F.when(language == "zh", fv.CONTENT_ERROR_MAX["zh"]).otherwise(fv.CONTENT_ERROR_MAX["en"])


def with_text_errors(df: DataFrame, target: str, predicted: str, language: str = "language") -> DataFrame:
    """Add ``norm_target, norm_predicted, wer, cer`` (rates rounded to four places)."""
    lang = F.coalesce(F.col(language), F.lit("en"))
    normed = df.withColumns({
        "norm_target": normalize(F.col(target), lang),
        "norm_predicted": F.when(F.col(predicted).isNotNull(), normalize(F.col(predicted), lang)),
    })
    return normed.withColumns({
        "wer": F.when(F.col("norm_predicted").isNotNull(),
                      F.round(wer(F.col("norm_target"), F.col("norm_predicted")), 4)),
        "cer": F.when(F.col("norm_predicted").isNotNull(),
                      F.round(cer(F.col("norm_target"), F.col("norm_predicted")), 4)),
    })


PRESERVATION_COLUMNS = (
    "norm_target", "norm_predicted", "wer", "cer", "content_preservation_metric", "content_preservation_error",
    "content_preservation_threshold", "content_preservation_pass")


def with_preservation(df: DataFrame, target: str, predicted: str, language: str = "language") -> DataFrame:
    """Add the text errors and the content-preservation verdict.

    The threshold is applied to the rounded error. Rows without a predicted transcript get nulls throughout. A table
    that carries the columns already is returned as it is, so several tasks can share one measurement.
    """
    if set(PRESERVATION_COLUMNS) <= set(df.columns):
        return df
    lang = F.coalesce(F.col(language), F.lit("en"))
    known = F.col("norm_predicted").isNotNull()
    zh = lang == "zh"
    return with_text_errors(df, target, predicted, language).withColumns({
        "content_preservation_metric": F.when(known, F.when(zh, "cer").otherwise("wer")),
        "content_preservation_error": F.when(zh, F.col("cer")).otherwise(F.col("wer")),
        "content_preservation_threshold": F.when(known, error_threshold(lang)),
    }).withColumn(
        "content_preservation_pass",
        F.col("content_preservation_error") <= F.col("content_preservation_threshold"),
    )


def within_error_budget(ref_norm: Column, hyp_norm: Column, language: Column) -> Column:
    """The preservation verdict alone: the edit distance stops once the error budget is exceeded.

    Use it when the error value itself is not wanted; the verdict equals ``with_preservation``.
    """
    def verdict(n: Column, m: Column, a: Column, b: Column, limit: float) -> Column:
        budget = (n * F.lit(limit + 0.00005)).cast("int") + 1
        close = let(edit_distance(a, b, budget), lambda d: (d >= 0) & (F.round(d / n, 4) <= limit))
        return F.when(n == 0, m == 0).when(F.abs(n - m) > budget, False).otherwise(close)

    def by_words(p: Column) -> Column:
        return let(_word_strings(p["r"], p["h"]), lambda c: verdict(
            F.size(p["r"]), F.size(p["h"]), c["r"], c["h"], fv.CONTENT_ERROR_MAX["en"]))

    chars = verdict(F.length(ref_norm), F.length(hyp_norm), ref_norm, hyp_norm, fv.CONTENT_ERROR_MAX["zh"])
    pair = F.struct(words(ref_norm).alias("r"), words(hyp_norm).alias("h"))
    return F.when(language == "zh", chars).otherwise(let(pair, by_words))


def _flag(value: Column) -> Column:
    return F.when(value, "True").otherwise("False")


def edit_success(edit_type: Column, original: Column, target: Column, after: Column, hyp: Column) -> Column:
    """Struct ``(success, reason)`` of the local edit check on normalised text; plain substring tests.

    ``original``, ``target`` and ``after`` are normalised with null or empty meaning "not given".
    """
    def given(text: Column) -> Column:
        return F.coalesce(text, F.lit("")) != ""

    def outcome(success: Column, reason: Column) -> Column:
        return F.struct(success.alias("success"), reason.alias("reason"))

    target_ok = F.contains(hyp, target)
    original_gone = ~given(original) | ~F.contains(hyp, original)
    replaced = target_ok & original_gone
    replace = outcome(replaced, F.when(replaced, "replace_target_present_original_absent").otherwise(
        F.concat(F.lit("replace_target_present="), _flag(target_ok),
                 F.lit(";original_absent="), _flag(original_gone))))
    order_ok = F.contains(hyp, after) & target_ok & (F.instr(hyp, after) <= F.instr(hyp, target))
    insert_plain = outcome(target_ok, F.when(target_ok, "insert_target_present").otherwise("insert_target_absent"))
    insert_after = outcome(order_ok, F.when(order_ok, "insert_target_present_after_anchor").otherwise(
        F.concat(F.lit("insert_target_present="), _flag(target_ok),
                 F.lit(";after_before_target="), _flag(order_ok))))
    gone = ~F.contains(hyp, original)
    delete = outcome(gone, F.when(gone, "delete_original_absent").otherwise("delete_original_present"))

    def no(reason: str) -> Column:
        return outcome(F.lit(False), F.lit(reason))

    kind = F.coalesce(edit_type, F.lit("unknown"))
    return (
        F.when((kind == "replace") & ~given(target), no("replace_missing_edit_target"))
        .when(kind == "replace", replace)
        .when((kind == "insert") & ~given(target), no("insert_missing_edit_target"))
        .when((kind == "insert") & ~given(after), insert_plain)
        .when(kind == "insert", insert_after)
        .when((kind == "delete") & ~given(original), no("delete_missing_edit_original"))
        .when(kind == "delete", delete)
        .otherwise(outcome(F.lit(False), F.concat(F.lit("unsupported_edit_type="), kind)))
    )


def _count_of(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def unbalanced_quotes(text: Column) -> Column:
    """Odd number of straight double quotes, or opening and closing curly quotes that do not pair up."""
    return (
        (F.pmod(_count_of(text, '"'), F.lit(2)) == 1)
        | (_count_of(text, "“") != _count_of(text, "”"))
        | (_count_of(text, "‘") != _count_of(text, "’"))
    )


def template_of(text: Column) -> Column:
    """The instruction with quoted spans and label words replaced by placeholders."""
    quoted = F.regexp_replace(text, '"[^"]+"', fv.TEMPLATE_QUOTE_MARK)
    return F.regexp_replace(quoted, "(?iuU)" + fv.TEMPLATE_LABEL_WORDS, fv.TEMPLATE_LABEL_MARK)


def fold_case(text: Column) -> Column:
    """Lower case, with the letters that only a case-blind search would equate with ``s``, ``i`` and ``k``."""
    rare = "ſıİ\u212a"
    has_rare = F.contains(text, F.lit(rare[0]))
    for letter in rare[1:]:
        has_rare = has_rare | F.contains(text, F.lit(letter))
    return F.lower(F.when(has_rare, F.translate(text, rare, "siik")).otherwise(text))


def _alternatives(pattern: str) -> list[str]:
    """The words of a pattern that is a plain list of alternatives; empty for any other pattern."""
    listed = re.sub(r"\\b\(|\)\\b", "", pattern).split("|")
    plain = all(w and all(c.isalnum() or c == " " for c in w) for w in listed)
    return listed if plain else []


def matches_pattern(folded: Column, pattern: str) -> Column:
    """Search in case-folded text with Unicode word boundaries; the pattern is lower case.

    A plain substring test rules out most texts first: the regular expression runs only where one of its words occurs.
    """
    found = folded.rlike("(?U)" + pattern)
    listed = _alternatives(pattern)
    if not listed:
        return found
    return reduce(or_, [F.contains(folded, F.lit(w)) for w in listed]) & found
