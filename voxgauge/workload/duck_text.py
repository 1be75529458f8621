"""DuckDB fragments that restate text errors and summaries for the checks."""

from __future__ import annotations

from collections.abc import Mapping

from voxgauge.workload.standins import CANDIDATES, IDEOGRAPHS, SAMPLES, SCORES, duck


def r4(value: str) -> str:
    """Four decimals, half away from zero on the decimal value (a plain double round misses exact ties)."""
    return f"round(({value})::DECIMAL(30, 12), 4)::DOUBLE"


def norm_en(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'))"


def norm_zh(text: str) -> str:
    return rf"regexp_replace({text}, '[^\x{{4e00}}-\x{{9fff}}0-9a-zA-Z]', '', 'g')"


def norm(text: str, language: str = "language") -> str:
    return f"CASE WHEN {language} = 'en' THEN {norm_en(text)} ELSE {norm_zh(text)} END"


#: As many signs as there are ideographs in the samples; none of them is in a normalised text.
_SIGNS = "!#$%&()*+,-./:;<=>?@[]^_|~"


def one_byte(text: str) -> str:
    """A normalised text with a byte for every character: DuckDB's ``levenshtein`` counts bytes."""
    return f"translate({text}, '{IDEOGRAPHS}', '{_SIGNS}')"


def word_errors(source: str) -> str:
    """CTEs ``we_*`` ending in ``word_errors(sample_id, d, nr, nh)`` for ``source(sample_id, nt, np)``.

    A row of the edit table per hypothesis word; the dependency inside a row is a running minimum.
    """
    return f"""
we_pairs AS (SELECT sample_id, nt, np,
    list_filter(string_split(nt, ' '), lambda x: x <> '') AS rw,
    list_filter(string_split(np, ' '), lambda x: x <> '') AS hw FROM {source} WHERE np IS NOT NULL),
we_open AS (SELECT * FROM we_pairs WHERE nt <> np AND len(rw) > 0 AND len(hw) > 0),
we_table AS (
    SELECT sample_id, 0::BIGINT AS i, j, j AS d FROM (
        SELECT sample_id, unnest(range(0, len(rw) + 1)) AS j FROM we_open)
    UNION ALL
    SELECT sample_id, i, j, j + min(t - j) OVER (PARTITION BY sample_id ORDER BY j) AS d FROM (
        SELECT x.sample_id, x.i + 1 AS i, x.j,
            CASE WHEN x.j = 0 THEN x.i + 1 ELSE least(x.d + 1,
                lag(x.d) OVER (PARTITION BY x.sample_id ORDER BY x.j)
                + CASE WHEN p.rw[x.j] = p.hw[x.i + 1] THEN 0 ELSE 1 END) END AS t
        FROM we_table x JOIN we_open p ON p.sample_id = x.sample_id WHERE x.i < len(p.hw))),
word_errors AS (
    SELECT p.sample_id, len(p.rw) AS nr, len(p.hw) AS nh,
        CASE WHEN p.nt = p.np THEN 0 WHEN len(p.rw) = 0 OR len(p.hw) = 0 THEN greatest(len(p.rw), len(p.hw))
             ELSE t.d END AS d
    FROM we_pairs p LEFT JOIN we_table t
      ON t.sample_id = p.sample_id AND t.i = len(p.hw) AND t.j = len(p.rw))"""


def matched_ctes() -> str:
    """``samples``, ``best`` outputs, ``matched`` samples with scores."""
    return f"""
samples AS ({duck(SAMPLES)}),
best AS (SELECT sample_id, path AS output_path FROM (
    SELECT sample_id, path, row_number() OVER (PARTITION BY sample_id ORDER BY dir_rank, ext_rank, path) AS rn
    FROM ({duck(CANDIDATES)})) WHERE rn = 1),
scores AS ({duck(SCORES)}),
matched AS (SELECT s.*, best.output_path, best.sample_id IS NOT NULL AS has_output, c.* EXCLUDE (sample_id)
    FROM samples s LEFT JOIN best ON best.sample_id = s.sample_id LEFT JOIN scores c ON c.sample_id = s.sample_id)"""


def text_ctes(target: str = "transcript") -> str:
    """``matched_ctes`` plus ``scored``: text errors and the preservation verdict of every sample."""
    return f"""{matched_ctes()},
normed AS (SELECT *, {norm(target)} AS nt, CASE WHEN transcript_predicted IS NOT NULL THEN
    {norm('transcript_predicted')} END AS np FROM matched),
{word_errors('normed')},
rated AS (SELECT m.*,
    CASE WHEN m.np IS NULL THEN NULL WHEN w.nr > 0 THEN {r4('w.d::DOUBLE / w.nr')}
         WHEN w.nh > 0 THEN 1.0 ELSE 0.0 END AS wer,
    CASE WHEN m.np IS NULL THEN NULL WHEN length(m.nt) > 0
         THEN {r4(f"levenshtein({one_byte('m.nt')}, {one_byte('m.np')})::DOUBLE / length(m.nt)")}
         WHEN length(m.np) > 0 THEN 1.0 ELSE 0.0 END AS cer
    FROM normed m LEFT JOIN word_errors w ON w.sample_id = m.sample_id),
scored AS (SELECT *, CASE WHEN language = 'zh' THEN cer ELSE wer END AS cp_error,
    (CASE WHEN language = 'zh' THEN cer ELSE wer END) <= 0.1::DOUBLE AS cp_pass FROM rated)"""


def four_places(units: str, n: str) -> str:
    """Exact half-up rounding of ``units / n`` given in ten-thousandths."""
    return f"(sign({units}) * ((2 * abs({units}) + {n}) // nullif(2 * {n}, 0)) / 1e4)"


def rate(flag: str, among: str = "TRUE") -> str:
    return four_places(f"((count(*) FILTER (WHERE ({flag}) AND ({among}))) * 10000)",
                       f"(count({flag}) FILTER (WHERE {among}))")


def share(flag: str, of: str = "TRUE") -> str:
    exact = four_places(f"((count(*) FILTER (WHERE ({flag}) AND ({of}))) * 10000)", f"(count(*) FILTER (WHERE {of}))")
    return f"coalesce({exact}, 0.0)"


def mean(value: str, among: str = "TRUE", empty: str = "NULL") -> str:
    """Mean of finite values; rounded only at the end."""
    kept = f"({among}) AND isfinite(({value})::DOUBLE)"
    total = f"(sum(TRY_CAST(({value}) AS DECIMAL(38, 12))) FILTER (WHERE {kept}))::DOUBLE"
    return f"coalesce({r4(f'{total} / nullif(count(*) FILTER (WHERE {kept}), 0)')}, {empty})"


def count(flag: str) -> str:
    return f"count(*) FILTER (WHERE {flag})"


COVERAGE = {
    "total": "count(*)",
    "outputs_evaluated": count("has_output"),
    "missing_outputs": count("NOT has_output"),
    "coverage": share("has_output"),
    "error_count": count("has_output AND coalesce(error, '') <> ''"),
}


def summary(source: str, dims: Mapping[str, str], measures: Mapping[str, str]) -> str:
    """One SELECT per dimension, stacked: the long ``(dim, key, …)`` summary."""
    cols = ", ".join(f"{sql} AS {name}" for name, sql in measures.items())
    parts = [f"SELECT 'overall' AS dim, 'all' AS key, {cols} FROM {source}"]
    parts += [
        f"SELECT 'by_{d}' AS dim, ({expr})::VARCHAR AS key, {cols} FROM {source} WHERE ({expr}) IS NOT NULL GROUP BY 2"
        for d, expr in dims.items()
    ]
    return "\nUNION ALL\n".join(parts)


def unknown(column: str) -> str:
    """Dimension of evaluated rows with the default for absent values."""
    return f"CASE WHEN has_output THEN coalesce({column}, 'unknown') END"
