"""Derived columns (B1-B12) and small numeric helpers, as Column expressions.

Each helper has a twin ``sql_*`` that renders the same computation as
DuckDB SQL text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vulnlake.plans import domains as D
from vulnlake.functions.rules import sql_str

CWE_RX = r"(CWE-\d+)"
SOURCE_RX = r"CWE-\d+_([^_]+)_"
ID_FORMAT_RX = r"^CWE-\d+_[^_]+_\d+\.py$"
# Unicode white space as Python's str.split() sees it.
WS_CLASS = (r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
TOKEN_RX = "[^" + WS_CLASS[1:]  # one run of non-space characters
# Word tokens of the two vectoriser modes.
WORD_RX = {"eda": r"[\p{L}\p{N}_]{2,}", "bench": r"[\p{L}\p{N}_]+"}
# Letter runs and non-letter runs, for Python-style title case.
TITLE_RUNS_RX = r"(\p{L}+|[^\p{L}]+)"


def extract_cwe(id_col: Column) -> Column:
    """B1: first CWE-<digits> in the id, else null."""
    return F.nullif(F.regexp_extract(id_col, CWE_RX, 1), F.lit(""))


def extract_source(id_col: Column) -> Column:
    """B2: text between the CWE and the next underscore, else null."""
    return F.nullif(F.regexp_extract(id_col, SOURCE_RX, 1), F.lit(""))


def title_case(s: Column) -> Column:
    """Python str.title(): upper-case the first letter of every letter run."""
    runs = F.regexp_extract_all(s, F.lit(TITLE_RUNS_RX), 1)
    cap = F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30))))
    return F.when(s.isNotNull(), F.array_join(cap, ""))


def map_category(cwe: Column) -> Column:
    """CWE → one of four classes; unknown or null → other_vuln."""
    return (F.when(cwe.isin(*D.SQLI_CWES), "sql_injection")
            .when(cwe.isin(*D.SECRET_CWES), "hardcoded_secret")
            .when(cwe.isin(*D.CRYPTO_CWES), "weak_crypto")
            .otherwise("other_vuln"))


def num_tokens(code: Column) -> Column:
    """Whitespace token count (empty text → 0), as Python's len(s.split()).

    Pieces between white-space runs, less the empty piece before a leading
    and after a trailing run.  (regexp_count would build an array holding
    every token as a string; split keeps one pass and fewer objects.)"""
    pieces = F.size(F.split(code, WS_CLASS + "+", -1))
    lead = F.substring(code, 1, 1).rlike(WS_CLASS).cast("int")
    trail = F.substring(code, -1, 1).rlike(WS_CLASS).cast("int")
    n = F.when(F.length(code) == 0, F.lit(0)).otherwise(pieces - lead - trail)
    return F.when(code.isNotNull(), n).cast("int")


def num_lines(code: Column) -> Column:
    """Newline count + 1."""
    return (F.length(code) - F.length(F.regexp_replace(code, "\n", "")) + 1).cast("int")


def display_label(c: Column) -> Column:
    """B8: '_' → ' ' then title case."""
    return F.initcap(F.regexp_replace(c, "_", " "))


def preview(code: Column, n: int = D.PREVIEW_CHARS) -> Column:
    """First n characters, newlines → spaces."""
    return F.translate(F.substring(code, 1, n), "\n", " ")


def format_mean_std(mean: Column, std: Column) -> Column:
    """B11: 'm.mmm ± s.sss' as Python prints it (Java's %f alone rounds the
    shortest decimal half-up, so values are pre-rounded exactly first)."""
    return F.format_string("%.3f ± %.3f", round_like_format(mean, 3), round_like_format(std, 3))


def format_pct(conf: Column) -> Column:
    """B11: '87%' from a share, rounding half up like Math.round."""
    return F.concat(F.floor(conf * 100 + F.lit(0.5)).cast("long").cast("string"), F.lit("%"))


def snippet_hash(code: Column) -> Column:
    """Stable content key."""
    return F.sha2(code, 256)


def round_half_even(x: Column, places: int) -> Column:
    """numpy-style round: rint(x * 10^p) / 10^p."""
    scale = float(10 ** places)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


SPLIT = 134217729.0  # 2^27 + 1: Veltkamp split of a double into two 26-bit halves


def round_like_format(x: Column, places: int) -> Column:
    """Round as Python's f"{x:.{p}f}" does: from the exact binary value,
    half-even only on exact ties.  rint(x·10^p) agrees except when the
    rounded product lands exactly on k + 0.5; there the sign of the
    product's rounding error (error-free product via a Veltkamp split)
    says on which side the exact value lies."""
    scale = F.lit(float(10 ** places))
    c = x * F.lit(SPLIT)
    hi = c - (c - x)
    lo = x - hi
    p = x * scale
    err = (hi * scale - p) + lo * scale
    fl = F.floor(p).cast("double")
    tie = (p - fl) == F.lit(0.5)
    r = F.when(tie & (err > 0), fl + 1).when(tie & (err < 0), fl).otherwise(F.rint(p))
    return F.when(F.abs(x) < F.lit(1e15), r / scale).otherwise(x)


def confidence(id_col: Column, verdict_col: Column, negative: str = "safe", seed: int = D.SEED) -> Column:
    """Deterministic confidence in [0.72, 0.96] for a hit and
    [0.88, 0.97] otherwise, two decimals, from md5(seed:id)."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string"))), 1, 8), 16, 10).cast("long")
    lo_h, hi_h = D.CONFIDENCE_HIT
    lo_s, hi_s = D.CONFIDENCE_SAFE
    cents_hit = F.lit(lo_h) + F.floor(h * F.lit(hi_h - lo_h + 1) / F.lit(4294967296))
    cents_safe = F.lit(lo_s) + F.floor(h * F.lit(hi_s - lo_s + 1) / F.lit(4294967296))
    cents = F.when(verdict_col == F.lit(negative), cents_safe).otherwise(cents_hit)
    return cents.cast("long") / F.lit(100.0)


# ------------------------------- SQL twins ---------------------------------

def sql_extract_cwe(id_sql: str) -> str:
    return f"nullif(regexp_extract({id_sql}, {sql_str(CWE_RX)}, 1), '')"


def sql_extract_source(id_sql: str) -> str:
    return f"nullif(regexp_extract({id_sql}, {sql_str(SOURCE_RX)}, 1), '')"


def sql_title_case(s: str) -> str:
    return (f"CASE WHEN {s} IS NOT NULL THEN array_to_string(list_transform(regexp_extract_all({s}, "
            f"{sql_str(TITLE_RUNS_RX)}, 1), lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), '') END")


def sql_map_category(cwe: str) -> str:
    def lst(v):
        return ", ".join(sql_str(x) for x in v)
    return (f"CASE WHEN {cwe} IN ({lst(D.SQLI_CWES)}) THEN 'sql_injection' "
            f"WHEN {cwe} IN ({lst(D.SECRET_CWES)}) THEN 'hardcoded_secret' "
            f"WHEN {cwe} IN ({lst(D.CRYPTO_CWES)}) THEN 'weak_crypto' ELSE 'other_vuln' END")


def sql_num_tokens(code: str) -> str:
    return f"CAST(len(regexp_extract_all({code}, {sql_str(TOKEN_RX + '+')})) AS INTEGER)"


def sql_num_lines(code: str) -> str:
    return f"CAST(length({code}) - length(replace({code}, chr(10), '')) + 1 AS INTEGER)"


def sql_display_label(c: str) -> str:
    # only underscores and single words occur in labels: initcap per word
    return (f"array_to_string(list_transform(string_split(replace({c}, '_', ' '), ' '), "
            f"lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), ' ')")


def sql_preview(code: str, n: int = D.PREVIEW_CHARS) -> str:
    return f"replace(substr({code}, 1, {n}), chr(10), ' ')"


def sql_round_half_even(x: str, places: int) -> str:
    scale = float(10 ** places)
    return f"(round_even(({x}) * {scale}, 0) / {scale})"


def sql_round_like_format(x: str, places: int) -> str:
    scale = float(10 ** places)
    c = f"(({x}) * {SPLIT})"
    hi = f"({c} - ({c} - ({x})))"
    lo = f"(({x}) - {hi})"
    p = f"(({x}) * {scale})"
    err = f"(({hi} * {scale} - {p}) + {lo} * {scale})"
    fl = f"CAST(floor({p}) AS DOUBLE)"
    tie = f"({p} - {fl} = 0.5)"
    r = f"(CASE WHEN {tie} AND {err} > 0 THEN {fl} + 1 WHEN {tie} AND {err} < 0 THEN {fl} ELSE round_even({p}, 0) END)"
    return f"(CASE WHEN abs({x}) < 1e15 THEN {r} / {scale} ELSE ({x}) END)"


def sql_format_mean_std(mean: str, std: str) -> str:
    return f"printf('%.3f ± %.3f', {sql_round_like_format(mean, 3)}, {sql_round_like_format(std, 3)})"


def sql_format_pct(conf: str) -> str:
    return f"CAST(CAST(floor({conf} * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%'"


def sql_confidence(id_sql: str, verdict_sql: str, negative: str = "safe", seed: int = D.SEED) -> str:
    h = f"CAST(('0x' || substr(md5('{seed}:' || CAST({id_sql} AS VARCHAR)), 1, 8)) AS BIGINT)"
    lo_h, hi_h = D.CONFIDENCE_HIT
    lo_s, hi_s = D.CONFIDENCE_SAFE
    return (f"(CAST(CASE WHEN {verdict_sql} = '{negative}' THEN {lo_s} + floor({h} * {hi_s - lo_s + 1} / 4294967296.0) "
            f"ELSE {lo_h} + floor({h} * {hi_h - lo_h + 1} / 4294967296.0) END AS BIGINT) / 100.0)")


def softmax(arr: Column) -> Column:
    """F8: probabilities from raw scores (max subtracted first)."""
    m = F.array_max(arr)
    e = F.transform(arr, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)
