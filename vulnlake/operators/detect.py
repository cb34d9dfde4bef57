"""Rule detection, explanation and remediation operators.

All operators are projections plus (at most) one aggregation over a scan;
metadata tables are fixed literal relations of ≤ 5 rows and are broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.functions import derive as B
from vulnlake.functions import rules as R
from vulnlake.functions.rules import sql_str
from vulnlake.plans import domains as D
from vulnlake.plans.registry import register
from vulnlake.sources import views as V

VERDICTS = ["sql_injection", "weak_crypto", "hardcoded_secret", "safe"]


# ------------------------------- operators ---------------------------------

def with_flags(df: DataFrame, code: str = "insecure_code") -> DataFrame:
    c = F.col(code)
    return df.withColumns({"flag_sqli": R.flag_sqli(c), "flag_crypto": R.flag_crypto(c),
                           "flag_secret": R.flag_secret(c)})


def with_verdict(df: DataFrame, policy: str = "component", code: str = "insecure_code", name: str = "verdict") -> DataFrame:
    return df.withColumn(name, R.verdict(F.col(code), policy))


def policy_diff(df: DataFrame, code: str = "insecure_code") -> DataFrame:
    """Snippets where the two priority policies disagree, by verdict pair."""
    both = df.select(R.verdict(F.col(code), "component").alias("verdict_component"),
                     R.verdict(F.col(code), "page").alias("verdict_page"))
    agree = ((F.col("verdict_component") == F.col("verdict_page"))
             | ((F.col("verdict_component") == "safe") & (F.col("verdict_page") == "secure")))
    # Filter after the aggregate, on an aggregate output: a row filter on the
    # verdicts would be pushed below the projection with both 35-rule
    # verdicts copied into it (three evaluations each).  `agree` is constant
    # within a (component, page) group, so the rows are the same.
    counts = both.groupBy("verdict_component", "verdict_page").agg(
        F.count(F.lit(1)).alias("n"), F.max(agree.cast("int")).alias("_agree"))
    return counts.where(F.col("_agree") == 0).drop("_agree")


def rule_hits(df: DataFrame, key: str = "doc_id", code: str = "insecure_code") -> DataFrame:
    """Long table (key, family, rule_id) of every rule that fires.
    Each rule runs once per row, only where its needles occur.

    The lower-cased text and the slot array are projected before the
    explode: Spark shares repeated subexpressions inside a Project but not
    inside a generator, where lower(code) would be recomputed for every
    needle test of every rule."""
    low = df.select(F.col(key), F.col(code), F.lower(F.col(code)).alias("_low"))
    slots = low.select(F.col(key), R.rule_hit_slots(F.col(code), F.col("_low")).alias("_slots"))
    # explode_outer: a plain explode makes the optimizer infer a
    # size(slots) > 0 filter and push a copy of all 35 rules down to the
    # scan, running every rule twice.  The slot array is never empty.
    return (slots.select(F.col(key), F.explode_outer("_slots").alias("rule_id"))
            .where(F.col("rule_id").isNotNull())
            .withColumn("family", R.rule_family(F.col("rule_id"))))


def rule_hit_counts(df: DataFrame, key: str = "doc_id", code: str = "insecure_code") -> DataFrame:
    return rule_hits(df, key, code).groupBy("rule_id", "family").agg(F.count(F.lit(1)).alias("n"))


def multi_flags(df: DataFrame, code: str = "insecure_code") -> DataFrame:
    """Three independent detectors and their co-occurrence counts."""
    return (with_flags(df, code).groupBy("flag_sqli", "flag_crypto", "flag_secret")
            .agg(F.count(F.lit(1)).alias("n")))


def enrich_verdict(df: DataFrame, spark: SparkSession, policy: str = "component") -> DataFrame:
    """Join the verdict metadata (4 literal rows, broadcast)."""
    meta = D.verdict_meta_dim(spark, policy)
    return df.join(F.broadcast(meta), "verdict", "left")


def remediation(df: DataFrame, spark: SparkSession) -> DataFrame:
    """C11: verdict → CWE reference and fix text; unmapped verdicts get nulls."""
    return df.join(F.broadcast(D.remediation_dim(spark)), "verdict", "left")


def _alternatives(verdict: str, lower: bool = False) -> str | None:
    """One group that matches any risky token of the verdict literally."""
    quoted = [re.escape(t.lower() if lower else t) for t in D.VERDICT_META_COMPONENT[verdict][5] if t]
    return f"({'|'.join(quoted)})" if quoted else None


def risky_pattern(verdict: str) -> str | None:
    group = _alternatives(verdict)
    return group and "(?i)" + group


def _by_verdict(verdict_col, make):
    expr = None
    for v in VERDICTS:
        p = risky_pattern(v)
        if p is None:
            continue
        cond = verdict_col == F.lit(v)
        expr = F.when(cond, make(p)) if expr is None else expr.when(cond, make(p))
    return expr


def risky_tokens(df: DataFrame, key: str = "doc_id", code: str = "insecure_code") -> DataFrame:
    """Every risky-token occurrence with its ordinal (list order wins)."""
    arr = _by_verdict(F.col("verdict"), lambda p: F.regexp_extract_all(F.col(code), F.lit(p), 1))
    # outer + null filter: same rows as posexplode, without the inferred
    # size(toks) > 0 filter that would repeat the extraction at the scan
    return (df.select(F.col(key), F.col("verdict"), arr.alias("toks"))
            .select(key, "verdict", F.posexplode_outer("toks").alias("pos", "token"))
            .where(F.col("token").isNotNull()))


def highlight(df: DataFrame, code: str = "insecure_code") -> DataFrame:
    """Wrap risky tokens in <mark>…</mark>; an empty list returns the code."""
    marked = _by_verdict(F.col("verdict"), lambda p: F.regexp_replace(F.col(code), p, "<mark>$1</mark>"))
    return df.withColumn("highlighted", F.coalesce(marked, F.col(code)))


def lower_risky_pattern(verdict: str) -> str | None:
    """Case-sensitive pattern of the lower-cased tokens, for lower-cased text."""
    return _alternatives(verdict, lower=True)


def risky_token_counts(df: DataFrame, k: int = 5, key: str = "doc_id", code: str = "insecure_code") -> DataFrame:
    """C14: token frequency per verdict, top k (count desc, token asc).

    Only lower-cased tokens are counted, so they are extracted from the
    lower-cased text with a case-sensitive pattern (the same matches as the
    case-insensitive one on the original text, at a fraction of the cost)."""
    from pyspark.sql.window import Window
    low = F.lower(F.col(code))
    expr = None
    for v in VERDICTS:
        p = lower_risky_pattern(v)
        if p is None:
            continue
        cond, val = F.col("verdict") == F.lit(v), F.regexp_extract_all(low, F.lit(p), 1)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    toks = df.select("verdict", F.explode_outer(expr).alias("token")).where(F.col("token").isNotNull())
    counts = toks.groupBy("verdict", "token").agg(F.count(F.lit(1)).alias("n"))
    # at most (#verdicts × #tokens) rows after the aggregate: the window is tiny
    w = Window.partitionBy("verdict").orderBy(F.col("n").desc(), F.col("token").asc())
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def by_language(df: DataFrame) -> DataFrame:
    """Verdict counts per language (pivot with a fixed value list)."""
    return (df.groupBy("lang").pivot("verdict", VERDICTS).agg(F.count(F.lit(1)))
            .fillna(0, subset=VERDICTS))


def example_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insecure/fixed pair per class, one pair per document (doc_id mod 3),
    document text as prefix: two rows per document, no join."""
    doc = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    n = len(D.EXAMPLE_PAIRS)
    idx = (F.col("doc_id") % n + 1).cast("int")
    cls = F.element_at(F.array(*[F.lit(p[0]) for p in D.EXAMPLE_PAIRS]), idx)
    bad = F.element_at(F.array(*[F.lit(p[1]) for p in D.EXAMPLE_PAIRS]), idx)
    good = F.element_at(F.array(*[F.lit(p[2]) for p in D.EXAMPLE_PAIRS]), idx)
    sides = F.array(
        F.struct(cls.alias("expected"), F.concat(F.col("text"), F.lit("\n"), bad).alias("code")),
        F.struct(F.lit("safe").alias("expected"), F.concat(F.col("text"), F.lit("\n"), good).alias("code")),
    )
    return doc.select("doc_id", F.inline_outer(sides))  # two structs per row: same rows, no inferred filter


def rule_quality(pairs: DataFrame, strict: bool = False) -> DataFrame:
    """Hit / miss / false alarm per expected class (strict=True: the
    '%' rule ignores a bare %s placeholder before a quote)."""
    v = pairs.withColumn("verdict", R.verdict(F.col("code"), "component", strict))
    outcome = (F.when((F.col("expected") != "safe") & (F.col("verdict") == F.col("expected")), "hit")
               .when(F.col("expected") != "safe", "miss")
               .when(F.col("verdict") != "safe", "false_alarm")
               .otherwise("correct_clean"))
    return v.groupBy("expected", "verdict", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def default_blank(code, default: str = D.DEFAULT_SNIPPET):
    """C17: empty input → the default snippet."""
    return F.coalesce(F.nullif(code, F.lit("")), F.lit(default))


def risk_legend(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Legend LEFT JOIN severity counts (MEDIUM is never produced → 0)."""
    counts = (enrich_verdict(df, spark).groupBy("severity").agg(F.count(F.lit(1)).alias("n")))
    return (F.broadcast(D.legend_dim(spark)).join(counts, "severity", "left")
            .select("severity", "legend_ord", "color", "meaning", "action",
                    F.coalesce(F.col("n"), F.lit(0)).alias("n")))


# ------------------------------ SQL helpers --------------------------------

def _sql_by_verdict(make: str) -> str:
    whens = []
    for v in VERDICTS:
        p = risky_pattern(v)
        if p is None:
            continue
        whens.append(f"WHEN verdict = '{v}' THEN {make.format(p=sql_str(p))}")
    return "CASE " + " ".join(whens) + " END"


def _sql_meta(policy: str) -> str:
    if policy == "component":
        rows = []
        for k, (sev, title, detail, learn, rem, toks) in D.VERDICT_META_COMPONENT.items():
            lst = "CAST([" + ", ".join(sql_str(t) for t in toks) + "] AS VARCHAR[])"
            rows.append(f"({sql_str(k)}, {sql_str(sev)}, {sql_str(title)}, {sql_str(detail)}, {sql_str(learn)}, {sql_str(rem)}, {lst})")
        return ("SELECT * FROM (VALUES " + ", ".join(rows) +
                ") m(verdict, severity, title, detail, learn, remediation, risky_tokens)")
    rows = [f"({sql_str(k)}, {sql_str(a)}, {sql_str(b)}, {sql_str(c)}, {sql_str(d)})"
            for k, (a, b, c, d) in D.VERDICT_META_PAGE.items()]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") m(verdict, severity, title, detail, remediation)"


# ------------------------------- queries -----------------------------------

def _snip(spark, sf):
    return V.snippets(spark, sf)


@register("flag_sqli", lambda: V.with_views("snippets") +
          f"SELECT doc_id, id, {R.sql_family_flag('insecure_code', 'sql_injection')} AS flag_sqli FROM snippets")
def q_flag_sqli(spark, sf):
    return _snip(spark, sf).select("doc_id", "id", R.flag_sqli(F.col("insecure_code")).alias("flag_sqli"))


@register("flag_crypto", lambda: V.with_views("snippets") +
          f"SELECT doc_id, id, {R.sql_family_flag('insecure_code', 'weak_crypto')} AS flag_crypto FROM snippets")
def q_flag_crypto(spark, sf):
    return _snip(spark, sf).select("doc_id", "id", R.flag_crypto(F.col("insecure_code")).alias("flag_crypto"))


@register("flag_secret", lambda: V.with_views("snippets") +
          f"SELECT doc_id, id, {R.sql_family_flag('insecure_code', 'hardcoded_secret')} AS flag_secret FROM snippets")
def q_flag_secret(spark, sf):
    return _snip(spark, sf).select("doc_id", "id", R.flag_secret(F.col("insecure_code")).alias("flag_secret"))


@register("flag_secret_documents", lambda:
          f"SELECT doc_id, {R.sql_family_flag('text', 'hardcoded_secret')} AS flag_secret FROM documents")
def q_flag_secret_documents(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", R.flag_secret(F.col("text")).alias("flag_secret"))


@register("verdict_component", lambda: V.with_views("snippets") +
          f"SELECT doc_id, id, {R.sql_verdict('insecure_code', 'component')} AS verdict FROM snippets")
def q_verdict_component(spark, sf):
    return with_verdict(_snip(spark, sf), "component").select("doc_id", "id", "verdict")


@register("verdict_page", lambda: V.with_views("snippets") +
          f"SELECT doc_id, id, {R.sql_verdict('insecure_code', 'page')} AS verdict FROM snippets")
def q_verdict_page(spark, sf):
    return with_verdict(_snip(spark, sf), "page").select("doc_id", "id", "verdict")


@register("policy_diff", lambda: V.with_views("snippets") +
          f"SELECT verdict_component, verdict_page, count(*) AS n FROM (SELECT "
          f"{R.sql_verdict('insecure_code', 'component')} AS verdict_component, "
          f"{R.sql_verdict('insecure_code', 'page')} AS verdict_page FROM snippets) b "
          f"WHERE NOT (verdict_component = verdict_page OR (verdict_component = 'safe' AND verdict_page = 'secure')) "
          f"GROUP BY 1, 2")
def q_policy_diff(spark, sf):
    return policy_diff(_snip(spark, sf))


@register("rule_hits", lambda: V.with_views("snippets") +
          f"SELECT doc_id, rule_id, {R.sql_rule_family('rule_id')} AS family FROM "
          f"(SELECT doc_id, unnest({R.sql_rule_hit_ids('insecure_code')}) AS rule_id FROM snippets) h")
def q_rule_hits(spark, sf):
    return rule_hits(_snip(spark, sf))


@register("rule_hit_counts", lambda: V.with_views("snippets") +
          f"SELECT rule_id, {R.sql_rule_family('rule_id')} AS family, count(*) AS n FROM "
          f"(SELECT doc_id, unnest({R.sql_rule_hit_ids('insecure_code')}) AS rule_id FROM snippets) h GROUP BY 1, 2")
def q_rule_hit_counts(spark, sf):
    return rule_hit_counts(_snip(spark, sf))


@register("multi_flags", lambda: V.with_views("snippets") +
          f"SELECT {R.sql_family_flag('insecure_code', 'sql_injection')} AS flag_sqli, "
          f"{R.sql_family_flag('insecure_code', 'weak_crypto')} AS flag_crypto, "
          f"{R.sql_family_flag('insecure_code', 'hardcoded_secret')} AS flag_secret, count(*) AS n "
          f"FROM snippets GROUP BY 1, 2, 3")
def q_multi_flags(spark, sf):
    return multi_flags(_snip(spark, sf))


@register("confidence", lambda: V.with_views("snippets") +
          f"SELECT doc_id, id, verdict, {B.sql_confidence('id', 'verdict')} AS confidence FROM "
          f"(SELECT doc_id, id, {R.sql_verdict('insecure_code')} AS verdict FROM snippets) v")
def q_confidence(spark, sf):
    v = with_verdict(_snip(spark, sf)).select("doc_id", "id", "verdict")
    return v.withColumn("confidence", B.confidence(F.col("id"), F.col("verdict")))


@register("enrich_verdict", lambda: V.with_views("snippets") +
          f"SELECT v.doc_id, v.verdict, v.confidence, m.severity, m.title, m.detail, m.learn, m.remediation, m.risky_tokens FROM "
          f"(SELECT doc_id, verdict, {B.sql_confidence('id', 'verdict')} AS confidence FROM "
          f"(SELECT doc_id, id, {R.sql_verdict('insecure_code')} AS verdict FROM snippets) x) v "
          f"LEFT JOIN ({_sql_meta('component')}) m USING (verdict)")
def q_enrich_verdict(spark, sf):
    v = with_verdict(_snip(spark, sf)).select("doc_id", "id", "verdict")
    v = v.withColumn("confidence", B.confidence(F.col("id"), F.col("verdict"))).drop("id")
    return enrich_verdict(v, spark, "component")


@register("enrich_verdict_page", lambda: V.with_views("snippets") +
          f"SELECT v.doc_id, v.verdict, m.severity, m.title, m.detail, m.remediation FROM "
          f"(SELECT doc_id, {R.sql_verdict('insecure_code', 'page')} AS verdict FROM snippets) v "
          f"LEFT JOIN ({_sql_meta('page')}) m USING (verdict)")
def q_enrich_verdict_page(spark, sf):
    v = with_verdict(_snip(spark, sf), "page").select("doc_id", "verdict")
    return enrich_verdict(v, spark, "page")


def _sql_remediation():
    rows = ", ".join(f"({sql_str(v)}, {sql_str(c)}, {sql_str(D.VERDICT_META_COMPONENT[v][4])})"
                     for v, c in (("sql_injection", "CWE-089"), ("weak_crypto", "CWE-327"), ("hardcoded_secret", "CWE-798")))
    return f"SELECT * FROM (VALUES {rows}) r(verdict, cwe_ref, fix)"


@register("remediation", lambda: V.with_views("snippets") +
          f"SELECT v.doc_id, v.verdict, r.cwe_ref, r.fix FROM "
          f"(SELECT doc_id, {R.sql_verdict('insecure_code')} AS verdict FROM snippets) v "
          f"LEFT JOIN ({_sql_remediation()}) r USING (verdict)")
def q_remediation(spark, sf):
    v = with_verdict(_snip(spark, sf)).select("doc_id", "verdict")
    return remediation(v, spark)


@register("risky_tokens", lambda: V.with_views("snippets") +
          "SELECT doc_id, verdict, CAST(unnest(generate_series(0, len(toks) - 1)) AS INTEGER) AS pos, unnest(toks) AS token FROM "
          f"(SELECT doc_id, verdict, {_sql_by_verdict('regexp_extract_all(insecure_code, {p}, 1)')} AS toks FROM "
          f"(SELECT doc_id, insecure_code, {R.sql_verdict('insecure_code')} AS verdict FROM snippets) v) t "
          "WHERE toks IS NOT NULL AND len(toks) > 0")
def q_risky_tokens(spark, sf):
    return risky_tokens(with_verdict(_snip(spark, sf)))


_SQL_MARK = "regexp_replace(insecure_code, {p}, " + sql_str("<mark>\\1</mark>") + ", 'g')"


@register("highlight", lambda: V.with_views("snippets") +
          f"SELECT doc_id, verdict, coalesce({_sql_by_verdict(_SQL_MARK)}, insecure_code) AS highlighted FROM "
          f"(SELECT doc_id, insecure_code, {R.sql_verdict('insecure_code')} AS verdict FROM snippets) v")
def q_highlight(spark, sf):
    return highlight(with_verdict(_snip(spark, sf))).select("doc_id", "verdict", "highlighted")


@register("risky_token_counts", lambda: V.with_views("snippets") +
          "SELECT verdict, token, n, CAST(rank AS INTEGER) AS rank FROM (SELECT verdict, token, n, "
          "row_number() OVER (PARTITION BY verdict ORDER BY n DESC, token ASC) AS rank FROM "
          "(SELECT verdict, lower(token) AS token, count(*) AS n FROM "
          f"(SELECT doc_id, verdict, unnest({_sql_by_verdict('regexp_extract_all(insecure_code, {p}, 1)')}) AS token FROM "
          f"(SELECT doc_id, insecure_code, {R.sql_verdict('insecure_code')} AS verdict FROM snippets) v) t "
          "GROUP BY 1, 2) c) r WHERE rank <= 5")
def q_risky_token_counts(spark, sf):
    return risky_token_counts(with_verdict(_snip(spark, sf)), 5)


@register("by_language", lambda: V.with_views("snippets") +
          "SELECT lang, " + ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in VERDICTS) +
          f" FROM (SELECT lang, {R.sql_verdict('insecure_code')} AS verdict FROM snippets) v GROUP BY lang")
def q_by_language(spark, sf):
    return by_language(with_verdict(_snip(spark, sf)).select("lang", "verdict"))


def _sql_pairs():
    n = len(D.EXAMPLE_PAIRS)
    cls = "[" + ", ".join(sql_str(p[0]) for p in D.EXAMPLE_PAIRS) + f"][doc_id % {n} + 1]"
    bad = "[" + ", ".join(sql_str(p[1]) for p in D.EXAMPLE_PAIRS) + f"][doc_id % {n} + 1]"
    good = "[" + ", ".join(sql_str(p[2]) for p in D.EXAMPLE_PAIRS) + f"][doc_id % {n} + 1]"
    return (f"SELECT doc_id, {cls} AS expected, text || chr(10) || {bad} AS code FROM documents "
            f"UNION ALL SELECT doc_id, 'safe' AS expected, text || chr(10) || {good} AS code FROM documents")


def _sql_rule_quality(strict: bool) -> str:
    return ("SELECT expected, verdict, CASE WHEN expected <> 'safe' AND verdict = expected THEN 'hit' "
            "WHEN expected <> 'safe' THEN 'miss' WHEN verdict <> 'safe' THEN 'false_alarm' ELSE 'correct_clean' END AS outcome, "
            f"count(*) AS n FROM (SELECT expected, {R.sql_verdict('code', 'component', strict)} AS verdict FROM ({_sql_pairs()}) p) v "
            "GROUP BY 1, 2, 3")


@register("rule_quality", lambda: _sql_rule_quality(False))
def q_rule_quality(spark, sf):
    return rule_quality(example_pairs(spark, sf))


@register("rule_quality_strict", lambda: _sql_rule_quality(True))
def q_rule_quality_strict(spark, sf):
    return rule_quality(example_pairs(spark, sf), strict=True)


_SQL_DEFAULTED = "coalesce(nullif(text, ''), " + sql_str(D.DEFAULT_SNIPPET) + ")"


@register("default_blank", lambda:
          f"SELECT doc_id, (text IS NULL OR text = '') AS defaulted, "
          f"{R.sql_verdict(_SQL_DEFAULTED, 'page')} AS verdict FROM documents")
def q_default_blank(spark, sf):
    doc = V.table(spark, sf, "documents")
    code = default_blank(F.col("text"))
    return doc.select("doc_id", (F.col("text").isNull() | (F.col("text") == "")).alias("defaulted"),
                      R.verdict(code, "page").alias("verdict"))


def _sql_legend():
    rows = ", ".join(f"({sql_str(s)}, {i}, {sql_str(c)}, {sql_str(m)}, {sql_str(a)})"
                     for i, (s, c, m, a) in enumerate(D.RISK_LEGEND))
    return f"SELECT * FROM (VALUES {rows}) l(severity, legend_ord, color, meaning, action)"


@register("risk_legend", lambda: V.with_views("snippets") +
          "SELECT l.severity, l.legend_ord, l.color, l.meaning, l.action, coalesce(c.n, 0) AS n FROM "
          f"({_sql_legend()}) l LEFT JOIN (SELECT m.severity, count(*) AS n FROM "
          f"(SELECT {R.sql_verdict('insecure_code')} AS verdict FROM snippets) v "
          f"LEFT JOIN ({_sql_meta('component')}) m USING (verdict) GROUP BY 1) c USING (severity)")
def q_risk_legend(spark, sf):
    v = with_verdict(_snip(spark, sf)).select("verdict")
    return risk_legend(v, spark)
