"""Profiling aggregates (D1-D12) over the enriched snippets.

Every statistic is one hash aggregate with map-side partial aggregation;
the category domain (4 rows) is a literal broadcast relation joined
*after* aggregation, so no join ever touches unaggregated rows except
the box-plot whisker pass, which joins 4 rows of quartiles by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.functions import derive as B
from vulnlake.plans import domains as D
from vulnlake.plans.registry import register
from vulnlake.sources import views as V




def category_counts(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Rows per category in report order, absent categories 0."""
    counts = df.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    dom = F.broadcast(D.category_dim(spark).select("category", "report_ord"))
    return dom.join(counts, "category", "left").select(
        "category", "report_ord", F.coalesce(F.col("n"), F.lit(0)).alias("total_count"))


def published_rates(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Split count beside the published rate."""
    rates = F.broadcast(D.category_dim(spark).select("category", "insecure_rate_pct"))
    return category_counts(df, spark).join(rates, "category").select(
        "category", F.col("total_count").alias("split_count"),
        F.col("insecure_rate_pct").alias("guide_benchmark_insecure_rate_pct"))


def rate_frame(df: DataFrame, spark: SparkSession) -> DataFrame:
    """D3: counts full-outer-aligned with the published rates;
    insecure_count = half-even(total × rate / 100)."""
    counts = df.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    rates = D.category_dim(spark).select("category", "report_ord", "insecure_rate_pct")
    j = counts.join(F.broadcast(rates), "category", "full_outer")
    total = F.coalesce(F.col("n"), F.lit(0))
    return j.select(
        "category", "report_ord", total.alias("total_count"), "insecure_rate_pct",
        F.rint(total * F.col("insecure_rate_pct") / F.lit(100.0)).cast("long").alias("insecure_count"))


def category_share(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Share of the total in percent (2 dp) and a 1-dp label."""
    rf = rate_frame(df, spark)
    from pyspark.sql.window import Window
    # rf holds 4 aggregated rows, so a global window over it is harmless
    j = rf.withColumn("grand", F.sum("total_count").over(Window.partitionBy()).cast("double"))
    pct = F.col("total_count") / F.col("grand") * F.lit(100.0)
    return j.select("category", "report_ord", "total_count", "insecure_rate_pct",
                    B.round_half_even(pct, 2).alias("share_pct"),
                    F.format_string("%.1f%%", pct).alias("share_label"))


def feature_stats(df: DataFrame, by: str, cols=("num_tokens", "num_lines"), domain: DataFrame | None = None,
                  approx: bool = False) -> DataFrame:
    """Mean, median, sample std, min, max per group, rounded 2 dp
    half-even; with a domain, absent groups appear with nulls.  The exact
    median keeps a value→count map per group (bounded by distinct values);
    approx=True uses the percentile_approx sketch instead."""
    aggs = []
    for c in cols:
        med = F.percentile_approx(c, 0.5).cast("double") if approx else F.median(c)
        aggs += [
            B.round_half_even(F.avg(c), 2).alias(f"{c}_mean"),
            B.round_half_even(med, 2).alias(f"{c}_median"),
            B.round_half_even(F.stddev_samp(c), 2).alias(f"{c}_std"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
    st = df.groupBy(by).agg(*aggs)
    if domain is not None:
        st = F.broadcast(domain).join(st, by, "left")
    return st


def top_cwes(df: DataFrame, k: int = 15) -> DataFrame:
    """Count per (cwe, category), top k by count desc then cwe asc."""
    return (df.where(F.col("cwe").isNotNull()).groupBy("cwe", "category").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("cwe").asc()).limit(k))


def source_distribution(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Count per (category, source); values outside the source
    domain become null and sort last."""
    counts = (df.where(F.col("source").isNotNull()).groupBy("category", "source").agg(F.count(F.lit(1)).alias("count")))
    cat = F.broadcast(D.category_dim(spark).select("category", F.col("report_ord").alias("category_ord")))
    src = F.broadcast(D.source_dim(spark).select(F.col("display").alias("source"), "source_ord"))
    j = counts.join(cat, "category", "left").join(src, "source", "left")
    return j.select("category", F.when(F.col("source_ord").isNotNull(), F.col("source")).alias("source"),
                    "count", "category_ord", "source_ord")


def box_stats(df: DataFrame, col: str, by: str) -> DataFrame:
    """Quartiles (linear interpolation), 1.5·IQR whiskers at the
    furthest point inside, outlier count.

    The rows are first reduced to a histogram (group, value, frequency) —
    one pass, map-side combined — and every statistic is computed from it
    (weighted percentile, then whiskers over the histogram)."""
    hist = df.groupBy(by, col).agg(F.count(F.lit(1)).alias("freq"))
    q = (hist.groupBy(by).agg(F.percentile(col, [0.25, 0.5, 0.75], F.col("freq")).alias("q"))
         .select(by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
         .withColumn("iqr", F.col("q3") - F.col("q1")))
    lo = F.col("q1") - F.lit(1.5) * F.col("iqr")
    hi = F.col("q3") + F.lit(1.5) * F.col("iqr")
    x = F.col(col)
    # q has one row per group: broadcast it onto the histogram
    j = hist.join(F.broadcast(q), by)
    return j.groupBy(by, "q1", "median", "q3", "iqr").agg(
        F.min(F.when(x >= lo, x)).alias("whisker_low"),
        F.max(F.when(x <= hi, x)).alias("whisker_high"),
        F.sum(F.when((x < lo) | (x > hi), F.col("freq")).otherwise(0)).cast("long").alias("n_outliers"),
    )


def rate_matrix(df: DataFrame, spark: SparkSession) -> DataFrame:
    """3 × 4 matrix (insecure count, total, rate) by category."""
    rf = rate_frame(df, spark)
    long = rf.select("category", F.expr(
        "stack(3, 'Insecure count', 0, CAST(insecure_count AS DOUBLE), "
        "'Total count', 1, CAST(total_count AS DOUBLE), "
        "'Insecure rate (%)', 2, insecure_rate_pct) AS (metric, metric_ord, value)"))
    return long.groupBy("metric", "metric_ord").pivot("category", D.CATEGORY_ORDER).agg(F.first("value"))


def rate_ranking(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Categories ascending by rate, report order breaks ties."""
    from pyspark.sql.window import Window
    rf = rate_frame(df, spark)
    # 4 aggregated rows; a global window over them is harmless
    w = Window.orderBy(F.col("insecure_rate_pct").asc(), F.col("report_ord").asc())
    return rf.select("category", "insecure_rate_pct", F.row_number().over(w).alias("rank"))


def cwe_coverage(df: DataFrame) -> DataFrame:
    """Distinct CWEs, exact and approximate, overall and per category."""
    overall = df.agg(F.lit("all").alias("scope"), F.countDistinct("cwe").alias("n_cwe"),
                     F.approx_count_distinct("cwe").alias("n_cwe_approx"))
    per = df.groupBy(F.col("category").alias("scope")).agg(
        F.countDistinct("cwe").alias("n_cwe"), F.approx_count_distinct("cwe").alias("n_cwe_approx"))
    return overall.unionByName(per)


def size_by_class(df: DataFrame) -> DataFrame:
    """Mean / median token length per class, longest first."""
    from pyspark.sql.window import Window
    st = df.groupBy("category").agg(B.round_half_even(F.avg("num_tokens"), 2).alias("mean_tokens"),
                                    B.round_half_even(F.median("num_tokens"), 2).alias("median_tokens"))
    w = Window.orderBy(F.col("mean_tokens").desc(), F.col("category").asc())
    return st.withColumn("rank", F.row_number().over(w))


# --------------------------------- SQL -------------------------------------

def _sql_dim() -> str:
    rows = ", ".join(f"('{c}', {D.CATEGORY_ORDER.index(c)}, {D.PUBLISHED_RATES[c]!r})" for c in D.CATEGORY_ORDER)
    return f"(SELECT category, CAST(report_ord AS INTEGER) AS report_ord, CAST(rate AS DOUBLE) AS insecure_rate_pct FROM (VALUES {rows}) d(category, report_ord, rate))"


def _sql_rate_frame() -> str:
    return (f"SELECT coalesce(c.category, d.category) AS category, d.report_ord, CAST(coalesce(c.n, 0) AS BIGINT) AS total_count, "
            f"d.insecure_rate_pct, CAST(round_even(coalesce(c.n, 0) * d.insecure_rate_pct / 100.0, 0) AS BIGINT) AS insecure_count "
            f"FROM (SELECT category, count(*) AS n FROM enriched GROUP BY 1) c FULL OUTER JOIN {_sql_dim()} d ON c.category = d.category")


def _with(extra=None):
    return V.with_views("enriched", extra=extra)


def _feature_sql(by: str, src: str, cols=("num_tokens", "num_lines")) -> str:
    parts = []
    for c in cols:
        parts += [f"{B.sql_round_half_even(f'avg({c})', 2)} AS {c}_mean",
                  f"{B.sql_round_half_even(f'median({c})', 2)} AS {c}_median",
                  f"{B.sql_round_half_even(f'stddev_samp({c})', 2)} AS {c}_std",
                  f"min({c}) AS {c}_min", f"max({c}) AS {c}_max"]
    return f"SELECT {by}, {', '.join(parts)} FROM {src} GROUP BY {by}"


# -------------------------------- queries ----------------------------------

def _en(spark, sf):
    return V.enriched_snippets(spark, sf)


@register("category_counts", lambda: _with() +
          f"SELECT d.category, d.report_ord, CAST(coalesce(c.n, 0) AS BIGINT) AS total_count FROM {_sql_dim()} d "
          "LEFT JOIN (SELECT category, count(*) AS n FROM enriched GROUP BY 1) c USING (category)")
def q_category_counts(spark, sf):
    return category_counts(_en(spark, sf).select("category"), spark)


@register("published_rates", lambda: _with() +
          f"SELECT d.category, CAST(coalesce(c.n, 0) AS BIGINT) AS split_count, d.insecure_rate_pct AS guide_benchmark_insecure_rate_pct "
          f"FROM {_sql_dim()} d LEFT JOIN (SELECT category, count(*) AS n FROM enriched GROUP BY 1) c USING (category)")
def q_published_rates(spark, sf):
    return published_rates(_en(spark, sf).select("category"), spark)


@register("rate_frame", lambda: _with() + _sql_rate_frame())
def q_rate_frame(spark, sf):
    return rate_frame(_en(spark, sf).select("category"), spark)


@register("category_share", lambda: _with([("rf", _sql_rate_frame())]) +
          f"SELECT category, report_ord, total_count, insecure_rate_pct, "
          f"{B.sql_round_half_even('total_count / grand * 100.0', 2)} AS share_pct, "
          f"printf('%.1f%%', total_count / grand * 100.0) AS share_label "
          f"FROM rf, (SELECT CAST(sum(total_count) AS DOUBLE) AS grand FROM rf) g")
def q_category_share(spark, sf):
    return category_share(_en(spark, sf).select("category"), spark)


@register("feature_stats", lambda: _with() +
          f"SELECT d.category, s.* EXCLUDE (category) FROM {_sql_dim()} d LEFT JOIN ({_feature_sql('category', 'enriched')}) s USING (category)")
def q_feature_stats(spark, sf):
    dom = D.category_dim(spark).select("category")
    return feature_stats(_en(spark, sf).select("category", "num_tokens", "num_lines"), "category", domain=dom)


@register("feature_stats_by_lang", lambda:
          _feature_sql("lang", f"(SELECT lang, {B.sql_num_tokens('text')} AS num_tokens, {B.sql_num_lines('text')} AS num_lines FROM documents) x"))
def q_feature_stats_by_lang(spark, sf):
    doc = V.table(spark, sf, "documents")
    x = doc.select("lang", B.num_tokens(F.col("text")).alias("num_tokens"), B.num_lines(F.col("text")).alias("num_lines"))
    return feature_stats(x, "lang")


@register("top_cwes", lambda: _with() +
          "SELECT cwe, category, count(*) AS count FROM enriched WHERE cwe IS NOT NULL GROUP BY 1, 2 "
          "ORDER BY count DESC, cwe ASC LIMIT 15")
def q_top_cwes(spark, sf):
    return top_cwes(_en(spark, sf).select("cwe", "category"))


def _sql_source_dim() -> str:
    rows = ", ".join(f"('{v}', {D.SOURCE_ORDER.index(v)})" for v in D.SOURCE_DISPLAY.values())
    return f"(SELECT display, CAST(o AS INTEGER) AS source_ord FROM (VALUES {rows}) s(display, o))"


@register("source_distribution", lambda: _with() +
          f"SELECT c.category, CASE WHEN s.source_ord IS NOT NULL THEN c.source END AS source, c.count, d.report_ord AS category_ord, s.source_ord "
          f"FROM (SELECT category, source, count(*) AS count FROM enriched WHERE source IS NOT NULL GROUP BY 1, 2) c "
          f"LEFT JOIN {_sql_dim()} d ON c.category = d.category LEFT JOIN {_sql_source_dim()} s ON c.source = s.display")
def q_source_distribution(spark, sf):
    return source_distribution(_en(spark, sf).select("category", "source"), spark)


@register("box_stats", lambda: _with([("q", "SELECT category, q[1] AS q1, q[2] AS median, q[3] AS q3, q[3] - q[1] AS iqr FROM "
                                           "(SELECT category, quantile_cont(CAST(num_tokens AS DOUBLE), [0.25, 0.5, 0.75]) AS q FROM enriched GROUP BY 1) z")]) +
          "SELECT e.category, q.q1, q.median, q.q3, q.iqr, "
          "min(CASE WHEN num_tokens >= q1 - 1.5 * iqr THEN num_tokens END) AS whisker_low, "
          "max(CASE WHEN num_tokens <= q3 + 1.5 * iqr THEN num_tokens END) AS whisker_high, "
          "CAST(sum(CASE WHEN num_tokens < q1 - 1.5 * iqr OR num_tokens > q3 + 1.5 * iqr THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers "
          "FROM enriched e JOIN q USING (category) GROUP BY 1, 2, 3, 4, 5")
def q_box_stats(spark, sf):
    return box_stats(_en(spark, sf).select("category", "num_tokens"), "num_tokens", "category")


@register("rate_matrix", lambda: _with([("rf", _sql_rate_frame())]) +
          "SELECT metric, metric_ord, " + ", ".join(
              f"max(CASE WHEN category = '{c}' THEN value END) AS {c}" for c in D.CATEGORY_ORDER) +
          " FROM (SELECT category, 'Insecure count' AS metric, 0 AS metric_ord, CAST(insecure_count AS DOUBLE) AS value FROM rf "
          "UNION ALL SELECT category, 'Total count', 1, CAST(total_count AS DOUBLE) FROM rf "
          "UNION ALL SELECT category, 'Insecure rate (%)', 2, insecure_rate_pct FROM rf) l GROUP BY 1, 2")
def q_rate_matrix(spark, sf):
    return rate_matrix(_en(spark, sf).select("category"), spark)


@register("rate_ranking", lambda: _with([("rf", _sql_rate_frame())]) +
          "SELECT category, insecure_rate_pct, CAST(row_number() OVER (ORDER BY insecure_rate_pct ASC, report_ord ASC) AS INTEGER) AS rank FROM rf")
def q_rate_ranking(spark, sf):
    return rate_ranking(_en(spark, sf).select("category"), spark)


@register("cwe_coverage", lambda: _with() +
          "SELECT 'all' AS scope, count(DISTINCT cwe) AS n_cwe FROM enriched "
          "UNION ALL SELECT category, count(DISTINCT cwe) FROM enriched GROUP BY category")
def q_cwe_coverage(spark, sf):
    return cwe_coverage(_en(spark, sf).select("category", "cwe")).drop("n_cwe_approx")


# HyperLogLog sketches differ between engines: rows-only check.
@register("cwe_coverage_approx")
def q_cwe_coverage_approx(spark, sf):
    return cwe_coverage(_en(spark, sf).select("category", "cwe"))


@register("size_by_class", lambda: _with() +
          f"SELECT category, mean_tokens, median_tokens, CAST(row_number() OVER (ORDER BY mean_tokens DESC, category ASC) AS INTEGER) AS rank FROM "
          f"(SELECT category, {B.sql_round_half_even('avg(num_tokens)', 2)} AS mean_tokens, "
          f"{B.sql_round_half_even('median(num_tokens)', 2)} AS median_tokens FROM enriched GROUP BY 1) s")
def q_size_by_class(spark, sf):
    return size_by_class(_en(spark, sf).select("category", "num_tokens"))
