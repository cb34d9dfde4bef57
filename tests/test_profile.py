"""Golden class table of the studied corpus (121 rows: 6, 6, 7, 102)."""

from vulnlake.operators import profile as P

GOLDEN = {"sql_injection": 6, "hardcoded_secret": 6, "weak_crypto": 7, "other_vuln": 102}


def _frame(spark, counts):
    rows = [(c,) for c, n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "category string")


def test_rate_frame_and_share(spark):
    df = _frame(spark, GOLDEN)
    rf = {r.category: r for r in P.rate_frame(df, spark).collect()}
    assert {c: rf[c].total_count for c in GOLDEN} == GOLDEN
    # half-even rounding of total × rate / 100
    assert {c: rf[c].insecure_count for c in GOLDEN} == {"sql_injection": 6, "hardcoded_secret": 5,
                                                          "weak_crypto": 7, "other_vuln": 86}
    share = {r.category: r.share_pct for r in P.category_share(df, spark).collect()}
    assert share == {"sql_injection": 4.96, "hardcoded_secret": 4.96, "weak_crypto": 5.79, "other_vuln": 84.3}


def test_absent_category_is_zero_filled(spark):
    df = _frame(spark, {"other_vuln": 3})
    got = {r.category: r.total_count for r in P.category_counts(df, spark).collect()}
    assert got == {"sql_injection": 0, "hardcoded_secret": 0, "weak_crypto": 0, "other_vuln": 3}
    stats = {r.category: r.num_tokens_mean for r in P.feature_stats(
        spark.createDataFrame([("other_vuln", 1, 1)], "category string, num_tokens int, num_lines int"),
        "category", domain=P.D.category_dim(spark).select("category")).collect()}
    assert stats["sql_injection"] is None and stats["other_vuln"] == 1.0


def test_rate_ranking_ties_by_report_order(spark):
    ranks = {r.category: r.rank for r in P.rate_ranking(_frame(spark, GOLDEN), spark).collect()}
    assert ranks == {"hardcoded_secret": 1, "other_vuln": 2, "sql_injection": 3, "weak_crypto": 4}


def test_box_stats_against_numpy(spark):
    import numpy as np
    vals = [1, 2, 2, 3, 4, 5, 5, 6, 100]
    df = spark.createDataFrame([("a", v) for v in vals], "category string, num_tokens int")
    r = P.box_stats(df, "num_tokens", "category").collect()[0]
    q1, med, q3 = np.percentile(vals, [25, 50, 75])
    iqr = q3 - q1
    assert (r.q1, r.median, r.q3) == (q1, med, q3)
    assert r.whisker_high == max(v for v in vals if v <= q3 + 1.5 * iqr)
    assert r.n_outliers == sum(1 for v in vals if v < q1 - 1.5 * iqr or v > q3 + 1.5 * iqr)
