"""Cases that earlier versions got wrong."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vulnlake.functions import rules as R
from vulnlake.operators import audit, evaluation, history
from vulnlake.plans import registry
from vulnlake.sources import views as V
from vulnlake.streaming import streams as S


@pytest.mark.parametrize("text", ['sql = "select %' + " " * 1_000_000, 'sql = f"select ' + "{" * 1_000_000, "mongodb://a:" * 80_000,
                                  'Cipher.getInstance("' + "ECB" * 300_000, "postgresql://a:@" * 60_000], ids=["spaces", "braces", "urls", "quoted", "at"])
def test_rules_are_linear(spark, text):
    df = spark.createDataFrame([(text,)], "code string")
    t0 = time.time()
    df.select(F.array_compact(R.rule_hit_slots(F.col("code"))).alias("r")).collect()
    assert time.time() - t0 < 5


def test_rules_on_other_scripts_and_urls(spark):
    cases = {'épassword = "abcd1234"': True, 'password = "abcd1234"': True, 'xpassword = "abcd1234"': False, 'password\u0085= "abcd1234"': False,
             "mongodb://u:p@h": True, "mongodb://u:@h": False, "mongodb://u@v:p@h": True, "mongodb://u:p h@": False, "x@mongodb://u:p y mongodb://u:pp@z": True,
             "postgres://u:@mongodb://u:q@": True, "mongodb+srv://a:b c@d": False}
    df = spark.createDataFrame(list(cases.items()), "code string, want boolean")
    assert [r.code for r in df.where(R.flag_secret(F.col("code")) != F.col("want")).collect()] == []


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "doc_id long, lang string")
    assert Counter(r.doc_id for r in evaluation.stratified_folds(df, "lang", "doc_id").collect()) == Counter([1, 2, 3])
    assert evaluation.stratified_holdout(df, "lang", "doc_id").count() == evaluation.class_weights(df, "lang").count() == 3
    an = spark.createDataFrame([(1, None, 0, "safe"), (2, 7, 1, "safe"), (3, None, 2, "safe")], "analysis_id long, user_id long, t long, verdict string")
    an = an.withColumn("ts", F.timestamp_seconds("t"))
    assert {r.analysis_id: r.total for r in history.running_totals(an).collect()} == {1: 1, 2: 1, 3: 2}
    cached = an.withColumn("key", F.when(F.col("user_id") == 7, "k"))
    assert {r.analysis_id: r.hit for r in history.cache_hits(cached, "key").collect()} == {1: False, 2: False, 3: False}


def test_out_of_fold_table_misses_no_id(spark):
    pred = spark.createDataFrame([("A", 1, 1), ("A", 3, 2)], "model string, vec_id long, fold int")
    ids = spark.range(1, 4).withColumnRenamed("id", "vec_id")
    assert [r.complete for r in evaluation.oof_check(pred, ids).collect()] == [False]
    assert {r.vec_id: r.fold for r in evaluation.oof_assemble(pred, ids).collect()} == {1: 1, 2: None, 3: 2}


def test_exact_thresholds(spark):
    rows = [("A", 0, [0.29, 0.71, 0.0, 0.0]), ("A", 1, [0.29, 0.71, 0.0, 0.0]), ("A", 0, [0.58, 0.42, 0.0, 0.0])]
    pred = spark.createDataFrame(rows, "model string, label int, scores array<double>")
    name = evaluation.CLASS_NAMES[0]
    sweep = {r.threshold: r.precision for r in evaluation.threshold_sweep(pred).collect() if r["class"] == name}
    assert sweep[0.29] == pytest.approx(2 / 3) and sweep[0.3] == 1.0 and sweep[0.58] == 1.0 and sweep[0.59] is None
    assert {r["class"]: r.threshold for r in evaluation.threshold_pick(pred).collect()}[name] == 0.58


def test_store_takes_each_result_once(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda *x: spark.createDataFrame(x, "analysis_id long, t long").select("analysis_id", F.timestamp_seconds("t").alias("ts"))
    audit.store_analyses(rows((1, 0), (1, 0), (2, 10)), path)
    audit.store_analyses(rows((1, 500_000), (2, 10), (3, 20)), path)
    assert sorted(r.analysis_id for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        audit.store_analyses(rows((1, 0)), str(tmp_path / "broken"))


def _folder(spark, tmp_path):
    """sf0.001 with tables as folders of several part files."""
    for name in ("documents", "events"):
        V.table(spark, SF_SMALL, name).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_streams_read_folder_tables(spark, tmp_path):
    sf, q = _folder(spark, tmp_path), registry.queries()
    rows = lambda df: Counter(map(str, df.collect()))
    for name in ("stream_classify", "stream_stats", "stream_trend", "stream_cache", "stream_history", "stream_store"):
        cols = sorted(q[name](spark, SF_SMALL).columns)
        assert rows(q[name](spark, sf).select(*cols)) == rows(q[name](spark, SF_SMALL).select(*cols)), name


def test_history_restarts_without_new_data_and_store_ignores_redelivery(spark, tmp_path):
    sf = _folder(spark, tmp_path)
    run = lambda: S.read_stream(spark, sf, "events", 1)
    an = lambda: V.analyses_from(run().withColumn("ts", F.col("ts").cast("timestamp")), spark, sf)
    first = S.stream_history(an(), str(tmp_path / "history"))
    assert first["path"] and S.stream_history(an(), str(tmp_path / "history")) == first
    store = lambda: S.stream_store(an().select("analysis_id", "ts", "user_id"), str(tmp_path / "store"))
    store()
    n = spark.read.parquet(str(tmp_path / "store" / "data")).count()
    V.table(spark, SF_SMALL, "events").limit(300).coalesce(1).write.mode("append").parquet(f"{sf}/events.parquet")
    store()
    assert n == 1_000 == spark.read.parquet(str(tmp_path / "store" / "data")).count()


def test_analyses_with_gaps_in_the_ids(spark, tmp_path):
    V.table(spark, SF_SMALL, "documents").withColumn("doc_id", F.col("doc_id") * 7 + 3).write.parquet(str(tmp_path / "documents.parquet"))
    V.table(spark, SF_SMALL, "events").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.analysis_id: r.doc_id for r in V.analyses(spark, str(tmp_path)).select("analysis_id", "doc_id").collect()}
    want = {r.analysis_id: r.doc_id * 7 + 3 for r in V.analyses(spark, SF_SMALL).select("analysis_id", "doc_id").collect()}
    assert got == want
