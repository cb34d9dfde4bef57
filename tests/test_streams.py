"""Streams equal their batch counterparts at sf0.001."""

from vulnlake.plans import registry
from tests.conftest import SF_SMALL


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_classify_equals_batch(spark):
    q = registry.queries()
    s = q["stream_classify"](spark, SF_SMALL).select("doc_id", "verdict", "confidence", "severity")
    b = q["enrich_verdict"](spark, SF_SMALL).select("doc_id", "verdict", "confidence", "severity")
    assert _rows(s) == _rows(b)


def test_stream_cache_equals_batch(spark):
    q = registry.queries()
    assert _rows(q["stream_cache"](spark, SF_SMALL).select("analysis_id", "hit")) == \
        _rows(q["cache_hits"](spark, SF_SMALL).select("analysis_id", "hit"))


def test_stream_history_equals_batch(spark):
    q = registry.queries()
    s = q["stream_history"](spark, SF_SMALL).select("user_id", "rank", "analysis_id")
    b = q["recent_history_by_user"](spark, SF_SMALL).select("user_id", "rank", "analysis_id")
    assert _rows(s) == _rows(b)


def test_stream_store_is_idempotent(spark):
    q = registry.queries()
    assert q["stream_store"](spark, SF_SMALL).count() == q["store_analyses"](spark, SF_SMALL).count()


def test_stream_cache_state_carries_across_batches(spark, tmp_path):
    """Events split in time over two files (two micro-batches): the per-key
    write time kept in state gives the batch answer."""
    from pyspark.sql import functions as F

    from vulnlake.operators import history as H
    from vulnlake.plans import domains as D
    from vulnlake.sources import views as V
    from vulnlake.streaming import streams as S

    ev = V.table(spark, SF_SMALL, "events")
    mid = ev.agg(F.expr("percentile_approx(event_id, 0.5)")).collect()[0][0]
    src = str(tmp_path / "src")
    ev.where(F.col("event_id") <= mid).coalesce(1).write.parquet(src + "/p1")
    ev.where(F.col("event_id") > mid).coalesce(1).write.parquet(src + "/p2")
    schema = ev.schema
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(src))
    a = V.analyses_from(stream.withColumn("ts", F.col("ts").cast("timestamp")), spark, SF_SMALL)
    a = a.withColumn("cache_key", F.col("user_id") % 20)
    out = str(tmp_path / "out")
    S.run_available(S.stream_cache(a).writeStream.format("parquet").outputMode("append")
                    .option("path", out).option("checkpointLocation", str(tmp_path / "ck")))
    got = _rows(spark.read.parquet(out).select("analysis_id", "hit"))
    batch = V.analyses(spark, SF_SMALL).withColumn("cache_key", F.col("user_id") % 20)
    assert got == _rows(H.cache_hits(batch, "cache_key").select("analysis_id", "hit"))


def test_stream_history_over_three_batches(spark, tmp_path):
    """Events in three files (three micro-batches): the alternating slots
    carry the latest five per user from batch to batch."""
    from pyspark.sql import functions as F

    from vulnlake.sources import views as V
    from vulnlake.streaming import streams as S

    ev = V.table(spark, SF_SMALL, "events")
    src = str(tmp_path / "src")
    for i, (lo, hi) in enumerate(((0, 300), (300, 650), (650, 10 ** 9))):
        ev.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1).write.parquet(f"{src}/p{i}")
    stream = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(src))
    a = V.analyses_from(stream.withColumn("ts", F.col("ts").cast("timestamp")), spark, SF_SMALL)
    holder = S.stream_history(a, str(tmp_path / "hist"))
    assert holder["path"].endswith("slot0")  # batches 0, 1, 2: the last one wrote slot 0
    got = _rows(spark.read.parquet(holder["path"]).select("user_id", "rank", "analysis_id"))
    want = _rows(registry.queries()["recent_history_by_user"](spark, SF_SMALL).select("user_id", "rank", "analysis_id"))
    assert got == want


def test_an_append_reads_the_keys_of_its_range_only(spark, tmp_path):
    from pyspark.sql import functions as F

    from vulnlake.operators.audit import store_analyses, stored_between

    path = str(tmp_path / "store")
    for i in range(4):
        rows = spark.range(i * 10_000, (i + 1) * 10_000).select(F.col("id").alias("analysis_id"), F.timestamp_seconds("id").alias("ts"), F.lit("x").alias("v"))
        store_analyses(rows, path)
    late = spark.range(9_990, 10_010).select(F.col("id").alias("analysis_id"), F.timestamp_seconds(F.col("id") + 86_400 * 9).alias("ts"), F.lit("y").alias("v"))
    assert store_analyses(late, path).count() == 40_000  # delivered again under another day
    batch = spark.range(40_000, 40_010).select(F.col("id").alias("analysis_id"))
    seen = stored_between(spark, batch, path, "analysis_id")
    assert "GreaterThanOrEqual(analysis_id,40000)" in seen._jdf.queryExecution().executedPlan().toString()
    seen.collect()
    scan = seen._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scan.metrics().apply("numOutputRows").value() == 0  # every row group is skipped by its statistics


def test_stats_after_a_run_without_new_events(spark, tmp_path):
    from vulnlake.streaming import streams as S

    spark.createDataFrame([("safe",), ("safe",), ("weak_crypto",)], "verdict string").write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("verdict string").parquet(str(tmp_path / "in"))
    first = S.stream_stats_table(read(), str(tmp_path / "out"))
    again = S.stream_stats_table(read(), str(tmp_path / "out"))
    assert first == again and {(r.verdict, r.n) for r in spark.read.parquet(again).collect()} == {("safe", 2), ("weak_crypto", 1)}


def test_cache_table_over_several_batches_of_a_hot_key(spark, tmp_path):
    """A third and more of all rows in one key, five micro-batches in time order; equal to the batch cache.
    A late request within the time to live is a hit, and a restart goes on."""
    import datetime as dt
    import os
    import random

    from vulnlake.operators import history as H
    from vulnlake.streaming import streams as S

    rng, base, rows = random.Random(4), dt.datetime(2024, 1, 1), []
    for i in range(600):
        rows.append((i, "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None]), base + dt.timedelta(seconds=61 * i)))
    schema = "analysis_id long, cache_key string, ts timestamp"
    source, out = tmp_path / "in", str(tmp_path / "out")
    for n in range(5):
        spark.createDataFrame(rows[n * 120:(n + 1) * 120], schema).coalesce(1).write.mode("append").parquet(str(source))
        for name in os.listdir(source):  # the stream reads older files first
            if name.endswith(".parquet") and not name.startswith("p"):
                os.utime(source / name, (n, n))
        read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        if n in (2, 4):  # two runs: of three batches, then of two
            S.stream_cache_table(read, out)
    got = {r.analysis_id: r.hit for r in spark.read.parquet(f"{out}/data").collect()}
    want = {r.analysis_id: r.hit for r in H.cache_hits(spark.createDataFrame(rows, schema), "cache_key").collect()}
    assert got == want and len(os.listdir(f"{out}/data")) == 5
    last = max(r[0] for r in rows if r[1] == "hot" and not want[r[0]])
    late = spark.createDataFrame([(9_000, "hot", rows[last][2] - dt.timedelta(seconds=30))], schema)
    late.write.mode("append").parquet(str(source))
    S.stream_cache_table(spark.readStream.schema(schema).parquet(str(source)), out)
    assert spark.read.parquet(f"{out}/data").where("analysis_id = 9000").first().hit
