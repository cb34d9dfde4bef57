"""Structured Streaming operators.

Sources are file streams over the driver tables; every query runs with
``trigger(availableNow=True)`` and a checkpoint in the shared folder, so a
restarted query resumes where it stopped and file sinks are exactly-once.
Results land in parquet under the shared folder and are read back as
DataFrames (nothing is gathered on the driver).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from vulnlake.functions import derive as B
from vulnlake.functions import rules as R
from vulnlake.operators import detect
from vulnlake.plans import domains as D
from vulnlake.plans.registry import register
from vulnlake.operators.audit import store_analyses
from vulnlake.operators.history import cache_walk
from vulnlake.session import is_folder, path_exists, shared_path, written
from vulnlake.sources import views as V


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """File stream over one table.  A table that is a folder of part files is
    watched itself; of a table that is one file, the folder round it is, for
    files of that name.  The size of a micro-batch is the caller's choice."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if is_folder(spark, path):
        return reader.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_available(writer) -> None:
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def _event_time(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


# ------------------------------- operators ---------------------------------

def stream_classify(docs: DataFrame) -> DataFrame:
    """Each arriving document → snippet → verdict, confidence and the
    verdict metadata (stream-static broadcast join with 4 literal rows)."""
    sn = V.snippets_from(docs)
    v = sn.select("doc_id", "id", R.verdict(F.col("insecure_code")).alias("verdict"))
    v = v.withColumn("confidence", B.confidence(F.col("id"), F.col("verdict"))).drop("id")
    meta = D.verdict_meta_dim(docs.sparkSession, "component").select("verdict", "severity", "title", "remediation")
    return v.join(F.broadcast(meta), "verdict", "left")


def stream_stats(analyses: DataFrame) -> DataFrame:
    """Running counters per verdict (complete-mode aggregate)."""
    return analyses.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def stream_stats_table(analyses: DataFrame, path: str) -> str | None:
    """T2 kept as a table: the slot of the last batch, also after a run without
    a new one (None before any).  Each batch is the whole result; two
    alternating slots keep the last one intact while the next is written."""

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{path}/slot{epoch % 2}")

    run_available(stream_stats(analyses).writeStream.outputMode("complete")
                  .foreachBatch(keep).option("checkpointLocation", f"{path}/_checkpoint"))
    return latest_slot(analyses.sparkSession, path)


def stream_trend(analyses: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Tumbling counts per verdict; rows later than the watermark are dropped."""
    return (analyses.withWatermark("ts", delay)
            .groupBy(F.window("ts", window).alias("w"), "verdict").agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "verdict", "n"))


CACHE_OUT = "analysis_id long, cache_key string, hit boolean"
CACHE_STATE = "write_us long"


def _cache_fn(ttl_us: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # rows of one key in this micro-batch (bounded by the trigger size)
        rows = (pd.concat(list(pdfs), ignore_index=True).sort_values(["t", "analysis_id"], kind="mergesort")
                .reset_index(drop=True))  # positional, so the hit flags below line up with the ids
        t = rows["t"].to_numpy(dtype="int64")
        write = state.get[0] if state.exists else None
        # Walk the misses only: the next miss is the first request at or
        # after write + ttl (binary search), so a hot key costs one step per
        # miss, not one Python step per request.
        hits = np.ones(len(t), dtype=bool)
        i = 0 if write is None else int(np.searchsorted(t, write + ttl_us, side="left"))
        while i < len(t):
            hits[i] = False
            write = int(t[i])
            i = int(np.searchsorted(t, write + ttl_us, side="left"))
        state.update((write,))
        # the entry can be forgotten once the watermark passes its expiry
        state.setTimeoutTimestamp(max(write // 1000 + ttl_us // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"analysis_id": rows["analysis_id"].to_numpy(dtype="int64"), "cache_key": key[0],
                            "hit": hits})
    return fn


def stream_cache(analyses: DataFrame, key: str = "cache_key", ttl_seconds: int = D.CACHE_TTL_SECONDS,
                 delay: str = "1 hour") -> DataFrame:
    """T4: a repeated key is a hit for ttl from its write (H6 semantics).
    State per key is one timestamp; it times out on event time."""
    ttl_us = ttl_seconds * 1_000_000
    x = (analyses.withWatermark("ts", delay)
         .select(F.col(key).cast("string").alias(key), "analysis_id", "ts", F.unix_micros("ts").alias("t")))
    return x.groupBy(key).applyInPandasWithState(
        _cache_fn(ttl_us), CACHE_OUT, CACHE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


#: Stands in a batch for the write that a key had before it.
HELD = -(1 << 63)


def stream_cache_table(analyses: DataFrame, path: str, key: str = "cache_key", ttl_seconds: int = D.CACHE_TTL_SECONDS,
                       delay_seconds: int = 3600) -> None:
    """T4 for keys of any size: hits and misses as a table, by the walk of the
    batch cache (H6) over each micro-batch.

    The last write of every key is kept between batches, in two alternating
    slots like T5's table, and opens the key's requests of the next batch.  A
    request that is older than it is judged at its time, as the stateful form
    does.  Writes that expired ``delay_seconds`` before the latest request are
    forgotten.  A batch replayed after a failure overwrites what it wrote."""
    ttl, delay = ttl_seconds * 1_000_000, delay_seconds * 1_000_000

    def serve(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        asked = batch.select(F.col(key).cast("string").alias("key"), F.unix_micros("ts").alias("t"), F.col("analysis_id").alias("rid"))
        if epoch > 0:
            held = spark.read.parquet(f"{path}/slot{(epoch - 1) % 2}").select("key", "t")
            asked = asked.join(held.select("key", F.col("t").alias("_w")), "key", "left").select("key", F.greatest("t", "_w").alias("t"), "rid")
            asked = asked.unionByName(held.select("key", "t", F.lit(HELD).alias("rid")))
        out = written(spark, cache_walk(asked, ttl), "cache-batch")
        out.where(F.col("rid") != HELD).select(F.col("rid").alias("analysis_id"), F.col("key").alias("cache_key"), "hit").write.mode(
            "overwrite").parquet(f"{path}/data/epoch={epoch}")
        writes = out.where(~F.col("hit") & F.col("key").isNotNull()).groupBy("key").agg(F.max("t").alias("t"))
        latest = out.agg(F.coalesce(F.max("t"), F.lit(0))).first()[0]
        writes.where(F.col("t") > latest - ttl - delay).withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{path}/slot{epoch % 2}")

    run_available(analyses.writeStream.foreachBatch(serve).option("checkpointLocation", f"{path}/_checkpoint"))


def latest_slot(spark: SparkSession, path: str) -> str | None:
    """The slot of the last complete batch, or None before the first."""
    found = {}
    for slot in ("slot0", "slot1"):
        if path_exists(spark, f"{path}/{slot}/_SUCCESS"):
            last = spark.read.parquet(f"{path}/{slot}").agg(F.max("epoch")).first()[0]
            found[-1 if last is None else last] = f"{path}/{slot}"
    return found[max(found)] if found else None


def stream_history(analyses: DataFrame, path: str, n: int = D.HISTORY_LEN) -> dict:
    """T5: latest n per user kept as a table; each micro-batch is merged
    with the stored rows (foreachBatch).

    The table lives in two alternating slots: batch e reads slot (e-1) % 2,
    written by the last committed batch, and overwrites slot e % 2.  The
    slot follows from the batch id alone, so a restarted query (or a
    replayed batch) resumes from the stored table, and storage stays at two
    copies of users × n rows.  Returns the ``path`` of the last batch's slot,
    also when there was no new batch (None before any)."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        cols = ["user_id", "analysis_id", "ts", "preview", "verdict", "confidence"]
        cur = batch.select(*cols)
        if epoch > 0:
            cur = cur.unionByName(spark.read.parquet(f"{path}/slot{(epoch - 1) % 2}").select(*cols))
        w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("analysis_id").desc())
        top = cur.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
        out = f"{path}/slot{epoch % 2}"
        top.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(out)

    run_available(analyses.writeStream.foreachBatch(merge)
                  .option("checkpointLocation", f"{path}/_checkpoint"))
    return {"path": latest_slot(analyses.sparkSession, path)}


def stream_store(analyses: DataFrame, path: str) -> None:
    """Store each result once (A9), also when it is delivered again in
    another file or a micro-batch is replayed."""
    run_available(analyses.writeStream.foreachBatch(lambda batch, _: store_analyses(batch, f"{path}/data"))
                  .option("checkpointLocation", f"{path}/_checkpoint"))


# -------------------------------- queries ----------------------------------

def _stream_analyses(spark, sf):
    """The analyses of arriving events.  Documents are scored once, into a
    table that every micro-batch joins."""
    path = shared_path(spark, "document_verdicts")
    V.document_verdicts(spark, sf).write.parquet(path)
    ev = _event_time(read_stream(spark, sf, "events"))
    return V.analyses_from(ev, spark, sf, spark.read.parquet(path))


@register("stream_classify", lambda: V.with_views("snippets") +
          "SELECT v.doc_id, v.verdict, v.confidence, m.severity, m.title, m.remediation FROM "
          f"(SELECT doc_id, verdict, {B.sql_confidence('id', 'verdict')} AS confidence FROM "
          f"(SELECT doc_id, id, {R.sql_verdict('insecure_code')} AS verdict FROM snippets) x) v "
          f"LEFT JOIN ({detect._sql_meta('component')}) m USING (verdict)")
def q_stream_classify(spark, sf):
    base = shared_path(spark, "stream_classify")
    out = stream_classify(read_stream(spark, sf, "documents"))
    run_available(out.writeStream.format("parquet").option("path", f"{base}/data")
                  .option("checkpointLocation", f"{base}/_checkpoint"))
    return spark.read.parquet(f"{base}/data").select("doc_id", "verdict", "confidence", "severity", "title", "remediation")


@register("stream_stats", lambda: V.with_views("analyses") + "SELECT verdict, count(*) AS n FROM analyses GROUP BY verdict")
def q_stream_stats(spark, sf):
    base = shared_path(spark, "stream_stats")
    path = stream_stats_table(_stream_analyses(spark, sf), base)
    if path is None:  # no event yet
        return V.analyses(spark, sf).limit(0).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    return spark.read.parquet(path).drop("epoch")


@register("stream_trend", lambda: V.with_views("analyses") +
          "SELECT window_start, window_end, verdict, count(*) AS n FROM (SELECT date_trunc('day', ts) AS window_start, "
          "date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, verdict FROM analyses) a "
          "WHERE window_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM analyses) GROUP BY 1, 2, 3")
def q_stream_trend(spark, sf):
    base = shared_path(spark, "stream_trend")
    out = stream_trend(_stream_analyses(spark, sf))
    run_available(out.writeStream.format("parquet").outputMode("append").option("path", f"{base}/data")
                  .option("checkpointLocation", f"{base}/_checkpoint"))
    return spark.read.parquet(f"{base}/data")


@register("stream_cache", lambda: __import__("vulnlake.operators.history", fromlist=["x"])._sql_cache_walk() +
          "SELECT analysis_id, cache_key, hit FROM walk")
def q_stream_cache(spark, sf):
    base = shared_path(spark, "stream_cache")
    stream_cache_table(_stream_analyses(spark, sf).withColumn("cache_key", F.col("snippet_hash")), base)
    if not path_exists(spark, f"{base}/data"):  # no event yet
        return spark.createDataFrame([], CACHE_OUT)
    return spark.read.parquet(f"{base}/data").select("analysis_id", "cache_key", "hit")


@register("stream_history", lambda: V.with_views("analyses") +
          "SELECT user_id, analysis_id, ts, preview, verdict, confidence, CAST(rank AS INTEGER) AS rank FROM "
          "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, analysis_id DESC) AS rank FROM analyses) r WHERE rank <= 5")
def q_stream_history(spark, sf):
    base = shared_path(spark, "stream_history")
    path = stream_history(_stream_analyses(spark, sf), base)["path"]
    if path is None:  # no event yet
        return V.analyses(spark, sf).limit(0).select("user_id", "analysis_id", "ts", "preview", "verdict", "confidence", F.lit(0).alias("rank"))
    return spark.read.parquet(path).drop("epoch")


_STORE = ["analysis_id", "ts", "user_id", "snippet_hash", "verdict", "confidence"]


@register("stream_store", lambda: V.with_views("analyses") + f"SELECT {', '.join(_STORE)} FROM analyses")
def q_stream_store(spark, sf):
    base = shared_path(spark, "stream_store")
    a = _stream_analyses(spark, sf).select(*_STORE)
    stream_store(a, base)
    return spark.read.parquet(f"{base}/data").select(*_STORE)
