"""History, usage and cache analytics over the analyses table (H1-H7).

Running counters go over ranges of (user, time) with carried sums
(``prefix``), so that no single user, who may hold a third of all rows, lands
in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.functions import derive as B
from vulnlake.plans import domains as D
from vulnlake.operators.prefix import PLACE, dealt, running_sums
from vulnlake.plans.registry import register
from vulnlake.session import written
from vulnlake.sources import views as V

VERDICTS = ["sql_injection", "weak_crypto", "hardcoded_secret", "safe"]


def recent_history(df: DataFrame, n: int = D.HISTORY_LEN) -> DataFrame:
    """H1 (global): latest n analyses — a top-k, planned as TakeOrderedAndProject."""
    return (df.orderBy(F.col("ts").desc(), F.col("analysis_id").desc()).limit(n)
            .select("analysis_id", "ts", "preview", "verdict", B.format_pct(F.col("confidence")).alias("confidence_pct")))


def recent_history_by_user(df: DataFrame, n: int = D.HISTORY_LEN) -> DataFrame:
    """H1 (per user): row_number ≤ n; Spark applies a partial per-partition
    limit (WindowGroupLimit) before the shuffle, so a hot user costs n rows."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("analysis_id").desc())
    return (df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("user_id", "rank", "analysis_id", "ts", "preview", "verdict",
                    B.format_pct(F.col("confidence")).alias("confidence_pct")))


def history_join(analyses: DataFrame, documents: DataFrame, customer: DataFrame) -> DataFrame:
    """H2: analyses with snippet and user attributes (fact-dimension joins;
    AQE picks broadcast or sort-merge from runtime sizes)."""
    docs = documents.select(F.col("doc_id"), F.col("lang"))
    users = customer.select(F.col("c_custkey").alias("user_id"), "c_name", "c_mktsegment", "c_nationkey")
    return (analyses.select("analysis_id", "ts", "user_id", "doc_id", "snippet_id", "verdict")
            .join(docs, "doc_id", "left").join(users, "user_id", "left"))


def verdict_trend(df: DataFrame, verdicts=VERDICTS) -> DataFrame:
    """H3: analyses per day and verdict, days without analyses filled with 0.
    The calendar runs from the first to the last day of the counts."""
    day = F.date_trunc("day", F.col("ts"))
    counts = df.groupBy(day.alias("day"), "verdict").agg(F.count(F.lit(1)).alias("n"))
    bounds = counts.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    cal = (bounds.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("day"))
           .select("day", F.explode(F.array(*[F.lit(v) for v in verdicts])).alias("verdict")))
    return (cal.join(counts, ["day", "verdict"], "left")
            .select("day", "verdict", F.coalesce("n", F.lit(0)).alias("n")))


def running_totals(df: DataFrame, verdicts=VERDICTS) -> DataFrame:
    """H4: per user, total and per-verdict counters after each analysis
    (order ts, analysis_id), by sums carried along ranges of (user, ts)."""
    metrics = {"total": F.lit(1)} | {v: (F.col("verdict") == v).cast("long") for v in verdicts}
    x = df.select("analysis_id", "user_id", "ts", *[F.coalesce(c.cast("long"), F.lit(0)).alias(k) for k, c in metrics.items()])
    out = running_sums(df.sparkSession, x, ["user_id"], [F.col("ts"), F.col("analysis_id")], list(metrics))
    return out.select("analysis_id", "user_id", *metrics)


def stats_bar(df: DataFrame, verdicts=VERDICTS) -> DataFrame:
    """H5: total and one counter per verdict, one pass."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  *[F.sum((F.col("verdict") == v).cast("long")).alias(v) for v in verdicts])


#: log2 of the requests that are walked together.
SLICE_BITS = 12


def _successors(t: np.ndarray, ttl: int) -> np.ndarray:
    """Per request of a key, in order, the first one that its write no longer covers."""
    return np.searchsorted(t, t + ttl, side="left")


def _walk(t: np.ndarray, start: int, ttl: int) -> tuple[np.ndarray, int | None]:
    """Misses among a key's requests if ``start`` is the first one, and the time of the last write."""
    miss, write, i = np.zeros(len(t), bool), None, start
    while i < len(t):
        miss[i], write = True, int(t[i])
        i = int(np.searchsorted(t, write + ttl, side="left"))
    return miss, write


def _transition(t: np.ndarray, ttl: int) -> tuple[list[int], list[int]]:
    """What a slice of one key does to the write before it: ``expiry`` times up
    to which the slice's last write is ``last``.  Walks that begin at different
    requests soon meet, so there are few pieces."""
    following = _successors(t, ttl)
    end = np.arange(len(t))
    for i in range(len(t) - 1, -1, -1):
        if following[i] < len(t):
            end[i] = end[following[i]]
    cut = np.append(np.flatnonzero(np.diff(end)), len(t) - 1)
    return t[cut].tolist(), t[end[cut]].tolist()


def _segments(rows: pd.DataFrame) -> np.ndarray:
    """Where the rows of each key begin, and the end."""
    key = rows["key"].to_numpy()
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])


def cache_hits(df: DataFrame, key: str, ttl_seconds: int = D.CACHE_TTL_SECONDS, ts: str = "ts", rid: str = "analysis_id") -> DataFrame:
    """H6: per request, hit or miss for a cache keyed by `key` whose entry
    lives `ttl_seconds` from its write (a miss writes).  A request exactly
    ttl after the write is a miss.

    Requests are dealt over ranges of (key, time) and cut into slices of up to
    2^SLICE_BITS.  A key that begins inside a slice begins with a miss, so all
    but the slice's first key are settled there.  The first key may come from
    the slice before: for it the slice is a step function from the write before
    to its last write.  These functions are put together along each key, one
    short row a slice, and give every slice the write it starts with; then the
    slices are walked.  No key is ever in one task with more than its slices' rows.
    A request without a key is a miss that writes nothing; ``rid`` must be
    unique.
    """
    ev = df.select(F.col(key).alias("key"), F.unix_micros(F.col(ts)).alias("t"), F.col(rid).alias("rid"))
    return cache_walk(ev, ttl_seconds * 1_000_000).select(F.col("rid").alias(rid), F.col("key").alias(key), "hit")


def cache_walk(ev: DataFrame, ttl: int) -> DataFrame:
    """``cache_hits`` on (key, t, rid), times in microseconds: rid, key, t, hit."""
    spark = ev.sparkSession
    kind = {c: ev.schema[c].dataType.simpleString() for c in ("key", "rid")}
    placed = dealt(spark, ev, ["key"], [F.col("t"), F.col("rid")])
    keyless = placed.where("key IS NULL").select("rid", "key", "t", F.lit(False).alias("hit"))
    sliced = placed.where("key IS NOT NULL").withColumn("slice", F.shiftright(PLACE, SLICE_BITS))

    def ends(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(PLACE)
        cut, t, keys = _segments(rows), rows["t"].to_numpy(np.int64), rows["key"].to_numpy()
        expiry, last = _transition(t[:cut[1]], ttl)
        out = [(keys[0], int(rows["slice"].iloc[0]), expiry, last, None)]
        if len(cut) > 2:  # the last key begins here: its last write is certain
            out.append((keys[-1], out[0][1], [], [], _walk(t[cut[-2]:], 0, ttl)[1]))
        return pd.DataFrame(out, columns=["key", "slice", "expiry", "last", "write"]).astype({"write": "Int64"})

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = write = None
        for b in batches:
            out = []
            for k, piece, expiry, last, certain in zip(b["key"], b["slice"], b["expiry"], b["last"], b["write"]):
                if k != current:
                    current, write = k, None
                if not pd.isna(certain):
                    write = int(certain)
                    continue
                out.append((piece, write))
                at = 0 if write is None else int(np.searchsorted(expiry, write + ttl, side="left"))
                write = int(last[at]) if at < len(expiry) else write
            yield pd.DataFrame(out, columns=["slice", "write"]).astype({"write": "Int64"})

    def settle(_: tuple, rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(PLACE)
        cut, t = _segments(rows), rows["t"].to_numpy(np.int64)
        miss = np.zeros(len(t), bool)
        for n, (low, high) in enumerate(zip(cut, cut[1:])):
            write = before["write"].iloc[0] if n == 0 else None
            start = 0 if pd.isna(write) else int(np.searchsorted(t[low:high], int(write) + ttl, side="left"))
            miss[low:high] = _walk(t[low:high], start, ttl)[0]
        return pd.DataFrame({"rid": rows["rid"], "key": rows["key"], "t": rows["t"], "hit": ~miss})

    functions = sliced.groupBy("slice").applyInPandas(
        ends, f"key {kind['key']}, slice long, expiry array<long>, last array<long>, write long")
    # of one slice its first key's function stands before its last key's write
    along = written(spark, functions, "cache-slices").repartition("key").sortWithinPartitions("key", "slice", F.col("write").isNotNull())
    before = along.mapInPandas(starts, "slice long, write long")
    out = sliced.groupBy("slice").cogroup(before.groupBy("slice")).applyInPandas(
        settle, f"rid {kind['rid']}, key {kind['key']}, t long, hit boolean")
    return out.unionByName(keyless)


def cache_hit_rate(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count(F.lit(1)).alias("requests"),
                    F.sum(F.col("hit").cast("long")).alias("hits"),
                    F.sum((~F.col("hit")).cast("long")).alias("misses"),
                    B.round_half_even(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"))


def dedup_snippets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """H7: one row per content hash with its lowest id and number of copies
    (partial aggregation absorbs a hot hash map-side)."""
    return df.groupBy(B.snippet_hash(F.col(text)).alias("snippet_hash")).agg(
        F.min(key).alias("first_id"), F.count(F.lit(1)).alias("copies"))


# -------------------------------- queries ----------------------------------

def _an(spark, sf):
    return V.analyses(spark, sf)


def _w():
    return V.with_views("analyses")


@register("recent_history", lambda: _w() +
          f"SELECT analysis_id, ts, preview, verdict, {B.sql_format_pct('confidence')} AS confidence_pct FROM analyses "
          "ORDER BY ts DESC, analysis_id DESC LIMIT 5")
def q_recent_history(spark, sf):
    return recent_history(_an(spark, sf))


@register("recent_history_by_user", lambda: _w() +
          f"SELECT user_id, CAST(rank AS INTEGER) AS rank, analysis_id, ts, preview, verdict, {B.sql_format_pct('confidence')} AS confidence_pct FROM "
          "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, analysis_id DESC) AS rank FROM analyses) r WHERE rank <= 5")
def q_recent_history_by_user(spark, sf):
    return recent_history_by_user(_an(spark, sf))


@register("history_join", lambda: _w() +
          "SELECT a.analysis_id, a.ts, a.user_id, a.doc_id, a.snippet_id, a.verdict, d.lang, c.c_name, c.c_mktsegment, c.c_nationkey "
          "FROM analyses a LEFT JOIN documents d ON a.doc_id = d.doc_id LEFT JOIN customer c ON a.user_id = c.c_custkey")
def q_history_join(spark, sf):
    return history_join(_an(spark, sf), V.table(spark, sf, "documents"), V.table(spark, sf, "customer"))


@register("verdict_trend", lambda: _w() +
          "SELECT c.day, c.verdict, coalesce(n.n, 0) AS n FROM "
          "(SELECT d AS day, v.verdict FROM (SELECT unnest(generate_series(min(date_trunc('day', ts)), max(date_trunc('day', ts)), INTERVAL 1 DAY)) AS d FROM analyses) g, "
          "(SELECT unnest(['sql_injection', 'weak_crypto', 'hardcoded_secret', 'safe']) AS verdict) v) c "
          "LEFT JOIN (SELECT date_trunc('day', ts) AS day, verdict, count(*) AS n FROM analyses GROUP BY 1, 2) n USING (day, verdict)")
def q_verdict_trend(spark, sf):
    return verdict_trend(_an(spark, sf).select("ts", "verdict"))


@register("running_totals", lambda: _w() +
          "SELECT analysis_id, user_id, count(*) OVER w AS total, " +
          ", ".join(f"CAST(sum(CASE WHEN verdict = '{v}' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS {v}" for v in VERDICTS) +
          " FROM analyses WINDOW w AS (PARTITION BY user_id ORDER BY ts, analysis_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def q_running_totals(spark, sf):
    return running_totals(_an(spark, sf))


@register("stats_bar", lambda: _w() + "SELECT count(*) AS total, " +
          ", ".join(f"CAST(sum(CASE WHEN verdict = '{v}' THEN 1 ELSE 0 END) AS BIGINT) AS {v}" for v in VERDICTS) + " FROM analyses")
def q_stats_bar(spark, sf):
    return stats_bar(_an(spark, sf))


def _sql_cache_walk() -> str:
    return (_w().replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n"
            "ev AS (SELECT snippet_hash AS cache_key, ts, analysis_id, "
            "row_number() OVER (PARTITION BY snippet_hash ORDER BY ts, analysis_id) AS rn FROM analyses),\n"
            "walk AS (SELECT cache_key, rn, analysis_id, ts AS write_ts, false AS hit FROM ev WHERE rn = 1 "
            "UNION ALL SELECT e.cache_key, e.rn, e.analysis_id, "
            f"CASE WHEN e.ts - w.write_ts < INTERVAL {D.CACHE_TTL_SECONDS} SECOND THEN w.write_ts ELSE e.ts END, "
            f"e.ts - w.write_ts < INTERVAL {D.CACHE_TTL_SECONDS} SECOND "
            "FROM walk w JOIN ev e ON e.cache_key = w.cache_key AND e.rn = w.rn + 1)\n")


def _cache_frame(spark, sf):
    # the result cache of the design: snippet hash → verdict, one-hour TTL
    a = _an(spark, sf).withColumn("cache_key", F.col("snippet_hash"))
    return cache_hits(a, "cache_key")


@register("cache_hits", lambda: _sql_cache_walk() + "SELECT analysis_id, cache_key, hit FROM walk")
def q_cache_hits(spark, sf):
    return _cache_frame(spark, sf)


@register("cache_hit_rate", lambda: _sql_cache_walk() +
          f"SELECT count(*) AS requests, CAST(sum(CAST(hit AS INTEGER)) AS BIGINT) AS hits, "
          f"CAST(sum(CAST(NOT hit AS INTEGER)) AS BIGINT) AS misses, {B.sql_round_half_even('avg(CAST(hit AS DOUBLE))', 6)} AS hit_rate FROM walk")
def q_cache_hit_rate(spark, sf):
    return cache_hit_rate(_cache_frame(spark, sf))


@register("dedup_snippets", lambda: "SELECT sha256(text) AS snippet_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def q_dedup_snippets(spark, sf):
    return dedup_snippets(V.table(spark, sf, "documents"))
