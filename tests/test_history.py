"""History and cache analytics against brute-force Python."""

import datetime as dt
import random

from vulnlake.operators import history as H


def _brute_cache(rows, ttl):
    out = {}
    by_key = {}
    for rid, key, ts in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        by_key.setdefault(key, []).append((rid, ts))
    for key, evs in by_key.items():
        write = None
        for rid, ts in evs:
            if write is not None and (ts - write).total_seconds() < ttl:
                out[rid] = True
            else:
                out[rid] = False
                write = ts
    return out


def test_cache_hits_match_brute_force(spark):
    rng = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        key = rng.randrange(4)
        ts = base + dt.timedelta(seconds=rng.randrange(0, 3 * 24 * 3600))
        rows.append((i, key, ts))
    # a request exactly one TTL after a write is a miss
    rows += [(1000, 9, base), (1001, 9, base + dt.timedelta(seconds=3600)), (1002, 9, base + dt.timedelta(seconds=3601))]
    df = spark.createDataFrame(rows, "analysis_id long, k long, ts timestamp")
    got = {r.analysis_id: r.hit for r in H.cache_hits(df, "k", 3600).collect()}
    assert got == _brute_cache(rows, 3600)
    assert got[1001] is False and got[1002] is True


def test_running_totals_match_naive(spark):
    rng = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    verdicts = H.VERDICTS
    rows = [(i, rng.randrange(3), base + dt.timedelta(minutes=rng.randrange(0, 5 * 24 * 60)), rng.choice(verdicts))
            for i in range(400)]
    df = spark.createDataFrame(rows, "analysis_id long, user_id long, ts timestamp, verdict string")
    got = {r.analysis_id: (r.total, r.safe) for r in H.running_totals(df).collect()}
    for rid, user, ts, _ in rows:
        prior = [r for r in rows if r[1] == user and (r[2], r[0]) <= (ts, rid)]
        assert got[rid] == (len(prior), sum(1 for r in prior if r[3] == "safe"))


def test_cache_hits_with_nearly_all_requests_for_one_key(spark, monkeypatch):
    """Slices of eight requests; keys that begin, end and go on across slices; requests at the same time; no key."""
    monkeypatch.setattr(H, "SLICE_BITS", 3)
    rng = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "hot", base + dt.timedelta(seconds=rng.randrange(0, 40_000))) for i in range(900)]
    rows += [(1000 + i, f"k{rng.randrange(30)}", base + dt.timedelta(seconds=rng.randrange(0, 40_000))) for i in range(120)]
    rows += [(2000 + i, "late", base + dt.timedelta(days=1)) for i in range(40)] + [(2100, "late", base + dt.timedelta(days=1, hours=1))]
    df = spark.createDataFrame([*rows, (3000, None, base), (3001, None, base)], "analysis_id long, k string, ts timestamp")
    got = {r.analysis_id: r.hit for r in H.cache_hits(df, "k", 3600).collect()}
    assert got == _brute_cache(rows, 3600) | {3000: False, 3001: False}
    for ttl in (1, 50, 500_000):
        assert {r.analysis_id: r.hit for r in H.cache_hits(df.where("k is not null"), "k", ttl).collect()} == _brute_cache(rows, ttl)
    assert H.cache_hits(df.limit(0), "k").count() == 0
