"""Late rows behind the watermark are dropped by the streaming trend."""

import datetime as dt
import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from vulnlake.streaming import streams as S


def test_late_rows_are_dropped(spark):
    root = tempfile.mkdtemp(prefix="vulnlake-wm-")
    src, out, ck = os.path.join(root, "src"), os.path.join(root, "out"), os.path.join(root, "ck")
    os.makedirs(src)
    d = dt.datetime(2024, 1, 1)
    first = pd.DataFrame({"ts": [d + dt.timedelta(hours=h) for h in range(0, 60)], "verdict": "safe"})
    first.to_parquet(os.path.join(src, "a.parquet"), coerce_timestamps="us")
    schema = spark.read.parquet(src).schema

    def run():
        sdf = spark.readStream.schema(schema).parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
        S.run_available(S.stream_trend(sdf).writeStream.format("parquet").outputMode("append")
                        .option("path", out).option("checkpointLocation", ck))

    run()
    # a second file: one row far behind the watermark (day 1), one new row (day 4)
    late = pd.DataFrame({"ts": [d + dt.timedelta(hours=1), d + dt.timedelta(hours=80)], "verdict": "safe"})
    late.to_parquet(os.path.join(src, "b.parquet"), coerce_timestamps="us")
    run()
    got = {r.window_start.day: r.n for r in spark.read.parquet(out).collect()}
    assert got[1] == 24  # the late day-1 row did not reopen its window
    assert got[2] == 24
