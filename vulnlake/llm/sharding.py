"""Sharding by sampled splitters.

A size-weighted sample of the keys gives splitters at equal sample
distances; records fall into the key ranges between them.  Ranges that turn
out overfull are subdivided: evenly between their least and greatest key, or
by a hash of the record where all keys are equal.  Exact byte totals of the ranges
place every record at its byte offset in key order, and the shard is the
offset's share of the whole, so shard sizes differ by at most one record.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vulnlake.llm.common import free_names, row_key, staged, uniform

SHARDS = 24
#: Sampled keys per range between two splitters.
OVERSAMPLE = 16
#: Ranges: at least so many for each shard, and one for so many rows.
RANGES_PER_SHARD = 32
ROWS_PER_RANGE = 20_000
SEED = 8


def _splitters(records: DataFrame, total: int, ranges: int, seed: int) -> list[int]:
    """Quantile boundaries of a size-weighted key sample.  The driver gets
    about ``ranges * OVERSAMPLE`` numbers, whatever the size of the input."""
    want = ranges * OVERSAMPLE
    hit = uniform(seed, F.col("uid")) < F.col("size") * F.lit(want / max(total, 1))
    keys = sorted(r[0] for r in records.where(hit).select("key").collect())
    step = max(1, len(keys) // ranges)
    return sorted(set(keys[step::step]))


def range_shards(spark: SparkSession, records: DataFrame, n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Give every record of ``records`` (``key`` long, ``size`` long > 0, any
    other columns) its ``shard`` 0 to n_shards - 1 and its gapless ``slot``.

    Records are cut in key order where the running size passes each multiple
    of total / n_shards.  Null keys sort first.  Repeated rows and keys are
    records of their own, in any order.  No records: no rows.  Columns named ``uid``,
    ``_range``, ``_sub`` or ``_before`` are not allowed in the input.
    """
    records = staged(spark, records.withColumn("key", F.coalesce("key", F.lit(-(1 << 63)))).withColumn("uid", row_key()), "shard-records")
    n, total = records.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(n_shards * RANGES_PER_SHARD, -(-n // ROWS_PER_RANGE))
    bounds = np.array(_splitters(records, total, ranges, seed), dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(np.int64), side="right").astype(np.int32))

    placed = records.withColumn("_range", range_of("key"))
    full = 2.0 * max(total, 1) / ranges
    parts = (placed.groupBy("_range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"),
                                          F.min("key").cast("double").alias("_low"), F.max("key").cast("double").alias("_high"))
             .select("_range", "_low", "_high", F.greatest(F.ceil(F.col("bytes") / full), F.ceil(F.col("rows") / (2.0 * ROWS_PER_RANGE))).alias("_parts")))
    along = F.least(F.floor((F.col("key").cast("double") - F.col("_low")) / (F.col("_high") - F.col("_low")) * F.col("_parts")), F.col("_parts") - 1)
    sub = F.when(F.col("_high") > F.col("_low"), along).otherwise(F.pmod(F.xxhash64(F.lit(seed), "uid"), F.col("_parts")))
    # one row per range, bounded by the splitters drawn above
    cells = placed.join(F.broadcast(parts), "_range").withColumn("_sub", sub).drop("_parts", "_low", "_high")
    cells = staged(spark, cells, "shard-cells")
    sums = cells.groupBy("_range", "_sub").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy("_range", "_sub").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, not records
    sums = sums.select("_range", "_sub", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("_bytes0"),
                       F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("_rows0"))
    inside = Window.partitionBy("_range", "_sub").orderBy("key", "uid")
    offset = F.col("_bytes0") + F.sum("size").over(inside) - F.col("size") / 2
    ranked = (cells.join(sums, ["_range", "_sub"])
              .withColumn("shard", F.least(F.floor(offset * F.lit(n_shards / max(total, 1))), F.lit(n_shards - 1)).cast("int"))
              .withColumn("_before", F.col("_rows0") + F.row_number().over(inside) - 1))
    ranked = staged(spark, ranked.drop("_range", "_sub", "_bytes0", "_rows0", "uid"), "shard-ranked")
    first = ranked.groupBy("shard").agg(F.min("_before").alias("_first"))
    return (ranked.join(F.broadcast(first), "shard")  # one row per shard
            .withColumn("slot", (F.col("_before") - F.col("_first")).cast("long")).drop("_before", "_first"))


def text_order(doc_id: Column, text: Column) -> Column:
    """Key under which equal texts lie side by side, apart by a hash of their
    id, so that splitters can fall inside a large group of copies."""
    return F.shiftleft(F.shiftright(F.xxhash64(text), 24), 24) + F.pmod(F.xxhash64(doc_id), F.lit(1 << 24))


def document_shards(spark: SparkSession, docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """Law ``bytes`` over documents, in ``text_order``; size = UTF-8 bytes + 8
    (null text: 8, checksum 0).  Adds key, size, text_crc32, shard and slot to
    doc_id.  Columns beyond ``doc_id`` and ``text`` are not looked at."""
    text = F.coalesce("text", F.lit(""))
    records = docs.select("doc_id", text_order(F.col("doc_id"), text).alias("key"), (F.octet_length(text) + 8).cast("long").alias("size"),
                          F.crc32(text.cast("binary")).alias("text_crc32"))
    return range_shards(spark, records, n_shards)


def shard_documents(spark: SparkSession, docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs``, all columns, with their ``shard``.  The shards'
    first keys are enough to place a row, so texts are not shuffled; rows with
    one key (repeated rows) go to one shard.  A column ``shard`` is replaced."""
    firsts = document_shards(spark, docs, n_shards).groupBy("shard").agg(F.min("key").alias("first")).orderBy("shard").collect()
    (name,) = free_names(docs, "_key")
    key = text_order(F.col("doc_id"), F.coalesce("text", F.lit("")))
    # one comparison per shard; a shard without records shares the next one's place
    shard = F.lit(firsts[0].shard if firsts else 0)
    for before, at in zip(firsts, firsts[1:], strict=False):
        shard = shard + F.when(F.col(name) >= at["first"], at.shard - before.shard).otherwise(0)
    return docs.withColumn(name, key).withColumn("shard", shard.cast("int")).drop(name)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write a frame with ``shard`` as one folder per shard."""
    sharded.write.partitionBy("shard").parquet(path)
