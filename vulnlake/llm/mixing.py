"""Mixing sources to target weights by capped water-filling.

Every source asks for its weight's share of the mix; a source whose share
passes ``max_epochs`` times its size is clamped there, and what it leaves
is shared among the others by weight, until no share is above its cap.
The mix takes each source's whole repetitions and then a seeded sample:
documents in a seeded order until the fraction of a repetition is full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vulnlake.llm.common import free_names, row_key, staged, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 3
#: Largest table of sources that is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Hex digits of the seeded order that name a bucket: 4,096 buckets a source.
BUCKET_DIGITS = 3


def seeded_order(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) → adds ``target``.  Weights go round the sources
    in code-point order, null last.  Each round of clamping moves two sums to
    the driver, never the sources."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))  # one row per source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = sources.select("source", "source_size", w.alias("weight"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    left = float(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    level, clamped = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        n, held, free = sources.agg(F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)),
                                    F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if n == clamped or free == 0:
            break
        clamped, level = n, (left - held) / free
    target = cap if level is None else F.least(F.col("weight") * F.lit(level), cap)
    return sources.withColumn("target", target.cast("double"))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
        max_epochs: int = MAX_EPOCHS, seed: int = SEED, whole: bool = False) -> DataFrame:
    """``docs`` (doc_id, source, text, anything else) → doc_id, source, size,
    source_size, target, taken, and of the rule: ord, full, more.

    ``size`` is the word count (null text: 0).  ``taken`` is the words the mix
    takes of the document, repetitions counted: the source's whole
    repetitions, plus one more for the first documents of the seeded order.
    The document on which the fraction runs out gives the words still missing,
    or with ``whole`` all or none of them, whichever is nearer.  ``full`` is
    the whole repetitions and ``more`` the words of the last one.  Null
    sources form one source; documents without an id share one place in the
    order; repeated rows count each.  Empty input: no rows.
    """
    key = F.coalesce("source", F.lit(""))
    rows = staged(spark, docs.select("doc_id", F.col("source").isNull().alias("no_source"), key.alias("source_key"),
                                     word_count(F.col("text")).alias("size"), seeded_order(seed).alias("ord")).withColumn("uid", row_key()), "mix-rows")
    by = ["no_source", "source_key"]
    bucket = F.substring("ord", 1, BUCKET_DIGITS)
    buckets = rows.groupBy(*by, bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    buckets = staged(spark, buckets, "mix-buckets")
    sizes = buckets.groupBy(*by).agg(F.sum("bucket_size").alias("source_size"))
    back = F.when(~F.col("no_source"), F.col("source_key"))
    targets = source_targets(sizes.select(back.alias("source"), "source_size"), weights, share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = staged(spark, targets.select(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"),
                                           "source_size", "target", epochs.alias("full")), "mix-targets")
    extra = F.floor(F.col("target") + 0.5) - F.col("full") * F.col("source_size")
    earlier = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 16**digits rows a source
    starts = (buckets.withColumn("start", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
              .join(targets, by).withColumn("extra", extra)
              .select(*by, "bucket", "source_size", "target", "full",
                      # words of the extra repetition left when the bucket begins; null: the bucket is wholly in or out
                      (F.col("extra") - F.col("start")).alias("room"),
                      ((F.col("start") < F.col("extra")) & (F.col("extra") < F.col("start") + F.col("bucket_size"))).alias("cut")))
    placed = rows.withColumn("bucket", bucket).join(starts, [*by, "bucket"])
    outside = placed.where(~F.col("cut")).withColumn("more", F.when(F.col("room") > 0, F.col("size")).otherwise(0))
    inside = Window.partitionBy(*by).orderBy("ord", "doc_id", "uid").rowsBetween(Window.unboundedPreceding, -1)
    still = F.col("room") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), still))
    if whole:
        part = F.when(part * 2 >= F.col("size"), F.when(still > 0, F.col("size")).otherwise(0)).otherwise(0)
    taken = outside.unionByName(placed.where(F.col("cut")).withColumn("more", part))
    words = (F.col("full") * F.col("size") + F.col("more")).cast("long")
    return taken.select("doc_id", back.alias("source"), "size", "source_size", "target", words.alias("taken"), "ord", "full", "more")


def repeat_documents(spark: SparkSession, docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as the
    mix takes it in whole texts; documents without words stay once.

    What a document gets follows from its source's whole repetitions and from
    the place in the seeded order where the last one ends, so texts are not
    shuffled: a table of one row per source is joined to them."""
    name, full, cut, times, copy = free_names(docs, "_source", "_full", "_cut", "_times", "_copy")
    cuts = mix(spark, docs, seed=seed, whole=True).groupBy("source").agg(
        F.first("full").alias(full), F.coalesce(F.min(F.when((F.col("more") == 0) & (F.col("size") > 0), F.col("ord"))), F.lit("g")).alias(cut))
    cuts = staged(spark, cuts.withColumnRenamed("source", name), "mix-cuts")
    side = F.broadcast(cuts) if cuts.count() <= BROADCAST_SOURCES else cuts
    due = F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col(full) + (seeded_order(seed) < F.col(cut)).cast("int")).otherwise(1)
    placed = docs.join(side, F.col("source").eqNullSafe(F.col(name))).withColumn(times, due.cast("int")).where(F.col(times) > 0)
    copies = placed.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return copies.drop(name, full, cut, times, copy)
