"""Near-duplicate documents by min-max hashing.

Every permutation of the shingle hashes is evaluated once and gives two
signature values, its minimum and its maximum; bands of several minima, or
of several maxima, are the keys under which candidates meet.  Candidates
are confirmed on their full shingle sets, and confirmed links are joined to
components.

Work is done on distinct shingle sets, so copies of a text cost one set.
Within a key, members are compared with one hub only, the member that shares
most keys with others.  Two members linked to the hub are in one component.
If x is not linked to the hub h, then x and y can be linked only if they
differ from h in the same shingles: with I = |x & y| needed for a link,

    I = |h| - |h - x| - |h - y| + |Dx & Dy|,    Dx = (h - x) | (x - h),

so |Dx & Dy| has to reach a number t that follows from the sizes.  Members of
unfinished keys therefore meet in a prefix-filtered join on their differences
from the hub, rarest first.  So a large group of near copies costs one
comparison per member and key, its members are never all paired, and no pair
that shares a key is left undecided.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm.common import REMEMBERED, free_names, in_batches, staged
from vulnlake.llm.graph import components

#: Similarity from which two sets are linked, as a fraction of integers.
LINK = (80, 100)
#: 56 permutations give 112 values: 28 bands of four.  At similarity 0.8 a
#: pair meets in no band with probability (1 - 0.8**4)**28 < 4e-7.
PERMUTATIONS, BAND_ROWS = 56, 4
SEED = 1
#: Largest id table that is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000
_CHUNK = 1 << 13
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (constants of the public splitmix64 generator)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes:
    """64-bit hashes of the words of a text, ASCII letters in lower case."""

    def __init__(self) -> None:
        self.seen: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
        seen, digest = self.seen, xxhash.xxh3_64_intdigest
        if len(seen) > REMEMBERED:
            seen.clear()
        out = np.empty(len(words), dtype=_U)
        for i, w in enumerate(words):
            h = seen.get(w)
            if h is None:
                h = seen[w] = digest(w)
            out[i] = h
        return out


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; fewer words make
    one shingle of the whole sequence, no words none."""
    if len(words) == 0:
        return words
    width = min(width, len(words))
    h = np.full(len(words) - width + 1, width, dtype=_U)
    for k in range(width):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + words[k: len(words) - width + 1 + k])
    return np.unique(h)


class MinMaxSignature:
    """Band keys of a shingle set."""

    def __init__(self, permutations: int = PERMUTATIONS, band_rows: int = BAND_ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mul = rng.integers(0, 1 << 63, permutations, dtype=_U) * _U(2) + _U(1)
        self.add = rng.integers(0, 1 << 63, permutations, dtype=_U)
        self.rows = band_rows

    def values(self, shingles: np.ndarray) -> np.ndarray:
        """Minima of all permutations, then maxima."""
        low = np.full(len(self.mul), np.iinfo(_U).max, dtype=_U)
        high = np.zeros(len(self.mul), dtype=_U)
        for i in range(0, len(shingles), _CHUNK):
            v = shingles[i: i + _CHUNK, None] * self.mul + self.add
            np.minimum(low, v.min(axis=0), out=low)
            np.maximum(high, v.max(axis=0), out=high)
        return np.concatenate([low, high])

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        v = self.values(shingles).reshape(-1, self.rows)
        key = np.arange(1, len(v) + 1, dtype=_U)
        for k in range(self.rows):
            key = _mix(key * _U(0x9E3779B97F4A7C15) + v[:, k])
        return key.view(np.int64)


def _fingerprint(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def text_key(text: Column) -> Column:
    """Tells rows with one id and different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signatures(spark: SparkSession, docs: DataFrame, width: int) -> DataFrame:
    """doc_id, h (text key), n_shingles, fp (null for empty sets), bands."""
    in_batches(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, signature = WordHashes(), MinMaxSignature()
        for frame in batches:
            sets = [shingle_set(hashes(t), width) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "h": frame["h"], "n_shingles": [len(s) for s in sets],
                                "fp": [_fingerprint(s) if len(s) else None for s in sets],
                                "bands": [signature.bands(s) if len(s) else None for s in sets]})

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return docs.select("doc_id", text_key(F.col("text")).alias("h"), "text").mapInPandas(
        run, f"doc_id {kind}, h long, n_shingles long, fp binary, bands array<long>")


def _few(df: DataFrame) -> DataFrame:
    """Broadcast a staged id table if its row count allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _sets(spark: SparkSession, docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """fp, s (full shingle set) of the sets in ``wanted`` (fp, doc_id, h)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for frame in batches:
            sets = [shingle_set(hashes(t), width) for t in frame["text"]]
            yield pd.DataFrame({"fp": frame["fp"], "s": [s.view(np.int64) for s in sets]})

    w = _few(wanted.select("fp", F.col("doc_id").alias("w_id"), F.col("h").alias("w_h")))
    texts = docs.select("doc_id", text_key(F.col("text")).alias("h"), "text")
    texts = texts.join(w, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h"))).select("fp", "text")
    return texts.mapInPandas(run, "fp binary, s array<long>").dropDuplicates(["fp"])


def _confirmed(spark: SparkSession, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    ends = staged(spark, pairs.select(F.col("a").alias("fp")).unionAll(pairs.select("b")).distinct(), "dup-ends")
    sets = sets.join(_few(ends), "fp", "left_semi")
    left = pairs.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    return both.where(same * LINK[1] >= (F.size("sa") + F.size("sb") - same) * LINK[0]).select("a", "b")


def _with_root(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("root", F.col("fp"))
    return members.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _needed(total: Column) -> Column:
    """Least |x & y| of a link between sets of ``total`` shingles together."""
    return F.ceil(total * F.lit(LINK[0]) / F.lit(sum(LINK)))


def _pairs_by_difference(spark: SparkSession, group: DataFrame, full: DataFrame) -> DataFrame:
    """Pairs (a, b) of one group that may be linked, at least one of them not to the hub.

    ``group``: hub, fp, root, hub_root.  Differences from the hub are sorted by
    how many members share them; a pair must share one within the first
    elements, with enough elements left after it (positions are counted from
    0, so |D| - position elements are left)."""
    near = group.join(full.select("fp", F.col("s").alias("sx")), "fp").join(full.select(F.col("fp").alias("hub"), F.col("s").alias("sh")), "hub")
    gone, new = F.array_except("sh", "sx"), F.array_except("sx", "sh")
    tag = lambda side: lambda e: F.struct(F.lit(side).alias("side"), e.alias("e"))
    near = near.select("hub", "fp", "root", (F.col("root") != F.col("hub_root")).alias("failed"), F.size("sx").alias("nx"), F.size("sh").alias("nh"),
                       F.size(gone).alias("na"), F.size(new).alias("nb"), F.concat(F.transform(gone, tag(0)), F.transform(new, tag(1))).alias("d"))
    near = staged(spark, near, "dup-differences")
    each = near.select("hub", "fp", F.explode("d").alias("d")).select("hub", "fp", "d.side", "d.e")
    shared = each.groupBy("hub", "side", "e").agg(F.count(F.lit(1)).alias("df"))
    ordered = each.join(shared, ["hub", "side", "e"]).groupBy("hub", "fp").agg(F.sort_array(F.collect_list(F.struct("df", "side", "e"))).alias("d"))
    near = near.drop("d").join(ordered, ["hub", "fp"])
    # what a partner must share at least: of a member that failed, and of any member beside one that failed
    short = _needed(F.col("nx") + F.col("nh")) - F.col("nh") + F.col("na")
    beside = F.ceil((F.col("na") * 5 + F.col("nb") * 4 + 1) / F.lit(9))
    size = F.size("d")
    prefix = near.select("hub", "fp", "root", "failed", "nx", "nh", "na", "nb", size.alias("nd"),
                         F.greatest(size - beside + 1, F.when(F.col("failed"), size - short + 1).otherwise(0)).alias("length"),
                         F.posexplode("d").alias("at", "d")).where((F.col("at") < F.col("length")) & (F.col("d.df") > 1))
    prefix = staged(spark, prefix.select("hub", "fp", "root", "failed", "nx", "nh", "na", "nb", (F.col("nd") - F.col("at")).alias("left"), "d.side", "d.e"), "dup-prefixes")
    other = prefix.select("hub", "side", "e", *[F.col(c).alias(f"{c}2") for c in ("fp", "root", "nx", "na", "nb", "left")])
    t = _needed(F.col("nx") + F.col("nx2")) - F.col("nh") + F.col("na") + F.col("na2")
    may = (t <= F.least("left", "left2")) & (t <= F.least("na", "na2") + F.least("nb", "nb2"))
    met = prefix.where("failed").join(other, ["hub", "side", "e"]).where((F.col("root") != F.col("root2")) & may)
    return met.select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b")).distinct()


def link_sets(spark: SparkSession, docs: DataFrame, sets: DataFrame, width: int) -> DataFrame | None:
    """(node, root) of the distinct sets that have a link, or None.
    ``sets``: fp, n, bands, doc_id, h (a document that holds the set)."""
    keys = sets.select("fp", "n", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    members = staged(spark, keys.join(shared, "band"), "dup-members")
    central = staged(spark, members.groupBy("fp").agg(F.sum("k").alias("met")), "dup-central")
    wanted = staged(spark, sets.select("fp", "doc_id", "h").join(central.select("fp"), "fp", "left_semi"), "dup-wanted")
    full = staged(spark, _sets(spark, docs, wanted, width), "dup-sets")
    best = F.min(F.struct((-F.col("met")).alias("o"), F.xxhash64("fp").alias("tie"), F.col("fp"), F.col("n"))).alias("hub")
    hubs = members.join(central, "fp").groupBy("band").agg(best).select("band", F.col("hub.fp").alias("hub"), F.col("hub.n").alias("n2"))
    hubs = staged(spark, hubs, "dup-hubs")
    # the smaller set of a link holds at least the share of the larger
    alike = F.least("n", "n2") * LINK[1] >= F.greatest("n", "n2") * LINK[0]
    met = members.join(hubs, "band").where((F.col("fp") != F.col("hub")) & alike)
    pairs = staged(spark, met.select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct(), "dup-pairs")
    links = staged(spark, _confirmed(spark, pairs, full), "dup-links")
    roots = staged(spark, components(spark, links), "dup-roots") if links.take(1) else None
    rest = _with_root(members.join(hubs, "band").where("fp <> hub").select("band", "hub", "fp"), roots)
    apart = rest.groupBy("band").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("band")
    group = rest.join(apart, "band", "left_semi").select("hub", "fp", "root").distinct()
    hub_roots = _with_root(hubs.select(F.col("hub").alias("fp")).distinct(), roots).select(F.col("fp").alias("hub"), F.col("root").alias("hub_root"))
    group = staged(spark, group.join(hub_roots, "hub"), "dup-groups")
    if group.take(1):
        pairs = staged(spark, _pairs_by_difference(spark, group, full), "dup-pairs")
        more = staged(spark, _confirmed(spark, pairs, full), "dup-links")
        if more.take(1):
            # the stars found so far stand for all earlier links
            roots = staged(spark, components(spark, more if roots is None else more.unionAll(roots.select("node", "root"))), "dup-roots")
    return roots


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, h, n_shingles, component_id, kept, first.

    Documents whose ``width``-word shingle sets reach a Jaccard similarity of
    0.8 are linked; ``component_id`` is the least id reachable (null ids are
    passed over unless there is no other) and ``kept`` says that the row has
    it.  ``first`` is true for one (id, text) of each component.  Texts
    without words, and null texts, are linked with nothing and kept.  Repeated
    rows share their component.  Columns beyond doc_id and text are not looked
    at.  Empty input: no rows."""
    rows = staged(spark, signatures(spark, docs, width), "dup-signatures")
    # struct order puts nulls first: the flag sends rows without an id last
    me = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("h"))
    sets = rows.where("fp is not null").groupBy("fp").agg(F.min(me).alias("me"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    sets = staged(spark, sets.select("fp", "n", "bands", "me", "me.doc_id", "me.h"), "dup-distinct")
    roots = link_sets(spark, docs, sets, width)
    heads = sets.select("fp", F.col("me").alias("head"))
    if roots is not None:
        joined = staged(spark, roots.withColumnRenamed("node", "fp").join(heads, "fp"), "dup-joined")
        best = joined.groupBy("root").agg(F.min("head").alias("best"))
        linked = joined.join(best, "root").select("fp", "best")
        heads = heads.join(linked, "fp", "left").select("fp", F.coalesce("best", "head").alias("head"))
    out = rows.drop("bands").join(heads, "fp", "left")
    # a null id is the component's only if no row of it has one
    own = F.col("fp").isNull()
    return out.select("doc_id", "h", "n_shingles", F.when(own, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
                      (own | F.col("doc_id").eqNullSafe(F.col("head.doc_id"))).alias("kept"),
                      (own | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("h") == F.col("head.h")))).alias("first"))


def keep_first(spark: SparkSession, docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each component.
    Rows that repeat an id and a text are copies of one document."""
    verdicts = staged(spark, near_duplicates(spark, docs, width), "dup-verdicts")
    per_row = verdicts.groupBy("doc_id", "h").agg(F.max("first").alias("first"), F.count(F.lit(1)).alias("k"), F.max("n_shingles").alias("n"))
    key, own_id, own_key, one = free_names(docs, "_key", "_id", "_h", "_first")
    odd = per_row.where("not first or (k > 1 and n > 0)").select(F.col("doc_id").alias(own_id), F.col("h").alias(own_key), F.col("first").alias(one))
    odd = staged(spark, odd, "dup-odd")
    keyed = docs.withColumn(key, text_key(F.col("text")))
    on = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_key))
    once = keyed.join(_few(odd), on, "left_anti")
    repeated = odd.where(F.col(one))
    if repeated.take(1):
        again = keyed.join(_few(staged(spark, repeated, "dup-repeated")), on, "left_semi")
        once = once.unionByName(again.dropDuplicates(["doc_id", key]))
    return once.drop(key)
