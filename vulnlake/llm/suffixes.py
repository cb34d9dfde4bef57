"""Exact removal of repeated byte strings by sorted suffixes.

A byte string of length L that starts at two places makes the suffixes there
neighbours in suffix order.  Sorting a suffix for every byte is out of reach
of a shuffle, so suffixes are sampled by content: in every window of L bytes
the positions of the least gram (the anchors) are taken, hence equal windows
have their anchors at equal offsets and meet at them.

1. Suffixes at anchors are range-partitioned by their leading bytes with
   sampled splitters, equal ones combined beforehand; buckets sort locally
   and neighbours are compared, also across bucket boundaries.  An anchor
   whose gram has no equal neighbour lies in no repeated window.
2. An anchor whose hull (all bytes of the windows round it) occurs twice has
   repeated windows only.  What is left, with one witness of every repeated
   hull beside it, is compared window by window within its gram.
3. Grams with very many different hulls (the edges of a passage that a large
   part of all documents share) are not gathered: their windows form
   intervals, and an interval whose hull occurs twice is repeated, one whose
   core (the bytes its windows share) occurs once is not, and what lies
   between is cut into single windows, all by counting.

Grams, and windows within a gram, are compared by 64-bit hashes of two
independent bases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm.common import discard, in_batches, staged
from vulnlake.llm.minhash import text_key

LENGTH = 400
#: Windows that share an anchor: one gram is LENGTH - SPREAD + 1 bytes long.
SPREAD = 256
#: Windows in an interval of the second level; single windows are the third.
STEP = 16
#: Leading bytes of a suffix by which buckets are cut and sorted: one long.
LEAD = 8
#: Contexts of one gram that are compared in one task; larger grams are counted.
GROUP = 500
SEED = 4
#: Largest tables of spans (documents) and of open anchors that are broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_ANCHORS = 2_000_000
_U = np.uint64
_MASK = (1 << 64) - 1


class Rolling:
    """Hashes of any substrings of a byte string: sums of byte codes times
    powers of an odd base, modulo 2**64, so every length is one subtraction."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.codes = rng.integers(0, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
        self.base = (int(rng.integers(0, 1 << 61)) << 3 | 5) & _MASK
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = np.ones(1, _U)
        self.down = np.ones(1, _U)

    def _powers(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([self.up, self.up * _U(pow(self.base, m, 1 << 64))])
                self.down = np.concatenate([self.down, self.down * _U(pow(self.inverse, m, 1 << 64))])

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, _U)
        np.cumsum(self.codes[data] * self.down[: len(data)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._mixed((prefix[end] - prefix[start]) * self.up[start], (end - start).astype(_U))

    def every(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """The hashes of all substrings of ``width`` bytes, by their starts."""
        n = len(prefix) - width
        return self._mixed((prefix[width:] - prefix[:n]) * self.up[:n], _U(width))

    @staticmethod
    def _mixed(h: np.ndarray, width) -> np.ndarray:
        h = (h ^ (h >> _U(31))) * _U(0x94D049BB133111EB) + width
        return h ^ (h >> _U(29))


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every ``width`` consecutive values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[: len(x) - step], x[step:])
        done += step
    return x


def anchors_of(gram_hash: np.ndarray, spread: int) -> np.ndarray:
    """Positions whose gram is least in some run of ``spread`` grams."""
    least = _sliding(gram_hash, spread, np.minimum)
    pad = np.zeros(spread - 1, gram_hash.dtype)
    nearest = _sliding(np.concatenate([pad, least, pad]), spread, np.maximum)
    return np.flatnonzero(nearest == gram_hash)


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The LEAD bytes at each position as a long of the same order."""
    out = np.zeros(len(at), _U)
    for k in range(LEAD):
        out = (out << _U(8)) | data[at + k].astype(_U)
    return (out ^ _U(1 << 63)).view(np.int64)


def _hull(hashes: Rolling, prefix: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end and of where the anchor lies in
    them, so that a hull cut short by an end of its text differs from others."""
    return hashes.between(prefix, start, end).view(np.int64) * 3 + (at - start) * 1_000_003 + (end - at)


def document_anchors(spark: SparkSession, docs: DataFrame, length: int, spread: int) -> DataFrame:
    """doc_id, h, at, lead, g (gram), u (hull of the windows round the anchor
    inside the document)."""
    gram = length - spread + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, hulls = Rolling(SEED), Rolling(SEED + 1)
        for frame in batches:
            cols: dict[str, list] = {k: [] for k in ("row", "at", "lead", "g", "u")}
            for row, text in enumerate(frame["text"]):
                data = _bytes(text)
                n = len(data)
                if n < length:
                    continue
                g = grams.every(grams.prefix(data), gram)
                at = anchors_of(g, spread)
                cols["row"].append(np.full(len(at), row))
                cols["at"].append(at.astype(np.int32))
                cols["lead"].append(_leading(data, at))
                cols["g"].append(g[at].view(np.int64))
                cols["u"].append(_hull(hulls, hulls.prefix(data), at, np.maximum(at - spread + 1, 0), np.minimum(at + length, n)))
            if cols["row"]:
                rows, *rest = (np.concatenate(v) for v in cols.values())
                of_doc = {c: frame[c].to_numpy()[rows] for c in ("doc_id", "h")}
                yield pd.DataFrame(of_doc | dict(zip(("at", "lead", "g", "u"), rest, strict=True)))

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    texts = docs.where(F.octet_length("text") >= length).select("doc_id", text_key(F.col("text")).alias("h"), "text")
    return texts.mapInPandas(run, f"doc_id {kind}, h long, at int, lead long, g long, u long")


def repeated_grams(spark: SparkSession, anchors: DataFrame) -> DataFrame:
    """lead, g, hulls, single of the grams that start at two anchors or more:
    how many different hulls they have, and how many occur once.

    Equal (gram, hull) pairs are combined first, so a gram of very many copies
    is a few records; the records are range-partitioned by leading bytes with
    sampled splitters, each bucket is sorted, and a record is compared with
    the one before it.  Runs of one gram that cross a bucket boundary are
    joined afterwards."""
    hulls = anchors.groupBy("lead", "g", "u").agg(F.count(F.lit(1)).alias("n"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = hulls.repartitionByRange(parts, "lead", "g", "u").sortWithinPartitions("lead", "g")

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row for each run of equal grams in a bucket that may have two anchors."""
        last, first_run = None, True
        for frame in batches:
            if not len(frame):
                continue
            lead, g, n = frame["lead"].to_numpy(), frame["g"].to_numpy(), frame["n"].to_numpy()
            new = np.ones(len(frame), bool)
            new[1:] = (g[1:] != g[:-1]) | (lead[1:] != lead[:-1])
            first = np.flatnonzero(new)
            out = pd.DataFrame({"lead": lead[first], "g": g[first], "n": np.add.reduceat(n, first),
                                "hulls": np.diff(np.append(first, len(frame))), "single": np.add.reduceat((n == 1).astype(np.int64), first)})
            if last is not None:
                if (last["lead"].iloc[0], last["g"].iloc[0]) == (out["lead"].iloc[0], out["g"].iloc[0]):
                    out.loc[0, ["n", "hulls", "single"]] += last[["n", "hulls", "single"]].iloc[0]
                else:
                    out = pd.concat([last, out], ignore_index=True)
            last = out.iloc[-1:].reset_index(drop=True)
            out = out.iloc[:-1]
            # a single anchor matters only at the ends of the bucket
            keep = (out["n"] > 1).to_numpy()
            if first_run and len(out):
                keep[0], first_run = True, False
            yield out[keep]
        if last is not None:
            yield last

    found = ordered.mapInPandas(runs, "lead long, g long, n long, hulls long, single long")
    whole = found.groupBy("lead", "g").agg(*[F.sum(c).alias(c) for c in ("n", "hulls", "single")])
    return whole.where("n > 1").select("lead", "g", "hulls", "single")


def _window_runs(rows: list[tuple], hashes: Rolling, length: int, spread: int) -> list[tuple]:
    """(doc_id, h, start, end) of the repeated windows round the anchors of one
    gram; rows are (doc_id, h, at, w, left, context)."""
    if sum(row[3] for row in rows) < 2:
        return []
    keys, which, windows, weights = [], [], [], []
    for i, (_, _, _, w, left, context) in enumerate(rows):
        # windows that start s bytes before the anchor and end inside the context
        s = np.arange(max(0, left + length - len(context)), min(left, spread - 1) + 1)
        if not len(s):
            continue
        start = left - s
        keys.append(hashes.between(hashes.prefix(np.frombuffer(context, np.uint8)), start, start + length) * _U(spread * 2 + 1) + s.astype(_U))
        which.append(np.full(len(s), i))
        windows.append(s)
        weights.append(np.full(len(s), w))
    if not keys:
        return []
    _, same = np.unique(np.concatenate(keys), return_inverse=True)
    often = np.bincount(same, weights=np.concatenate(weights))[same] > 1
    which, windows = np.concatenate(which)[often], np.concatenate(windows)[often]
    out = []
    if len(which):
        # runs of consecutive windows of one context
        cut = np.flatnonzero((np.diff(which) != 0) | (np.diff(windows) != 1)) + 1
        for a, b in zip(np.append(0, cut), np.append(cut, len(which)), strict=True):
            doc, h, at = rows[which[a]][:3]
            out.append((doc, h, int(at - windows[b - 1]), int(at - windows[a] + length)))
    return out


def _compare_grams(length: int, spread: int):
    """mapInPandas over contexts sorted by gram: one gram at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, gram, rows = Rolling(SEED + 1), None, []
        for frame in batches:
            out: list[tuple] = []
            columns = (frame[c].tolist() for c in ("doc_id", "h", "at", "w", "left", "context"))
            for g, row in zip(frame["g"].tolist(), zip(*columns, strict=True), strict=True):
                if g != gram:
                    out += _window_runs(rows, hashes, length, spread)
                    gram, rows = g, []
                rows.append(row)
            yield pd.DataFrame(out, columns=["doc_id", "h", "start", "end"])
        yield pd.DataFrame(_window_runs(rows, hashes, length, spread), columns=["doc_id", "h", "start", "end"])

    return run


def _intervals(frame: pd.DataFrame, cores: Rolling, hulls: Rolling, length: int, spread: int, step: int, only: str | None) -> pd.DataFrame:
    """Intervals of ``step`` windows round each anchor: doc_id, h, at, lo, w, core
    and hull hashes.  Window s starts s bytes before the anchor.  ``only``
    names a column of interval starts to cut; else all are."""
    cols: dict[str, list] = {k: [] for k in ("doc_id", "h", "at", "lo", "w", "c", "u")}
    for row in frame.itertuples(index=False):
        data = np.frombuffer(row.context, np.uint8)
        a = row.left  # the anchor within its context
        lo = np.arange(0, spread, step) if only is None else np.concatenate([np.arange(x, x + STEP, step) for x in getattr(row, only)])
        hi = lo + step - 1
        inside = (a - lo >= 0) & (a - hi + length <= len(data))  # the core lies in the document: some window may
        lo, hi = lo[inside], hi[inside]
        if not len(lo):
            continue
        start, end = np.maximum(a - hi, 0), np.minimum(a - lo + length, len(data))
        cols["lo"].append(lo)
        cols["c"].append(cores.between(cores.prefix(data), a - lo, a - hi + length).view(np.int64))
        cols["u"].append(_hull(hulls, hulls.prefix(data), np.full(len(lo), a), start, end))
        for k, v in (("doc_id", row.doc_id), ("h", row.h), ("at", row.at), ("w", row.w)):
            cols[k].append(np.full(len(lo), v, dtype=object))
    return pd.DataFrame({k: np.concatenate(v) if v else [] for k, v in cols.items()})


def _count_large_grams(spark: SparkSession, context: DataFrame, kind: str, length: int, spread: int) -> DataFrame:
    """doc_id, h, start, end of repeated windows in grams of very many hulls, by counting intervals."""
    schema = f"doc_id {kind}, h long, at int, lo int, w int, c long, u long"

    def cut(step: int, only: str | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cores, hulls = Rolling(SEED), Rolling(SEED + 1)
            for frame in batches:
                yield _intervals(frame, cores, hulls, length, spread, step, only)
        return run

    parts = staged(spark, context.mapInPandas(cut(STEP, None), schema), "suffix-intervals")
    cores = parts.groupBy("lo", "c").agg(F.sum("w").alias("nc")).where("nc > 1")
    hulls = parts.groupBy("lo", "c", "u").agg(F.sum("w").alias("nu"), F.min(F.struct("doc_id", "h", "at")).alias("witness"))
    hulls = hulls.join(cores, ["lo", "c"]).withColumn("state", F.when(F.col("nu") > 1, 2).otherwise(1))
    settled = staged(spark, parts.join(hulls, ["lo", "c", "u"]), "suffix-settled")
    sure = settled.where("state = 2").select("doc_id", "h", F.greatest(F.col("at") - F.col("lo") - (STEP - 1), F.lit(0)).alias("start"),
                                             (F.col("at") - F.col("lo") + length).alias("end"))
    # cores beside which an interval is undecided, each hull once: a witness counts twice
    undecided = settled.where("state = 1").select("lo", "c").distinct()
    once = settled.join(undecided, ["lo", "c"], "left_semi").where("state = 1 or (witness.doc_id <=> doc_id and witness.h = h and witness.at = at)")
    chosen = once.groupBy("doc_id", "h", "at").agg(F.collect_list(F.when(F.col("state") == 1, F.col("lo"))).alias("ones"),
                                                   F.collect_list(F.when(F.col("state") == 2, F.col("lo"))).alias("twos"))
    narrow = context.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("at").alias("_at"), "left", "context")
    fine = staged(spark, chosen.join(narrow, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")) & (F.col("at") == F.col("_at")))
                  .drop("_id", "_h", "_at"), "suffix-fine")
    ones = fine.where("size(ones) > 0").withColumn("w", F.lit(1)).mapInPandas(cut(1, "ones"), schema)
    twos = fine.where("size(twos) > 0").withColumn("w", F.lit(2)).mapInPandas(cut(1, "twos"), schema)
    windows = staged(spark, ones.unionAll(twos), "suffix-windows")
    again = windows.groupBy("lo", "c", "u").agg(F.sum("w").alias("n")).where("n > 1").select("lo", "c", "u")
    single = windows.join(again, ["lo", "c", "u"], "left_semi").select(
        "doc_id", "h", (F.col("at") - F.col("lo")).alias("start"), (F.col("at") - F.col("lo") + length).alias("end"))
    return sure.unionAll(single)


def repeated_spans(spark: SparkSession, docs: DataFrame, length: int = LENGTH, spread: int = SPREAD) -> DataFrame:
    """doc_id, h, spans: for every (id, text) with repeated bytes, the maximal
    byte ranges (start, end) covered by ``length``-byte strings that also
    start elsewhere, in the same or another document."""
    in_batches(spark)
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    anchors = staged(spark, document_anchors(spark, docs, length, spread), "suffix-anchors")
    grams = staged(spark, repeated_grams(spark, anchors), "suffix-grams")
    shared = staged(spark, anchors.join(grams, ["lead", "g"]).drop("lead"), "suffix-shared")
    discard(spark, anchors)
    hulls = shared.groupBy("g", "u").agg(F.count(F.lit(1)).alias("nu"), F.min(F.struct("doc_id", "h", "at")).alias("first"),
                                         F.first("hulls").alias("hulls"), F.first("single").alias("single"))
    hulls = staged(spark, hulls, "suffix-hulls")
    spans = [shared.join(hulls.where("nu > 1").select("g", "u"), ["g", "u"], "left_semi")
             .select("doc_id", "h", F.greatest(F.col("at") - (spread - 1), F.lit(0)).alias("start"), (F.col("at") + length).alias("end"))]
    # single hulls, and one witness, counted twice, for every repeated hull beside them
    open_ = hulls.where("single > 0").select("first.*", F.least("nu", F.lit(2)).cast("int").alias("w"), "g", (F.col("hulls") > GROUP).alias("large"))
    open_ = staged(spark, open_.groupBy("doc_id", "h").agg(F.collect_list(F.struct("at", "w", "g", "large")).alias("ats")), "suffix-open")
    n_open = open_.agg(F.coalesce(F.sum(F.size("ats")), F.lit(0))).first()[0]

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for doc, h, text, ats in zip(frame["doc_id"], frame["h"], frame["text"], frame["ats"], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                for x in ats:
                    left = min(x["at"], spread - 1)
                    rows.append((doc, h, x["at"], x["w"], x["g"], left, data[x["at"] - left: x["at"] + length]))
            yield pd.DataFrame(rows, columns=["doc_id", "h", "at", "w", "g", "left", "context"])

    repeated_rows = bool(docs.groupBy("doc_id", text_key(F.col("text")).alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1))

    def contexts_of(large: bool) -> DataFrame:
        ats = F.filter("ats", lambda x: x["large"] == F.lit(large))
        side = open_.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), ats.alias("ats")).where(F.size("ats") > 0)
        side = F.broadcast(side) if n_open <= BROADCAST_ANCHORS else side
        texts = docs.select("doc_id", text_key(F.col("text")).alias("h"), "text")
        texts = texts.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("doc_id", "h", "text", "ats")
        context = texts.mapInPandas(contexts, f"doc_id {kind}, h long, at int, w int, g long, left int, context binary")
        # rows that repeat an id and a text give their contexts once
        return context.dropDuplicates(["doc_id", "h", "at"]) if repeated_rows else context

    small = contexts_of(False).repartition("g").sortWithinPartitions("g")
    small = small.mapInPandas(_compare_grams(length, spread), f"doc_id {kind}, h long, start int, end int")
    spans.append(staged(spark, small, "suffix-runs"))
    if open_.where(F.exists("ats", lambda x: x["large"])).take(1):
        spans.append(_count_large_grams(spark, staged(spark, contexts_of(True), "suffix-contexts"), kind, length, spread))
    every = spans[0]
    for more in spans[1:]:
        every = every.unionAll(more)

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def maximal(found: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in xs])] for xs in found])

    # ranges of one text: their number follows its length
    return every.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "end")).alias("spans")).withColumn("spans", maximal("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of byte ranges."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, spread: int = SPREAD) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed byte runs), kept (the bytes left).

    Null and empty texts, and texts shorter than ``length``, lose nothing.
    Rows that repeat an id and a text are copies of each other and lose what
    repeats like any other copies.  Columns beyond doc_id and text are not
    looked at.  Empty input: no rows."""
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    spans = staged(spark, repeated_spans(spark, docs, length, spread), "suffix-spans")
    side = spans.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "spans")
    side = F.broadcast(side) if spans.count() <= BROADCAST_ROWS else side
    joined = docs.select("doc_id", "text").join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key(F.col("text")) == F.col("_h")), "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for doc, text, found in zip(frame["doc_id"], frame["text"], frame["spans"], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                # a hull is given with its full reach: the text may end before
                runs = [(x["start"], min(x["end"], len(data))) for x in found] if found is not None else []
                ends = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                rows.append((doc, len(data), [{"start": a, "end": b} for a, b in runs], kept))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "spans", "kept"])

    return joined.select("doc_id", "text", "spans").mapInPandas(
        run, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
