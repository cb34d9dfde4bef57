"""Cross-tokenizer alignment: which tokens of one vocabulary meet which of another.

A text is encoded by a byte-level BPE (A, with a space before it) and by a
SentencePiece model (B, which adds that space).  Tokens of A and B whose byte
ranges overlap are linked; byte offsets where both end cut the text into groups.

Both tokenizers begin anew at a space between two other signs, so a text is the
sequence of its units (the stretches between such spaces), and a unit is aligned
once and remembered, within a bound, for all its occurrences in the worker's
tasks.

1. First pass: every task counts the links of its documents for each id pair.
2. The distinct pairs are dealt into buckets by a hash; each bucket gets a
   minimal perfect hash (levels of bits: a key takes the first level where no
   other key shares its bit; its number is the rank of that bit).
3. The tasks' counts become dense vectors indexed by that hash, some tasks to a
   vector, and the vectors are summed up a tree.  The keys lie in a vector of
   the same order, so a key that the hash does not know is told apart.
4. Second pass: documents are aligned again, and the counts of their links are
   looked up.  Tables up to ``BROADCAST_BYTES`` go to all tasks; beyond, the
   links of each document, one row for each of its pairs, are joined with them.

Texts that are null or empty, or whose tokens do not give back the bytes of
space + text, have no tokens: zeros and an empty string.  Repeated rows are
aligned alike; an empty table gives no rows.  Memory: a batch of texts, the
units remembered, and the tokens of the longest stretch without a space.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm.common import in_batches, row_key, staged

#: Units remembered by a Python worker, and id pairs that one may count before it hands them on.
UNITS = 400_000
PAIRS = 400_000
#: Signs of a run of units that are encoded together.
RUN = 1 << 15
#: Keys of a bucket, about; tasks (or vectors) that are summed at once.
BUCKET = 1 << 15
FAN_IN = 16
#: Size of a table of pairs (hash, keys, counts) that all tasks may hold.
BROADCAST_BYTES = 48 << 20
#: A pair's key: the id of A above that of B.
SHIFT = 24
NO_KEY = -1


# ------------------------------- alignment ---------------------------------

def byte_alphabet() -> dict[str, int]:
    """The signs that stand for bytes in a byte-level vocabulary: printable
    bytes for themselves, the others by the signs from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_json: bytes, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        signs = byte_alphabet()
        names = json.loads(a_json)["model"]["vocab"]
        size = max(names.values()) + 1
        self.a_bytes = [b""] * size
        for name, i in names.items():
            self.a_bytes[i] = bytes(signs[c] for c in name)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
                        for p in (self.b.id_to_piece(i) for i in range(self.b.vocab_size()))]
        self.a_names, self.b_names = list(map(str, range(size))), list(map(str, range(len(self.b_bytes))))
        self.a_size = np.array([len(t) for t in self.a_bytes])
        self.b_size = np.array([len(t) for t in self.b_bytes])

    def _encoded(self, runs: list[str]) -> tuple[list, list]:
        """Ids of A and of B for each run of units; None where the bytes differ."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + r for r in runs], add_special_tokens=False)]
        b = self.b.encode(runs, num_threads=1)
        for i, run in enumerate(runs):
            whole = f" {run}".encode()
            if b"".join(map(self.b_bytes.__getitem__, b[i])) != whole or b"".join(map(self.a_bytes.__getitem__, a[i])) != whole:
                a[i] = b[i] = None
        return a, b

    def align(self, units: list[str], groups: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Per unit whether its bytes differ and its numbers of tokens and
        groups, the keys of all links with their units, and the groups as text.

        Units are encoded in runs, for both tokenizers begin anew at the spaces
        between them; the units of a run that fails are encoded one by one."""
        runs, size = [], RUN
        for i, u in enumerate(units):
            odd = u != u.strip()  # beside a white space no new beginning is certain
            if odd or size >= RUN:
                runs.append([])
                size = RUN if odd else 0
            runs[-1].append(i)
            size += len(u)
        a, b = self._encoded([" ".join([units[i] for i in r]) for r in runs])
        failed = [j for j, x in enumerate(a) if x is None and len(runs[j]) > 1]
        if failed:
            alone = [i for j in failed for i in runs[j]]
            more_a, more_b = self._encoded([units[i] for i in alone])
            left = [j for j in range(len(runs)) if j not in set(failed)]
            runs = [runs[j] for j in left] + [[i] for i in alone]
            a, b = [a[j] for j in left] + more_a, [b[j] for j in left] + more_b
        bad = np.zeros(len(units), bool)
        bad[[i for r, x in zip(runs, a) if x is None for i in r]] = True
        order = np.array([i for r, x in zip(runs, a) if x is not None for i in r], int)
        good_a, good_b = ([x for x in y if x is not None] for y in (a, b))
        ids_a = np.fromiter(chain.from_iterable(good_a), np.int64)
        ids_b = np.fromiter(chain.from_iterable(good_b), np.int64)
        ends_a, ends_b = self.a_size[ids_a].cumsum(), self.b_size[ids_b].cumsum()
        unit_ends = np.cumsum([len(units[i].encode()) + 1 for i in order], dtype=np.int64)
        cuts = np.union1d(ends_a, ends_b)  # a stretch between cuts lies in one token of each
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        sums, texts = np.zeros((len(units), 3), np.int64), [""] * len(units)
        if not len(order):
            return bad, sums, np.zeros(0, np.int64), np.zeros(0, np.int64), texts
        keys = ids_a[np.searchsorted(ends_a, cuts)] << SHIFT | ids_b[np.searchsorted(ends_b, cuts)]
        for j, ends in enumerate((ends_a, ends_b, common)):
            sums[order, j] = np.bincount(np.searchsorted(unit_ends, ends), minlength=len(order))
        if groups:
            names_a = list(map(self.a_names.__getitem__, chain.from_iterable(good_a)))
            names_b = list(map(self.b_names.__getitem__, chain.from_iterable(good_b)))
            to_a, to_b = (np.searchsorted(e, common, "right").tolist() for e in (ends_a, ends_b))
            parts = [f"{names_a[i] if j - i == 1 else ','.join(names_a[i:j])}|{names_b[k] if m - k == 1 else ','.join(names_b[k:m])}"
                     for i, j, k, m in zip([0, *to_a], to_a, [0, *to_b], to_b)]
            last = np.searchsorted(common, unit_ends, "right").tolist()
            for i, low, high in zip(order.tolist(), [0, *last], last):
                texts[i] = ";".join(parts[low:high])
        return bad, sums, keys, order[np.searchsorted(unit_ends, cuts)], texts


_SPACED = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def units_of(text: str) -> list[str]:
    """A text cut at the spaces that stand between two other signs."""
    units = text.split(" ")
    words = text.split()
    if len(text) - sum(map(len, words)) == len(words) - 1:  # every white space stands between two other signs
        return units
    if text[0] == " " or text[-1] == " " or _SPACED.search(text):
        return _CUT.split(text)
    return units


_PAIRS: dict[bytes, Pair] = {}


def loaded(files) -> Pair:
    """The tokenizers of a worker, loaded once."""
    a_json, b_model = files.value
    mark = hashlib.md5(a_json + b_model).digest()
    if mark not in _PAIRS:
        _PAIRS[mark] = Pair(a_json, b_model)
    return _PAIRS[mark]


# -------------------------- minimal perfect hash ---------------------------

def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finalizer of the murmur kind."""
    x = keys.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(keys, 0) % np.uint64(buckets)).astype(np.int64)


class PerfectHash:
    """Distinct keys → 0 .. n - 1, without the keys: levels of bits."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0  # number of the keys before each bit
        for bits in levels:
            self.ranks.append(base + np.concatenate([[0], np.cumsum(bits, dtype=np.int64)]))
            base += int(bits.sum())
        self.size = base

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            place = cls._place(rest, len(levels), 2 * len(rest))
            bits = np.bincount(place, minlength=2 * len(rest)) == 1
            levels.append(bits)
            rest = rest[~bits[place]]
        return cls(levels)

    @staticmethod
    def _place(keys: np.ndarray, level: int, width: int) -> np.ndarray:
        return (_mix(keys, level + 1) % np.uint64(width)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; -1 where no level has it (other keys may get any number)."""
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(rest):
                break
            place = self._place(keys[rest], level, len(bits))
            hit = bits[place]
            out[rest[hit]] = self.ranks[level][place[hit]]
            rest = rest[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *[len(b) for b in self.levels]], np.int64)
        return sizes.tobytes() + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes, at, levels = np.frombuffer(data, np.int64, n, 8), 8 + 8 * n, []
        for size in sizes:
            width = (int(size) + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=int(size)).astype(bool))
            at += width
        return cls(levels)


class PairCounts:
    """Counts of id pairs by their hash, the keys verified."""

    def __init__(self, rows: list[tuple[int, bytes, bytes, bytes]], buckets: int):
        self.buckets = buckets
        self.parts = {b: (PerfectHash.from_bytes(h), np.frombuffer(k, np.int64), np.frombuffer(c, np.int64)) for b, h, k, c in rows}

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        out, bucket = np.zeros(len(keys), np.int64), bucket_of(keys, self.buckets)
        order = np.argsort(bucket, kind="stable")
        starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for rows in np.split(order, starts[1:]):
            if len(rows) and (part := self.parts.get(int(bucket[rows[0]]))):
                table, known, counts = part
                at = table.index(keys[rows])
                sure = (at >= 0) & (known[at] == keys[rows])
                out[rows[sure]] = counts[at[sure]]
        return out


# --------------------------------- passes ----------------------------------

#: What a unit adds to its document.
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Slots(dict):
    """Units → their numbers, in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = at = len(self)
        self.new.append(unit)
        return at


class Remembered:
    """Units of a worker, each aligned once until there are too many."""

    def __init__(self, pair: Pair, counts: PairCounts | None = None, best: np.ndarray | None = None, groups: bool = False):
        self.pair, self.counts, self.best, self.groups = pair, counts, best, groups
        self.clear()

    def clear(self) -> None:
        self.slot = Slots()
        self.text: list[str] = []
        self.bad = np.zeros(0, bool)
        self.sums = np.zeros((0, len(SUMS)), np.int64)
        self.links = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def learn(self, docs: list[list[str]]) -> list[np.ndarray | None]:
        """Numbers of each document's units; None if its bytes are not given back."""
        base, number = len(self.slot), self.slot.__getitem__
        slots = [np.fromiter(map(number, units), np.int64, len(units)) for units in docs]
        new, self.slot.new = self.slot.new, []
        if new:
            bad, tokens, keys, unit, texts = self.pair.align(new, self.groups)
            sums = np.zeros((len(new), len(SUMS)), np.int64)
            sums[:, :3] = tokens
            sums[:, 3] = np.bincount(unit, minlength=len(new))
            if self.counts is not None:
                n = self.counts.look_up(keys)
                np.add.at(sums[:, 4], unit, n == self.best[keys & ((1 << SHIFT) - 1)])
                np.add.at(sums[:, 5], unit, n)
            else:  # with the counts at hand the sums are all that is needed
                self.links.append((keys, unit + base))
            if self.groups:
                self.text += texts
            self.sums, self.bad = np.concatenate([self.sums, sums]), np.concatenate([self.bad, bad])
        return [None if self.bad[x].any() else x for x in slots]

    def joined_links(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys of all links, and their units."""
        if len(self.links) > 1:
            self.links = [(np.concatenate([k for k, _ in self.links]), np.concatenate([u for _, u in self.links]))]
        return self.links[0]


_SEEN: dict[str, Remembered] = {}


def remembered(step: str, make) -> Remembered:
    """What a worker remembers in one pass of one run, kept between its tasks."""
    if step not in _SEEN:
        _SEEN.clear()
        _SEEN[step] = make()
    return _SEEN[step]


def _portions(texts: list, most: int = 1 << 20) -> Iterator[tuple[int, list[list[str]]]]:
    """Documents cut into units, about a million signs of text at once."""
    begin, docs, size = 0, [], 0
    for i, text in enumerate(texts):
        docs.append(units_of(text) if text else [])
        size += len(text or "")
        if size > most:
            yield begin, docs
            begin, docs, size = i + 1, [], 0
    if docs:
        yield begin, docs


def _counted(files):
    """First pass: (part, key, n) for the id pairs of a task."""
    step = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        seen = remembered(step, lambda: Remembered(loaded(files)))
        times = np.zeros(len(seen.slot), np.int64)  # documents' uses of each unit
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def flush() -> None:
            nonlocal keys, sums, times
            links, unit = seen.joined_links()
            both = np.concatenate([keys, links])
            n = np.concatenate([sums, times[unit]])
            both, n = both[n > 0], n[n > 0]
            keys, at = np.unique(both, return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, at, n)
            if len(seen.slot) > UNITS:
                seen.clear()
            times = np.zeros(len(seen.slot), np.int64)

        def frame() -> pd.DataFrame:
            return pd.DataFrame({"part": np.full(len(keys), part, np.int64), "key": keys, "n": sums})

        for b in batches:
            for _, docs in _portions(b["text"].tolist()):
                known = [slots for slots in seen.learn(docs) if slots is not None]
                times = np.concatenate([times, np.zeros(len(seen.slot) - len(times), np.int64)])
                if known:
                    times += np.bincount(np.concatenate(known), minlength=len(times))
                if len(seen.slot) > UNITS:
                    flush()
                    if len(keys) > PAIRS:
                        yield frame()
                        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        flush()
        yield frame()

    return run


def _hashes(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    keys = rows["key"].to_numpy(np.int64)
    table = PerfectHash.of(keys)
    dense = np.empty(len(keys), np.int64)
    dense[table.index(keys)] = keys
    return pd.DataFrame({"bucket": [key[0]], "hash": [table.to_bytes()], "keys": [dense.tobytes()]})


def _dense(key: tuple, rows: pd.DataFrame, hashes: pd.DataFrame) -> pd.DataFrame:
    """The counts of some tasks as one vector in the order of the hash."""
    table = PerfectHash.from_bytes(hashes["hash"].iloc[0])
    out = np.zeros(table.size, np.int64)
    np.add.at(out, table.index(rows["key"].to_numpy(np.int64)), rows["n"].to_numpy(np.int64))
    return pd.DataFrame({"bucket": [key[0]], "grp": [key[1]], "counts": [out.tobytes()]})


def _summed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, np.int64) for c in rows["counts"])
    return pd.DataFrame({"bucket": [key[0]], "grp": [key[1]], "counts": [total.tobytes()]})


def count_pairs(spark: SparkSession, docs: DataFrame, files, text: str = "text") -> tuple[DataFrame, int]:
    """(bucket, hash, keys, counts) over the links of all documents, and the number of buckets."""
    in_batches(spark)
    counted = docs.select(F.col(text).alias("text")).mapInPandas(_counted(files), "part long, key long, n long")
    parts = staged(spark, counted, "align-parts")
    distinct = staged(spark, parts.select("key").distinct(), "align-keys")
    n, last = distinct.count(), parts.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]
    buckets = n // BUCKET + 1

    @F.pandas_udf("long")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(key.to_numpy(np.int64), buckets))

    hashes = distinct.withColumn("bucket", bucket("key")).groupBy("bucket").applyInPandas(_hashes, "bucket long, hash binary, keys binary")
    hashes = staged(spark, hashes, "align-hashes")
    groups = last // FAN_IN + 1
    dealt = hashes.select("bucket", "hash", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("grp"))
    sparse = parts.select(bucket("key").alias("bucket"), F.floor(F.col("part") / FAN_IN).alias("grp"), "key", "n")
    schema = "bucket long, grp long, counts binary"
    sums = staged(spark, sparse.groupBy("bucket", "grp").cogroup(dealt.groupBy("bucket", "grp")).applyInPandas(_dense, schema), "align-sums")
    while groups > 1:
        level = sums.withColumn("grp", F.floor(F.col("grp") / FAN_IN))
        sums = staged(spark, level.groupBy("bucket", "grp").applyInPandas(_summed, schema), "align-sums")
        groups = (groups - 1) // FAN_IN + 1
    return staged(spark, hashes.join(sums.select("bucket", "counts"), "bucket"), "align-table"), buckets


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for keys, counts in zip(b["keys"], b["counts"]):
            yield pd.DataFrame({"key": np.frombuffer(keys, np.int64), "n": np.frombuffer(counts, np.int64)})


def _scored(files, held, best):
    """Second pass with the table in hand: a row of sums for each document."""
    step = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = remembered(step, lambda: Remembered(loaded(files), PairCounts(*held.value), best.value, groups=True))
        for b in batches:
            texts = b["text"].tolist()
            sums, groups = np.zeros((len(texts), len(SUMS)), np.int64), [""] * len(texts)
            for begin, docs in _portions(texts):
                if len(seen.slot) > UNITS:
                    seen.clear()
                for i, slots in enumerate(seen.learn(docs), begin):
                    if slots is not None and len(slots):
                        sums[i] = seen.sums[slots].sum(0)
                        groups[i] = ";".join(map(seen.text.__getitem__, slots.tolist()))
            yield pd.DataFrame({"doc_id": b["doc_id"]} | {c: sums[:, j] for j, c in enumerate(SUMS)} | {"groups": groups})

    return run


def _linked(files):
    """Second pass with the table elsewhere: sums and groups of each document
    (key ``NO_KEY``), then a row for each id pair of it with the number of its links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Remembered(loaded(files), groups=True)
        for b in batches:
            ids, docs_ids, texts = b["_uid"].tolist(), b["doc_id"].tolist(), b["text"].tolist()
            for begin, docs in _portions(texts):
                if len(seen.slot) > UNITS:
                    seen.clear()
                known = seen.learn(docs)
                links, unit = seen.joined_links()
                order = np.argsort(unit, kind="stable")
                starts = np.searchsorted(unit[order], np.arange(len(seen.slot) + 1))
                for i, slots in enumerate(known, begin):
                    sums, text, keys, m = np.zeros(len(SUMS), np.int64), "", np.zeros(0, np.int64), np.zeros(0, np.int64)
                    if slots is not None and len(slots):
                        sums, text = seen.sums[slots].sum(0), ";".join(map(seen.text.__getitem__, slots.tolist()))
                        keys, m = np.unique(np.concatenate([links[order[starts[u]:starts[u + 1]]] for u in slots]), return_counts=True)
                    rest = len(keys)
                    yield pd.DataFrame({
                        "_uid": np.full(rest + 1, ids[i]), "doc_id": [docs_ids[i]] + [None] * rest,
                        **{c: np.concatenate([sums[j:j + 1], np.zeros(rest, np.int64)]) for j, c in enumerate(SUMS[:4])},
                        "groups": [text] + [""] * rest, "key": np.concatenate([[NO_KEY], keys]), "m": np.concatenate([[0], m])})

    return run


def _by_join(docs: DataFrame, files, flat: DataFrame, best: DataFrame) -> DataFrame:
    schema = "_uid long, doc_id long, " + ", ".join(f"{c} long" for c in SUMS[:4]) + ", groups string, key long, m long"
    linked = staged(docs.sparkSession, docs.withColumn("_uid", row_key()).mapInPandas(_linked(files), schema), "align-links")
    counted = flat.withColumn("_b", F.col("key").bitwiseAND(F.lit((1 << SHIFT) - 1))).join(F.broadcast(best), "_b").select(
        "key", "n", (F.col("n") == F.col("best")).cast("long").alias("is_best"))
    links = linked.where(F.col("key") != NO_KEY).select("_uid", "key", "m").join(counted, "key")
    scores = links.groupBy("_uid").agg(F.sum(F.col("m") * F.col("is_best")).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))
    out = linked.where(F.col("key") == NO_KEY).drop("key", "m").join(scores, "_uid", "left").fillna(0, ["n_best", "count_sum"])
    return out.select("doc_id", *SUMS, "groups")


def align_documents(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text",
                    broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document the numbers of tokens, groups and links, how many links
    have the highest count of their B id, the sum of the links' counts, and
    the groups themselves as ``a1,a2|b1;a3|b2,b3``."""
    # two vocabulary files of a few MB
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        files = spark.sparkContext.broadcast((a.read(), b.read()))
    table, buckets = count_pairs(spark, docs, files, text)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    flat = table.select("keys", "counts").mapInPandas(_unpacked, "key long, n long")
    # at most as many rows as B has ids
    best = staged(spark, flat.groupBy(F.col("key").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("_b")).agg(F.max("n").alias("best")), "align-best")
    size = table.agg(F.coalesce(F.sum(F.octet_length("hash") + F.octet_length("keys") + F.octet_length("counts")), F.lit(0))).first()[0]
    if size > broadcast_bytes:
        return _by_join(docs, files, flat, best)
    tops = best.collect()
    top = np.zeros(1 + max((r[0] for r in tops), default=0), np.int64)
    for b_id, n in tops:
        top[b_id] = n
    rows = [(r[0], bytes(r[1]), bytes(r[2]), bytes(r[3])) for r in table.select("bucket", "hash", "keys", "counts").collect()]
    held, best_of = spark.sparkContext.broadcast((rows, buckets)), spark.sparkContext.broadcast(top)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in SUMS) + ", groups string"
    return docs.mapInPandas(_scored(files, held, best_of), schema)
