"""Benchmark decontamination by template canonicalisation.

Words become tokens: numbers, names and units turn into typed placeholders,
every other word into its bare lower-case form.  Windows of tokens (the
templates) of the benchmark are hash-joined with those of the documents, so
a question with other numbers or names still meets its original.  The values
in the placeholders then have to agree: over one alignment, a value of the
benchmark always stands for the same value of the document and vice versa.
A name or number of several words is one placeholder.  Windows with too few
literals to say anything as templates are joined on their words as they are.
An item is found in a document when consistent windows, on one alignment or
on several in the item's order, cover enough of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm.common import REMEMBERED, free_names, in_batches, staged
from vulnlake.llm.minhash import text_key

#: Tokens in a window, and how many of them must be no placeholders; windows
#: with fewer are compared word by word.
WINDOW, MIN_LITERALS = 8, 4
#: Share of an item's tokens that consistent windows must cover, and share of
#: the windows met on one alignment that must be consistent.
MIN_COVERAGE, MIN_CONSISTENT = 0.5, 0.8
#: Largest number of template windows that is sent to the tasks as a filter
#: (and broadcast in the join); a larger benchmark is joined by shuffle.
BROADCAST_WINDOWS = 1_000_000
#: Units that may follow a number.
UNITS = frozenset("""mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers
    mg g kg t lb lbs oz gram grams kilogram kilograms ton tons pound pounds ounce ounces ml l liter liters litre litres gallon gallons
    ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
    cent cents dollar dollars usd eur euro euros gbp percent % degree degrees mph kmh hz khz mhz ghz w kw kwh v a kb mb gb tb""".split())
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(?:[a-zA-Z%]{1,4})?$")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_ENDS = re.compile(r"[.!?:]\W*$")
_MARKS = ".,;:!?\"'()[]%*&$#|<>-"
_LITERAL, _NUM, _CAP, _UNIT, _NOTHING = range(5)
#: Flags of a word beside its kind: ends a sentence, marks before it, marks after it.
_KIND, _CLOSES, _BEFORE, _AFTER = 7, 8, 16, 32
_U = np.uint64
#: Hashes of the placeholders, by type.
_TYPED = [xxhash.xxh3_64_intdigest(x) for x in ("\0number", "\0name", "\0unit")]


class Canonical(dict):
    """Turns texts into token arrays; what is known of a word is remembered:
    its number, and under that the hash and the flags."""

    def __init__(self) -> None:
        self._hash, self._flags = np.empty(1024, _U), np.empty(1024, np.int8)

    def __missing__(self, word: str) -> int:
        left = word.rstrip(_MARKS)
        plain = left.lstrip(_MARKS)
        if plain.isalpha():  # most words: letters between common marks
            kind, flags = None, 0
            if len(left) < len(word):
                flags = _AFTER | (_CLOSES if any(c in ".!?:" for c in word[len(left):]) else 0)
            if len(plain) < len(left):
                flags |= _BEFORE
        else:
            kind = _NUM if _NUMBER.fullmatch(word.rstrip(".,;:!?)\"'")) else None
            plain = _EDGES.sub("", word)
            flags = (_CLOSES if _ENDS.search(word) else 0) | (0 if word[0].isalnum() else _BEFORE) | (0 if word[-1].isalnum() else _AFTER)
        lower = plain.lower()
        if kind is None:
            if not plain:
                kind = _UNIT if word == "%" else _NOTHING
            elif lower in UNITS:
                kind = _UNIT
            elif plain[0].isupper() and (len(plain) == 1 or not plain.isupper()):
                kind = _CAP
            else:
                kind = _LITERAL
        self[word] = at = len(self)
        if at == len(self._hash):
            self._hash, self._flags = (np.concatenate([t, np.empty_like(t)]) for t in (self._hash, self._flags))
        self._hash[at] = xxhash.xxh3_64_intdigest(lower)
        self._flags[at] = kind | flags
        return at

    def tokens(self, text: str | None) -> Tokens:
        """Words without a letter or digit are left out."""
        if len(self) > REMEMBERED:
            self.clear()
        lines = [line.split() for line in (text or "").split("\n")]
        words = [w for line in lines for w in line]
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if not len(ids):
            return Tokens(np.empty(0, _U), np.empty(0, _U), np.empty(0, bool), np.zeros(1, np.int64), [])
        plain, flags = self._hash[ids], self._flags[ids]
        kinds, ends = flags & _KIND, flags & _CLOSES != 0
        before, after = flags & _BEFORE != 0, flags & _AFTER != 0
        starts = np.zeros(len(ids) + 1, bool)
        starts[np.cumsum([0, *map(len, lines)])] = True
        starts[1:] |= ends
        held = kinds != _NOTHING
        number_before = np.zeros(len(ids), bool)
        number_before[1:] = kinds[:-1] == _NUM
        name = (kinds == _CAP) & ~starts[:-1]
        unit = (kinds == _UNIT) & number_before
        number = kinds == _NUM
        out = plain.copy()
        for which, code in zip((number, name, unit), _TYPED, strict=True):
            out[which] = code
        slots = number | name | unit
        first = np.ones(len(ids), bool)  # a name or number goes on unless a mark or a line end parts the words
        first[1:] = ~((number[1:] & number[:-1] | name[1:] & name[:-1]) & ~(before[1:] | after[:-1] | starts[1:-1]))
        if not held.all():
            words = [w for w, h in zip(words, held, strict=True) if h]
            plain, out, slots, first = plain[held], out[held], slots[held], first[held]
        at = np.flatnonzero(first)
        return Tokens(plain, out[at], slots[at], np.append(at, len(plain)), words)


@dataclass
class Tokens:
    """A text's words: their hashes; and its template: hashes of literals and
    placeholders, which of them are placeholders, and the word at which each
    starts (one entry more: the number of words)."""

    plain: np.ndarray
    template: np.ndarray
    slots: np.ndarray
    starts: np.ndarray
    words: list[str]

    def values(self, at: int, size: int) -> list[str]:
        """Values of the placeholders in a window of the template."""
        s = self.starts
        return [" ".join(_EDGES.sub("", w).lower() for w in self.words[s[i]: s[i + 1]]) for i in range(at, at + size) if self.slots[i]]


_RADIX = 0x9E3779B97F4A7C15
_powers = [np.ones(1, _U), np.ones(1, _U)]  # of the radix and of its inverse modulo 2^64


def _hashes(tokens: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of the window of ``size`` tokens at each position: a polynomial in
    the tokens from sums over the text's start, the same at every position."""
    n = len(tokens) - size + 1
    if n <= 0 or size <= 0:
        return np.empty(0, _U)
    if len(_powers[0]) <= len(tokens):
        for i, base in enumerate((_RADIX, pow(_RADIX, -1, 1 << 64))):
            _powers[i] = np.cumprod(np.concatenate([np.ones(1, _U), np.full(2 * len(tokens) + 1023, base, _U)]), dtype=_U)
    sums = np.zeros(len(tokens) + 1, _U)
    np.cumsum(tokens * _powers[0][: len(tokens)], out=sums[1:])
    h = (sums[size:] - sums[:n]) * _powers[1][:n] + _U(2 * size + seed)
    h ^= h >> _U(32)
    h *= _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


def windows(text: Tokens, size: int, words: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the template's window at each position, and whether it has
    enough literals for so many words (its size, if none are given)."""
    h = _hashes(text.template, size, 0)
    if not len(h):
        return h, np.empty(0, bool)
    placeholders = np.concatenate([[0], np.cumsum(text.slots)])
    literals = size - (placeholders[size:] - placeholders[:-size])
    return h, literals >= min(MIN_LITERALS, -(-max(size, words) // 2))


def verbatim_windows(text: Tokens, size: int) -> np.ndarray:
    """Hash of the words at each position."""
    return _hashes(text.plain, size, 1)


def item_windows(text: Tokens) -> tuple[int, np.ndarray, np.ndarray]:
    """(size, hash at each position, whether it has enough literals) of the
    template's windows.  A template that runs make short needs the literals of
    its words."""
    size = min(WINDOW, len(text.template))
    return size, *windows(text, size, min(WINDOW, len(text.plain)))


def untold(text: Tokens) -> np.ndarray:
    """Positions of the windows of words with too few literals or with a word
    outside all template windows; a text of one window has it in any case, as
    the first word of a sentence is a literal in one place and a name in another."""
    n, size = len(text.plain), min(WINDOW, len(text.plain))
    if n <= WINDOW:
        return np.arange(min(n, 1))
    span, _, fit = item_windows(text)
    told = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(fit)
    np.add.at(told, text.starts[at], 1)
    np.add.at(told, text.starts[at + span], -1)
    free = np.concatenate([[0], np.cumsum(np.cumsum(told[:-1]) == 0)])
    slots = np.concatenate([[0], np.cumsum(np.repeat(text.slots, np.diff(text.starts)))])
    return np.flatnonzero((free[size:] - free[:-size] > 0) | (slots[size:] - slots[:-size] > size - MIN_LITERALS))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, b_key, n_tokens, w (window hash), verbatim, size, item_pos (in
    the template, or in the words of a verbatim window), item_start and
    item_stop (its words), item_slots.
    An item shorter than a window is one window of its own length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canonical = Canonical()
        for frame in batches:
            rows = []
            for item, key, text in zip(frame["item_id"], frame["b_key"], frame["text"], strict=True):
                text = canonical.tokens(text)
                n = len(text.plain)
                size, hashes, fit = item_windows(text)
                rows += [(item, key, n, w, False, size, i, int(text.starts[i]), int(text.starts[i + size]), text.values(i, size))
                         for i, w in zip(np.flatnonzero(fit).tolist(), hashes[fit].view(np.int64).tolist(), strict=True)]
                size, at = min(WINDOW, n), untold(text)
                hashes = verbatim_windows(text, size)
                slot = np.repeat(text.slots, np.diff(text.starts)).tolist()
                rows += [(item, key, n, w, True, size, i, i, i + size, [_EDGES.sub("", text.words[k]).lower() for k in range(i, i + size) if slot[k]])
                         for i, w in zip(at.tolist(), hashes[at].view(np.int64).tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=["item_id", "b_key", "n_tokens", "w", "verbatim", "size", "item_pos", "item_start", "item_stop", "item_slots"])

    kind = dict(benchmark.select("item_id").dtypes)["item_id"]
    return (benchmark.select("item_id", text_key(F.col("text")).alias("b_key"), "text")
            .mapInPandas(run, f"item_id {kind}, b_key long, n_tokens int, w long, verbatim boolean, size int, item_pos int, item_start int, item_stop int, item_slots array<string>"))


def document_windows(spark: SparkSession, docs: DataFrame, sizes: list[tuple[bool, int]], wanted: np.ndarray | None) -> DataFrame:
    """doc_id, h, w, pos, start, stop, slots: the windows of every document of
    the given (verbatim, size), those in ``wanted`` (sorted hashes) only where
    that filter is small enough to send.  Verbatim windows have no slots.
    Windows of fewer than three tokens stand for whole documents only."""
    in_batches(spark)
    columns = ["doc_id", "h", "w", "pos", "start", "stop", "slots"]
    likely = None
    if wanted is not None:
        likely = np.zeros(1 << 20, bool)  # most hashes are not wanted: told by their first bits
        likely[wanted.view(_U) >> _U(44)] = True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canonical = Canonical()
        for frame in batches:
            rows = []
            for doc, h, text in zip(frame["doc_id"], frame["h"], frame["text"], strict=True):
                text = canonical.tokens(text)
                for verbatim, size in sizes:
                    if size < 3 and len(text.plain if verbatim else text.template) != size:
                        continue
                    hashes, fit = (verbatim_windows(text, size), None) if verbatim else windows(text, size)
                    keys = hashes.view(np.int64)
                    if fit is None:
                        fit = np.ones(len(keys), bool)
                    if wanted is not None and len(keys):
                        fit &= likely[hashes >> _U(44)]
                        at = np.flatnonzero(fit)
                        at = at[wanted[np.minimum(np.searchsorted(wanted, keys[at]), len(wanted) - 1)] == keys[at]].tolist()
                    else:
                        at = np.flatnonzero(fit).tolist()
                    if verbatim:
                        rows += [(doc, h, int(keys[i]), i, i, i + size, []) for i in at]
                    else:
                        rows += [(doc, h, int(keys[i]), i, int(text.starts[i]), int(text.starts[i + size]), text.values(i, size)) for i in at]
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return (docs.where(F.col("text").isNotNull()).select("doc_id", text_key(F.col("text")).alias("h"), "text")
            .mapInPandas(run, f"doc_id {kind}, h long, w long, pos int, start int, stop int, slots array<string>"))


def consistent(pairs: list[tuple[list[str], list[str]]]) -> list[bool]:
    """Which windows agree with the slot values of those before them: each
    value of one side stands for one value of the other."""
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    out = []
    for item, doc in pairs:
        ok = len(item) == len(doc) and all(there.get(a, b) == b and back.get(b, a) == a for a, b in zip(item, doc, strict=False))
        ok = ok and len(set(zip(item, doc, strict=False))) == len(set(item)) == len(set(doc))
        if ok:
            there.update(zip(item, doc, strict=False))
            back.update(zip(doc, item, strict=False))
        out.append(ok)
    return out


@dataclass
class Piece:
    """Words of an item found in a row in a document, the values of its
    placeholders both ways, and what a chain of pieces up to it covers."""

    item: int
    item_stop: int
    doc: int
    doc_stop: int
    there: dict[str, str]
    back: dict[str, str]
    covered: int = 0
    windows: int = 0

    def after(self, last: Piece) -> Piece | None:
        """The chain that this piece makes longer, if it goes on behind the
        last one on both sides and its values agree with the chain's."""
        both = max(0, last.item_stop - self.item, last.doc_stop - self.doc)
        gain = self.item_stop - self.item - both
        if gain <= 0 or self.item < last.item or self.doc < last.doc:
            return None
        if any(last.there.get(a, b) != b for a, b in self.there.items()) or any(last.back.get(b, a) != a for b, a in self.back.items()):
            return None
        return Piece(self.item, self.item_stop, self.doc, self.doc_stop, last.there | self.there, last.back | self.back,
                     last.covered + gain, last.windows + self.windows)


def chained(pieces: list[Piece]) -> tuple[int, int]:
    """(words, windows) of the chain of pieces, in the order of both sides,
    that covers most.  For each end in the item the best chain and the latest
    one are kept: pieces of one copy follow each other in the document."""
    ends: dict[int, list[Piece]] = {}
    for piece in sorted(pieces, key=lambda p: (p.doc, p.item, p.item_stop)):
        longer = [x for two in ends.values() for last in two if (x := piece.after(last))]
        new = max([piece, *longer], key=lambda p: (p.covered, p.windows))
        two = ends.setdefault(piece.item_stop, [new, new])
        two[1] = new
        if new.covered >= two[0].covered:
            two[0] = new
    return max(((p.covered, p.windows) for two in ends.values() for p in two), default=(0, 0))


def _verdict(hits: list[dict]) -> tuple[int, int]:
    """(words, windows) of one (document, item): of its best alignment, or chain of pieces of alignments."""
    alignments: dict[tuple[bool, int], dict[int, tuple]] = {}
    for x in hits:
        item_slots = list(x["item_slots"])
        row = (x["item_start"], x["item_stop"], x["start"], x["stop"], item_slots, item_slots if x["verbatim"] else list(x["slots"]))
        alignments.setdefault((x["verbatim"], x["pos"] - x["item_pos"]), {}).setdefault(x["item_pos"], row)
    best, pieces = (0, 0), []
    for one in alignments.values():
        rows = [one[at] for at in sorted(one)]
        fine = consistent([r[4:] for r in rows])
        if sum(fine) < MIN_CONSISTENT * len(fine):
            continue
        own: list[Piece] = []
        for start, stop, doc, doc_stop, item_slots, slots in (r for r, ok in zip(rows, fine, strict=True) if ok):
            if not own or start > own[-1].item_stop:
                own.append(Piece(start, stop, doc, doc_stop, {}, {}))
            last = own[-1]
            last.item_stop, last.doc_stop = stop, doc_stop
            last.covered, last.windows = stop - last.item, last.windows + 1
            last.there.update(zip(item_slots, slots, strict=True))
            last.back.update(zip(slots, item_slots, strict=True))
        best = max(best, (sum(p.covered for p in own), sum(p.windows for p in own)))
        pieces += own
    if len(pieces) > 1:
        best = max(best, chained(pieces))
    return best


def _verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        best = np.array([_verdict(hits) for hits in frame["hits"]], dtype=np.int64).reshape(-1, 2)
        out = frame.drop(columns="hits").assign(n_covered=best[:, 0], n_windows=best[:, 1])
        yield out.assign(coverage=out["n_covered"] / out["n_tokens"])


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, h, item_id, n_tokens, n_covered, n_windows, coverage of every
    (document, item) of which consistent windows cover half of the item's words.

    Null and empty texts meet nothing; items, and parts of items, with hardly
    a literal word meet the same words only.
    Items of one or two tokens are found only in documents of the same tokens.
    Repeated rows are found once; items with equal texts are found each.  Rows
    without an id keep a null.  Other columns are not looked at.  An empty
    table on either side: no rows."""
    in_batches(spark)
    items = staged(spark, benchmark_windows(benchmark.where(F.col("text").isNotNull())), "leak-items")
    keys = items.select("w").distinct()
    small = keys.count() <= BROADCAST_WINDOWS
    wanted = np.sort(np.array([r[0] for r in keys.collect()], dtype=np.int64)) if small else None
    sizes = sorted(tuple(r) for r in items.select("verbatim", "size").distinct().collect())  # at most twice WINDOW
    if not sizes:
        sizes, wanted = [], None
    found = staged(spark, document_windows(spark, docs, sizes, wanted), "leak-windows")
    hits = found.join(F.broadcast(items) if small else items, "w")
    kinds = dict(hits.dtypes)
    columns = ["verbatim", "item_pos", "pos", "item_start", "item_stop", "start", "stop", "item_slots", "slots"]
    # the hits of one document with one item
    grouped = hits.groupBy("doc_id", "h", "item_id", "b_key").agg(F.first("n_tokens").alias("n_tokens"), F.collect_list(F.struct(*columns)).alias("hits"))
    checked = grouped.mapInPandas(
        _verdicts, f"doc_id {kinds['doc_id']}, h long, item_id {kinds['item_id']}, b_key long, n_tokens int, n_covered int, n_windows int, coverage double")
    return checked.where(F.col("coverage") >= MIN_COVERAGE).drop("b_key")


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item is found."""
    key, own_id, own_key = free_names(docs, "_key", "_id", "_h")
    bad = contaminated(spark, docs, benchmark).select(F.col("doc_id").alias(own_id), F.col("h").alias(own_key)).distinct()
    bad = staged(spark, bad, "leak-bad")
    side = F.broadcast(bad) if bad.count() <= BROADCAST_WINDOWS // 2 else bad
    on = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_key))
    return docs.withColumn(key, text_key(F.col("text"))).join(side, on, "left_anti").drop(key)
