"""Byte-level BPE encoding and decoding of whole texts.

A text is cut by the vocabulary's pattern; a word that is a token of its own
gets its rank, any other is merged from its bytes, step by step, at the
adjacent pair of the lowest rank (the leftmost of equal ones).  Words over
``LONG`` bytes (text without spaces, rows of one sign) keep their pairs in a
heap, so the work stays near the length.  Decoding looks every id up in the
table of byte strings and concatenates them.

Every text is encoded where it stands and nothing is shuffled: the tasks share
the rank file (0.8 MB), and a worker remembers the ids of the words it has
merged, a bounded number, for their next occurrence.

Memory: a batch of texts with their words and ids, and the words remembered.
Null texts count as empty and have no ids; repeated rows are encoded alike; an
empty table gives no rows.  The pattern's ``\\s`` is that of the tiktoken
library; ``\\p{L}`` and ``\\p{N}`` are those of the installed ``regex`` module.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm.common import in_batches

#: Bytes of a word from which its pairs are kept in a heap.
LONG = 128
#: Words that a worker remembers: some 120 MB.
FREQUENT_WORDS = 400_000
#: Rank of a pair that does not merge.
NEVER = 1 << 60


def _ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def _file(path: str) -> bytes:
    with open(path, "rb") as f:  # on the driver
        return f.read()


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes → rank, from a rank file (one base64 token and its rank a line)."""
    return _ranks_of(_file(path))


def _names(ranks: dict[bytes, int]) -> list[bytes]:
    """The bytes of each id."""
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


class Vocabulary:
    """The literal of one rank file: the bytes of each id."""

    def __init__(self, path: str):
        self.tokens = F.split(F.lit(",".join(token.hex() for token in _names(read_ranks(path)))), ",")


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """An array of ids → the bytes of its tokens, one after the other."""
    def pieces(tokens: Column) -> Column:
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(tokens, i)), ""))
    return F.get(F.transform(F.array(vocabulary.tokens), pieces), F.lit(0))


def as_array(ids: Column) -> Column:
    """Decimal ids joined by commas → array of ids."""
    return F.when(ids == "", F.array().cast("array<int>")).otherwise(F.split(ids, ",").cast("array<int>"))


def merge(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """The ids of the tokens of a word (not empty)."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > LONG:
        return _merge_long(ranks, word)
    get, ends = ranks.get, list(range(len(word) + 1))
    pairs = [get(word[i:i + 2], NEVER) for i in range(len(word) - 1)]  # pair i: the bytes from ends[i] to ends[i + 2]
    while pairs and (least := min(pairs)) != NEVER:
        i = pairs.index(least)
        del ends[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(word[ends[i]:ends[i + 2]], NEVER)
        if i:
            pairs[i - 1] = get(word[ends[i - 1]:ends[i + 1]], NEVER)
    return [ranks[word[a:b]] for a, b in zip(ends, ends[1:])]


def _merge_long(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """The same with a heap of (rank, start) and links between tokens; a pair
    that has changed since it was put there is passed over."""
    n = len(word)
    after, before = list(range(1, n + 2)), list(range(-1, n))  # starts of the neighbouring tokens
    now = [ranks.get(word[i:i + 2], NEVER) for i in range(n - 1)] + [NEVER, NEVER]  # rank of the pair at each start
    heap = [(rank, i) for i, rank in enumerate(now) if rank != NEVER]
    heapify(heap)
    while heap:
        rank, i = heappop(heap)
        if now[i] != rank:
            continue
        gone = after[i]
        now[gone] = NEVER
        after[i] = after[gone]
        before[after[i]] = i
        for j in (before[i], i):
            if j >= 0:
                end = after[after[j]] if after[j] < n else n + 1
                now[j] = ranks.get(word[j:end], NEVER) if end <= n else NEVER
                if now[j] != NEVER:
                    heappush(heap, (now[j], j))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:after[i]]])
        i = after[i]
    return out


class Encoder:
    """Encodes words and decodes their ids; remembers ``limit`` words: those of
    late, and those met again of the half before."""

    def __init__(self, data: bytes, pattern: str, limit: int):
        import regex

        self.cut: Callable[[str], list[str]] = regex.compile(pattern).findall
        self.ranks, self.limit = _ranks_of(data), limit
        self.tokens = _names(self.ranks)
        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes]] = {}

    def learn(self, word: str) -> tuple[int, str, bytes]:
        """A word's number of ids, the ids, and the bytes they decode to."""
        if (found := self.older.get(word)) is None:
            ids = merge(self.ranks, word.encode())
            found = len(ids), ",".join(map(str, ids)), b"".join([self.tokens[i] for i in ids])
        if len(word) <= LONG and self.limit:
            if len(self.known) >= self.limit // 2:
                self.known, self.older = {}, self.known
            self.known[word] = found
        return found

    def text(self, text: str | None) -> tuple[int, str, bytes]:
        """The same for a whole text; null and empty texts have no ids."""
        words = self.cut(text or "")
        found = list(map(self.known.get, words))
        if None in found:
            found = [known or self.known.get(word) or self.learn(word) for known, word in zip(found, words)]
        n, ids, decoded = zip(*found) if found else ((), (), ())
        return sum(n), ",".join(ids), b"".join(decoded)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(data: bytes, pattern: str, limit: int) -> Encoder:
    """One encoder for a worker process, kept between tasks."""
    key = hashlib.md5(data).digest(), pattern, limit
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(data, pattern, limit)
    return _ENCODERS[key]


def encode_documents(spark: SparkSession, docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text",
                     frequent: int = FREQUENT_WORDS) -> DataFrame:
    """Per document its token ids (``ids``: decimal, joined by commas; see
    ``as_array``), their number and the bytes they decode to.  No special tokens."""
    in_batches(spark)
    ranks = spark.sparkContext.broadcast(_file(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(ranks.value, pattern, frequent).text
        for frame in batches:
            rows = [encode(t) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_tokens": [n for n, _, _ in rows],
                                "ids": [ids for _, ids, _ in rows], "decoded": [raw for _, _, raw in rows]})

    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kind = held.schema["doc_id"].dataType.simpleString()
    return held.mapInPandas(run, f"doc_id {kind}, n_tokens long, ids string, decoded binary")
