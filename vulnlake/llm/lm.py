"""Language-model scores from a causal self-attention model on subword ids.

A token is a word (or the end of the text).  A public tokenizer cuts it into
subword ids; its first and last ids, the frequent ones each a class of its
own, are what the model reads, and the class of the first id is what it
predicts from the tokens before.  Within a class, a word's probability is its
smoothed share of the training tokens of the class, with one place for all
unknown words, so the probabilities of all texts are proper:

    P(token | before) = P(class | before) * (c + 0.1) / (N_class + 0.1 * (V_class + 1))

Counts cover every training document.  The attention weights start from a
bounded sample of windows and are then trained on every token of every
training document, in windows side by side and in parallel replicas whose
weights are averaged each round.  Texts are scored whole: context windows
overlap, and each token is scored once, in the window that gives it the most
context.
"""

from __future__ import annotations

import base64
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm.attention import Attention
from vulnlake.llm.common import BATCH_ROWS, in_batches, staged, uniform
from vulnlake.llm.minhash import text_key

#: Rank file of a byte-level BPE; read by the driver, 0.8 MB, and sent to the tasks.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Classes: 0 is the end of a text, 1 all rare ids.
CLASSES, LAST_CLASSES = 128, 128
#: Tokens in a window, and by how many the next one is moved.
LENGTH, STRIDE = 32, 24
SMOOTHING = 0.1
#: Windows the driver warms the weights up on, and its passes over them.
WARM_WINDOWS, WARM_PASSES = 2_000, 12
ROUNDS, BATCH, RATE, LATE_RATE = 2, 64, 0.01, 0.003
SEED = 5
#: Spreads the windows of a document evenly over [0, 1).
GOLDEN = 0.6180339887498949
#: Largest vocabulary that is broadcast (24 bytes a word); a larger one is joined by shuffle.
BROADCAST_WORDS = 6_000_000
_CACHE = 600_000
#: Windows that are scored at once: their sums stay in a core's cache.
_WINDOWS_AT_ONCE = 64
_WORDS_AT_ONCE = 4_096


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 10; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


class Subwords:
    """First and last subword id of a word."""

    def __init__(self, ranks: bytes):
        import tiktoken
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("subwords", pat_str=r"\s*\S+|^\s+$", mergeable_ranks=table, special_tokens={})
        self.sizes = np.zeros(max(table.values(), default=0) + 1, np.int64)
        self.sizes[list(table.values())] = [len(token) for token in table]
        self.packing = np.dtype(np.uint16 if len(self.sizes) + 2 <= 1 << 16 else np.uint32)
        self.known: dict[bytes, tuple[int, int]] = {}

    def __call__(self, word: bytes) -> tuple[int, int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > _CACHE:
                self.known.clear()
            ids = self.encoding.encode_ordinary(" " + word.decode("utf-8", "replace"))
            found = self.known[word] = (ids[0], ids[-1])
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        """First and last ids of many words, a row each.  Words are encoded as
        one text, which the pattern cuts before each of them, but for those
        that it would cut inside."""
        out, whole = np.empty((len(words), 2), np.int32), np.fromiter(map(bytes.isascii, words), bool, len(words))
        for i in np.flatnonzero(~whole).tolist():
            whole[i] = _whole(words[i])
        plain = np.flatnonzero(whole)
        for at in range(0, len(plain), _WORDS_AT_ONCE):
            some = plain[at: at + _WORDS_AT_ONCE]
            chosen = [words[i] for i in some.tolist()]
            ids = np.array(self.encoding.encode_ordinary(" " + b" ".join(chosen).decode()), np.int32)
            last = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(word) + 1 for word in chosen]))
            out[some, 1] = ids[last]
            out[some, 0] = ids[np.concatenate([[0], last[:-1] + 1])]
        for i in np.flatnonzero(~whole).tolist():
            out[i] = self(words[i])
        return out


def _whole(word: bytes) -> bool:
    """Whether a word is valid and without spaces beyond ASCII."""
    text = word.decode("utf-8", "replace")
    return text.split() == [text] and "\ufffd" not in text


_SUBWORDS: dict[bytes, Subwords] = {}


def subwords(ranks: bytes) -> Subwords:
    """One tokenizer for a worker process, kept between tasks."""
    key = ranks[:64] + str(len(ranks)).encode()
    if key not in _SUBWORDS:
        _SUBWORDS[key] = Subwords(ranks)
    return _SUBWORDS[key]


class Numbered(dict):
    """Words → their numbers, in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of the texts, ASCII letters in lower case, one after the other, and each text's count of them."""
        cut = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        sizes, coded = pc.list_value_length(cut).to_numpy().astype(np.int64), cut.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
        # a space at a text's begin or end leaves an empty word
        number = np.array([self[word] if word else -1 for word in words], np.int64)
        numbers = number[coded.indices.to_numpy()]
        if (empty := numbers < 0).any():
            sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[empty], minlength=len(sizes))
            numbers = numbers[~empty]
        return numbers, sizes

    def fresh(self) -> list[bytes]:
        """The words that were numbered since the last call."""
        new, self.new = self.new, []
        return new


def _hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], dtype=np.uint64).view(np.int64)


def _ranks(path: str) -> bytes:
    with open(path, "rb") as f:  # on the driver
        return f.read()


_ROWS = {"u": pa.float64(), "ids": pa.binary(), "w": pa.int64(), "first": pa.int32(), "last": pa.int32(), "c": pa.int64()}


def _rows(n: int, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    """Rows of the columns given; the others are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[k], v) if k in columns else pa.nulls(n, v) for k, v in _ROWS.items()], names=list(_ROWS))


def _packed(ids: np.ndarray, kind: np.dtype) -> pa.Array:
    """Windows of first and last ids, (windows, 2, LENGTH + 1), as bytes; ids are moved by 2 to have no sign."""
    width = ids[:1].size * kind.itemsize or kind.itemsize
    flat = (ids + 2).astype(kind).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.arange(len(ids) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(flat)])


def _unpacked(column: pa.Array, kind: np.dtype) -> np.ndarray:
    joined = b"".join(column.to_numpy(zero_copy_only=False))
    return np.frombuffer(joined, kind).reshape(len(column), 2, LENGTH + 1).astype(np.int32) - 2


def training_rows(docs: DataFrame, ranks: bytes) -> DataFrame:
    """The windows of all training documents, and the words that a task met,
    counted, from one reading of the texts.  Rows of windows have ``u``, rows of words ``w``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, place = subwords(ranks), np.arange(LENGTH + 1)
        kind = cut.packing
        words, ids, counts = Numbered(), np.zeros((0, 2), np.int32), np.zeros(0, np.int64)

        def counted() -> Iterator[pa.RecordBatch]:
            hashes = _hashes(list(words))
            for i in range(0, len(hashes), 10 * BATCH_ROWS):
                j = slice(i, i + 10 * BATCH_ROWS)
                yield _rows(len(hashes[j]), w=hashes[j], first=ids[j, 0], last=ids[j, 1], c=counts[j])

        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, sizes = words.of(batch.column("text"))
            if new := words.fresh():
                ids = np.concatenate([ids, cut.of(new)])
                counts = np.concatenate([counts, np.zeros(len(new), np.int64)])
            counts += np.bincount(tokens, minlength=len(counts))
            n = sizes // LENGTH + 1  # window i predicts tokens i * LENGTH + 1 .. (i + 1) * LENGTH
            slots = n * LENGTH + 1
            begins = np.cumsum(slots) - slots
            flat = np.full((slots.sum(), 2), -2, np.int32)
            flat[begins] = flat[begins + sizes + 1] = -1
            flat[np.arange(len(tokens)) + np.repeat(begins + 1 - (np.cumsum(sizes) - sizes), sizes)] = ids[tokens]
            i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            starts, u = np.repeat(begins, n) + i * LENGTH, (np.repeat(batch.column("u").to_numpy(), n) + i * GOLDEN) % 1.0
            for at in range(0, len(starts), 10 * BATCH_ROWS):
                some = flat[starts[at: at + 10 * BATCH_ROWS, None] + place]
                yield _rows(len(some), u=u[at: at + 10 * BATCH_ROWS], ids=_packed(some.transpose(0, 2, 1), kind))
            if len(words) > _CACHE:
                yield from counted()
                words, ids, counts = Numbered(), ids[:0], counts[:0]
        yield from counted()

    return docs.select("text", "u").mapInArrow(run, "u double, ids binary, w long, first int, last int, c long")


def word_counts(rows: DataFrame) -> DataFrame:
    """w (word hash), first, last (subword ids), c: tokens of the training documents."""
    return rows.where("w IS NOT NULL").groupBy("w").agg(F.first("first").alias("first"), F.first("last").alias("last"), F.sum("c").alias("c"))


def windows_of(rows: DataFrame) -> DataFrame:
    return rows.where("u IS NOT NULL").select("u", "ids")


def training_windows(docs: DataFrame, ranks: bytes) -> DataFrame:
    """u, firsts, lasts: every training document in windows side by side, each
    predicting the next LENGTH tokens, as subword ids, the token before it
    first; -1 is the end of a text, -2 nothing.  ``u`` is seeded by the document
    and the window's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _unpacked(batch.column("ids"), subwords(ranks).packing)
            yield pa.RecordBatch.from_pydict({"u": batch.column("u"), "firsts": pa.array(list(ids[:, 0])), "lasts": pa.array(list(ids[:, 1]))})

    return windows_of(training_rows(docs, ranks)).mapInArrow(run, "u double, firsts array<int>, lasts array<int>")


class Classes:
    """Classes of first and last subword ids."""

    def __init__(self, firsts: list[int], lasts: list[int]):
        size = max([0, *firsts, *lasts]) + 3
        self.first, self.last = np.ones(size, np.int16), np.ones(size, np.int16)
        for table, ids in ((self.first, firsts), (self.last, lasts)):
            table[[i + 2 for i in ids]] = np.arange(2, len(ids) + 2)
            table[:2] = 0  # nothing and the end

    def _of(self, table: np.ndarray, ids: np.ndarray) -> np.ndarray:
        at = np.asarray(ids, dtype=np.int64) + 2
        return np.where(at < len(table), table[np.minimum(at, len(table) - 1)], 1)

    def of_first(self, ids: np.ndarray) -> np.ndarray:
        return self._of(self.first, ids)

    def of_last(self, ids: np.ndarray) -> np.ndarray:
        return self._of(self.last, ids)


def _model(weights: np.ndarray | None = None) -> Attention:
    model = Attention(CLASSES, LAST_CLASSES, LENGTH, seed=SEED)
    if weights is not None:
        model.load(weights)
    return model


def _arrays(windows: pa.RecordBatch, classes: Classes, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = _unpacked(windows.column("ids"), kind)
    first, last = ids[:, 0], ids[:, 1]
    a, b = classes.of_first(first), classes.of_last(last)
    return a[:, :-1], b[:, :-1], a[:, 1:].astype(np.int64), first[:, 1:] != -2


def fit(spark: SparkSession, windows: DataFrame, classes: Classes, prior: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Weights: a warm start on a bounded sample of windows on the driver, then
    rounds of training in parallel; of each round the driver gets one mean per weight."""
    model = _model()
    model.p["b"] = prior.astype(np.float32)
    n = windows.count()
    sample = windows.where(F.col("u") * n < 2 * WARM_WINDOWS).orderBy("u", "ids").limit(WARM_WINDOWS).toArrow().combine_chunks() if n else []
    if not len(sample):
        return model.vector()
    x1, x2, y, live = _arrays(sample.to_batches()[0], classes, kind)
    rng = np.random.default_rng(SEED)
    for turn in range(WARM_PASSES):
        order = rng.permutation(len(x1))
        for i in range(0, len(order), BATCH):
            j = order[i: i + BATCH]
            model.step(x1[j], x2[j], y[j], live[j], RATE * (1 - 0.7 * turn / WARM_PASSES))
    weights = model.vector()
    for _ in range(ROUNDS):
        now = weights

        def replica(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            local, seen = _model(now), 0
            for batch in batches:
                a, b, t, alive = _arrays(batch, classes, kind)
                for i in range(0, len(a), BATCH):
                    local.step(a[i: i + BATCH], b[i: i + BATCH], t[i: i + BATCH], alive[i: i + BATCH], LATE_RATE)
                seen += len(a)
            if seen:
                flat = local.vector().astype(float)
                yield pa.RecordBatch.from_pydict({"i": np.arange(len(flat), dtype=np.int32), "v": flat * seen, "n": np.full(len(flat), seen)})

        sums = windows.select("ids").mapInArrow(replica, "i int, v double, n long").groupBy("i").agg(
            (F.sum("v") / F.sum("n")).alias("v")).orderBy("i").toPandas()
        weights = sums["v"].to_numpy(np.float32)
    return weights


class Scorer:
    """Scores texts with the model; holds what it learned of frequent words."""

    def __init__(self, ranks: bytes, classes: Classes, weights: np.ndarray, vocabulary: tuple[np.ndarray, ...] | None):
        """``vocabulary``: sorted word hashes, their counts and, if at hand, their first and last ids."""
        self.cut, self.classes, self.model, self.vocabulary = subwords(ranks), classes, _model(weights), vocabulary
        self.forget()

    def forget(self) -> None:
        self.index = Numbered()
        self.first, self.last = np.zeros(0, np.int16), np.zeros(0, np.int16)
        self.count, self.log, self.hash = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        ids, h = np.zeros((len(new), 2), np.int32), _hashes(new)
        count, strange = np.zeros(len(new), np.int64), np.ones(len(new), bool)
        if self.vocabulary is not None and len(self.vocabulary[0]):
            words, counts, *known = self.vocabulary
            order = np.argsort(h)  # neighbours are found near each other
            i = np.minimum(np.searchsorted(words, h[order]), len(words) - 1)
            met, i = order[words[i] == h[order]], i[words[i] == h[order]]
            count[met] = counts[i]
            if known:
                ids[met, 0], ids[met, 1] = known[0][i], known[1][i]
                strange[met] = False
        ids[strange] = self.cut.of([new[j] for j in np.flatnonzero(strange).tolist()])
        self.first = np.concatenate([self.first, self.classes.of_first(ids[:, 0]).astype(np.int16)])
        self.last = np.concatenate([self.last, self.classes.of_last(ids[:, 1]).astype(np.int16)])
        self.count, self.hash = np.concatenate([self.count, count]), np.concatenate([self.hash, h])
        self.log = np.concatenate([self.log, np.log10(count + SMOOTHING)])

    def ids(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Numbers of the words of each text: good for one batch."""
        if len(self.index) > _CACHE:
            self.forget()
        numbers, sizes = self.index.of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        if new := self.index.fresh():
            self._learn(new)
        return np.split(numbers, np.cumsum(sizes)[:-1]) if len(sizes) else []

    def class_scores(self, ids: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each text's classes, its end included."""
        ends = np.cumsum([len(x) + 1 for x in ids])
        begins = np.concatenate([[0], ends[:-1]])
        a = np.zeros(ends[-1] + 1 if len(ids) else 1, np.int64)  # a[i]: class of the token before token i
        b = np.zeros_like(a)
        target = np.zeros_like(a)
        for x, at in zip(ids, begins, strict=True):
            target[at: at + len(x)] = self.first[x]
            a[at + 1: at + 1 + len(x)] = self.first[x]
            b[at + 1: at + 1 + len(x)] = self.last[x]
        starts, docs, fresh = [], [], []
        for d, (at, end) in enumerate(zip(begins, ends, strict=True)):
            s = np.arange(at, max(at + 1, end - LENGTH + STRIDE), STRIDE)
            starts.append(s)
            docs.append(np.full(len(s), d))
            fresh.append(np.where(s == at, 0, LENGTH - STRIDE))
        if not starts:
            return np.zeros(0)
        starts, docs, fresh = np.concatenate(starts), np.concatenate(docs), np.concatenate(fresh)
        total = np.zeros(len(ids))
        step = np.arange(LENGTH)
        for i in range(0, len(starts), _WINDOWS_AT_ONCE):
            at = starts[i: i + _WINDOWS_AT_ONCE, None] + step
            d = docs[i: i + _WINDOWS_AT_ONCE]
            live = (at < ends[d][:, None]) & (step >= fresh[i: i + _WINDOWS_AT_ONCE, None])
            at = np.minimum(at, ends[d][:, None] - 1)
            logp = self.model.log_probs(a[at], b[at], target[at], live)
            total += np.bincount(np.repeat(d, live.sum(axis=1)), weights=logp, minlength=len(total))
        return total


_SCORERS: dict[str, Scorer] = {}


def kept_scorer(step: str, make) -> Scorer:
    """The scorer of one run, kept by a worker between its tasks."""
    if step not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[step] = make()
    return _SCORERS[step]


def score(spark: SparkSession, docs: DataFrame, tokenizer: str = TOKENIZER, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts have one token, their end.  A null id is in the
    held-out fold.  Repeated rows are scored each, and counted each in
    training.  Without training documents every token is unknown.  Columns
    beyond doc_id and text are not looked at.  Empty input: no rows."""
    in_batches(spark)
    ranks = _ranks(tokenizer)
    train = docs.where(~held_out(F.col("doc_id"))).select(F.coalesce("text", F.lit("")).alias("text"),
                                                         uniform(SEED, F.col("doc_id"), text_key(F.col("text"))).alias("u"))
    n_train = train.count()
    rows = staged(spark, training_rows(train, ranks), "lm-rows")
    vocabulary = staged(spark, word_counts(rows), "lm-words")
    n_words, in_words = vocabulary.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()

    def frequent(column: str, n: int) -> list[int]:
        return [r[0] for r in vocabulary.groupBy(column).agg(F.sum("c").alias("c")).orderBy(F.desc("c"), column).limit(n).collect()]

    firsts = frequent("first", CLASSES - 2)
    classes = Classes(firsts, frequent("last", LAST_CLASSES - 2))
    # tokens and distinct words of each class: the rare ids share class 1
    by_first = vocabulary.groupBy(F.when(F.col("first").isin(firsts), F.col("first")).alias("first")).agg(
        F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_first:
        k = 1 if r["first"] is None else int(classes.of_first(r["first"]))
        n_class[k], v_class[k] = r["c"], r["v"]
    tokens, distinct = in_words + n_train, n_words + (n_train > 0)
    prior = np.log(np.concatenate([[n_train], n_class[1:]]) + 1.0)
    weights = fit(spark, windows_of(rows), classes, prior - prior.max(), subwords(ranks).packing)
    base = math.log10(tokens + SMOOTHING * (distinct + 1))
    inside = np.log10(n_class + SMOOTHING * (v_class + 1))
    end_base = math.log10(n_train + SMOOTHING) - base
    to10 = 1 / math.log(10)
    small = n_words <= broadcast_words
    words = None
    if small:
        table = vocabulary.select("w", "c", "first", "last").toArrow()  # at most broadcast_words rows
        order = np.argsort(table["w"].to_numpy())
        words = spark.sparkContext.broadcast(tuple(table[name].to_numpy()[order] for name in ("w", "c", "first", "last")))

    step = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept_scorer(step, lambda: Scorer(ranks, classes, weights, words.value if words is not None else None))
        for batch in batches:
            ids = scorer.ids(batch.column("text"))
            out = {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                   "n_tokens": np.array([len(x) + 1 for x in ids], np.int64), "class_score": scorer.class_scores(ids) * to10,
                   # what the classes' totals take from each word's smoothed count
                   "class_total": np.array([inside[scorer.first[x]].sum() for x in ids], float)}
            if words is not None:
                out["n_known"] = np.array([(scorer.count[x] > 0).sum() for x in ids], np.int64)
                out["count_score"] = np.array([scorer.log[x].sum() for x in ids], float)
            else:
                pairs = [np.unique(scorer.hash[x], return_counts=True) for x in ids]
                out["uid"] = batch.column("uid")
                out["words"] = pa.array([w for w, _ in pairs], pa.list_(pa.int64()))
                out["times"] = pa.array([n for _, n in pairs], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(out)

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    texts = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    common = f"doc_id {kind}, held_out boolean, n_tokens long, class_score double, class_total double"
    if small:
        scored = texts.mapInArrow(run, f"{common}, n_known long, count_score double")
    else:
        parts = texts.withColumn("uid", F.monotonically_increasing_id())
        parts = staged(spark, parts.mapInArrow(run, f"{common}, uid long, words array<long>, times array<long>"), "lm-parts")
        each = parts.select("uid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("uid", F.col("x.words").alias("w"), F.col("x.times").alias("n"))
        met = each.join(vocabulary.select("w", "c"), "w", "left").groupBy("uid").agg(
            F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"),
            F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTHING))).alias("count_score"))
        scored = parts.join(met, "uid", "left").withColumns({"n_known": F.coalesce("n_known", F.lit(0)), "count_score": F.coalesce("count_score", F.lit(0.0))})
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.lit(1 if n_train else 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("count_score") - (F.col("n_tokens") - 1) * F.lit(base) + F.lit(end_base)).alias("base_score"),
        (F.col("class_score") + F.col("count_score") - F.col("class_total")).alias("score"))
