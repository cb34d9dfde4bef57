"""Toxicity: a learned lexicon, a fuzzy matcher and context windows.

1. The lexicon is learned from labelled documents: words, and word beginnings
   (stems), that occur in toxic documents almost only.
2. The lexicon's trie is intersected with Levenshtein automata: one lazily
   determinised automaton whose states are sets of (trie node, edits) accepts
   every word within a term's edit bound, so misspelled terms are found too.
3. A window of words round every hit tells quotation (quote marks, reporting
   words) from abuse (words of address); the weighted hits of a document are
   turned into a probability by a logistic fit on the same labelled documents.

Texts are read whole; labels, language, source and id are no inputs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm.common import REMEMBERED, in_batches, staged, uniform

THRESHOLD = 0.7
#: Bounds of the labelled sample the classifier is fitted on, by label.
MAX_TOXIC_ROWS, MAX_CLEAN_ROWS = 8_000, 16_000
#: Bound of the lexicon; the terms with most toxic documents stay.
MAX_TERMS = 2_000
#: A term needs so many toxic texts and as many different contexts in them, and at most this many clean ones for each.
MIN_TOXIC_DOCS, MAX_CLEAN_SHARE = 5, 0.1
STEM_LENGTHS = (4, 5, 6)
#: Log odds at which a term has its full weight.
FULL_ODDS = 6.0
#: Words within this distance of a hit are its context.
WINDOW = 6
#: Weights of hits by edit distance, of quoted hits and of hits beside a word of address.
EDIT_WEIGHT = (1.0, 0.6, 0.35)
QUOTED, ADDRESSED = 0.4, 1.25
#: Quotation marks, reporting words, words of address, look-alike digits.
MARKS = frozenset("\"'“”„‚‘’«»‹›")
REPORTING = frozenset("said says called calls quote quoted quotes wrote word term sagte nannte zitat wort dit disait mot terme dijo llamó cita palabra".split())
ADDRESS = frozenset("you your du dein ihr tu te vous votre usted tú eres".split())
LOOKALIKE = str.maketrans("013457@$!", "oieastasi")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SEED = 7


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; 1 is held out.  A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def bare(word: str) -> str:
    """The word in lower case without marks at its edges."""
    return _EDGES.sub("", word.lower())


def hash_of(text: str) -> int:
    """A signed 64-bit number that is the same in every process."""
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class FuzzyLexicon:
    """Trie of terms ∩ Levenshtein automata, determinised as words are read.

    ``terms`` maps a term to True if it is a stem (anything may follow) and
    its weight.  ``find(word)`` is the best weight, less for each edit, of a
    term that admits the word, or 0.
    """

    DEAD = 0

    def __init__(self, terms: dict[str, tuple[bool, float]]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[int, bool, float]] = {}
        self.bound = [0]  # most edits that any term below the node allows
        for term, (stem, weight) in sorted(terms.items()):
            node, allowed = 0, 0 if stem else edits_allowed(term)
            self.bound[0] = max(self.bound[0], allowed)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.bound.append(0)
                node = self.children[node][c]
                self.bound[node] = max(self.bound[node], allowed)
            self.ends[node] = (allowed, stem, weight)
        self.known: dict[frozenset, int] = {frozenset(): self.DEAD}
        self.sets: list[frozenset] = [frozenset()]
        self.steps: list[dict[str, int]] = [{}]
        self.accepts: list[tuple[float, float]] = [(0.0, 0.0)]
        self.start = self._state({0: 0})
        self.words: dict[str, float] = {}

    def _state(self, at: dict[int, int]) -> int:
        queue = list(at)
        while queue:  # skipping letters of the term costs an edit each
            node = queue.pop()
            for child in self.children[node].values():
                e = at[node] + 1
                if e <= self.bound[child] and e < at.get(child, 99):
                    at[child] = e
                    queue.append(child)
        key = frozenset(at.items())
        if key not in self.known:
            self.known[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [(self.ends[node], e) for node, e in at.items() if node in self.ends and e <= self.ends[node][0]]
            whole = [weight * EDIT_WEIGHT[e] for (_, _, weight), e in ends]
            stems = [weight * EDIT_WEIGHT[e] for (_, stem, weight), e in ends if stem]
            self.accepts.append((max(whole, default=0.0), max(stems, default=0.0)))
        return self.known[key]

    def _step(self, state: int, c: str) -> int:
        at: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.bound[node] and e < at.get(node, 99):
                at[node] = e

        for node, e in self.sets[state]:
            reach(node, e + 1)
            for letter, child in self.children[node].items():
                reach(child, e + (letter != c))
        return self._state(at)

    def _match(self, word: str) -> float:
        state, stem = self.start, 0.0
        for c in word:
            nxt = self.steps[state].get(c)
            if nxt is None:
                nxt = self.steps[state][c] = self._step(state, c)
            state = nxt
            if state == self.DEAD:
                return stem
            stem = max(stem, self.accepts[state][1])
        return max(stem, self.accepts[state][0])

    def find(self, raw: str) -> float:
        """Weight of a word as written; look-alike digits count as one edit.
        Answers are remembered for frequent words."""
        if raw in self.words:
            return self.words[raw]
        word = bare(raw)
        out = self._match(word)
        if not out and (plain := word.translate(LOOKALIKE)) != word:
            out = self._match(plain) * EDIT_WEIGHT[1]
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if len(self.sets) > REMEMBERED:
            self._forget()
        self.words[raw] = out
        return out

    def _forget(self) -> None:
        first = self.sets[self.start]
        self.known, self.sets, self.steps, self.accepts = {frozenset(): self.DEAD}, [frozenset()], [{}], [(0.0, 0.0)]
        self.start = self._state(dict(first))


def evidence(text: str | None, lexicon: FuzzyLexicon) -> tuple[float, float, int, list[tuple[int, str, float]]]:
    """(abuse, quotation, words, hits) of a whole text; a hit is (word position, word, weight)."""
    words = _WORD.findall(text) if text else []
    abuse = quoted = 0.0
    hits: list[tuple[int, str, float]] = []
    find = lexicon.find
    for i, raw in enumerate(words):
        weight = find(raw)
        if not weight:
            continue
        near = words[max(0, i - WINDOW): i] + words[i + 1: i + 1 + WINDOW]
        plain = {bare(x) for x in near}
        opens = any(x[0] in MARKS for x in words[max(0, i - WINDOW): i + 1])
        closes = any(x.rstrip(".,;:!?")[-1:] in MARKS for x in words[i: i + 1 + WINDOW])
        if (opens and closes) or plain & REPORTING:
            quoted += weight
            weight *= QUOTED
        elif plain & ADDRESS:
            weight *= ADDRESSED
        abuse += weight
        hits.append((i, raw, weight))
    return abuse, quoted, len(words), hits


def _labelled(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic, text of the bounded labelled sample outside the held-out fold."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 1))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("u", uniform(_SEED, F.col("doc_id"))))
    known = staged(spark, known, "toxic-labels")
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = {k: min(1.0, m / max(n.get(k, 0), 1)) for k, m in ((1, MAX_TOXIC_ROWS), (0, MAX_CLEAN_ROWS))}
    picked = known.where(((F.col("toxic") == 1) & (F.col("u") < rate[1])) | ((F.col("toxic") == 0) & (F.col("u") < rate[0])))
    # the sample's ids are bounded by the two parameters above
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked.select("doc_id", "toxic")), "doc_id")
    return staged(spark, sample.select("toxic", "text"), "toxic-sample")


def learn_lexicon(sample: DataFrame) -> dict[str, tuple[bool, float]]:
    """Terms that mark toxic documents of the sample, each with whether it is a
    stem and its weight: the log odds of toxic against clean documents, 1 at most.

    A text counts once, however often it was copied, and so does a context (the
    words before and after): near copies of a text say nothing new.  The bar is
    the same for samples of all sizes, but so few terms as one in all that
    were looked at may reach it by chance."""
    sample = sample.groupBy("toxic", F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.first("text").alias("text")).select("toxic", "text")
    sample = staged(sample.sparkSession, sample, "toxic-texts")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(t, s, a, b) for (t, s), (a, b) in totals().items()], columns=["term", "stem", "toxic", "clean"])
            seen.clear()
            return out

        def totals() -> dict:
            both: dict[tuple[str, bool], list[int]] = {}
            for (term, stem, toxic), n in seen.items():
                both.setdefault((term, stem), [0, 0])[0 if toxic else 1] += n
            return both

        for frame in batches:
            for toxic, text in zip(frame["toxic"], frame["text"], strict=True):
                words = {bare(w) for w in set(_WORD.findall(text))}
                seen.update((w, False, toxic) for w in words if len(w) >= 3)
                seen.update((w, True, toxic) for w in {w[:k] for w in words for k in STEM_LENGTHS if len(w) > k})
            if len(seen) > 300_000:
                yield flush()
        yield flush()

    sums = (sample.mapInPandas(count, "term string, stem boolean, toxic long, clean long")
            .groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    n_toxic, n_all = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    # words that more clean than toxic texts hold are not looked at again
    sums = staged(sample.sparkSession, sums.where(F.col("toxic") >= MIN_TOXIC_DOCS), "toxic-terms")
    looked_at = sums.count()
    first = sums.where(F.col("clean") <= F.col("toxic"))

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            seen = set()
            for toxic, text in zip(frame["toxic"], frame["text"], strict=True):
                words = ["", *map(bare, _WORD.findall(text)), ""]
                for before, word, after in zip(words, words[1:], words[2:], strict=False):
                    seen.update((t, s, toxic, hash_of(f"{before} {after}")) for t, s in [(word, False), *((word[:k], True) for k in STEM_LENGTHS if len(word) > k)]
                                if (t, s) in candidates)
            yield pd.DataFrame(list(seen), columns=["term", "stem", "kind", "context"])

    candidates = {(r.term, r.stem) for r in first.select("term", "stem").collect()}  # words of the bounded sample
    varied = (sample.mapInPandas(contexts, "term string, stem boolean, kind int, context long").distinct().groupBy("term", "stem")
              .agg(F.sum("kind").alias("in_toxic"), F.sum(1 - F.col("kind")).alias("in_clean")))
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = F.lit(n_toxic / max(n_all, 1))
    # log likelihood of the split against that by chance; e to the minus it bounds the probability of such a split
    evidence = a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0)
    rows = (first.join(varied, ["term", "stem"])
            .select("term", "stem", F.least("toxic", "in_toxic").alias("toxic"), F.least("clean", "in_clean").alias("clean"))
            .where((a >= MIN_TOXIC_DOCS) & (b <= a * MAX_CLEAN_SHARE) & (a > (a + b) * share) & (evidence >= math.log(max(looked_at, 1))))
            .orderBy(F.desc("toxic"), F.length("term"), "term").limit(MAX_TERMS).collect())
    terms: dict[str, tuple[bool, float]] = {}
    stems = {r.term: r.toxic for r in rows if r.stem}
    for r in sorted(rows, key=lambda r: (-r.toxic, len(r.term), r.term)):
        shorter = [r.term[:k] for k in STEM_LENGTHS if k < len(r.term) and r.term[:k] in stems]
        if not r.stem and r.term in terms:
            continue  # the stem of the same letters
        if r.stem and any(terms.get(s, (False, 0))[0] for s in shorter):
            continue  # a full word stays beside its stem: it is the word that is found with edits
        if r.stem and any(not x.stem and x.term.startswith(r.term) and x.toxic >= 0.8 * r.toxic for x in rows):
            continue  # one word makes the stem: the word itself, with its edits, is the better term
        odds = math.log((r.toxic + 0.5) / (n_toxic + 1) * (n_all - n_toxic + 1) / (r.clean + 0.5))
        terms[r.term] = (r.stem, max(0.05, min(1.0, odds / FULL_ODDS)))
    return terms


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def features(abuse: np.ndarray, quoted: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.column_stack([np.minimum(abuse, 1.0), np.log1p(abuse), abuse / np.sqrt(n + 1.0)])


class Model:
    """What scoring needs: the terms and the logistic weights."""

    def __init__(self, terms: dict[str, tuple[bool, float]], weights: np.ndarray):
        self.terms, self.weights = terms, weights

    def scores(self, abuse: np.ndarray, quoted: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = self.weights[0] + features(abuse, quoted, n) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon and weights from labelled documents outside the held-out fold.
    Without labels of both kinds, every score is the share of toxic ones, or 0."""
    in_batches(spark)
    sample = _labelled(spark, docs, labels)
    terms = learn_lexicon(sample)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = FuzzyLexicon(terms)
        for frame in batches:
            yield pd.DataFrame([(y, *evidence(t, lexicon)[:3]) for y, t in zip(frame["toxic"], frame["text"], strict=True)],
                               columns=["toxic", "abuse", "quoted", "n"])

    rows = sample.mapInPandas(measure, "toxic int, abuse double, quoted double, n long").toPandas()  # four numbers for each of the sample
    y = rows["toxic"].to_numpy(float)
    weights = np.zeros(4)
    if len(y) == 0 or y.min() == y.max():
        share = y.mean() if len(y) else 0.0
        weights[0] = math.log((share + 1e-6) / (1 - share + 1e-6))
    else:
        weights = fit_logistic(features(rows["abuse"].to_numpy(), rows["quoted"].to_numpy(), rows["n"].to_numpy()), y)
        weights[1:] = np.maximum(weights[1:], 0.0)  # more evidence never lowers a score
    return Model(terms, weights)


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits, hits (position, word, weight).

    Null and empty texts have no evidence and get the score of none.  Repeated
    rows are scored each; a null id is in the fold of the empty text.  Columns
    beyond doc_id and text are not looked at.  Empty input: no rows."""
    in_batches(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = FuzzyLexicon(model.terms)
        for frame in batches:
            found = [evidence(t, lexicon) for t in frame["text"]]
            numbers = np.array([f[:3] for f in found], dtype=float).reshape(-1, 3)
            out = pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "score": model.scores(*numbers.T)})
            out["predicted"] = (out["score"] >= THRESHOLD).astype(int)
            out["n_hits"] = [len(f[3]) for f in found]
            out["hits"] = [[{"position": i, "word": w, "weight": x} for i, w, x in f[3]] for f in found]
            yield out

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return (docs.select("doc_id", "text", (fold(F.col("doc_id")) == 1).alias("held_out"))
            .mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_hits long, hits array<struct<position:long,word:string,weight:double>>"))


def keep_clean(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic."""
    in_batches(spark)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = FuzzyLexicon(model.terms)
        for texts in batches:
            numbers = np.array([evidence(t, lexicon)[:3] for t in texts], dtype=float).reshape(-1, 3)
            yield pd.Series(model.scores(*numbers.T) < THRESHOLD)

    return docs.where(clean("text"))
