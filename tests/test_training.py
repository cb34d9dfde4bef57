"""Baselines: exact features per split, brute-force counterparts, coverage, proper and repeatable scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vulnlake.operators import boosting, sparsefeat
from vulnlake.operators import evaluation as EV
from vulnlake.operators import kernelsvm as K
from vulnlake.operators import textfeat as TF
from vulnlake.operators import training as G

TERMS = ["aa", "bb", "cc", "dd", "ee", "ff", "gg"]


@pytest.fixture(scope="module")
def docs(spark):
    """Seven terms, four classes told apart by them; two folds."""
    rows = [(i, " ".join(TERMS[i % 4: i % 4 + 3] * (1 + i % 3)), ["en", "de", "es", "fr"][i % 4], float(i % 4), i // 4 % 2 + 1) for i in range(48)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, label double, fold int").cache()


@pytest.fixture(scope="module")
def prepared(spark, docs):
    return G.Prepared(spark, docs.select("doc_id", "text"), docs.select("doc_id", "label", "fold"))


@pytest.fixture(autouse=True)
def short_fits(monkeypatch):
    """Fewer rounds and trees: every round is a Spark job."""
    full = G.estimator

    def short(name, n_train=None):
        e = full(name, n_train)
        return e.setMaxIter(15) if name == "Logistic Regression" else e.setNumTrees(10)

    monkeypatch.setattr(G, "estimator", short)


def _check(rows, ids):
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    assert all(sum(r.scores) == pytest.approx(1.0) and r.prediction == max(range(4), key=lambda i: r.scores[i]) for r in rows)


def test_features_equal_the_long_form(spark, docs):
    """TF-IDF vectors of a split, with more terms in the corpus than in a vocabulary, against E3-E5."""
    rows = [(i, " ".join(f"t{(i * k) % 23}" for k in range(1, 9 + i % 5)) + ("\nq" if i % 3 else "")) for i in range(40)] + [(40, ""), (41, None)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    folds = texts.select("doc_id", (F.col("doc_id") % 2).cast("double").alias("label"), (F.col("doc_id") % 3).cast("int").alias("fold"))
    p = G.Prepared(spark, texts, folds, terms=6, candidates=1)  # the candidates have to be doubled
    for held in (0, 1, 2, None):
        train = texts.where(F.col("doc_id") % 3 != held) if held is not None else texts
        weights, idf = TF.fit_transform(train, "bench", 6)
        assert [p.vocabulary[i] for i in p.splits[held].positions] == [r.term for r in idf.orderBy("rank").collect()]
        rank = {r.term: r["rank"] - 1 for r in idf.collect()}
        want = {(r.doc_id, rank[r.term]): r.weight for r in TF.transform(texts, idf, "bench").collect()}
        got = {(r.doc_id, i): v for r in p.features(held).collect() for i, v in enumerate(r.features.toArray()[:-2]) if v}
        assert got == pytest.approx(want)
    assert {r.weight for r in p.features(0).where("fold <> 0").collect()} == {28 / (2 * 14)}


def test_candidates_stay_few_without_held_out_rows(spark):
    """One fold: no rows are left to train the split that holds it out, which asks for no more terms."""
    rows = [(i, " ".join(f"t{j}" for j in range(60) for _ in range(60 - j)) + f" rare{i} once{i}") for i in range(50)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    folds = texts.select("doc_id", F.lit(0.0).alias("label"), F.lit(0).alias("fold"))
    for held in (None, (None,)):
        p = G.Prepared(spark, texts, folds, terms=5, held=held)
        assert len(p.vocabulary) == 5 * sparsefeat.CANDIDATES
        assert [p.vocabulary[i] for i in p.splits[None].positions] == [f"t{j}" for j in range(5)]


def test_no_exchange_carries_a_text(spark, docs, monkeypatch):
    plans = []
    keep = sparsefeat.written
    monkeypatch.setattr(sparsefeat, "written", lambda s, df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(s, df, name))
    G.Prepared(spark, docs.select("doc_id", "text"), docs.select("doc_id", "label", "fold"))
    lines = [x for plan in plans for x in plan.split("\n")]
    below = [lines[i + 1] for i, x in enumerate(lines) if "Exchange" in x]
    assert below and not any("text#" in x for x in below)


def test_vectors_in_long_form(spark):
    from tests.conftest import SF_SMALL
    from vulnlake.plans.registry import queries
    long = {(r.doc_id, r.term): r.weight for r in queries()["assemble"](spark, SF_SMALL).collect()}
    rows = queries()["assemble_vector"](spark, SF_SMALL).collect()
    assert len(rows) == sum(v != 0 for v in long.values())
    sizes = {r.doc_id: r.value for r in rows if r.position == 501}
    assert sizes == {d: v for (d, t), v in long.items() if t == TF.NUM_TERMS[0]}


# -------------------------------- boosting ---------------------------------

def plain_booster(x, y, classes, rounds, extra):
    """The same trees by trying every split of every node on the raw values."""
    prior = np.log([max(1e-12, (y == k).mean()) for k in range(classes)])
    margins, other = np.tile(prior, (len(x), 1)), np.tile(prior, (len(extra), 1))
    for _ in range(rounds):
        p = boosting.softmax(margins)
        grown = []
        for k in range(classes):
            res = (y == k) - p[:, k]

            def grow(rows, depth):
                best = (1e-12, None)
                for f in range(x.shape[1]) if depth < boosting.DEPTH else ():
                    values = np.unique(x[:, f])
                    for cut in (values[1:] + values[:-1]) / 2:
                        left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                        if len(left) and len(right):
                            gain = len(left) * len(right) / len(rows) * (res[left].mean() - res[right].mean()) ** 2
                            if gain > best[0] * (1 + 1e-9):
                                best = (gain, (f, cut, left, right))
                if best[1] is None:
                    h = (np.abs(res[rows]) * (1 - np.abs(res[rows]))).sum()
                    value = boosting.RATE * (classes - 1) / classes * res[rows].sum() / h if h > 1e-150 else 0.0
                    return lambda row: value
                f, cut, left, right = best[1]
                low, high = grow(left, depth + 1), grow(right, depth + 1)
                return lambda row: low(row) if row[f] <= cut else high(row)

            grown.append(grow(np.arange(len(x)), 0))
        margins = margins + np.array([[t(r) for t in grown] for r in x])
        other = other + np.array([[t(r) for t in grown] for r in extra])
    return boosting.softmax(other)


def test_trees_walked_together_as_one_by_one():
    rng = np.random.default_rng(4)
    trees = []
    for _ in range(boosting.REWRITE + 3):
        t = boosting.Trees(3)
        t.feature, t.bin, t.leaf = rng.integers(0, 6, (3, 7)), rng.integers(0, 5, (3, 7)), rng.normal(size=(3, 8))
        trees.append(t)
    x = rng.integers(0, 6, (6, 40)).astype(np.uint8)
    want, got = np.zeros((40, 3)), np.zeros((40, 3))
    for t in trees:
        for row in range(40):
            for k in range(3):
                at = 0
                for _ in range(boosting.DEPTH):
                    at = 2 * at + 1 + (x[t.feature[k, at], row] > t.bin[k, at])
                want[row, k] += t.leaf[k, at - 7]
    boosting.add_trees(got, x, trees)
    assert got == pytest.approx(want)


def test_wide_rows_reach_python_in_short_batches(spark, prepared):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, str(1 << 30))
        G.fit_predict("SVM (RBF)", prepared, 1)
        assert [int(spark.conf.get(n).rstrip("b")) for n in names] == [2_000, 8 << 20]
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_forest_rows_remember_their_nodes():
    assert G.estimator("Random Forest").getCacheNodeIds()


def test_boosting_equals_a_plain_booster(spark, prepared, monkeypatch):
    """Both folds together; small stretches, groups of sums and rewritten blocks."""
    monkeypatch.setattr(boosting, "STRETCH", 3)
    monkeypatch.setattr(boosting, "FAN_IN", 1 << 1)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 5)
    monkeypatch.setattr(boosting, "REWRITE", 2)
    got = {r.doc_id: r.scores for r in boosting.Booster(spark, prepared, [1, 2], 4, rounds=3).predict().collect()}
    assert len(got) == 48
    for fold in (1, 2):
        rows = prepared.features(fold).collect()
        train, valid = [r for r in rows if r.fold != fold], [r for r in rows if r.fold == fold]
        x = np.array([r.features.toArray() for r in train])
        want = plain_booster(x, np.array([r.label for r in train]), 4, 3, np.array([r.features.toArray() for r in valid]))
        for r, w in zip(valid, want):
            assert sum(got[r.doc_id]) == pytest.approx(1.0)
            assert got[r.doc_id] == pytest.approx(list(w), abs=1e-9)


def test_blocks_are_written_once_and_hold_what_is_not_zero(spark, prepared, monkeypatch):
    """Margins are carried on without writing the features again; the sums of sparse blocks are those of all cells."""
    tables, keep = [], boosting.written
    monkeypatch.setattr(boosting, "written", lambda s, df, name: tables.append(keep(s, df, name)) or tables[-1])
    monkeypatch.setattr(boosting, "REWRITE", 2)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 7)
    b = boosting.Booster(spark, prepared, [1, 2], 4, rounds=5)
    assert len(tables) == 1 and b.done == 4
    for fold in (1, 2):
        zero, edges = b.zeros[fold], b.edges[fold]
        rows = [r.features.toArray() for r in prepared.features(fold).where(F.col("fold") != fold).collect()]
        full = boosting.binned(np.array(rows), edges)
        blocks = [r for r in tables[0].collect() if r.fold == fold]
        assert sum(len(r.y) for r in blocks) == len(rows) and max(len(r.y) for r in blocks) <= 7
        assert sum(len(r.row) // 2 for r in blocks) == (full != zero).sum()
    rng = np.random.default_rng(1)
    x, zero = rng.integers(0, 4, (30, 6)).astype(np.uint8), np.array([0, 0, 1, 0, 2, 3])
    row, feature = np.nonzero(x != zero)
    block = boosting.Block(1, feature * boosting.BINS + x[row, feature], row, np.zeros(30), np.zeros((30, 2)))
    targets, node = rng.normal(size=(2, 30)), rng.integers(0, 2, (2, 30))
    assert (block.some(np.array([1, 4]), zero) == x[:, [1, 4]].T).all()
    sums, whole = boosting.level_sums(block, 6 * boosting.BINS, targets, node, 2, 3)
    for k in range(2):
        for n in range(2):
            got = boosting.filled(sums[:, k, n].reshape(3, 6, boosting.BINS), zero, whole[k, n])
            for f in range(6):
                for cut in range(4):
                    t = targets[k, (x[:, f] == cut) & (node[k] == n)]
                    assert got[f, cut] == pytest.approx([t.sum(), len(t), (np.abs(t) * (1 - np.abs(t))).sum()], abs=1e-12)


def test_bin_edges():
    x = np.array([[0.0, 1.0], [0.0, 1.0], [0.5, 1.0], [2.0, 1.0]])
    e = boosting.edges_of(x)
    assert e[0, :2].tolist() == [0.25, 1.25] and np.isinf(e[0, 2:]).all() and np.isinf(e[1]).all()
    many = np.concatenate([np.zeros(500), np.arange(1, 1001)])[:, None]
    bins = np.bincount(boosting.binned(many, boosting.edges_of(many))[:, 0], minlength=boosting.BINS)
    assert bins[0] == 500 and (bins[1:] > 40).all() and (bins[1:] < 110).all()


# ------------------------------- kernel SVM --------------------------------

def test_linear_svms_reach_the_minimum(spark, prepared):
    rows = prepared.features(1, log_sizes=True).where("fold <> 1").withColumn("inner", (F.col("doc_id") / 8 % 2 + 1).cast("int"))
    fitted = K.linear_svms(spark, rows, 4, 2)
    assert len(fitted) == 12
    data = rows.collect()
    x = np.array([[*r.features.toArray(), 1.0] for r in data])
    for (k, held), v in fitted.items():
        weight = np.array([r.weight * (r.inner != held) for r in data])
        _, gradient, _ = K.hinge_sums(x, np.array([1.0 if r.label == k else -1.0 for r in data]), weight, v)
        assert np.abs(gradient / weight.sum() + np.append(np.full(len(v) - 1, K.RIDGE), 1e-9) * v).max() < 1e-6


def test_sigmoids_are_calibrated(spark):
    rows = [(float(i % 2), [(-1.0) ** (i + 1) * (i % 7 - 1) / 3.0, 0.0]) for i in range(200)]
    a, b = K.sigmoids(spark.createDataFrame(rows, "label double, margins array<double>"), 2)[0]

    def loss(a, b):
        out = 0.0
        for label, m in rows:
            t = 101 / 102 if label == 0 else 1 / 102
            p = 1 / (1 + math.exp(-(a * m[0] + b)))
            out -= t * math.log(p) + (1 - t) * math.log(1 - p)
        return out
    assert all(loss(a, b) <= loss(a + d, b + e) + 1e-6 for d in (-.02, 0, .02) for e in (-.02, 0, .02))


def kernel_error(x, kernel_map):
    z = kernel_map(x)
    exact = np.exp(-K.RBF_GAMMA * ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    return float(np.abs(z @ z.T - exact).mean())


def test_landmarks_come_closer_than_random_features(spark):
    r = np.random.default_rng(7)
    x = np.abs(r.normal(size=(300, 40))) * (r.random((300, 40)) < 0.2)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    near, far = kernel_error(x, K.Nystrom(x[:64])), kernel_error(x, K.RandomFourier(40))
    assert near < 0.02 and near < far / 3
    assert kernel_error(x[:64], K.Nystrom(x[:64])) < 1e-6


# --------------------------------- models ----------------------------------

@pytest.mark.parametrize("name", ["Logistic Regression", "SVM (RBF)", "Random Forest"])
def test_models_on_a_small_vocabulary(spark, prepared, name):
    """The width follows the fitted vocabulary; the same answer twice."""
    out = G.fit_predict(name, prepared, 1).collect()
    _check(out, [i for i in range(48) if i // 4 % 2 == 0])
    assert sum(r.label == r.prediction for r in out) > 12
    if name == "Logistic Regression":
        assert sorted((r.doc_id, r.prediction) for r in G.fit_predict(name, prepared, 1).collect()) == sorted((r.doc_id, r.prediction) for r in out)


def test_cross_validation_report_equals_a_recount(spark, prepared):
    oof = G.benchmark(prepared, rounds=2).checkpoint()
    report = {r.model: r for r in G.cv_report(oof).collect()}
    assert set(report) == set(G.MODELS)
    for name, got in report.items():
        rows = oof.where(F.col("model") == name).collect()
        _check(rows, range(48))
        folds = {}
        for r in rows:
            folds.setdefault(r.fold, []).append(r.label == r.prediction)
        assert len(folds) == 2 and got.complete and got.n_ids == 48
        assert got.accuracy_mean == pytest.approx(sum(sum(v) / len(v) for v in folds.values()) / 2)
        aucs = []
        for c in range(4):
            pos, neg = ([r.scores[c] for r in rows if (r.label == c) == want] for want in (True, False))
            aucs.append(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)))
        assert got.roc_auc_ovr == pytest.approx(sum(aucs) / 4, abs=1e-6)
    ranked = EV.compare_models(G.cv_report(oof)).collect()
    assert sorted(r.f1_rank for r in ranked) == [1, 2, 3, 4] and sum(r.recommended for r in ranked) == 1


def test_missing_predictions_are_reported(spark, prepared):
    pred = spark.createDataFrame([("A", 0, 1, 0, 0, [1.0, 0.0, 0.0, 0.0])], "model string, doc_id long, fold int, label int, prediction int, scores array<double>")
    oof = EV.oof_assemble(pred, prepared.frame.select("doc_id"), "doc_id")
    assert oof.count() == 48 and not G.cv_report(oof).first().complete
