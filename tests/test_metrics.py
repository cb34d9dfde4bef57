"""Evaluation: the worked 8-row example, AUC against brute force,
split balance and the two-phase class rank."""

import itertools
import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.operators import evaluation as EV

TRUTH = [0, 1, 2, 3, 2, 1, 0, 3]
PRED = [0, 1, 2, 3, 1, 1, 0, 3]


def _pred(spark):
    rows = [("m", 1, i, t, p) for i, (t, p) in enumerate(zip(TRUTH, PRED))]
    return spark.createDataFrame(rows, "model string, fold int, vec_id int, label int, prediction int")


def test_fold_metrics_worked_example(spark):
    r = EV.fold_metrics(_pred(spark)).collect()[0]
    assert abs(r.accuracy - 0.875) < 1e-12
    assert abs(r.macro_precision - 0.916667) < 1e-6
    assert abs(r.macro_recall - 0.875) < 1e-12
    assert abs(r.macro_f1 - 0.866667) < 1e-6


def test_classification_report_worked_example(spark):
    rep = {r.row_name: r for r in EV.classification_report(_pred(spark)).collect()}
    assert abs(rep["other_vuln"].precision - 2 / 3) < 1e-12
    assert abs(rep["sql_injection"].recall - 0.5) < 1e-12
    assert abs(rep["other_vuln"].f1 - 0.8) < 1e-12
    assert abs(rep["sql_injection"].f1 - 2 / 3) < 1e-12
    assert rep["accuracy"].f1 == 0.875 and rep["macro avg"].support == 8


def _brute_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_auc_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        raw = [round(rng.random(), 2) for _ in range(4)]  # coarse scores → many ties
        s = sum(raw) or 1.0
        rows.append(("m", i, rng.randrange(4), [x / s for x in raw]))
    df = spark.createDataFrame(rows, "model string, vec_id int, label int, scores array<double>")
    got = {r["class"]: r.auc for r in EV.roc_auc_ovr(df).collect()}
    for c, name in enumerate(EV.CLASS_NAMES):
        exp = _brute_auc([r[3][c] for r in rows], [r[2] == c for r in rows])
        assert abs(got[name] - exp) < 1e-12
    assert abs(got["macro"] - sum(got[n] for n in EV.CLASS_NAMES) / 4) < 1e-12


def test_class_rank_equals_single_window(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("c"))
    two_phase = EV.class_rank(df, "c", "k")
    h = F.md5(F.concat(F.lit(f"{EV.D.SEED}:"), F.col("k").cast("string")))
    one = df.withColumn("r1", F.row_number().over(Window.partitionBy("c").orderBy(h, "k")))
    diff = two_phase.join(one, ["k", "c"]).where(F.col("class_rank") != F.col("r1")).count()
    assert diff == 0


def test_fold_balance(spark):
    df = spark.range(1003).select(F.col("id").alias("k"), F.when(F.col("id") % 10 < 7, "a").otherwise("b").alias("c"))
    sizes = EV.stratified_folds(df, "c", "k").groupBy("c", "fold").count().collect()
    for cls in ("a", "b"):
        n = [r["count"] for r in sizes if r.c == cls]
        assert len(n) == 5 and max(n) - min(n) <= 1


def test_holdout_quota(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 < 7, "a").otherwise("b").alias("c"))
    s = EV.stratified_holdout(df, "c", "k").where(F.col("split") == "test").groupBy("c").count().collect()
    assert {r.c: r["count"] for r in s} == {"a": 140, "b": 60}


def test_confusion_matrix_rows_are_stochastic(spark):
    """16 cells per model; each actual class present sums to rate 1;
    the worked example's class 2 row splits 0.5 / 0.5."""
    cm = EV.confusion_matrix(_pred(spark)).collect()
    assert len(cm) == 16
    by_actual = {}
    for r in cm:
        by_actual.setdefault(r.actual, []).append(r)
    for rows in by_actual.values():
        assert abs(sum(r.rate for r in rows) - 1.0) < 1e-12
    cls2 = EV.CLASS_NAMES[2]
    assert sorted(r.rate for r in by_actual[cls2] if r.rate > 0) == [0.5, 0.5]


def _brute_macro(truth, pred):
    """Accuracy and macro P / R / F1 with scikit-learn's rules: labels are
    the classes in truth or prediction; an undefined ratio counts as 0."""
    labels = sorted(set(truth) | set(pred))
    ps, rs, fs = [], [], []
    for c in labels:
        tp = sum(1 for t, p in zip(truth, pred) if t == c and p == c)
        n_pred = sum(1 for p in pred if p == c)
        n_true = sum(1 for t in truth if t == c)
        prec = tp / n_pred if n_pred else 0.0
        rec = tp / n_true if n_true else 0.0
        f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
        ps.append(prec), rs.append(rec), fs.append(f1)
    acc = sum(1 for t, p in zip(truth, pred) if t == p) / len(truth)
    return acc, sum(ps) / len(ps), sum(rs) / len(rs), sum(fs) / len(fs)


def test_fold_metrics_with_absent_classes_against_brute_force(spark):
    """Random folds where some classes never occur in truth, or are never
    predicted (the hand-made 'class absent from one fold' case)."""
    rng = random.Random(23)
    rows, want = [], {}
    for fold in range(1, 41):
        k = rng.randint(1, 4)
        truth_classes = rng.sample(range(4), k)
        n = rng.randint(1, 12)
        truth = [rng.choice(truth_classes) for _ in range(n)]
        pred = [rng.randrange(4) if rng.random() < 0.4 else t for t in truth]
        want[fold] = _brute_macro(truth, pred)
        rows += [("m", fold, i, t, p) for i, (t, p) in enumerate(zip(truth, pred))]
    df = spark.createDataFrame(rows, "model string, fold int, vec_id int, label int, prediction int")
    got = {r.fold: (r.accuracy, r.macro_precision, r.macro_recall, r.macro_f1) for r in EV.fold_metrics(df).collect()}
    assert got.keys() == want.keys()
    for fold, w in want.items():
        assert all(abs(a - b) < 1e-12 for a, b in zip(got[fold], w)), (fold, got[fold], w)


def test_compare_models_tie_goes_to_first_model(spark):
    """F13 on a tie (the hand-made 'tie on the top score' case): like
    pandas idxmax, the first model in order is the best and recommended."""
    cols = [f"{m}_{x}" for m in EV.METRICS for x in ("mean", "std")]
    vals = {"A": [0.7, 0.01, 0.6, 0.02, 0.5, 0.03, 0.64, 0.01], "B": [0.7, 0.02, 0.61, 0.01, 0.5, 0.01, 0.64, 0.02],
            "C": [0.6, 0.01, 0.5, 0.01, 0.4, 0.01, 0.5, 0.01]}
    df = spark.createDataFrame([(k, *v) for k, v in vals.items()], "model string, " + ", ".join(f"{c} double" for c in cols))
    got = {r.model: r for r in EV.compare_models(df).collect()}
    assert got["A"].best_accuracy and not got["B"].best_accuracy          # tie 0.7: first model
    assert got["B"].best_macro_precision and not got["A"].best_macro_precision
    assert got["A"].best_macro_recall and got["A"].best_macro_f1          # ties again
    assert (got["A"].f1_rank, got["B"].f1_rank, got["C"].f1_rank) == (1, 2, 3)
    assert got["A"].recommended and not got["B"].recommended and not got["C"].recommended
