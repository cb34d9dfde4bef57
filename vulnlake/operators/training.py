"""Distributed baseline training.

Features per split are sparse vectors (``sparsefeat.Prepared``): TF-IDF over a
vocabulary fitted on the training rows only (so nothing leaks), plus num_tokens
and num_lines; splits are made on ids and joined to the vectors.  Class weights
are those of the training rows (F3) and feed ``weightCol``.

Logistic regression and forest are MLlib's; boosting (``boosting.Booster``)
trains all folds together; the kernel SVM is in ``kernelsvm``.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.functions import derive as B
from vulnlake.operators import evaluation as EV
from vulnlake.operators import kernelsvm as K
from vulnlake.operators import textfeat as TF
from vulnlake.operators.boosting import ROUNDS, Booster
from vulnlake.operators.sparsefeat import Prepared
from vulnlake.plans import domains as D
from vulnlake.plans.registry import register
from vulnlake.session import short_batches, written
from vulnlake.sources import views as V

# Trees grow until their leaves are pure in the studied benchmark; 30 is the
# greatest depth that MLlib grows.
FOREST_DEPTH = 30
INNER_FOLDS = 3  # of the training rows, for the calibration
CLASSES = len(TF.LANGS)


def labelled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, label): one of 4 unbalanced classes; other languages have none and are left out."""
    ids = V.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return ids.withColumn("label", TF.lang_label(F.col("lang")).cast("double")).where("label is not null")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", "text")


# --------------------------------- models ----------------------------------

def estimator(name: str, n_train: int | None = None):
    """MLlib's baselines with the reference's settings."""
    if name == "Logistic Regression":
        reg = 1.0 / max(n_train or 1, 1)  # C = 1 on the summed loss
        return LogisticRegression(family="multinomial", maxIter=1000, regParam=reg, elasticNetParam=0.0,
                                  standardization=False, weightCol="weight")
    if name == "Random Forest":
        # rows remember their nodes instead of walking each tree again for every group of nodes
        return RandomForestClassifier(numTrees=100, maxDepth=FOREST_DEPTH, seed=D.SEED, weightCol="weight", cacheNodeIds=True, maxMemoryInMB=512)
    raise ValueError(name)


def _finished(out: DataFrame, scores: Column) -> DataFrame:
    """(doc_id, label, prediction, scores); the prediction is the class of the greatest score."""
    kept = out.select("doc_id", F.col("label").cast("int").alias("label"), scores.alias("scores"))
    return kept.select("doc_id", "label", EV.argmax_label(F.col("scores"))[0].alias("prediction"), "scores")


def _svm(spark: SparkSession, train: DataFrame, valid: DataFrame) -> DataFrame:
    """One-vs-rest margins on mapped rows, calibrated on inner folds."""
    inner = EV.stratified_folds(train.select("doc_id", "label"), "label", "doc_id", INNER_FOLDS, D.SEED + 1).select("doc_id", F.col("fold").alias("inner"))
    rows = written(spark, train.join(inner, "doc_id"), "svm-rows")
    fitted = K.linear_svms(spark, rows, CLASSES, INNER_FOLDS)
    ab = K.sigmoids(K.margins_of(rows, fitted, CLASSES, own_inner=True).select("label", "margins"), CLASSES)
    return _finished(K.margins_of(valid, fitted, CLASSES, own_inner=False), K.calibrated(F.col("margins"), ab)).checkpoint()


def fit_predict(name: str, prepared: Prepared, fold, rounds: int = ROUNDS) -> DataFrame:
    """Fit features + model on all rows outside ``fold``, predict those of it:
    (doc_id, label, prediction, scores array<double>)."""
    short_batches(prepared.spark)
    if name == "Gradient Boosting":
        out = Booster(prepared.spark, prepared, [fold], CLASSES, rounds).predict()
        return _finished(out, F.col("scores")).checkpoint()
    rows = prepared.features(fold, log_sizes=name == "SVM (RBF)")
    train, valid = rows.where(F.col("fold") != F.lit(fold)), rows.where(F.col("fold") == F.lit(fold))
    if name == "SVM (RBF)":
        kernel_map = K.landmark_map(train, prepared.splits[fold].rows)
        return _svm(prepared.spark, K.mapped(train, kernel_map), K.mapped(valid, kernel_map))
    train = train.persist()
    model = estimator(name, prepared.splits[fold].rows).fit(train)
    done = _finished(model.transform(valid), vector_to_array("probability")).checkpoint()
    train.unpersist()
    return done


def folded(ids: DataFrame, k: int = EV.K_FOLDS) -> DataFrame:
    """(doc_id, label, fold): stratified folds of the ids alone."""
    return EV.stratified_folds(ids, "lang", "doc_id", k).select("doc_id", "label", "fold")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cross_validate(name: str, prepared: Prepared, rounds: int = ROUNDS) -> DataFrame:
    """Per fold, fit on the other folds only and predict the fold; the
    out-of-fold predictions with model and fold columns."""
    folds = sorted(prepared.sums)
    short_batches(prepared.spark)
    if name == "Gradient Boosting":
        pred = Booster(prepared.spark, prepared, folds, CLASSES, rounds).predict()
        kept = _finished(pred, F.col("scores")).join(prepared.frame.select("doc_id", "fold"), "doc_id")
        return kept.withColumn("model", F.lit(name)).checkpoint()

    def one(f) -> DataFrame:
        return fit_predict(name, prepared, f).withColumns({"fold": F.lit(f), "model": F.lit(name)}).checkpoint()

    # the fits are independent Spark jobs: submit them concurrently
    with ThreadPoolExecutor(max_workers=len(folds)) as pool:
        return _union(list(pool.map(one, folds)))


MODELS = ("Logistic Regression", "Random Forest", "SVM (RBF)", "Gradient Boosting")


def benchmark(prepared: Prepared, models: tuple[str, ...] = MODELS, rounds: int = ROUNDS) -> DataFrame:
    """G5 over several models on the same folds and vectors: the out-of-fold
    table (F6), every id with each model's prediction, null where none was made."""
    # the models share the cluster too: jobs of one fill the gaps between another's
    with ThreadPoolExecutor(max_workers=len(models)) as pool:
        pred = _union(list(pool.map(lambda m: cross_validate(m, prepared, rounds), models)))
    return EV.oof_assemble(pred, prepared.frame.select("doc_id"), "doc_id")


def cv_report(oof: DataFrame) -> DataFrame:
    """Per model of an out-of-fold table: mean and deviation of the fold
    metrics (F5), macro AUC over all scores (F7), the number of ids and
    whether each has a prediction (F6)."""
    done = oof.where("prediction is not null")
    auc = EV.roc_auc_ovr(done).where(F.col("class") == "macro").select("model", F.col("auc").alias("roc_auc_ovr"))
    complete = oof.groupBy("model").agg(F.countDistinct("doc_id").alias("n_ids"), (F.count("prediction") == F.countDistinct("doc_id")).alias("complete"))
    return EV.cv_summary(EV.fold_metrics(done)).join(auc, "model").join(complete, "model")


# -------------------------------- queries ----------------------------------

@register("assemble_vector", lambda: TF._with(TF._sql_fit("bench", D.BENCH_MAX_FEATURES)) +
          f"SELECT doc_id, CAST(position AS INTEGER) AS position, {B.sql_round_half_even('value', 6)} AS value FROM ("
          "SELECT wn.doc_id, idf.rank AS position, wn.weight AS value FROM wn JOIN idf USING (term) UNION ALL "
          f"SELECT doc_id, (SELECT count(*) FROM vocab) + 1, CAST({B.sql_num_tokens('text')} AS DOUBLE) FROM documents UNION ALL "
          f"SELECT doc_id, (SELECT count(*) FROM vocab) + 2, CAST({B.sql_num_lines('text')} AS DOUBLE) FROM documents) a WHERE value <> 0")
def q_assemble_vector(spark, sf):
    """E6 as vectors: the entries that are not zero of every row's features."""
    folds = V.table(spark, sf, "documents").select("doc_id", F.lit(0.0).alias("label"), F.lit(0).alias("fold"))
    rows = Prepared(spark, texts(spark, sf), folds, held=(None,)).features()
    entries = rows.select("doc_id", F.posexplode(vector_to_array("features")).alias("position", "value")).where("value <> 0")
    return entries.select("doc_id", (F.col("position") + 1).alias("position"), B.round_half_even(F.col("value"), 6).alias("value"))


def _holdout(spark, sf) -> Prepared:
    split = EV.stratified_holdout(labelled_ids(spark, sf), "lang", "doc_id")
    folds = split.select("doc_id", "label", (F.col("split") == "test").cast("int").alias("fold"))
    return Prepared(spark, texts(spark, sf), folds, held=(1,))


def _pred_query(name: str):
    def q(spark, sf):
        p = fit_predict(name, _holdout(spark, sf), 1)
        return p.select("doc_id", "label", "prediction", *[F.col("scores")[i].alias(f"p{i}") for i in range(CLASSES)])
    return q


register("train_lr")(_pred_query("Logistic Regression"))
register("train_rf")(_pred_query("Random Forest"))
register("train_svm_rbf")(_pred_query("SVM (RBF)"))
register("train_gbt")(_pred_query("Gradient Boosting"))


def _benchmark(spark, sf) -> DataFrame:
    folds = tuple(range(1, EV.K_FOLDS + 1))
    return benchmark(Prepared(spark, texts(spark, sf), folded(labelled_ids(spark, sf)), held=folds))


@register("cross_validate")
def q_cross_validate(spark, sf):
    return EV.fold_metrics(_benchmark(spark, sf).where("prediction is not null"))


@register("cv_report")
def q_cv_report(spark, sf):
    report = cv_report(_benchmark(spark, sf).checkpoint())
    # F13 on the trained models: best per metric, ranked by macro F1
    ranked = EV.compare_models(report)
    return ranked.select("model", *[f"{m}_{x}" for m in EV.METRICS for x in ("mean", "std")], "roc_auc_ovr", "n_ids", "complete",
                         *[f"best_{m}" for m in EV.METRICS], "f1_rank", "recommended")
