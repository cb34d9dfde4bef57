"""Splits and evaluation.

Splits rank rows inside a class without putting a class in one task:
rows are ordered by md5(seed:id); the first four hex digits form 65,536
ordered buckets, a row's rank is its position inside its (class, bucket)
plus the sizes of the earlier buckets of its class.  That is exactly the
rank a single window per class would give.

Metrics start from confusion counts (one aggregate), so everything after
it works on at most models × folds × classes² rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.functions import derive as B
from vulnlake.operators.prefix import running_sums
from vulnlake.plans import domains as D
from vulnlake.plans.registry import register
from vulnlake.sources import views as V

K_FOLDS = 5
HOLDOUT = (1, 5)  # test share 1/5
RANK_HEX_DIGITS = 4     # md5 prefix digits → 65,536 ordered buckets per class
CLASS_NAMES = D.LABELS


def _r6(c):
    return B.round_half_even(c, 6)


# ------------------------------- splits ------------------------------------

def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with null equal to null; the right side's keys are dropped."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(other[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(other, cond, how).drop(*[f"_r_{k}" for k in keys])


def class_rank(df: DataFrame, label: str, key: str, seed: int = D.SEED) -> DataFrame:
    """1-based rank of each row inside its class, ordered by (md5(seed:key), key)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    x = df.withColumns({"_h": h, "_b": F.conv(F.substring(h, 1, RANK_HEX_DIGITS), 16, 10).cast("int")})
    w_local = Window.partitionBy(label, "_b").orderBy("_h", key)
    x = x.withColumn("_rl", F.row_number().over(w_local))
    sizes = x.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    # ≤ 65,536 rows per class
    w_off = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select(label, "_b", F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"))
    return (join_null_safe(x, offs, [label, "_b"]).withColumn("class_rank", F.col("_rl") + F.col("_off"))
            .drop("_h", "_b", "_rl", "_off"))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = K_FOLDS, seed: int = D.SEED) -> DataFrame:
    """fold 1..k; per class, fold sizes differ by at most one."""
    r = class_rank(df, label, key, seed)
    return r.withColumn("fold", ((F.col("class_rank") - 1) % k + 1).cast("int")).drop("class_rank")


def stratified_holdout(df: DataFrame, label: str, key: str, frac=HOLDOUT, seed: int = D.SEED) -> DataFrame:
    """test share frac (num, den) with class shares kept: per-class
    quotas by largest remainder (exact integer arithmetic), ties by class."""
    num, den = frac
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    # one row per class: global windows over the class table are small
    g = Window.partitionBy()
    s = sizes.withColumn("n", F.sum("n_c").over(g))
    s = s.withColumn("n_test", F.expr(f"CAST(ceil(n * {num} / {den}) AS BIGINT)"))
    s = s.withColumns({"q0": F.expr("(n_c * n_test) div n"), "rem": F.expr("(n_c * n_test) % n")})
    s = s.withColumn("short", F.col("n_test") - F.sum("q0").over(g))
    s = s.withColumn("ord", F.row_number().over(Window.orderBy(F.col("rem").desc(), F.col(label).asc())))
    quota = s.select(label, (F.col("q0") + (F.col("ord") <= F.col("short")).cast("long")).alias("quota"))
    r = join_null_safe(class_rank(df, label, key, seed), quota, [label])
    return r.withColumn("split", F.when(F.col("class_rank") <= F.col("quota"), "test").otherwise("train")).drop("class_rank", "quota")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """balanced weight n / (k · n_class), joined to the rows."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    g = Window.partitionBy()
    w = sizes.select(label, (F.sum("n_c").over(g) / (F.count(F.lit(1)).over(g) * F.col("n_c"))).alias("weight"))
    return join_null_safe(df, w, [label])


# ------------------------------ metrics ------------------------------------

def confusion_counts(pred: DataFrame, by=("model", "fold")) -> DataFrame:
    return pred.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def per_class_counts(conf: DataFrame, by=("model", "fold")) -> DataFrame:
    """tp, support (actual) and predicted counts per class present."""
    sides = conf.select(*by, F.explode(F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).cast("long").alias("tp")),
        F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("tp")),
    )).alias("s")).select(*by, "s.*")
    return sides.groupBy(*by, "cls").agg(F.sum("actual").alias("support"), F.sum("predicted").alias("predicted"),
                                         F.sum("tp").alias("tp"))


def _class_metrics(pc: DataFrame) -> DataFrame:
    tp, sup, prd = F.col("tp"), F.col("support"), F.col("predicted")
    return pc.withColumns({
        "precision": F.when(prd > 0, tp / prd).otherwise(F.lit(0.0)),
        "recall": F.when(sup > 0, tp / sup).otherwise(F.lit(0.0)),
        "f1": F.when(sup + prd > 0, F.lit(2.0) * tp / (sup + prd)).otherwise(F.lit(0.0)),
    })


def fold_metrics(pred: DataFrame, by=("model", "fold")) -> DataFrame:
    """accuracy and macro precision / recall / F1 (undefined → 0) over
    the classes seen in truth or prediction of each group."""
    m = _class_metrics(per_class_counts(confusion_counts(pred, by), by))
    return m.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"))


METRICS = ["accuracy", "macro_precision", "macro_recall", "macro_f1"]


def cv_summary(folds: DataFrame) -> DataFrame:
    """mean and sample std of the fold metrics per model."""
    aggs = []
    for m in METRICS:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return folds.groupBy("model").agg(*aggs)


def oof_assemble(pred: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    """the out-of-fold table: every id of the input with each model's
    prediction for it, null where no fold predicted the id."""
    models = [r[0] for r in pred.select("model").distinct().collect()]  # a few names
    every = ids.select(key).distinct().withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    return every.join(pred, [key, "model"], "left")


def oof_check(pred: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    """per model, whether every id of the input has exactly one row."""
    want = ids.agg(F.countDistinct(key)).scalar()
    known = pred.join(ids.select(key).distinct(), key, "left_semi")
    return known.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_ids"),
                                      F.countDistinct("fold").alias("n_folds")).withColumn(
        "complete", (F.col("n_rows") == F.col("n_ids")) & (F.col("n_ids") == want))


def class_scores(pred: DataFrame, n_classes: int = 4) -> DataFrame:
    """(model, cls, score, positive) one-vs-rest rows from the score arrays."""
    return pred.select("model", "label", F.posexplode("scores").alias("cls", "score")).select(
        "model", F.col("cls").cast("int").alias("cls"), "score", (F.col("label") == F.col("cls")).alias("positive"))


def score_counts(cs: DataFrame) -> DataFrame:
    """Positives and negatives of each distinct (model, cls, score)."""
    return cs.groupBy("model", "cls", "score").agg(
        F.sum(F.col("positive").cast("long")).alias("pos"), F.sum((~F.col("positive")).cast("long")).alias("neg"))


def roc_auc_ovr(pred: DataFrame) -> DataFrame:
    """one-vs-rest AUC per class (ties count one half) and the macro mean.

    AUC = Σ_s pos(s)·(neg_below(s) + neg(s)/2) / (P·N).  Counts are first
    aggregated per distinct score; the negatives below are running sums over
    ranges of scores."""
    per_s = score_counts(class_scores(pred)).select("model", "cls", "score", "pos", "neg", F.col("neg").alias("upto"))
    j = running_sums(pred.sparkSession, per_s, ["model", "cls"], [F.col("score")], ["upto"])
    contrib = F.col("pos") * (F.col("upto") - F.col("neg") * F.lit(0.5))
    agg = j.groupBy("model", "cls").agg(F.sum(contrib).alias("u"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    auc = agg.select("model", "cls", F.when((F.col("P") > 0) & (F.col("N") > 0),
                                             F.col("u") / (F.col("P") * F.col("N"))).alias("auc"))
    names = F.element_at(F.array(*[F.lit(c) for c in CLASS_NAMES]), F.col("cls") + 1)
    per_class = auc.select("model", names.alias("class"), "auc")
    macro = auc.groupBy("model").agg(F.when(F.count("auc") == F.count(F.lit(1)), F.avg("auc")).alias("auc")).select(
        "model", F.lit("macro").alias("class"), "auc")
    return per_class.unionByName(macro)


softmax = B.softmax  # F8


def softmax_margin(d):
    """F8, two-column form for one margin d: softmax([-d, d])."""
    return softmax(F.array(-d, d))


def argmax_label(arr):
    """index of the highest score (first wins on a tie) and its value."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int"), F.array_max(arr)


def confusion_matrix(pred: DataFrame, n_classes: int = 4) -> DataFrame:
    """all n² cells per model with counts and row-normalised rates."""
    counts = confusion_counts(pred, ("model",))
    cells = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(p).alias("prediction"))
                      for a in range(n_classes) for p in range(n_classes)])
    grid = pred.select("model").distinct().select("model", F.inline(cells))
    j = grid.join(counts, ["model", "label", "prediction"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # models × n² rows
    row_tot = F.sum("n").over(Window.partitionBy("model", "label"))
    names = F.array(*[F.lit(c) for c in CLASS_NAMES])
    return j.select("model", F.element_at(names, F.col("label") + 1).alias("actual"),
                    F.element_at(names, F.col("prediction") + 1).alias("predicted"), "n",
                    F.when(row_tot > 0, F.col("n") / row_tot).alias("rate"))


def classification_report(pred: DataFrame, by=("model",)) -> DataFrame:
    """per class precision, recall, F1, support, plus accuracy, macro
    and weighted averages."""
    m = _class_metrics(per_class_counts(confusion_counts(pred, by), by))
    names = F.array(*[F.lit(c) for c in CLASS_NAMES])
    per = m.select(*by, F.element_at(names, F.col("cls") + 1).alias("row_name"), "precision", "recall", "f1", "support")
    tot = m.groupBy(*by).agg(
        F.sum("support").alias("n"), F.sum("tp").alias("tp"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"), F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"))
    acc = tot.select(*by, F.lit("accuracy").alias("row_name"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), (F.col("tp") / F.col("n")).alias("f1"),
                     F.col("n").alias("support"))
    mac = tot.select(*by, F.lit("macro avg").alias("row_name"), F.col("mp").alias("precision"),
                     F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("n").alias("support"))
    wei = tot.select(*by, F.lit("weighted avg").alias("row_name"), (F.col("wp") / F.col("n")).alias("precision"),
                     (F.col("wr") / F.col("n")).alias("recall"), (F.col("wf") / F.col("n")).alias("f1"),
                     F.col("n").alias("support"))
    return per.unionByName(acc).unionByName(mac).unionByName(wei)


def per_class_f1(pred: DataFrame) -> DataFrame:
    """model × class F1 matrix."""
    m = _class_metrics(per_class_counts(confusion_counts(pred, ("model",)), ("model",)))
    names = F.array(*[F.lit(c) for c in CLASS_NAMES])
    return (m.select("model", F.element_at(names, F.col("cls") + 1).alias("cls"), "f1")
            .groupBy("model").pivot("cls", CLASS_NAMES).agg(F.first("f1")))


def compare_models(summary: DataFrame) -> DataFrame:
    """flag the best model per metric (first model on a tie) and rank
    by macro F1; the top-ranked model is recommended.  One row per model."""
    g = Window.partitionBy()
    out = summary
    for m in METRICS:
        w = Window.orderBy(F.col(f"{m}_mean").desc(), F.col("model").asc())
        out = out.withColumn(f"best_{m}", F.row_number().over(w) == 1)
    out = out.withColumn("f1_rank", F.row_number().over(Window.orderBy(F.col("macro_f1_mean").desc(), F.col("model").asc())))
    return out.withColumn("recommended", F.col("f1_rank") == F.min("f1_rank").over(g))


def model_table(summary: DataFrame) -> DataFrame:
    """printable 'mean ± std' per metric."""
    cols = {"Accuracy": "accuracy", "Precision": "macro_precision", "Recall": "macro_recall", "F1": "macro_f1"}
    return summary.select("model", *[B.format_mean_std(F.col(f"{m}_mean"), F.col(f"{m}_std")).alias(k)
                                     for k, m in cols.items()])


def threshold_sweep(pred: DataFrame, steps: int = 100) -> DataFrame:
    """one-vs-rest precision and recall at thresholds 0, 1/steps, …, 1
    (predict positive when score ≥ threshold); binned counts then a
    cumulative sum from the top over steps+1 rows per class."""
    cs = class_scores(pred)
    # the greatest step whose threshold the score reaches; the product may
    # round to the wrong side of a step, so its neighbours are tried as well
    near = F.floor(F.col("score") * steps)
    reached = lambda k: k / F.lit(float(steps)) <= F.col("score")
    b = F.least(F.when(reached(near + 1), near + 1).when(reached(near), near).otherwise(near - 1), F.lit(steps)).cast("int")
    bins = cs.groupBy("model", "cls", b.alias("bin")).agg(
        F.sum(F.col("positive").cast("long")).alias("pos"), F.sum((~F.col("positive")).cast("long")).alias("neg"))
    grid = (cs.select("model", "cls").distinct()
            .select("model", "cls", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("bin")))
    j = grid.join(bins, ["model", "cls", "bin"], "left").fillna(0, ["pos", "neg"])
    w = Window.partitionBy("model", "cls").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tot = Window.partitionBy("model", "cls")
    j = j.withColumns({"tp": F.sum("pos").over(w), "fp": F.sum("neg").over(w), "P": F.sum("pos").over(tot)})
    names = F.array(*[F.lit(c) for c in CLASS_NAMES])
    return j.select("model", F.element_at(names, F.col("cls") + 1).alias("class"),
                    (F.col("bin") / F.lit(float(steps))).alias("threshold"),
                    F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    F.when(F.col("P") > 0, F.col("tp") / F.col("P")).alias("recall"))


def threshold_curve(pred: DataFrame) -> DataFrame:
    """one-vs-rest precision and recall at each distinct score (predict
    positive from it on), by running sums over ranges of falling scores."""
    counts = score_counts(class_scores(pred))
    up = running_sums(pred.sparkSession, counts, ["model", "cls"], [F.col("score").desc()], ["pos", "neg"])
    whole = counts.groupBy("model", "cls").agg(F.sum("pos").alias("P"))  # one row per model and class
    names = F.array(*[F.lit(c) for c in CLASS_NAMES])
    return up.join(whole, ["model", "cls"]).select(
        "model", F.element_at(names, F.col("cls") + 1).alias("class"), F.col("score").alias("threshold"),
        (F.col("pos") / (F.col("pos") + F.col("neg"))).alias("precision"), F.when(F.col("P") > 0, F.col("pos") / F.col("P")).alias("recall"))


def threshold_pick(pred: DataFrame, target: float = D.PRECISION_TARGET) -> DataFrame:
    """the lowest score at which predicting from it on reaches the target precision."""
    return threshold_curve(pred).groupBy("model", "class").agg(
        F.min(F.when(F.col("precision") >= target, F.col("threshold"))).alias("threshold"))


def learning_curves(log: DataFrame) -> DataFrame:
    """F16: first loss and first eval loss per epoch (log order), side by side."""
    tr = log.where(F.col("loss").isNotNull()).groupBy("epoch").agg(F.min_by("loss", "event_id").alias("loss"))
    ev = log.where(F.col("eval_loss").isNotNull()).groupBy("epoch").agg(F.min_by("eval_loss", "event_id").alias("eval_loss"))
    return tr.join(ev, "epoch", "full_outer")


def best_checkpoint(log: DataFrame) -> DataFrame:
    """epoch with the highest evaluation macro F1, earliest on a tie."""
    per = log.where(F.col("macro_f1").isNotNull()).groupBy("epoch").agg(F.min_by("macro_f1", "event_id").alias("macro_f1"))
    return per.orderBy(F.col("macro_f1").desc(), F.col("epoch").asc()).limit(1)


def attention_rollup(att: DataFrame) -> DataFrame:
    """last layer, first query, mean over heads per token, padding
    dropped by mask, strongest first."""
    used = (F.col("q") == 0) & (F.col("mask") == 1)
    per = att.groupBy("vec_id", "layer", "k", "token").agg(F.avg(F.when(used, F.col("weight"))).alias("attention"))
    # one row per layer and key of a snippet
    last = Window.partitionBy("vec_id")
    r = (per.withColumn("top", F.max("layer").over(last)).where((F.col("layer") == F.col("top")) & F.col("attention").isNotNull())
         .select("vec_id", "k", "token", "attention"))
    w = Window.partitionBy("vec_id").orderBy(F.col("attention").desc(), F.col("k").asc())  # ≤ keys per snippet
    return r.withColumn("rank", F.row_number().over(w)).drop("k")


# ------------------------------- SQL bits ----------------------------------

def _sql_class_rank(src: str, label: str, key: str) -> str:
    return (f"SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('{D.SEED}:' || CAST({key} AS VARCHAR)), {key}) "
            f"AS class_rank FROM {src}")


def _sql_names(col: str) -> str:
    return "([" + ", ".join(f"'{c}'" for c in CLASS_NAMES) + f"])[{col} + 1]"


def _sql_class_metrics(by: str) -> str:
    return (f"SELECT {by}, cls, CAST(sum(actual) AS BIGINT) AS support, CAST(sum(predicted) AS BIGINT) AS predicted, "
            f"CAST(sum(tp) AS BIGINT) AS tp FROM ("
            f"SELECT {by}, label AS cls, n AS actual, 0 AS predicted, CASE WHEN label = prediction THEN n ELSE 0 END AS tp FROM conf "
            f"UNION ALL SELECT {by}, prediction AS cls, 0, n, 0 FROM conf) s GROUP BY {by}, cls")


def _sql_metric_cols() -> str:
    return ("CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision, "
            "CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, "
            "CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0.0 END AS f1")


def _sql_pc(by: str) -> list[tuple[str, str]]:
    return [("conf", f"SELECT {by}, label, prediction, count(*) AS n FROM scored GROUP BY {by}, label, prediction"),
            ("pc", f"SELECT *, {_sql_metric_cols()} FROM ({_sql_class_metrics(by)}) c")]


def _sql_fold_metrics() -> str:
    return ("SELECT model, fold, sum(tp) / sum(support) AS accuracy, avg(precision) AS macro_precision, "
            "avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM pc GROUP BY model, fold")


def _sql_summary() -> str:
    return "SELECT model, " + ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std" for m in METRICS) + " FROM fm GROUP BY model"


def _sql_auc() -> list[tuple[str, str]]:
    return [
        ("cs", "SELECT model, CAST(i - 1 AS INTEGER) AS cls, scores[i] AS score, label = i - 1 AS positive FROM "
               "(SELECT model, label, scores, unnest(generate_series(1, len(scores))) AS i FROM scored) x"),
        ("ps", "SELECT model, cls, score, CAST(sum(CAST(positive AS INTEGER)) AS BIGINT) AS pos, "
               "CAST(sum(CAST(NOT positive AS INTEGER)) AS BIGINT) AS neg FROM cs GROUP BY 1, 2, 3"),
        ("pb", "SELECT *, coalesce(sum(neg) OVER (PARTITION BY model, cls ORDER BY score "
               "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ps"),
        ("ac", "SELECT model, cls, sum(pos * (below + neg * 0.5)) AS u, sum(pos) AS P, sum(neg) AS N FROM pb GROUP BY 1, 2"),
    ]


def _with(ctes) -> str:
    return ",\n".join(f"{n} AS ({b})" for n, b in ctes) + "\n"


def _sv(*ctes) -> str:
    base = V.with_views("scored").rstrip()
    extra = [c for group in ctes for c in group]
    return base + (",\n" + _with(extra) if extra else "\n")


# -------------------------------- queries ----------------------------------

def _docs(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", "lang")


@register("stratified_folds", lambda:
          f"SELECT doc_id, lang, CAST((class_rank - 1) % {K_FOLDS} + 1 AS INTEGER) AS fold FROM ({_sql_class_rank('(SELECT doc_id, lang FROM documents) d', 'lang', 'doc_id')}) r")
def q_stratified_folds(spark, sf):
    return stratified_folds(_docs(spark, sf), "lang", "doc_id")


@register("stratified_holdout", lambda:
          "WITH s AS (SELECT lang, count(*) AS n_c FROM documents GROUP BY 1), "
          f"t AS (SELECT *, sum(n_c) OVER () AS n, CAST(ceil(sum(n_c) OVER () * {HOLDOUT[0]} / {HOLDOUT[1]}) AS BIGINT) AS n_test FROM s), "
          "q AS (SELECT *, (n_c * n_test) // n AS q0, (n_c * n_test) % n AS rem FROM t), "
          "o AS (SELECT *, n_test - sum(q0) OVER () AS short, row_number() OVER (ORDER BY rem DESC, lang ASC) AS ord FROM q), "
          "quota AS (SELECT lang, q0 + CASE WHEN ord <= short THEN 1 ELSE 0 END AS quota FROM o) "
          f"SELECT r.doc_id, r.lang, CASE WHEN r.class_rank <= quota.quota THEN 'test' ELSE 'train' END AS split "
          f"FROM ({_sql_class_rank('(SELECT doc_id, lang FROM documents) d', 'lang', 'doc_id')}) r JOIN quota USING (lang)")
def q_stratified_holdout(spark, sf):
    return stratified_holdout(_docs(spark, sf), "lang", "doc_id")


@register("class_weights", lambda:
          f"SELECT d.doc_id, d.lang, {B.sql_round_half_even('w.weight', 6)} AS weight FROM documents d JOIN "
          "(SELECT lang, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM documents GROUP BY lang) w USING (lang)")
def q_class_weights(spark, sf):
    return class_weights(_docs(spark, sf), "lang").select("doc_id", "lang", _r6(F.col("weight")).alias("weight"))


@register("class_weights_quality", lambda:
          f"SELECT d.doc_id, d.quality, {B.sql_round_half_even('w.weight', 6)} AS weight FROM labels d JOIN "
          "(SELECT quality, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM labels GROUP BY quality) w USING (quality)")
def q_class_weights_quality(spark, sf):
    lab = V.table(spark, sf, "labels").select("doc_id", "quality")
    return class_weights(lab, "quality").select("doc_id", "quality", _r6(F.col("weight")).alias("weight"))


def _sc(spark, sf):
    return V.scored(spark, sf)


@register("fold_metrics", lambda: _sv(_sql_pc("model, fold")) +
          "SELECT model, fold, " + ", ".join(f"{B.sql_round_half_even(m, 6)} AS {m}" for m in METRICS) +
          f" FROM ({_sql_fold_metrics()}) f")
def q_fold_metrics(spark, sf):
    f = fold_metrics(_sc(spark, sf))
    return f.select("model", "fold", *[_r6(F.col(m)).alias(m) for m in METRICS])


def _sql_summary_cols() -> str:
    return ", ".join(f"{B.sql_round_half_even(f'{m}_{s}', 6)} AS {m}_{s}" for m in METRICS for s in ("mean", "std"))


@register("cv_summary", lambda: _sv(_sql_pc("model, fold"), [("fm", _sql_fold_metrics())]) +
          f"SELECT model, {_sql_summary_cols()} FROM ({_sql_summary()}) s")
def q_cv_summary(spark, sf):
    s = cv_summary(fold_metrics(_sc(spark, sf)))
    return s.select("model", *[_r6(F.col(f"{m}_{x}")).alias(f"{m}_{x}") for m in METRICS for x in ("mean", "std")])


@register("oof_assemble", lambda: _sv() +
          "SELECT model, count(*) AS n_rows, count(DISTINCT vec_id) AS n_ids, count(DISTINCT fold) AS n_folds, "
          "count(*) = count(DISTINCT vec_id) AND count(DISTINCT vec_id) = (SELECT count(DISTINCT vec_id) FROM embeddings) AS complete "
          "FROM scored WHERE vec_id IN (SELECT vec_id FROM embeddings) GROUP BY model")
def q_oof_assemble(spark, sf):
    return oof_check(_sc(spark, sf), V.table(spark, sf, "embeddings").select("vec_id"))


@register("oof_table", lambda: _sv() +
          "SELECT m.model, e.vec_id, s.fold, s.label, s.prediction FROM (SELECT DISTINCT vec_id FROM embeddings) e "
          "JOIN (SELECT DISTINCT model FROM scored) m ON true LEFT JOIN scored s ON s.model = m.model AND s.vec_id = e.vec_id")
def q_oof_table(spark, sf):
    """the assembled table itself."""
    out = oof_assemble(_sc(spark, sf), V.table(spark, sf, "embeddings").select("vec_id"))
    return out.select("model", "vec_id", "fold", "label", "prediction")


@register("roc_auc_ovr", lambda: _sv(_sql_auc()) +
          f"SELECT model, {_sql_names('cls')} AS class, {B.sql_round_half_even('CASE WHEN P > 0 AND N > 0 THEN u / (P * N) END', 6)} AS auc FROM ac "
          f"UNION ALL SELECT model, 'macro', {B.sql_round_half_even('CASE WHEN count(*) = count(CASE WHEN P > 0 AND N > 0 THEN 1 END) THEN avg(u / (P * N)) END', 6)} FROM ac GROUP BY model")
def q_roc_auc_ovr(spark, sf):
    return roc_auc_ovr(_sc(spark, sf)).withColumn("auc", _r6(F.col("auc")))


@register("softmax_scores", lambda: _sv() +
          "SELECT model, vec_id, " + ", ".join(f"{B.sql_round_half_even(f'scores[{i + 1}]', 6)} AS p{i}" for i in range(4)) + " FROM scored")
def q_softmax_scores(spark, sf):
    s = _sc(spark, sf)
    return s.select("model", "vec_id", *[_r6(F.col("scores")[i]).alias(f"p{i}") for i in range(4)])


@register("softmax_binary", lambda:
          "SELECT vec_id, " + B.sql_round_half_even("1.0 / (1.0 + exp(2.0 * CAST(embedding[9] AS DOUBLE)))", 6) + " AS p_neg, "
          + B.sql_round_half_even("1.0 / (1.0 + exp(-2.0 * CAST(embedding[9] AS DOUBLE)))", 6) + " AS p_pos FROM embeddings")
def q_softmax_binary(spark, sf):
    e = V.table(spark, sf, "embeddings")
    p = softmax_margin(F.element_at("embedding", 9).cast("double"))
    return e.select("vec_id", _r6(p[0]).alias("p_neg"), _r6(p[1]).alias("p_pos"))


@register("argmax_label", lambda: _sv() +
          f"SELECT model, vec_id, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS predicted, "
          f"{_sql_names('list_position(scores, list_max(scores)) - 1')} AS predicted_label, "
          f"{B.sql_round_half_even('list_max(scores)', 6)} AS confidence FROM scored")
def q_argmax_label(spark, sf):
    s = _sc(spark, sf)
    idx, conf = argmax_label(F.col("scores"))
    names = F.array(*[F.lit(c) for c in CLASS_NAMES])
    return s.select("model", "vec_id", idx.alias("predicted"), F.element_at(names, idx + 1).alias("predicted_label"),
                    _r6(conf).alias("confidence"))


@register("confusion_matrix", lambda: _sv() +
          f"SELECT g.model, {_sql_names('g.a')} AS actual, {_sql_names('g.p')} AS predicted, coalesce(c.n, 0) AS n, "
          f"{B.sql_round_half_even('CASE WHEN sum(coalesce(c.n, 0)) OVER (PARTITION BY g.model, g.a) > 0 THEN coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY g.model, g.a) END', 6)} AS rate "
          "FROM (SELECT DISTINCT model FROM scored) m, LATERAL (SELECT m.model, a, p FROM range(4) ra(a), range(4) rp(p)) g "
          "LEFT JOIN (SELECT model, label, prediction, count(*) AS n FROM scored GROUP BY 1, 2, 3) c "
          "ON c.model = g.model AND c.label = g.a AND c.prediction = g.p")
def q_confusion_matrix(spark, sf):
    return confusion_matrix(_sc(spark, sf)).withColumn("rate", _r6(F.col("rate")))


@register("classification_report", lambda: _sv(_sql_pc("model")) +
          "SELECT model, row_name, " + ", ".join(f"{B.sql_round_half_even(c, 6)} AS {c}" for c in ("precision", "recall", "f1")) +
          ", support FROM ("
          f"SELECT model, {_sql_names('cls')} AS row_name, precision, recall, f1, support FROM pc "
          "UNION ALL SELECT model, 'accuracy', NULL, NULL, sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM pc GROUP BY model "
          "UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM pc GROUP BY model "
          "UNION ALL SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), "
          "sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM pc GROUP BY model) r")
def q_classification_report(spark, sf):
    r = classification_report(_sc(spark, sf))
    return r.select("model", "row_name", *[_r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("per_class_f1", lambda: _sv(_sql_pc("model")) +
          "SELECT model, " + ", ".join(f"{B.sql_round_half_even(f'max(CASE WHEN cls = {i} THEN f1 END)', 6)} AS {c}"
                                       for i, c in enumerate(CLASS_NAMES)) + " FROM pc GROUP BY model")
def q_per_class_f1(spark, sf):
    p = per_class_f1(_sc(spark, sf))
    return p.select("model", *[_r6(F.col(c)).alias(c) for c in CLASS_NAMES])


def _spark_summary(spark, sf):
    s = cv_summary(fold_metrics(_sc(spark, sf)))
    s = s.select("model", *[_r6(F.col(f"{m}_{x}")).alias(f"{m}_{x}") for m in METRICS for x in ("mean", "std")])
    auc = roc_auc_ovr(_sc(spark, sf)).where(F.col("class") == "macro").select("model", _r6(F.col("auc")).alias("roc_auc_ovr"))
    return s.join(auc, "model", "left")


def _sql_summary_full() -> list[tuple[str, str]]:
    return [("fm", _sql_fold_metrics()),
            ("sm", f"SELECT model, {_sql_summary_cols()} FROM ({_sql_summary()}) s"),
            ("am", f"SELECT model, {B.sql_round_half_even('CASE WHEN count(*) = count(CASE WHEN P > 0 AND N > 0 THEN 1 END) THEN avg(u / (P * N)) END', 6)} AS roc_auc_ovr FROM ac GROUP BY model"),
            ("summ", "SELECT sm.*, am.roc_auc_ovr FROM sm LEFT JOIN am USING (model)")]


@register("compare_models", lambda: _sv(_sql_pc("model, fold"), _sql_auc(), _sql_summary_full()) +
          "SELECT model, " + ", ".join(f"{m}_mean" for m in METRICS) + ", roc_auc_ovr, " +
          ", ".join(f"row_number() OVER (ORDER BY {m}_mean DESC, model ASC) = 1 AS best_{m}" for m in METRICS) +
          ", CAST(row_number() OVER (ORDER BY macro_f1_mean DESC, model ASC) AS INTEGER) AS f1_rank, "
          "row_number() OVER (ORDER BY macro_f1_mean DESC, model ASC) = 1 AS recommended FROM summ")
def q_compare_models(spark, sf):
    c = compare_models(_spark_summary(spark, sf))
    return c.select("model", *[f"{m}_mean" for m in METRICS], "roc_auc_ovr", *[f"best_{m}" for m in METRICS],
                    "f1_rank", "recommended")


@register("model_table", lambda: _sv(_sql_pc("model, fold"), _sql_auc(), _sql_summary_full()) +
          "SELECT model, " + ", ".join(f"{B.sql_format_mean_std(f'{m}_mean', f'{m}_std')} AS {k}" for k, m in
                                       (("Accuracy", "accuracy"), ("Precision", "macro_precision"), ("Recall", "macro_recall"), ("F1", "macro_f1"))) +
          " FROM summ")
def q_model_table(spark, sf):
    return model_table(_spark_summary(spark, sf))


def mean_std_long(summary: DataFrame) -> DataFrame:
    """One row per (model, metric) with the mean, the sample std and
    their 'm.mmm ± s.sss' text (stack: one pass over the summary)."""
    pairs = ", ".join(f"'{m}', {m}_mean, {m}_std" for m in METRICS)
    long = summary.select("model", F.expr(f"stack({len(METRICS)}, {pairs}) AS (metric, mean, std)"))
    return long.withColumn("mean_std", B.format_mean_std(F.col("mean"), F.col("std")))


@register("format_mean_std", lambda: _sv(_sql_pc("model, fold"), _sql_auc(), _sql_summary_full()) +
          " UNION ALL ".join(f"SELECT model, '{m}' AS metric, {m}_mean AS mean, {m}_std AS std, "
                             f"{B.sql_format_mean_std(f'{m}_mean', f'{m}_std')} AS mean_std FROM summ" for m in METRICS))
def q_format_mean_std(spark, sf):
    return mean_std_long(_spark_summary(spark, sf))


def _sql_sweep() -> list[tuple[str, str]]:
    return _sql_auc()[:1] + [
        ("grid", "SELECT model, cls, CAST(unnest(generate_series(0, 100)) AS INTEGER) AS bin FROM (SELECT DISTINCT model, cls FROM cs) d"),
        # the plain definition: predicted positive when score >= threshold
        ("cum", "SELECT g.model, g.cls, g.bin, count(CASE WHEN c.score >= g.bin / 100.0 AND c.positive THEN 1 END) AS tp, "
                "count(CASE WHEN c.score >= g.bin / 100.0 AND NOT c.positive THEN 1 END) AS fp, count(CASE WHEN c.positive THEN 1 END) AS P "
                "FROM grid g JOIN cs c ON c.model = g.model AND c.cls = g.cls GROUP BY 1, 2, 3"),
        ("sweep", f"SELECT model, {_sql_names('cls')} AS class, bin / 100.0 AS threshold, "
                  "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN P > 0 THEN tp / P END AS recall FROM cum"),
    ]


@register("threshold_sweep", lambda: _sv(_sql_sweep()) +
          f"SELECT model, class, threshold, {B.sql_round_half_even('precision', 6)} AS precision, {B.sql_round_half_even('recall', 6)} AS recall FROM sweep")
def q_threshold_sweep(spark, sf):
    s = threshold_sweep(_sc(spark, sf))
    return s.select("model", "class", "threshold", _r6(F.col("precision")).alias("precision"), _r6(F.col("recall")).alias("recall"))


@register("threshold_curve", lambda: _sv(_sql_auc()[:1]) +
          f"SELECT DISTINCT model, {_sql_names('cls')} AS class, score AS threshold, {B.sql_round_half_even('tp / n', 6)} AS precision, "
          f"{B.sql_round_half_even('CASE WHEN p > 0 THEN tp / p END', 6)} AS recall FROM (SELECT model, cls, score, "
          "sum(CAST(positive AS INTEGER)) OVER w AS tp, count(*) OVER w AS n, sum(CAST(positive AS INTEGER)) OVER (PARTITION BY model, cls) AS p FROM cs "
          "WINDOW w AS (PARTITION BY model, cls ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x")
def q_threshold_curve(spark, sf):
    c = threshold_curve(_sc(spark, sf))
    return c.select("model", "class", "threshold", _r6(F.col("precision")).alias("precision"), _r6(F.col("recall")).alias("recall"))


@register("threshold_pick", lambda: _sv(_sql_auc()[:1]) +
          f"SELECT model, {_sql_names('cls')} AS class, min(CASE WHEN precision >= {D.PRECISION_TARGET} THEN score END) AS threshold FROM "
          "(SELECT model, cls, score, avg(CAST(positive AS INTEGER)) OVER (PARTITION BY model, cls ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING "
          "AND CURRENT ROW) AS precision FROM cs) p GROUP BY model, cls")
def q_threshold_pick(spark, sf):
    return threshold_pick(_sc(spark, sf))


def _tl():
    return V.with_views("trainlog")


@register("learning_curves", lambda: _tl() +
          "SELECT coalesce(a.epoch, b.epoch) AS epoch, a.loss, b.eval_loss FROM "
          "(SELECT epoch, arg_min(loss, event_id) AS loss FROM trainlog WHERE loss IS NOT NULL GROUP BY 1) a FULL OUTER JOIN "
          "(SELECT epoch, arg_min(eval_loss, event_id) AS eval_loss FROM trainlog WHERE eval_loss IS NOT NULL GROUP BY 1) b ON a.epoch = b.epoch")
def q_learning_curves(spark, sf):
    return learning_curves(V.trainlog(spark, sf))


@register("best_checkpoint", lambda: _tl() +
          f"SELECT epoch, {B.sql_round_half_even('macro_f1', 6)} AS macro_f1 FROM (SELECT epoch, arg_min(macro_f1, event_id) AS macro_f1 FROM trainlog "
          "WHERE macro_f1 IS NOT NULL GROUP BY 1) p ORDER BY macro_f1 DESC, epoch ASC LIMIT 1")
def q_best_checkpoint(spark, sf):
    b = best_checkpoint(V.trainlog(spark, sf))
    return b.select("epoch", _r6(F.col("macro_f1")).alias("macro_f1"))


@register("attention_rollup", lambda: V.with_views("attention") +
          f"SELECT vec_id, token, {B.sql_round_half_even('attention', 6)} AS attention, "
          "CAST(row_number() OVER (PARTITION BY vec_id ORDER BY attention DESC, k ASC) AS INTEGER) AS rank FROM "
          "(SELECT a.vec_id, a.k, a.token, avg(a.weight) AS attention FROM attention a JOIN "
          "(SELECT vec_id, max(layer) AS layer FROM attention GROUP BY 1) l ON a.vec_id = l.vec_id AND a.layer = l.layer "
          "WHERE a.q = 0 AND a.mask = 1 GROUP BY 1, 2, 3) r")
def q_attention_rollup(spark, sf):
    r = attention_rollup(V.attention(spark, sf))
    return r.select("vec_id", "token", _r6(F.col("attention")).alias("attention"), "rank")
