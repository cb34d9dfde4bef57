"""Running sums against a plain loop, with nearly all rows in one group or at one end."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from vulnlake.operators import evaluation as EV
from vulnlake.operators import history as H
from vulnlake.operators.prefix import PART, dealt, running_sums


def expected(rows):
    out, sums = {}, {}
    for g, o, a, b in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        s = sums.setdefault(g, [0, 0])
        s[0] += a
        s[1] += b
        out[g, o] = tuple(s)
    return out


@pytest.mark.parametrize("sizes", [{0: 900, 1: 50, None: 50}, {k: 3 for k in range(300)}, {None: 500}, {5: 1, 6: 700, 7: 700, 8: 1}, {}])
def test_running_sums(spark, sizes):
    r = random.Random(1)
    rows = [(g, o, r.randrange(5), r.randrange(3)) for g, n in sizes.items() for o in range(n)]
    r.shuffle(rows)
    table = spark.createDataFrame(rows, "g int, o int, a long, b long")
    got = {(x.g, x.o): (x.a, x.b) for x in running_sums(spark, table, ["g"], [F.col("o")], ["a", "b"], parts=16).collect()}
    assert got == expected(rows)


def test_a_hot_group_is_dealt(spark):
    rows = spark.range(20_000).select((F.col("id") >= 18_000).cast("int").alias("g"), "id")
    sizes = [r["count"] for r in dealt(spark, rows, ["g"], [F.col("id")], parts=16).groupBy(PART).count().collect()]
    assert max(sizes) < 3 * 20_000 / 16


def test_metrics_with_all_scores_at_one_end(spark):
    """90 % of the scores within a millionth of 1; every distinct score has its threshold."""
    r = random.Random(2)
    rows = []
    for i in range(400):
        s = 1 - r.random() * 1e-6 if i % 10 else round(r.random(), 2)
        rows.append(("A", i % 5, i, int(r.random() < s), 0, [1 - s, s]))
    pred = spark.createDataFrame(rows, "model string, fold int, vec_id long, label int, prediction int, scores array<double>")
    curve = {(x["class"], x.threshold): (x.precision, x.recall) for x in EV.threshold_curve(pred).collect()}
    assert len(curve) == sum(len({x[5][c] for x in rows}) for c in (0, 1))
    for c in (0, 1):
        of = [(x[5][c], x[3] == c) for x in rows]
        for t in {s for s, _ in of}:
            taken = [p for s, p in of if s >= t]
            assert curve[EV.CLASS_NAMES[c], t] == pytest.approx((sum(taken) / len(taken), sum(taken) / sum(p for _, p in of)))
        pairs = [(p > n) + (p == n) / 2 for (p, a), (n, b) in itertools.product(of, of) if a and not b]
        auc = {x["class"]: x.auc for x in EV.roc_auc_ovr(pred).collect()}
        assert auc[EV.CLASS_NAMES[c]] == pytest.approx(sum(pairs) / len(pairs))


def test_running_totals_of_one_user(spark):
    rows = [(i, 1 if i % 10 else None, i // 3, ["safe", "weak_crypto", None][i % 3]) for i in range(600)]
    df = spark.createDataFrame(rows, "analysis_id long, user_id long, ts long, verdict string")
    got = {r.analysis_id: (r.total, r.safe, r.weak_crypto, r.sql_injection) for r in H.running_totals(df).collect()}
    seen = {}
    for i, u, _, v in rows:
        s = seen.setdefault(u, [0, 0, 0, 0])
        for j, name in enumerate((v, "safe", "weak_crypto", "sql_injection")):
            s[j] += j == 0 or v == name
        assert got[i] == tuple(s)
