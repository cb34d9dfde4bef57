"""PCA and sequence encoding properties at sf0.001."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vulnlake.operators import textfeat as TF
from vulnlake.sources import views as V


def test_pca_centred_and_ratios_in_range(spark):
    docs = V.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    p = TF.pca_2d(spark, docs)
    r = p.agg(F.avg("pc1"), F.avg("pc2"), F.first("var_ratio1"), F.first("var_ratio2"), F.count(F.lit(1))).collect()[0]
    assert abs(r[0]) < 1e-9 and abs(r[1]) < 1e-9
    assert 0 < r[3] <= r[2] < 1
    assert r[4] == docs.count()


def test_encoded_sequences_have_fixed_length(spark):
    docs = V.table(spark, SF_SMALL, "documents").select("doc_id", "text", "lang")
    vocab = TF.vocabulary(TF.tokens(docs, "bench"), 500)
    enc = TF.encode_sequences(docs, vocab, label=TF.lang_label(F.col("lang")))
    bad = enc.where((F.size("input_ids") != 128) | (F.size("attention_mask") != 128)).count()
    assert bad == 0 and enc.count() == docs.count()
    # the mask marks exactly the non-pad positions
    assert enc.where(F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
                     != F.size(F.filter("input_ids", lambda x: x != 0))).count() == 0


def test_tfidf_l2_against_python(spark):
    """E1-E4 on a small fixture against the formulas written in Python:
    idf = ln((1+n)/(1+df)) + 1 over the top-n vocabulary, L2 per row."""
    import math
    import re
    from collections import Counter

    texts = ["SELECT a, b FROM t where a = b", "the cat and the hat", "Ça va? ça VA bien", "x y z", "",
             "hat cat hat cat dog", "b b b a a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n_vocab = 6
    weights, _ = TF.fit_transform(df, "eda", n_vocab)
    got = {(r.doc_id, r.term): r.weight for r in weights.collect()}

    toks = [Counter(re.findall(r"[^\W]{2,}", t.lower())) for t in texts]
    total = Counter()
    for c in toks:
        total.update(c)
    vocab = [t for t, _ in sorted(total.items(), key=lambda kv: (-kv[1], kv[0]))[:n_vocab]]
    dfreq = {t: sum(1 for c in toks if t in c) for t in vocab}
    idf = {t: math.log((1 + len(texts)) / (1 + dfreq[t])) + 1 for t in vocab}
    want = {}
    for i, c in enumerate(toks):
        w = {t: c[t] * idf[t] for t in vocab if t in c}
        norm = math.sqrt(sum(v * v for v in w.values()))
        want.update({(i, t): v / norm for t, v in w.items()})
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_analyses_cover_every_document(spark):
    """The analyses view maps event e to document (e div 2) mod |documents|:
    every document takes part and each is analysed by consecutive pairs."""
    a = V.analyses(spark, SF_SMALL)
    n_docs = V.table(spark, SF_SMALL, "documents").count()
    n_events = V.table(spark, SF_SMALL, "events").count()
    assert a.count() == n_events
    assert a.select("doc_id").distinct().count() == n_docs
    assert a.where(F.col("doc_id") != F.pmod(F.expr("analysis_id div 2"), F.lit(n_docs))).count() == 0


def _odd_docs(spark):
    rows = [(1, "aa bb aa cc"), (1, "bb dd"), (2, "Aa ee ff bb"), (None, "aa gg"), (None, "bb"), (3, None), (4, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_terms_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    docs = _odd_docs(spark)
    want = sorted((r.doc_id or 0, r.term, r.tf) for r in TF.tokens(docs).collect())
    monkeypatch.setattr(TF, "TASK_DOCS", 2)
    assert TF.spread(docs).rdd.getNumPartitions() == 4
    got = TF.tokens(TF.spread(docs))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1  # texts move, their tokens do not
    assert sorted((r.doc_id or 0, r.term, r.tf) for r in got.collect()) == want and (1, "bb", 2) in want and (0, "aa", 1) in want


def test_rare_terms_are_dropped_before_they_are_grouped(spark):
    docs = _odd_docs(spark)
    tok = TF.tokens(docs)
    vocab = TF.vocabulary(tok, 2)
    assert [tuple(r) for r in TF.corpus_vocabulary(docs, 2).orderBy("rank").collect()] == [tuple(r) for r in vocab.orderBy("rank").collect()] == [("aa", 4, 1), ("bb", 4, 2)]
    known = TF.known_tokens(docs, vocab)
    assert {tuple(r) for r in known.collect()} == {tuple(r) for r in tok.where("term in ('aa', 'bb')").collect()}
    plan = known._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [doc_id") < plan.index("Join Inner")
    _, idf = TF.fit_transform(docs, "eda", 2)
    want = TF.fit_idf(tok, vocab, F.lit(7.0))
    assert {tuple(r) for r in idf.collect()} == {tuple(r) for r in want.collect()}
