"""Text features (E1-E9) as long tables (doc_id, term, weight).

The vectoriser is expressed relationally: tokens are extracted JVM-side
(regexp_extract_all), term frequencies are a hash aggregate, the
vocabulary is a top-N (its size is the N the caller asks for, so it is a
proven bound and is broadcast), weights and document frequencies are
aggregated over vocabulary terms only: the texts are tokenised once for the
vocabulary and once for its terms, and no pair of document and rare term is
grouped or kept.  L2 norms use a window per document (bounded by the
vocabulary size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.functions import derive as B
from vulnlake.functions.rules import sql_str
from vulnlake.operators import evaluation as EV
from vulnlake.plans import domains as D
from vulnlake.plans.registry import register
from vulnlake.sources import views as V

LANGS = ["de", "en", "es", "fr"]  # our class domain for documents (alphabetical ids)
NUM_TERMS = ["__num_tokens", "__num_lines"]


def token_array(text, mode: str = "eda"):
    return F.regexp_extract_all(F.lower(text), F.lit(B.WORD_RX[mode]), 0)


#: Documents whose terms one task counts.
TASK_DOCS = 5_000


def spread(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` dealt by key to as many tasks as their number asks for: what a
    task groups is bounded, and rows of a key meet before they are exploded."""
    return docs.repartition(max(1, -(-docs.count() // TASK_DOCS)), key)


def occurrences(df: DataFrame, mode: str = "eda", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term): a row for every lower-cased word token."""
    # explode_outer + null filter = explode, minus the inferred
    # size(tokens) > 0 filter, which would tokenise every text twice
    return (df.select(F.col(key), F.explode_outer(token_array(F.col(text), mode)).alias("term"))
            .where(F.col("term").isNotNull()))


def tokens(df: DataFrame, mode: str = "eda", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf) — lower-cased word tokens, counted per row."""
    return occurrences(df, mode, key, text).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def known_tokens(df: DataFrame, vocab: DataFrame, mode: str = "eda", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of E1 with a term of the vocabulary: others are dropped before they are grouped."""
    known = occurrences(df, mode, key, text).join(F.broadcast(vocab.select("term")), "term")
    return known.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_vocabulary(docs: DataFrame, n: int, mode: str = "eda", key: str = "doc_id", text: str = "text") -> DataFrame:
    """E2 from the texts: terms are counted without their documents."""
    return vocabulary(occurrences(docs, mode, key, text).withColumn("tf", F.lit(1)), n)


def vocabulary(tok: DataFrame, n: int) -> DataFrame:
    """The n terms with the highest corpus count, ties by term."""
    w = Window.orderBy(F.col("count").desc(), F.col("term").asc())
    top = (tok.groupBy("term").agg(F.sum("tf").alias("count"))
           .orderBy(F.col("count").desc(), F.col("term").asc()).limit(n))
    # n rows after the top-n: numbering them needs no shuffle of the corpus
    return top.withColumn("rank", F.row_number().over(w))


def fit_idf(tok: DataFrame, vocab: DataFrame, n_docs) -> DataFrame:
    """Smoothed idf over the vocabulary: ln((1+n)/(1+df)) + 1."""
    dfreq = (tok.join(F.broadcast(vocab.select("term")), "term")
             .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    return (F.broadcast(vocab.select("term", "rank")).join(dfreq, "term", "left")
            .select("term", "rank", F.coalesce("df", F.lit(0)).alias("df"),
                    (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.coalesce("df", F.lit(0)))) + F.lit(1.0)).alias("idf")))


def tfidf(tok: DataFrame, idf: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tf × idf over the vocabulary (terms outside it are dropped)."""
    return (tok.join(F.broadcast(idf.select("term", "idf")), "term")
            .select(key, "term", (F.col("tf") * F.col("idf")).alias("weight")))


def l2_normalize(weights: DataFrame, key: str = "doc_id", col: str = "weight") -> DataFrame:
    """Scale each row's weights to unit length."""
    norm = F.sqrt(F.sum(F.col(col) * F.col(col)).over(Window.partitionBy(key)))
    return weights.withColumn(col, F.col(col) / norm)


def fit_transform(docs: DataFrame, mode: str, n: int, key: str = "doc_id", text: str = "text"):
    """Fit vocabulary + idf on `docs` and return (normalised weights, idf)."""
    tok, idf = fit_counts(docs, mode, n, key, text)
    return l2_normalize(tfidf(tok, idf, key), key), idf


def fit_counts(docs: DataFrame, mode: str, n: int, key: str = "doc_id", text: str = "text"):
    """(term frequencies over the vocabulary, idf) of `docs`; both are kept, for they are read several times."""
    vocab = corpus_vocabulary(docs, n, mode, key, text).persist()
    tok = known_tokens(docs, vocab, mode, key, text).persist()
    n_docs = docs.groupBy().agg(F.count(F.lit(1))).scalar().cast("double")
    return tok, fit_idf(tok, vocab, n_docs).persist()


def transform(docs: DataFrame, idf: DataFrame, mode: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """E5: apply a fitted vocabulary/idf to other rows; unseen terms drop out."""
    return l2_normalize(tfidf(known_tokens(docs, idf, mode, key, text), idf, key), key)


def unseen_report(docs: DataFrame, idf: DataFrame, mode: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """E5: per row, vocabulary terms kept and unseen terms dropped."""
    tok = tokens(docs, mode, key, text)
    flagged = tok.join(F.broadcast(idf.select("term", F.lit(True).alias("known"))), "term", "left")
    return flagged.groupBy(key).agg(
        F.sum(F.col("known").isNotNull().cast("long")).alias("kept_terms"),
        F.sum(F.col("known").isNull().cast("long")).alias("unseen_terms"),
        F.sum(F.when(F.col("known").isNull(), F.col("tf")).otherwise(0)).cast("long").alias("unseen_occurrences"))


def assemble_long(weights: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Append num_tokens and num_lines as two pseudo-terms."""
    extra = docs.select(key, F.explode_outer(F.array(
        F.struct(F.lit(NUM_TERMS[0]).alias("term"), B.num_tokens(F.col(text)).cast("double").alias("weight")),
        F.struct(F.lit(NUM_TERMS[1]).alias("term"), B.num_lines(F.col(text)).cast("double").alias("weight")),
    )).alias("x")).select(key, "x.term", "x.weight")
    return weights.unionByName(extra)


def dense_features(long: DataFrame, idf: DataFrame, key: str = "doc_id") -> DataFrame:
    """Long weights → one dense array per row indexed by vocabulary rank
    (size = vocabulary size, a fixed bound)."""
    size = idf.groupBy().agg(F.count(F.lit(1))).scalar()
    ranked = long.join(F.broadcast(idf.select("term", "rank")), "term")
    per = (ranked.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("rank"), F.col("weight")))).alias("m"))
           .withColumn("size", size.cast("int")))
    arr = F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    return per.select(key, arr.alias("features"))


def pca_2d(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = D.EDA_MAX_FEATURES,
           k: int = 2) -> DataFrame:
    """Centred PCA of the TF-IDF rows (StandardScaler withMean, then
    MLlib PCA).  MLlib gathers a (vocab × vocab) covariance on the driver;
    the vocabulary is capped at n, so that matrix is n² doubles."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    weights, idf = fit_transform(docs, "eda", n, key, text)
    dense = dense_features(weights, idf, key)
    # rows without any vocabulary term are all-zero rows
    allrows = docs.select(key).join(dense, key, "left").select(
        key, F.coalesce("features", F.array_repeat(F.lit(0.0), idf.groupBy().agg(F.count(F.lit(1))).scalar().cast("int"))).alias("features"))
    # three MLlib passes read this input: keep it materialised once
    vec = allrows.select(key, array_to_vector("features").alias("v")).persist()
    scaled = StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c").fit(vec).transform(vec)
    model = PCA(k=k, inputCol="c", outputCol="p").fit(scaled)
    # fix the arbitrary sign: largest-magnitude loading of each component positive
    pc = model.pc.toArray()
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    ratio = [float(x) for x in model.explainedVariance.toArray()]
    out = model.transform(scaled).select(key, vector_to_array("p").alias("p"))
    cols = [(F.col("p")[j] * F.lit(signs[j])).alias(f"pc{j + 1}") for j in range(k)]
    cols += [F.lit(ratio[j]).alias(f"var_ratio{j + 1}") for j in range(k)]
    return out.select(key, *cols)


def encode_sequences(docs: DataFrame, vocab: DataFrame, mode: str = "bench", n: int = D.SEQ_LEN,
                     key: str = "doc_id", text: str = "text", label=None) -> DataFrame:
    """Word tokens → vocabulary ids (0 pad, 1 unknown, 2.. by rank),
    truncated / padded to n, with the attention mask.  The whole text is
    tokenised; the first n positions are kept (the encoder's max length)."""
    lab = F.lit(None) if label is None else label
    seq = docs.select(key, lab.alias("labels"), F.slice(token_array(F.col(text), mode), 1, n).alias("toks"))
    ex = seq.select(key, "labels", F.posexplode_outer("toks").alias("pos", "term"))
    ids = F.broadcast(vocab.select("term", (F.col("rank") + 1).cast("int").alias("tid")))
    j = ex.join(ids, "term", "left").select(
        key, "labels", F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("tid", F.lit(1)).alias("tid"))).alias("e"))
    # the label rides along: no second scan and join for it
    g = j.groupBy(key).agg(F.sort_array(F.collect_list("e")).alias("es"), F.first("labels").alias("labels"))
    got = F.transform("es", lambda e: e["tid"])
    pad = F.lit(n) - F.size("es")
    out = g.select(key,
                   F.concat(got, F.array_repeat(F.lit(0), pad)).alias("input_ids"),
                   F.concat(F.array_repeat(F.lit(1), F.size("es")), F.array_repeat(F.lit(0), pad)).alias("attention_mask"), "labels")
    return out if label is not None else out.drop("labels")


def lang_label(lang):
    expr = None
    for i, l in enumerate(LANGS):
        expr = F.when(lang == l, F.lit(i)) if expr is None else expr.when(lang == l, F.lit(i))
    return expr


# --------------------------------- SQL -------------------------------------

def _sql_tokens(mode: str, src: str = "documents", where: str = "") -> str:
    return (f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), "
            f"{sql_str(B.WORD_RX[mode])})) AS term FROM {src} {where}) t GROUP BY 1, 2")


def _sql_vocab(tok: str, n: int) -> str:
    return (f"SELECT term, count, CAST(row_number() OVER (ORDER BY count DESC, term ASC) AS INTEGER) AS rank FROM "
            f"(SELECT term, CAST(sum(tf) AS BIGINT) AS count FROM {tok} GROUP BY 1 ORDER BY count DESC, term ASC LIMIT {n}) v")


def _sql_fit(mode: str, n: int, where: str = "") -> list[tuple[str, str]]:
    return [
        ("tok", _sql_tokens(mode, "documents", where)),
        ("vocab", _sql_vocab("tok", n)),
        ("ndocs", f"SELECT CAST(count(*) AS DOUBLE) AS n FROM documents {where}"),
        ("idf", "SELECT v.term, v.rank, coalesce(d.df, 0) AS df, ln((1.0 + (SELECT n FROM ndocs)) / (1.0 + coalesce(d.df, 0))) + 1.0 AS idf "
                "FROM vocab v LEFT JOIN (SELECT term, count(*) AS df FROM tok WHERE term IN (SELECT term FROM vocab) GROUP BY 1) d USING (term)"),
        ("w", "SELECT t.doc_id, t.term, t.tf * i.idf AS weight FROM tok t JOIN idf i USING (term)"),
        ("wn", "SELECT doc_id, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS weight FROM w"),
    ]


def _with(ctes) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({b})" for n, b in ctes) + "\n"


# -------------------------------- queries ----------------------------------

def _docs(spark, sf):
    return V.table(spark, sf, "documents")


@register("tokens", lambda: _sql_tokens("eda"))
def q_tokens(spark, sf):
    return tokens(spread(_docs(spark, sf).select("doc_id", "text")), "eda")


@register("tokens_bench", lambda: _sql_tokens("bench"))
def q_tokens_bench(spark, sf):
    return tokens(spread(_docs(spark, sf).select("doc_id", "text")), "bench")


@register("vocabulary", lambda: _with([("tok", _sql_tokens("eda"))]) + _sql_vocab("tok", D.EDA_MAX_FEATURES))
def q_vocabulary(spark, sf):
    return corpus_vocabulary(_docs(spark, sf), D.EDA_MAX_FEATURES)


def _fit_spark(spark, sf, mode, n):
    docs = _docs(spark, sf).select("doc_id", "text")
    return docs, *fit_counts(docs, mode, n)


@register("tfidf", lambda: _with(_sql_fit("eda", D.EDA_MAX_FEATURES)) +
          f"SELECT doc_id, term, {B.sql_round_half_even('weight', 6)} AS weight FROM w")
def q_tfidf(spark, sf):
    _, tok, idf = _fit_spark(spark, sf, "eda", D.EDA_MAX_FEATURES)
    return tfidf(tok, idf).withColumn("weight", B.round_half_even(F.col("weight"), 6))


@register("l2_normalize", lambda: _with(_sql_fit("eda", D.EDA_MAX_FEATURES)) +
          f"SELECT doc_id, term, {B.sql_round_half_even('weight', 6)} AS weight FROM wn")
def q_l2_normalize(spark, sf):
    _, tok, idf = _fit_spark(spark, sf, "eda", D.EDA_MAX_FEATURES)
    return l2_normalize(tfidf(tok, idf)).withColumn("weight", B.round_half_even(F.col("weight"), 6))


# Held-out rows: the first stratified fold (F1) by language, the rest train,
# as the studied benchmark transforms each CV fold with the vocabulary
# fitted on the other folds.
HELD_FOLD = 1
_TRAIN = f"WHERE doc_id IN (SELECT doc_id FROM hfold WHERE fold <> {HELD_FOLD})"
_HELD = f"WHERE doc_id IN (SELECT doc_id FROM hfold WHERE fold = {HELD_FOLD})"


def _sql_folds() -> tuple[str, str]:
    return ("hfold", f"SELECT doc_id, CAST((class_rank - 1) % {EV.K_FOLDS} + 1 AS INTEGER) AS fold FROM "
                     f"({EV._sql_class_rank('(SELECT doc_id, lang FROM documents) d', 'lang', 'doc_id')}) r")


def _heldout_ctes():
    ctes = [_sql_folds()] + _sql_fit("bench", D.BENCH_MAX_FEATURES, _TRAIN)
    ctes += [("htok", _sql_tokens("bench", "documents", _HELD)),
             ("hw", "SELECT t.doc_id, t.term, t.tf * i.idf AS weight FROM htok t JOIN idf i USING (term)"),
             ("hwn", "SELECT doc_id, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS weight FROM hw")]
    return ctes


def _split_spark(spark, sf):
    """(train, held) documents: held = stratified fold HELD_FOLD.  The folds
    are computed on the short (doc_id, lang) rows and applied to the texts
    with semi / anti joins on the key."""
    docs = _docs(spark, sf)
    held_ids = (EV.stratified_folds(docs.select("doc_id", "lang"), "lang", "doc_id")
                .where(F.col("fold") == HELD_FOLD).select("doc_id"))
    texts = docs.select("doc_id", "text")
    return texts.join(held_ids, "doc_id", "left_anti"), texts.join(held_ids, "doc_id", "left_semi")


def _heldout_spark(spark, sf):
    train, held = _split_spark(spark, sf)
    _, idf = fit_transform(train, "bench", D.BENCH_MAX_FEATURES)
    return held, idf


@register("transform_heldout", lambda: _with(_heldout_ctes()) +
          f"SELECT doc_id, term, {B.sql_round_half_even('weight', 6)} AS weight FROM hwn")
def q_transform_heldout(spark, sf):
    held, idf = _heldout_spark(spark, sf)
    return transform(held, idf, "bench").withColumn("weight", B.round_half_even(F.col("weight"), 6))


@register("heldout_unseen", lambda: _with(_heldout_ctes()) +
          "SELECT doc_id, CAST(sum(CASE WHEN i.term IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS kept_terms, "
          "CAST(sum(CASE WHEN i.term IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unseen_terms, "
          "CAST(sum(CASE WHEN i.term IS NULL THEN tf ELSE 0 END) AS BIGINT) AS unseen_occurrences "
          "FROM htok t LEFT JOIN idf i USING (term) GROUP BY doc_id")
def q_heldout_unseen(spark, sf):
    held, idf = _heldout_spark(spark, sf)
    return unseen_report(held, idf, "bench")


@register("assemble", lambda: _with(_sql_fit("bench", D.BENCH_MAX_FEATURES)) +
          f"SELECT doc_id, term, {B.sql_round_half_even('weight', 6)} AS weight FROM ("
          "SELECT doc_id, term, weight FROM wn UNION ALL "
          f"SELECT doc_id, '{NUM_TERMS[0]}', CAST({B.sql_num_tokens('text')} AS DOUBLE) FROM documents UNION ALL "
          f"SELECT doc_id, '{NUM_TERMS[1]}', CAST({B.sql_num_lines('text')} AS DOUBLE) FROM documents) a")
def q_assemble(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "text")
    w, _ = fit_transform(docs, "bench", D.BENCH_MAX_FEATURES)
    return assemble_long(w, docs).withColumn("weight", B.round_half_even(F.col("weight"), 6))


def _sql_shape(split: str, where: str, fit_where: str) -> str:
    return (f"SELECT '{split}' AS split, (SELECT count(*) FROM documents {where}) AS n_rows, "
            f"CAST((SELECT count(*) FROM vocab) + 2 AS INTEGER) AS n_cols, "
            f"(SELECT count(*) FROM (SELECT doc_id FROM {'hwn' if split == 'valid' else 'wn'} WHERE weight <> 0 UNION ALL "
            f"SELECT doc_id FROM documents {where} {'AND' if where else 'WHERE'} {B.sql_num_tokens('text')} <> 0 UNION ALL "
            f"SELECT doc_id FROM documents {where} {'AND' if where else 'WHERE'} {B.sql_num_lines('text')} <> 0) z) AS nnz")


@register("matrix_shape", lambda: _with(_heldout_ctes()) +
          "SELECT split, n_rows, n_cols, nnz, " + B.sql_round_half_even("nnz / (n_rows * n_cols)", 6) + " AS density FROM (" +
          _sql_shape("train", _TRAIN, _TRAIN) + " UNION ALL " + _sql_shape("valid", _HELD, _TRAIN) + ") s")
def q_matrix_shape(spark, sf):
    train, held = _split_spark(spark, sf)
    wt, idf = fit_transform(train, "bench", D.BENCH_MAX_FEATURES)
    wv = transform(held, idf, "bench")
    n_cols = idf.groupBy().agg(F.count(F.lit(1))).scalar().cast("int") + F.lit(2)
    parts = []
    for name, w, d in (("train", wt, train), ("valid", wv, held)):
        long = assemble_long(w, d)
        nnz = long.where(F.col("weight") != 0).groupBy().agg(F.count(F.lit(1))).scalar()
        parts.append(d.groupBy().agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("split"), "n_rows", n_cols.alias("n_cols"), nnz.alias("nnz")))
    out = parts[0].unionByName(parts[1])
    return out.withColumn("density", B.round_half_even(F.col("nnz") / (F.col("n_rows") * F.col("n_cols")), 6))


@register("pca_2d")
def q_pca_2d(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "text", "lang")
    p = pca_2d(spark, docs.select("doc_id", "text"))
    return p.join(docs.select("doc_id", "lang"), "doc_id")


def _sql_encode() -> str:
    ctes = [("tok", _sql_tokens("bench")), ("vocab", _sql_vocab("tok", D.BENCH_MAX_FEATURES)),
            ("seq", f"SELECT doc_id, regexp_extract_all(lower(text), {sql_str(B.WORD_RX['bench'])})[1:{D.SEQ_LEN}] AS toks FROM documents"),
            ("ex", "SELECT doc_id, unnest(generate_series(0, len(toks) - 1)) AS pos, unnest(toks) AS term FROM seq"),
            ("enc", "SELECT ex.doc_id, list(CAST(coalesce(v.rank + 1, 1) AS INTEGER) ORDER BY ex.pos) AS ids "
                    "FROM ex LEFT JOIN vocab v USING (term) GROUP BY ex.doc_id")]
    lab = "CASE " + " ".join(f"WHEN d.lang = '{l}' THEN {i}" for i, l in enumerate(LANGS)) + " END"
    return (_with(ctes) +
            f"SELECT d.doc_id, list_resize(coalesce(e.ids, CAST([] AS INTEGER[])), {D.SEQ_LEN}, 0) AS input_ids, "
            f"list_resize(list_transform(coalesce(e.ids, CAST([] AS INTEGER[])), lambda x: 1), {D.SEQ_LEN}, 0) AS attention_mask, "
            f"CAST({lab} AS INTEGER) AS labels FROM documents d LEFT JOIN enc e USING (doc_id)")


@register("encode_sequences", _sql_encode)
def q_encode_sequences(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "text", "lang")
    vocab = corpus_vocabulary(docs, D.BENCH_MAX_FEATURES, "bench")
    return encode_sequences(docs, vocab, "bench", D.SEQ_LEN, label=lang_label(F.col("lang")))
