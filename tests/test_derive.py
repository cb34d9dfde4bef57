from pyspark.sql import functions as F

from vulnlake.functions import derive as B
from vulnlake.plans import domains as D
from vulnlake.sources import views as V


def test_cwe_and_source_extraction(spark):
    df = spark.createDataFrame([("CWE-089_codeql_1.py",), ("doc_37.txt",), (None,), ("CWE-79_seed-corpus_9.py",)], "id string")
    rows = df.select(B.extract_cwe(F.col("id")).alias("c"), B.extract_source(F.col("id")).alias("s"),
                     V.normalize_source(B.extract_source(F.col("id"))).alias("n")).collect()
    assert [tuple(r) for r in rows] == [("CWE-089", "codeql", "CodeQL"), (None, None, None), (None, None, None),
                                         ("CWE-79", "seed-corpus", "Seed-Corpus")]


def test_title_case_like_python(spark):
    words = ["ab-cd ef", "x1y", "MIXED_case", "seed-corpus", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r.t for r in df.select(B.title_case(F.col("w")).alias("t")).collect()]
    assert got == [w.title() for w in words]


def test_category_map(spark):
    df = spark.createDataFrame([("CWE-089",), ("CWE-798",), ("CWE-327",), ("CWE-020",), (None,)], "c string")
    got = [r.k for r in df.select(B.map_category(F.col("c")).alias("k")).collect()]
    assert got == ["sql_injection", "hardcoded_secret", "weak_crypto", "other_vuln", "other_vuln"]


def test_token_and_line_counts_like_python(spark):
    texts = ["", "   ", "a b", "  a\tb\nc  ", "x y z", "one\n\ntwo\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(B.num_tokens(F.col("t")).alias("n"), B.num_lines(F.col("t")).alias("l")).collect()
    assert [r.n for r in rows] == [len(t.split()) for t in texts]
    assert [r.l for r in rows] == [t.count("\n") + 1 for t in texts]


def test_preview_and_pct(spark):
    code = "line one\nline two " + "x" * 80
    df = spark.createDataFrame([(code, 0.865), (code, 0.875)], "c string, p double")
    rows = df.select(B.preview(F.col("c")).alias("v"), B.format_pct(F.col("p")).alias("f")).collect()
    assert rows[0].v == code[:56].replace("\n", " ")
    assert [r.f for r in rows] == ["87%", "88%"]


def test_confidence_ranges(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("id"))
    v = df.select(B.confidence(F.col("id"), F.lit("safe")).alias("s"), B.confidence(F.col("id"), F.lit("weak_crypto")).alias("h"))
    r = v.agg(F.min("s"), F.max("s"), F.min("h"), F.max("h")).collect()[0]
    assert (r[0], r[1], r[2], r[3]) == (0.88, 0.97, 0.72, 0.96)


def test_snippets_view_shape(spark):
    from tests.conftest import SF_SMALL
    sn = V.snippets(spark, SF_SMALL)
    assert sn.columns == ["doc_id", "id", "prompt", "insecure_code", "lang"]
    bad = sn.where(F.col("doc_id") % D.MALFORMED_EVERY == 0).select("id").collect()
    assert all(r.id.startswith("doc_") for r in bad)


def test_mean_std_like_python_format(spark):
    """'m ± s' as Python's f"{m:.3f} ± {s:.3f}" prints it (half-even on
    exact binary halves such as 0.0625 and 0.125)."""
    pairs = [(0.0625, 0.125), (0.5834, 0.0414), (1.0, 0.0), (0.8745, 0.0005)]
    df = spark.createDataFrame(pairs, "m double, s double")
    got = [r.t for r in df.select(B.format_mean_std(F.col("m"), F.col("s")).alias("t")).collect()]
    assert got == [f"{m:.3f} ± {s:.3f}" for m, s in pairs]


def test_round_like_format_property(spark):
    """Against Python's own formatting on random doubles and on values
    whose scaled product lands on an exact half."""
    import random
    rng = random.Random(3)
    vals = [rng.random() for _ in range(3000)] + [k / 1000 + 0.0005 for k in range(1000)] + [k / 16 for k in range(32)]
    vals += [-v for v in vals[:500]]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.t for r in df.select(F.format_string("%.3f", B.round_like_format(F.col("x"), 3)).alias("t")).collect()]
    want = [f"{v:.3f}" for v in vals]
    bad = [(v, g, w) for v, g, w in zip(vals, got, want) if g != w and not (w == "-0.000" and g == "0.000")]
    assert not bad, bad[:5]


def test_token_count_like_python_split_random(spark):
    """Random texts over letters and every white-space kind Python splits on."""
    import random
    rng = random.Random(9)
    alphabet = ["a", "b", "é", "漢", "_", "-", " ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85",
                "\xa0", " ", " ", " ", " ", " ", " ", " ", "　", "​"]
    texts = ["", " ", "  ", "a", " a", "a ", "　a　"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(len(texts), None)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", B.num_tokens(F.col("t")).alias("n")).collect()}
    assert [got[i] for i in range(len(texts))] == [len(t.split()) for t in texts]
    assert got[len(texts)] is None
