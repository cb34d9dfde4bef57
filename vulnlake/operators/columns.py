"""Derived-column operators (B1-B12), each exposed as its own query over
the snippets view (pure projections: one scan, no shuffle, except the
B7 mean, which is a one-row aggregate)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnlake.functions import derive as B
from vulnlake.operators.evaluation import CLASS_NAMES
from vulnlake.plans import domains as D
from vulnlake.plans.registry import register
from vulnlake.sources import views as V


def _sn(spark, sf):
    return V.snippets(spark, sf)


def _w(*names):
    return V.with_views(*(names or ("snippets",)))


@register("extract_cwe", lambda: _w() + f"SELECT doc_id, id, {B.sql_extract_cwe('id')} AS cwe FROM snippets")
def q_extract_cwe(spark, sf):
    return _sn(spark, sf).select("doc_id", "id", B.extract_cwe(F.col("id")).alias("cwe"))


@register("extract_source", lambda: _w() + f"SELECT doc_id, id, {B.sql_extract_source('id')} AS source_raw FROM snippets")
def q_extract_source(spark, sf):
    return _sn(spark, sf).select("doc_id", "id", B.extract_source(F.col("id")).alias("source_raw"))


@register("normalize_source", lambda: _w() +
          f"SELECT doc_id, source_raw, {V.sql_normalize_source('source_raw')} AS source FROM "
          f"(SELECT doc_id, {B.sql_extract_source('id')} AS source_raw FROM snippets) s")
def q_normalize_source(spark, sf):
    s = _sn(spark, sf).select("doc_id", B.extract_source(F.col("id")).alias("source_raw"))
    return s.withColumn("source", V.normalize_source(F.col("source_raw")))


@register("map_category", lambda: _w() +
          f"SELECT doc_id, cwe, {B.sql_map_category('cwe')} AS category FROM (SELECT doc_id, {B.sql_extract_cwe('id')} AS cwe FROM snippets) s")
def q_map_category(spark, sf):
    s = _sn(spark, sf).select("doc_id", B.extract_cwe(F.col("id")).alias("cwe"))
    return s.withColumn("category", B.map_category(F.col("cwe")))


@register("num_tokens", lambda: f"SELECT doc_id, {B.sql_num_tokens('text')} AS num_tokens FROM documents")
def q_num_tokens(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", B.num_tokens(F.col("text")).alias("num_tokens"))


@register("num_lines", lambda: f"SELECT doc_id, {B.sql_num_lines('text')} AS num_lines FROM documents")
def q_num_lines(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", B.num_lines(F.col("text")).alias("num_lines"))


@register("insecure_flag", lambda: _w() + "SELECT count(*) AS n, avg(1) AS copilot_insecure_mean FROM snippets")
def q_insecure_flag(spark, sf):
    s = _sn(spark, sf).withColumn("copilot_insecure", F.lit(1))
    return s.agg(F.count(F.lit(1)).alias("n"), F.avg("copilot_insecure").alias("copilot_insecure_mean"))


def _sql_label_display(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in D.LABEL_DISPLAY.items()) + " END"


@register("display_label", lambda: _w("enriched") +
          f"SELECT doc_id, category, {B.sql_display_label('category')} AS category_display, "
          f"{_sql_label_display('category')} AS label_display FROM enriched")
def q_display_label(spark, sf):
    """Title-cased label, and the fixed label → display-name map
    (4-row literal dimension, broadcast)."""
    e = V.enriched_snippets(spark, sf).select("doc_id", "category")
    dom = F.broadcast(D.category_dim(spark).select("category", F.col("display").alias("label_display")))
    return (e.withColumn("category_display", B.display_label(F.col("category")))
            .join(dom, "category", "left").select("doc_id", "category", "category_display", "label_display"))


@register("encode_label", lambda: _w("enriched") +
          "SELECT doc_id, category, CAST(CASE " + " ".join(f"WHEN category = '{c}' THEN {i}" for i, c in enumerate(CLASS_NAMES)) +
          " END AS INTEGER) AS label_id, (" + "[" + ", ".join(f"'{c}'" for c in CLASS_NAMES) + "])["
          "CASE " + " ".join(f"WHEN category = '{c}' THEN {i}" for i, c in enumerate(CLASS_NAMES)) +
          " END + 1] AS decoded FROM enriched")
def q_encode_label(spark, sf):
    """Label → id in alphabetical order, and the id back to the label."""
    e = V.enriched_snippets(spark, sf).select("doc_id", "category")
    # the 4-row label domain, broadcast
    dom = F.broadcast(D.category_dim(spark).select("category", "label_id"))
    names = F.array(*[F.lit(c) for c in CLASS_NAMES])
    return (e.join(dom, "category", "left")
            .select("doc_id", "category", "label_id", F.element_at(names, F.col("label_id") + 1).alias("decoded")))


@register("preview", lambda: _w() + f"SELECT doc_id, {B.sql_preview('insecure_code')} AS preview FROM snippets")
def q_preview(spark, sf):
    return _sn(spark, sf).select("doc_id", B.preview(F.col("insecure_code")).alias("preview"))


@register("format_pct", lambda: _w("analyses") +
          f"SELECT analysis_id, confidence, {B.sql_format_pct('confidence')} AS confidence_pct FROM analyses")
def q_format_pct(spark, sf):
    a = V.analyses(spark, sf).select("analysis_id", "confidence")
    return a.withColumn("confidence_pct", B.format_pct(F.col("confidence")))


@register("snippet_hash", lambda: _w() + "SELECT doc_id, sha256(insecure_code) AS snippet_hash FROM snippets")
def q_snippet_hash(spark, sf):
    return _sn(spark, sf).select("doc_id", B.snippet_hash(F.col("insecure_code")).alias("snippet_hash"))
