"""Corpus scan, audits, sinks and browsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake.functions import derive as B
from vulnlake.functions.rules import sql_str
from vulnlake.plans.registry import register
from vulnlake.session import path_exists, shared_path, written
from vulnlake.sources import views as V

# Expected input schemas (FIXTURES.md §2), in DuckDB type names.
EXPECTED_SCHEMAS = {
    "documents": [("doc_id", "BIGINT"), ("text", "VARCHAR"), ("lang", "VARCHAR"), ("source", "VARCHAR"), ("n_chars", "BIGINT")],
    "events": [("event_id", "BIGINT"), ("ts", "TIMESTAMP"), ("user_id", "BIGINT"), ("event_type", "VARCHAR"),
               ("value", "DOUBLE"), ("props", "VARCHAR")],
    "embeddings": [("vec_id", "BIGINT"), ("embedding", "FLOAT[]"), ("label", "INTEGER")],
    "labels": [("doc_id", "BIGINT"), ("quality", "INTEGER"), ("toxic", "INTEGER")],
    "customer": [("c_custkey", "BIGINT"), ("c_name", "VARCHAR"), ("c_nationkey", "INTEGER"), ("c_acctbal", "DOUBLE"),
                 ("c_mktsegment", "VARCHAR")],
    "conversations": [("conv_id", "BIGINT"), ("turn", "BIGINT"), ("role", "VARCHAR"), ("text", "VARCHAR")],
    "pages": [("page_id", "BIGINT"), ("url", "VARCHAR"), ("html", "VARCHAR")],
    "benchmark": [("item_id", "BIGINT"), ("text", "VARCHAR")],
    "region": [("r_regionkey", "INTEGER"), ("r_name", "VARCHAR")],
    "nation": [("n_nationkey", "INTEGER"), ("n_name", "VARCHAR"), ("n_regionkey", "INTEGER")],
    "supplier": [("s_suppkey", "BIGINT"), ("s_name", "VARCHAR"), ("s_nationkey", "INTEGER"), ("s_acctbal", "DOUBLE")],
    "part": [("p_partkey", "BIGINT"), ("p_name", "VARCHAR"), ("p_brand", "VARCHAR"), ("p_type", "VARCHAR"), ("p_size", "INTEGER"),
             ("p_retailprice", "DOUBLE")],
    "orders": [("o_orderkey", "BIGINT"), ("o_custkey", "BIGINT"), ("o_orderstatus", "VARCHAR"), ("o_totalprice", "DOUBLE"),
               ("o_orderdate", "TIMESTAMP"), ("o_orderpriority", "VARCHAR")],
    "lineitem": [("l_orderkey", "BIGINT"), ("l_partkey", "BIGINT"), ("l_suppkey", "BIGINT"), ("l_linenumber", "INTEGER"),
                 ("l_quantity", "DOUBLE"), ("l_extendedprice", "DOUBLE"), ("l_discount", "DOUBLE"), ("l_tax", "DOUBLE"),
                 ("l_returnflag", "VARCHAR"), ("l_linestatus", "VARCHAR"), ("l_shipdate", "TIMESTAMP")],
}

_TYPE_NAMES = {
    T.LongType: "BIGINT", T.StringType: "VARCHAR", T.DoubleType: "DOUBLE", T.TimestampNTZType: "TIMESTAMP",
    T.TimestampType: "TIMESTAMP WITH TIME ZONE", T.IntegerType: "INTEGER", T.FloatType: "FLOAT",
    T.ShortType: "SMALLINT", T.BooleanType: "BOOLEAN", T.DateType: "DATE",
}


def type_name(dt: T.DataType) -> str:
    if isinstance(dt, T.ArrayType):
        return type_name(dt.elementType) + "[]"
    return _TYPE_NAMES.get(type(dt), dt.simpleString().upper())


def scan_corpus(df: DataFrame) -> DataFrame:
    """A1: the corpus under the names id, prompt, insecure_code."""
    return df.select("id", "prompt", "insecure_code")


def audit_schema(spark: SparkSession, tables: dict[str, DataFrame], expected: dict) -> DataFrame:
    """A2: one row per field with status ok / type_mismatch / missing / extra,
    beside the row count of its table.  Schemas are metadata; the row
    counts are distributed aggregates."""
    rows = []
    for name, df in tables.items():
        actual = {f.name: type_name(f.dataType) for f in df.schema.fields}
        exp = dict(expected.get(name, []))
        for col in list(exp) + [c for c in actual if c not in exp]:
            e, a = exp.get(col), actual.get(col)
            status = "missing" if a is None else "extra" if e is None else "ok" if e == a else "type_mismatch"
            rows.append((name, col, e, a, status))
    meta = spark.createDataFrame(rows, "table_name string, column_name string, expected_type string, actual_type string, status string")
    counts = None
    for name, df in tables.items():
        c = df.groupBy().agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table_name", F.lit(name))
        counts = c if counts is None else counts.unionByName(c)
    return meta.join(F.broadcast(counts), "table_name")


def audit_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A3: repeated keys (by id and by content hash) with their counts."""
    by_id = (df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("copies"))
             .where(F.col("copies") > 1).withColumn("key_kind", F.lit(key)))
    by_hash = (df.groupBy(F.md5(F.col(text)).alias("key")).agg(F.count(F.lit(1)).alias("copies"))
               .where(F.col("copies") > 1).withColumn("key_kind", F.lit("md5_" + text)))
    return by_id.unionByName(by_hash)


def audit_missing(df: DataFrame, table_name: str) -> DataFrame:
    """A4: per field nulls, empty strings and null share, in one pass."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for f in df.schema.fields:
        aggs.append(F.sum(F.col(f.name).isNull().cast("long")).alias(f"null__{f.name}"))
        if isinstance(f.dataType, T.StringType):
            aggs.append(F.sum((F.col(f.name) == "").cast("long")).alias(f"empty__{f.name}"))
        else:
            aggs.append(F.lit(0).cast("long").alias(f"empty__{f.name}"))
    one = df.agg(*aggs)
    n = len(df.schema.fields)
    stack_args = ", ".join(f"'{f.name}', `null__{f.name}`, `empty__{f.name}`" for f in df.schema.fields)
    long = one.select("n_rows", F.expr(f"stack({n}, {stack_args}) AS (column_name, n_null, n_empty)"))
    return long.select(F.lit(table_name).alias("table_name"), "column_name", "n_rows",
                       F.coalesce("n_null", F.lit(0)).alias("n_null"), F.coalesce("n_empty", F.lit(0)).alias("n_empty"),
                       B.round_half_even(F.coalesce("n_null", F.lit(0)) / F.col("n_rows"), 6).alias("null_share"))


def audit_id_format(df: DataFrame) -> DataFrame:
    """A5: ids that break {CWE-ID}_{Source}_{Serial}.py."""
    return df.where(~F.col("id").rlike(B.ID_FORMAT_RX) | F.col("id").isNull()).select("doc_id", "id")


def export_clean(df: DataFrame, path: str, partition: str = "category") -> DataFrame:
    """Write the analysis-ready table partitioned by class, read it back
    (a filter on the partition column prunes directories)."""
    df.write.mode("overwrite").partitionBy(partition).parquet(path)
    return df.sparkSession.read.parquet(path)


def explore(df: DataFrame, filters: dict, after_id: str = "", n: int = 20) -> DataFrame:
    """Filtered, key-ordered page after a key (keyset pagination)."""
    cond = F.col("id") > F.lit(after_id)
    for k, v in filters.items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.where(cond).orderBy("id").limit(n)


def profile_frame(df: DataFrame, key: str = "id", k: int = 3) -> DataFrame:
    """Row count, column count and the first k rows by key."""
    from pyspark.sql.window import Window
    n_cols = len(df.columns)
    head = df.orderBy(key).limit(k)
    # k rows: the numbering window is over k rows only
    head = head.withColumn("rank", F.row_number().over(Window.orderBy(key)))
    n_rows = df.groupBy().agg(F.count(F.lit(1))).scalar()  # scalar subquery
    return head.withColumns({"n_rows": n_rows, "n_cols": F.lit(n_cols)})


def store_analyses(df: DataFrame, path: str, key: str = "analysis_id") -> DataFrame:
    """Append results not yet stored, so a replayed batch is written once;
    partitioned by day.

    The key alone tells results apart: one delivered again, in the batch or
    later and also under another day, is not stored again, and of repeats in
    a batch the earliest stays.  Of the stored table only keys between the
    least and the greatest of the batch are read: files are sorted by key, so
    the scan skips the others by their statistics, and with keys that grow
    in time an append reads no more as the store grows.  A failed read fails
    the call; it is not taken for an empty store."""
    spark = df.sparkSession
    others = [c for c in df.columns if c not in (key, "ts")]
    once = df.groupBy(key).agg(F.min(F.struct("ts", *others)).alias("first")).select(key, "first.*")
    # read for its bounds and again for its rows
    new = written(spark, once.select(*df.columns).withColumn("day", F.to_date("ts")), "store-batch")
    if path_exists(spark, path):
        new = new.join(stored_between(spark, new, path, key), key, "left_anti")
    new.sortWithinPartitions("day", key).write.mode("append").partitionBy("day").parquet(path)
    return spark.read.parquet(path)


def stored_between(spark: SparkSession, batch: DataFrame, path: str, key: str) -> DataFrame:
    """The stored keys from the least to the greatest key of a batch."""
    low, high = batch.agg(F.min(key), F.max(key)).first()
    return spark.read.parquet(path).select(key).where(F.col(key).between(F.lit(low), F.lit(high)))


# -------------------------------- queries ----------------------------------

@register("scan_corpus", lambda: V.with_views("snippets") + "SELECT id, prompt, insecure_code FROM snippets")
def q_scan_corpus(spark, sf):
    return scan_corpus(V.snippets(spark, sf))


def _sql_audit_schema():
    exp_rows = ", ".join(f"({sql_str(t)}, {sql_str(c)}, {sql_str(ty)})"
                         for t, cols in EXPECTED_SCHEMAS.items() for c, ty in cols)
    names = ", ".join(sql_str(t) for t in EXPECTED_SCHEMAS)
    counts = " UNION ALL ".join(f"SELECT {sql_str(t)} AS t, count(*) AS n FROM {t}" for t in EXPECTED_SCHEMAS)
    return (f"WITH e AS (SELECT * FROM (VALUES {exp_rows}) v(table_name, column_name, expected_type)), "
            f"a AS (SELECT table_name, column_name, data_type FROM information_schema.columns WHERE table_name IN ({names})), "
            f"c AS ({counts}) "
            "SELECT coalesce(e.table_name, a.table_name) AS table_name, coalesce(e.column_name, a.column_name) AS column_name, "
            "e.expected_type, a.data_type AS actual_type, CASE WHEN a.column_name IS NULL THEN 'missing' "
            "WHEN e.column_name IS NULL THEN 'extra' WHEN e.expected_type = a.data_type THEN 'ok' ELSE 'type_mismatch' END AS status, "
            "c.n AS n_rows FROM e FULL OUTER JOIN a ON e.table_name = a.table_name AND e.column_name = a.column_name "
            "JOIN c ON c.t = coalesce(e.table_name, a.table_name)")


@register("audit_schema", _sql_audit_schema)
def q_audit_schema(spark, sf):
    tables = {t: V.table(spark, sf, t) for t in EXPECTED_SCHEMAS}
    return audit_schema(spark, tables, EXPECTED_SCHEMAS)


@register("audit_duplicates", lambda:
          "SELECT CAST(doc_id AS VARCHAR) AS key, count(*) AS copies, 'doc_id' AS key_kind FROM documents GROUP BY 1 HAVING count(*) > 1 "
          "UNION ALL SELECT md5(text), count(*), 'md5_text' FROM documents GROUP BY 1 HAVING count(*) > 1")
def q_audit_duplicates(spark, sf):
    return audit_duplicates(V.table(spark, sf, "documents"))


def _sql_missing(table: str) -> str:
    cols = [c for c, _ in EXPECTED_SCHEMAS[table]]
    strs = {c for c, ty in EXPECTED_SCHEMAS[table] if ty == "VARCHAR"}
    parts = []
    for c in cols:
        empty = f"count(*) FILTER (WHERE {c} = '')" if c in strs else "0"
        parts.append(f"SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, "
                     f"count(*) FILTER (WHERE {c} IS NULL) AS n_null, CAST({empty} AS BIGINT) AS n_empty, "
                     f"{B.sql_round_half_even(f'count(*) FILTER (WHERE {c} IS NULL) / count(*)', 6)} AS null_share FROM {table}")
    return " UNION ALL ".join(parts)


@register("audit_missing", lambda: _sql_missing("documents") + " UNION ALL " + _sql_missing("events"))
def q_audit_missing(spark, sf):
    return (audit_missing(V.table(spark, sf, "documents"), "documents")
            .unionByName(audit_missing(V.table(spark, sf, "events"), "events")))


@register("audit_id_format", lambda: V.with_views("snippets") +
          f"SELECT doc_id, id FROM snippets WHERE id IS NULL OR NOT regexp_matches(id, {sql_str(B.ID_FORMAT_RX)})")
def q_audit_id_format(spark, sf):
    return audit_id_format(V.snippets(spark, sf))


_EXPORT_COLS = ["id", "cwe", "source", "category", "num_tokens", "num_lines", "lang"]


@register("export_clean", lambda: V.with_views("enriched") + f"SELECT {', '.join(_EXPORT_COLS)} FROM enriched")
def q_export_clean(spark, sf):
    df = V.enriched_snippets(spark, sf).select(*_EXPORT_COLS)
    return export_clean(df, shared_path(spark, "export_clean")).select(*_EXPORT_COLS)


@register("explore_examples", lambda: V.with_views("enriched") +
          "SELECT id, cwe, source, category, prompt FROM enriched WHERE id > '' AND category = 'sql_injection' "
          "AND source = 'CodeQL' ORDER BY id LIMIT 20")
def q_explore_examples(spark, sf):
    df = V.enriched_snippets(spark, sf).select("id", "cwe", "source", "category", "prompt")
    return explore(df, {"category": "sql_injection", "source": "CodeQL"}, "", 20)


@register("profile_frame", lambda: V.with_views("enriched") +
          "SELECT id, prompt, CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS rank, "
          "(SELECT count(*) FROM enriched) AS n_rows, 12 AS n_cols FROM (SELECT id, prompt FROM enriched ORDER BY id LIMIT 3) h")
def q_profile_frame(spark, sf):
    df = V.enriched_snippets(spark, sf)
    out = profile_frame(df, "id", 3)
    return out.select("id", "prompt", "rank", "n_rows", "n_cols")


_STORE_COLS = ["analysis_id", "ts", "user_id", "snippet_hash", "verdict", "confidence"]


@register("store_analyses", lambda: V.with_views("analyses") + f"SELECT {', '.join(_STORE_COLS)} FROM analyses")
def q_store_analyses(spark, sf):
    path = shared_path(spark, "analyses_store")
    a = V.analyses(spark, sf).select(*_STORE_COLS)
    # first delivery: the first 15 days of analyses; then the whole batch is
    # delivered again (a replay), and only the rows not yet stored are added
    cut = a.agg(F.min("ts") + F.expr("INTERVAL 15 DAYS")).scalar()
    store_analyses(a.where(F.col("ts") < cut), path)
    store_analyses(a, path)
    return spark.read.parquet(path).select(*_STORE_COLS)
