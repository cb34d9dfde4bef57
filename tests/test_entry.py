"""Driver contract and a DuckDB parity sample at sf0.001."""

import duckdb

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from vulnlake.operators.audit import EXPECTED_SCHEMAS

PARITY_SAMPLE = ["verdict_component", "risk_legend", "feature_stats", "tfidf", "roc_auc_ovr", "cache_hit_rate",
                 "stratified_folds", "encode_sequences", "stream_classify", "audit_schema"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 4 and {r.severity for r in rows} == {"CRITICAL", "HIGH", "MEDIUM", "SAFE"}


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def _canon(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "tolist"):
        return tuple(v.tolist())
    if isinstance(v, list):
        return tuple(v)
    return v


def test_duckdb_parity_sample(spark):
    con = duckdb.connect()
    for t in EXPECTED_SCHEMAS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    qs, sqls = E.queries(), E.oracle_sql()
    for name in PARITY_SAMPLE:
        s = qs[name](spark, SF_SMALL).toPandas()
        d = con.execute(sqls[name]).fetchdf()
        cols = sorted(s.columns)
        assert cols == sorted(d.columns), name
        rs = sorted(tuple(_canon(x) for x in r) for r in s[cols].astype(object).itertuples(index=False))
        rd = sorted(tuple(_canon(x) for x in r) for r in d[cols].astype(object).itertuples(index=False))
        assert len(rs) == len(rd), name
        assert str(rs) == str(rd), name
