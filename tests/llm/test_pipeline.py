"""Contracts of the registered queries and of the pipeline."""

import duckdb

import __spark_entry__ as E
import corpus_pipeline
from tests.conftest import SF_SMALL
from tools.oracle_check import rows_of
from vulnlake.llm import decontaminate, minhash, queries, toxicity
from vulnlake.sources.views import table


def test_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries()) and sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


def test_oracles(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    for name, sql in queries.ORACLES.items():
        assert rows_of(queries.QUERIES[name](spark, SF_SMALL).toPandas()) == rows_of(con.execute(sql()).fetchdf()), name


def test_stages_take_effect(spark, tmp_path):
    docs = table(spark, SF_SMALL, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, SF_SMALL)
        if name != "sharding":
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "toxicity":
            model = toxicity.train(spark, before, table(spark, SF_SMALL, "labels"))
            assert toxicity.score(spark, docs, model).where("predicted = 1").count() == 0
        if name == "near_duplicates":
            assert minhash.near_duplicates(spark, docs).where("not kept").count() == 0
            assert docs.count() == minhash.near_duplicates(spark, before).where("kept").count()
        if name == "decontamination":
            assert decontaminate.contaminated(spark, docs, table(spark, SF_SMALL, "benchmark")).count() == 0
    assert docs.columns == [*columns, "shard"] and docs.count() > 0


def test_stages_on_odd_and_empty_tables(spark, make_docs):
    """Null ids and texts, empty and repeated rows: what each stage keeps of the same table."""
    rows = [(1, None, None), (None, "", "a"), (2, "x", "b"), (2, "x", "b"), (3, "y " * 300, None)]
    every = sorted([(1, None), (2, "x"), (2, "x"), (3, "y " * 300), (None, "")], key=str)
    kept = {name: every for name, _ in corpus_pipeline.STAGES}
    kept["near_duplicates"] = sorted({*every}, key=str)  # one of the repeated rows
    kept["mixing"] = sorted([*every, (2, "x"), (2, "x")], key=str)  # source b stops at twice its size; texts without words stay once
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, make_docs(rows), SF_SMALL).select("doc_id", "text").collect()
        assert sorted(map(tuple, out), key=str) == kept[name], name
        assert stage(spark, make_docs([]), SF_SMALL).count() == 0, name
