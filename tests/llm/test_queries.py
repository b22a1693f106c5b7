"""The registered queries, and the pipeline against a plain version of its stages."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as job
from docstruct.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(columns).collect()))) == sorted(map(str, want))


def test_eleven_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 11))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stage = dict(job.STAGES)
    good = stage["quality"](spark, docs, FOLDER).cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns and sum((i in kept) == (q == 1) for i, q in labels.items()) >= 0.95 * len(labels)
    one = stage["exact"](spark, good, FOLDER).cache()
    last = {}
    for i in sorted(kept):
        last[rows[i].text] = i
    assert {r.doc_id for r in one.collect()} == set(last.values())
    alone = stage["near"](spark, one, FOLDER).cache()
    from tests.llm.test_text_operators import brute_components

    parts = brute_components([(i, rows[i].text) for i in sorted(last.values())], 5, 4, 5)
    assert {r.doc_id for r in alone.collect()} == {c for _, c in parts.values()}
    mixed = stage["mix"](spark, alone, FOLDER).cache()
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in alone.collect()}
    assert mixed.count() > 0.8 * alone.count() and mixed.select("doc_id").distinct().count() == mixed.count()
    out = stage["pieces"](spark, mixed, FOLDER)
    from docstruct.llm.pieces import decode

    assert {r.doc_id: r.decoded for r in decode(out).collect()} == {r.doc_id: rows[r.doc_id].text for r in mixed.collect()}
    assert {r.doc_id for r in job.run(spark, FOLDER).select("doc_id").collect()} == {r.doc_id for r in mixed.collect()}


def test_stages_take_odd_rows(spark):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b", None, None, 3), (2, "a b", None, None, 3), (3, "x " * 30000, "en", "s", 60000)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in job.STAGES:
            out = stage(spark, docs, FOLDER)
            assert "doc_id" in out.columns and out.count() <= len(rows), name
            assert name == "pieces" or out.columns == docs.columns
