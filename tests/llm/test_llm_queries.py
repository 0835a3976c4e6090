"""The registered corpus queries and the pipeline on the small tables."""

import duckdb
import pytest

import corpus_pipeline
from plumbline.llm import queries

TABLES = ("documents", "pages", "benchmark", "labels", "embeddings")


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cur = con.execute(queries.SQL[name])
    names = [x[0] for x in cur.description]
    at = [names.index(c) for c in df.columns]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(
        str(tuple(r[i] for i in at)) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns, bad = docs.columns, {r["doc_id"] for r in labels.where("quality = 0").collect()}
    kept, sizes = docs, []
    for _, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.stored(stage(spark, kept, sf), "stage")
        sizes.append(kept.count())
        if len(sizes) < len(corpus_pipeline.STAGES):
            assert kept.columns == columns
    assert docs.count() >= sizes[0] >= sizes[1] >= sizes[2] > 0 and sizes[3] == sizes[4]
    left = {r["doc_id"] for r in kept.collect()}
    assert len(left & bad) <= len(bad) // 10
