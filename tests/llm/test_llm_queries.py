"""The queries against their SQL, and the pipeline from end to end."""

import duckdb
import pytest

import corpus_pipeline
from sparrowgrid.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    r = con.execute(ORACLES[name])
    found = [d[0] for d in r.description]
    assert sorted(found) == sorted(df.columns)
    key = lambda x: str(x)
    assert sorted((tuple(x[c] for c in found) for x in df.collect()), key=key) == sorted(r.fetchall(), key=key)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and all(r["n_tokens"] == len(r["ids"]) // 4 for r in rows)
