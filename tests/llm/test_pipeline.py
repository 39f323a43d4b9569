import duckdb
import pytest

import corpus_pipeline
from folio.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_call_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeats", "mix", "tokens"]
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from folio.llm.common import written

        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        m = docs.count()
        assert name == "mix" or m <= n
        n = m
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == n and "ids_sha256" in out.columns


def test_each_operator_has_one_query():
    found = sorted(int(k[2:].split("_")[0]) for k in queries.queries())
    assert found == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "labels", "conversations", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    whole = lambda rows: sorted(map(repr, map(tuple, rows)))
    assert whole(df.select(*names).collect()) == whole(found.fetchall())
