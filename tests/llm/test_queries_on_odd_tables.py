"""Every query on tables with nulls, repeats, empty and long texts, clashing columns, and on empty tables."""

import pytest

import corpus_pipeline
from folio.llm import queries
from tests.llm.test_audit_trie_warc import plain_rebuilt, plain_trie

LABELS = "doc_id long, quality int, toxic int"
TURNS = "conv_id long, turn long, role string, text string"
TURN_ROWS = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (None, None, None, None), (1, 0, "user", "hi"), (2, 5, "other", "")]
PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def odd(spark, docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    docs.union(docs.limit(5)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, None, None), (3, 7, None), (10**9, 1, 1)], LABELS).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(TURN_ROWS, TURNS).write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(1, "u", "<p>"), (None, None, None), (1, "u", "<p>"), (2, None, "<p>"), (3, "v", "")], PAGES).write.parquet(f"{d}/pages.parquet")
    return d


@pytest.fixture(scope="module")
def nothing(spark, empty, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("nothing"))
    empty.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], TURNS).write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([], PAGES).write.parquet(f"{d}/pages.parquet")
    return d


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, odd, nothing, rows, name):
    got = queries.queries()[name](spark, odd).count()
    nodes = len(list(plain_trie(plain_rebuilt(TURN_ROWS))))
    others = {"op2": 3, "op11": 600 * len({r[2] or "" for r in rows}), "op12": nodes, "op13": 5}
    assert got == others.get(name.split("_")[0], len(rows) + 5)
    assert queries.queries()[name](spark, nothing).count() == 0


def test_pipeline(spark, odd, nothing):
    assert corpus_pipeline.run(spark, odd).count() > 0
    assert corpus_pipeline.run(spark, nothing).count() == 0
