"""Plans that scale: filters and columns reach the scan, sides are not multiplied, Python stays out of native plans."""

import io
from contextlib import redirect_stdout

import pytest

from folio.plans import catalog

SF = "/root/testdata/sf0.001"
PYTHON_FREE = ["vocab_word_count", "context_features", "bio_items", "positional_merge", "line_number_tokens", "tag_shares", "class_metrics", "median_class_weights", "overlapping_boxes", "best_rows", "nearest_centroid"]


def plan(spark, name):
    out = io.StringIO()
    with redirect_stdout(out):
        catalog.queries()[name](spark, SF).explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", PYTHON_FREE)
def test_native_plans_have_no_python_and_no_product(spark, name):
    p = plan(spark, name)
    assert "Python" not in p and "Pandas" not in p and "Arrow" not in p
    assert "CartesianProduct" not in p


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(spark, "category_filter")
    assert "PushedFilters: [In(event_type" in p and "ReadSchema: struct<event_id:bigint,event_type:string>" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in plan(spark, "tag_shares")


def test_best_rows_need_no_sort(spark):
    assert "Window" not in plan(spark, "best_rows")


def test_targets_hold_whole_texts(spark, tmp_path):
    from folio.plans import catalog

    text = "first line\n\n  second & line \n" + "word " * 30_000 + "\nlast line\n"
    spark.createDataFrame([(1, text, "src0")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.name, r.value.split()) for r in catalog.queries()["xml_whole_targets"](spark, str(tmp_path)).orderBy("target_ord").collect()]
    words = text.replace("&", " ").split()
    assert got == [("body", words), *(("paragraph", x) for x in (words[:2], words[2:4], ["word"] * 30_000, ["last", "line"]))]


def test_words_are_zipped_up_to_the_shorter_item(spark, tmp_path):
    texts = [" ".join(f"{c}{k}" for k in range(n)) for c, n in (("a", 40), ("b", 12), ("c", 30))]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.item_id, r.k, r.word, r.beside) for r in catalog.queries()["zipped_neighbours"](spark, str(tmp_path)).collect())
    assert got == [(0, k + 1, f"a{k}", f"b{k}") for k in range(12)] + [(1, k + 1, f"b{k}", f"c{k}") for k in range(12)]


def test_the_whole_sort_comes_back_in_order(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey").collect()
    got = catalog.queries()["all_sorted_matches"](spark, SF).collect()
    assert len(got) > 200 and got == sorted(lines)


def test_rows_at_one_place_meet_as_in_a_join(spark):
    from folio.operators import joins, tokens

    rows = [(d, 0, k // 3, k % 3, f"{d}{k}", {"": f"t{k}"}) for d, n in ((1, 5), (2, 0), (3, 9), (4, 2)) for k in range(n)] + [(None, 0, 0, 0, "x", None)]
    t = spark.createDataFrame(rows, "doc_id int, page_idx int, line_idx int, token_idx int, text string, tags map<string, string>")
    more = [(1, 0, "a"), (1, 2, "O"), (1, 2, "b"), (1, None, "c"), (1, 7, "d"), (3, 8, ""), (3, 0, None), (5, 0, "e"), (None, 0, "f")]
    p = spark.createDataFrame(more, "doc_id long, doc_ord long, prediction string")
    plain = lambda df: sorted(map(repr, df.select(*t.columns, "prediction").collect()))
    want = tokens.with_ordinal(t).join(p, ["doc_id", "doc_ord"]).withColumn("doc_id", tokens.F.col("doc_id").cast("int"))
    assert plain(joins.at_same_place(t, p)) == plain(want) and want.count() == 5
    assert joins.at_same_place(t, p).select(*t.columns).schema["doc_id"].dataType == t.schema["doc_id"].dataType


@pytest.mark.parametrize("name", ["positional_merge", "predicted_tags", "context_features", "bio_items", "token_positions", "single_node_text", "sub_items"])
def test_tokens_are_not_shuffled(spark, name):
    p = plan(spark, name).split("== Initial Plan ==")[0]
    shuffles = [line for line in p.splitlines() if line.startswith("Arguments: hashpartitioning")]
    assert shuffles and all("REPARTITION_BY_NUM" in line for line in shuffles)


def test_items_are_put_together_in_one_pass(spark):
    assert "ObjectHashAggregate" not in plan(spark, "bio_items")


def test_tags_by_their_beginning_are_those_of_the_pattern(spark):
    from folio.functions import tags as T

    F = T.F
    given = ["b-x", "i-x", "x", "", "b-", "i-", "b", "-", "b-b-x", "B-x", "o-x", None, "b-x\n", "a\nb", "b-a\nb", "b-a\r", "i-\u2028x", "\nb-x", "b-\u00e4\U0001f600"]
    t = spark.createDataFrame([(g,) for g in given], "tag string")
    found = F.regexp_extract("tag", T._PREFIXED, 1)
    want = t.select(F.regexp_extract("tag", T._PREFIXED, 2), F.when(found != "", F.substring(found, 1, 1))).collect()
    assert [tuple(r) for r in t.select(T.tag_value("tag"), T.tag_prefix("tag")).collect()] == [tuple(r) for r in want]


WHOLE = ["predicted_tags", "context_features", "token_positions"]


@pytest.mark.parametrize("name", WHOLE)
def test_only_odd_documents_are_sorted_by_token(spark, name, monkeypatch):
    from folio.operators import tokens

    cut, seen = tokens.from_text, []
    monkeypatch.setattr(tokens, "from_text", lambda docs: seen.append(docs) or cut(docs))
    rows = catalog.queries()[name](spark, SF)
    assert [d.count() for d in seen] == [0] and rows.count() > 10_000


@pytest.mark.parametrize("name", WHOLE)
def test_whole_texts_give_the_rows_of_windows(spark, name, tmp_path, monkeypatch):
    from folio.operators import tokens

    texts = {1: "a  b o,\n\nsee the end,", 2: None, 3: "", 4: "same text of two\nrows", 5: "\n".join(["x Y"] * 120), 6: "o e\n \n", 7: " ", 8: "one", 9: "long " * 30}
    rows = [*texts.items(), (4, texts[4])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = []
    for most in (-1, 100, 1 << 18):  # all in windows, the long ones, only the id that stands twice
        monkeypatch.setattr(tokens, "WHOLE_TEXT", most)
        found.append(sorted(map(repr, catalog.queries()[name](spark, str(tmp_path)).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == sum(len(t.replace("\n", " ").split(" ")) for _, t in rows if t is not None)


def test_sub_items_sort_tokens_once(spark):
    out = io.StringIO()
    with redirect_stdout(out):
        catalog.queries()["sub_items"](spark, SF).explain()
    p = out.getvalue()
    assert "Aggregate" not in p and sum("Sort [" in line and "page_idx" in line for line in p.splitlines()) == 1


def test_only_tokens_of_mapped_items_are_grouped(spark):
    out = io.StringIO()
    with redirect_stdout(out):
        catalog.queries()["single_node_text"](spark, SF).explain()
    p = out.getvalue()
    assert p.rindex("IN (short,o)") > p.rindex("Aggregate")
