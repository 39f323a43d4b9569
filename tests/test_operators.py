import math

import pytest
from pyspark.sql import functions as F

from folio.operators import blocks, evaluation, features, islands, joins, line_numbers, tokens, weights

TOKEN = "doc_id string, page_idx int, line_idx int, token_idx int, text string, tag string"


def token_rows(spark, *rows):
    return spark.createDataFrame([("d", 0, *r) for r in rows], TOKEN)


def test_items_over_lines(spark):
    t = token_rows(spark, (0, 0, "Some", "b-title"), (0, 1, "title", "i-title"), (1, 0, "goes", "i-title"), (1, 1, "on", None), (2, 0, "New", "b-title"), (2, 1, "one", "b-title"))
    got = [(r.tag, r.tag_prefix, r.text, r.n_tokens) for r in islands.items(t).orderBy("item_ord").collect()]
    assert got == [("title", "b", "Some title\ngoes", 3), (None, None, "on", 1), ("title", "b", "New", 1), ("title", "b", "one", 1)]


def test_sub_items_and_untagged_runs(spark):
    t = token_rows(spark, (0, 0, "A", "author"), (0, 1, "B", "author"), (0, 2, "x", None), (0, 3, "y", None), (0, 4, "C", "author")).withColumn("sub_tag", F.when(F.col("text") == "B", "surname"))
    assert [(r.tag, r.sub_tag, r.text) for r in islands.sub_items(t).orderBy("item_ord", "sub_ord").collect()] == [("author", None, "A"), ("author", "surname", "B"), (None, None, "x y"), ("author", None, "C")]
    assert [(r.text, r.n_tokens) for r in islands.untagged_runs(t).collect()] == [("x y", 2)]


def test_prefixes_of_matches(spark):
    t = token_rows(spark, (0, 0, "a", "x"), (0, 1, "b", "x")).withColumn("m", F.lit(1))
    assert [r.tag for r in islands.begin_inside(t, ["m"]).orderBy("token_idx").collect()] == ["b-x", "i-x"]


def test_context(spark):
    rows = features.token_context(token_rows(spark, *[(0, k, w, None) for k, w in enumerate("abcd")])).orderBy("token_idx").collect()
    assert [r["-1:word.lower"] for r in rows] == [None, "a", "b", "c"] and [r["+2:word.lower"] for r in rows] == ["c", "d", None, None]
    assert [r["BOD[-1]"] for r in rows] == [True, False, False, False] and [r["EOD[+2]"] for r in rows] == [False, False, True, True]


def test_line_numbers(spark):
    rows = [(k, t, x, x2) for k in range(4) for t, x, x2 in ((0, 5.0 + k, str(k + 1)), (1, 50.0, "word"))]
    t = spark.createDataFrame([("d", 0, k, i, w, x) for k, i, x, w in rows], "doc_id string, page_idx int, line_idx int, token_idx int, text string, x double")
    assert sorted(r.text for r in line_numbers.line_numbers(t).collect()) == ["1", "2", "3", "4"]
    assert line_numbers.line_numbers(t.where("line_idx < 2")).collect() == []  # two candidates are too few


def test_shares(spark):
    t = token_rows(spark, *[(0, k, "w", "b-x" if k < 3 else None) for k in range(5)])
    shares = evaluation.tag_shares(t)
    assert {r.tag: (r["count"], r.percentage) for r in shares.collect()} == {"x": (3, 0.6), None: (2, 0.4)}
    assert evaluation.pages_with_tags(shares, 0.6).count() == 1 and evaluation.pages_with_tags(shares, 0.7).count() == 0
    assert evaluation.pages_with_tags(evaluation.tag_shares(t.where("tag IS NOT NULL")), 1.0).count() == 1


def test_confusion(spark):
    pairs = spark.createDataFrame(list(zip([0, 1, 2, 3, 3, 3], [0, 1, 1, 2, 3, 3], strict=True)), "label int, prediction int")
    m = {r.cls: r for r in evaluation.class_metrics(evaluation.confusion(pairs)).collect()}
    assert [(m[k].tp, m[k].fp, m[k].fn) for k in range(4)] == [(1, 0, 0), (1, 1, 0), (0, 1, 1), (2, 0, 1)]
    s = evaluation.summary(evaluation.class_metrics(evaluation.confusion(pairs))).first()
    assert abs(s.micro_f1 - 2 / 3) < 1e-12 and math.isnan(s.macro_f1) == any(math.isnan(m[k].f1) for k in range(4))


def test_weights(spark):
    rows = [(i, "abc"[k], float(f)) for k, fs in enumerate([[1, 1], [1, 1], [0, 1]]) for i, f in enumerate(fs)]
    freq = spark.createDataFrame(rows, "image int, label string, frequency double")
    assert {r.label: r.weight for r in weights.median_weights(freq).collect()} == {"a": 0.25, "b": 0.25, "c": 0.5}
    none = freq.withColumn("frequency", F.lit(0.0))
    assert {r.weight for r in weights.median_weights(none).collect()} == {0.0}
    e = {r.label: r.weight for r in weights.enet_weights(freq).collect()}
    assert abs(e["c"] - 1 / math.log(1.02 + 1 / 5)) < 1e-12
    assert weights.as_json(weights.median_weights(freq)).first().json == '{"a":0.25,"b":0.25,"c":0.5}'


def test_merge_by_position(spark):
    a = token_rows(spark, (0, 0, "x", None), (0, 1, "y", "old"), (0, 2, "z", None))
    b = token_rows(spark, (5, 3, "x", "new"), (5, 4, "y", None))
    assert [(r.text, r.tag) for r in joins.merge_tokens(a, b).orderBy("token_idx").collect()] == [("x", "new"), ("y", "old")]
    with pytest.raises(Exception, match="tokens differ"):
        joins.merge_tokens(a, token_rows(spark, (0, 0, "other", "t"))).collect()


def test_predictions_and_lists(spark):
    a = token_rows(spark, (0, 0, "x", None), (0, 1, "y", None))
    p = spark.createDataFrame([("d", 0, "title"), ("d", 1, "O")], "doc_id string, doc_ord int, prediction string")
    assert [r.crf_tag for r in joins.with_predictions(a, p).orderBy("token_idx").collect()] == ["title", None]
    one, two = spark.createDataFrame([("a",), ("b",)], "l string"), spark.createDataFrame([("c",)], "r string")
    with pytest.raises(Exception, match="differ in length"):
        joins.zip_lists(one, two, ["l"], ["r"]).collect()


def test_file_pairs_and_resume(spark):
    s = spark.createDataFrame([("x/1/a.pdf",), ("x/2/b.pdf",)], "path string")
    x = spark.createDataFrame([("x/1/c.xml",), ("x/3/d.xml",)], "path string")
    assert [tuple(r) for r in joins.file_pairs(s, x).collect()] == [("x/1/a.pdf", "x/1/c.xml")]
    assert joins.without_output(s, x.withColumn("path", F.lit("x/1/a.out")), F.regexp_replace("path", "pdf$", "out")).collect()[0].path == "x/2/b.pdf"


def test_centroids_and_ratios(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [0.5, 0.5])], "vec_id int, embedding array<double>")
    c = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 1.0])], "idx int, centroid array<double>")
    assert {r.vec_id: r.nearest for r in joins.nearest_centroid(v, c).collect()} == {1: 0, 2: 1, 3: 0}
    n = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 1, 1.0), (2, 2, 1.1), (3, 1, 1.0)], "query_id int, train_id int, distance double")
    assert [r.query_id for r in joins.ratio_filtered(n).collect()] == [1]


def test_blocks(spark):
    rows = [("d", 0, 0, "t", 0.0, 0.0, 16.0, 10.0), ("d", 0, 1, "t", 16.0, 0.0, 16.0, 10.0), ("d", 0, 2, "u", 16.0, 0.0, 16.0, 10.0), ("d", 0, 3, "t", 100.0, 0.0, 5.0, 5.0)]
    b = spark.createDataFrame(rows, blocks.SCHEMA)
    got = {(r.block_ord, r.tag, r.x, r.width) for r in blocks.merged_blocks(b).collect()}
    assert got == {(0, "t", 0, 32), (2, "u", 16, 16), (3, "t", 100, 5)}
    at = lambda gap, tolerance: blocks.merged_blocks(spark.createDataFrame([rows[0], ("d", 0, 1, "t", 16.0 + gap, 0.0, 16.0, 10.0)], blocks.SCHEMA), tolerance).count()
    assert at(10, 10) == 1 and at(11, 10) == 2


def test_block_merge_against_a_plain_loop():
    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(200):
        boxes = np.column_stack([r.integers(0, 40, 8), r.integers(0, 40, 8), r.integers(1, 12, 8), r.integers(1, 12, 8)]).astype(float)
        queue, out = list(enumerate(boxes.tolist())), []
        while queue:
            k, (x, y, w, h) = queue.pop(0)
            hit = [q for q in queue if q[1][0] <= x + w - 1 + 1 and x - 1 <= q[1][0] + q[1][2] - 1 and q[1][1] <= y + h - 1 and y <= q[1][1] + q[1][3] - 1]
            if hit:
                every = [[x, y, w, h], *[q[1] for q in hit]]
                x1, y1 = min(e[0] for e in every), min(e[1] for e in every)
                queue = [(k, [x1, y1, max(e[0] + e[2] for e in every) - x1, max(e[1] + e[3] for e in every) - y1]), *[q for q in queue if q not in hit]]
            else:
                out.append((k, [x, y, w, h]))
        assert blocks._merge(boxes, 0) == out


def test_tokens_and_spans(spark):
    d = spark.createDataFrame([(1, "a b\nc"), (2, None)], "doc_id long, text string")
    t = tokens.from_text(d)
    assert [(r.line_idx, r.token_idx, r.text) for r in t.orderBy("line_idx", "token_idx").collect()] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]
    s = d.select(F.explode(tokens.span_words(F.col("text"))).alias("w")).select("w.*").collect()
    assert [tuple(r) for r in s] == [("a", 0, 1), ("b", 2, 3), ("c", 4, 5)]
    x = spark.createDataFrame([("d", 0, 0, 0, "100"), ("d", 0, 0, 1, "20")], "doc_id string, page_idx int, line_idx int, token_idx int, x_raw string")
    order = lambda as_text: [r.token_idx for r in tokens.sorted_by_x(x, as_text).orderBy("x_order").collect()]
    assert order(False) == [1, 0] and order(True) == [0, 1]
