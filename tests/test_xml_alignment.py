import json
from xml.etree import ElementTree as ET

import pytest

from folio.functions.xpath import select
from folio.operators import alignment as A
from folio.operators import targets as X

SHORT, VALUE, LONG = "value1", "some value here", "some longer value that goes on"


def found(xml, **fields):
    mapping = {"article": {k.replace("__", ".").replace("_", "-") if "__" in k else k: v for k, v in fields.items()}}
    return X.targets_of(ET.fromstring(f"<article>{xml}</article>"), mapping)


def test_xpath():
    root = ET.fromstring('<a><b t="1"/><c><b t="2"/><d><b/></d></c></a>')
    assert [e.get("t") for e in select(root, "b")] == ["1"] and [e.get("t") for e in select(root, ".//b")] == ["1", "2", None]
    assert len(select(root, "c//b[not(@t) or @t='2']")) == 2 and len(select(root, "b|c/b")) == 2
    assert select(root, ".") == [root] and [e.tag for e in select(root, "c/*")] == ["b", "d"]


def test_targets():
    assert found("") == found("<other>x</other>", title="title") == []
    one = found(f"<title>{VALUE}</title>", title="title")
    assert [(t["name"], t["value"], t["is_list"], t["bonding"]) for t in one] == [("title", [VALUE], False, False)]
    assert found("<title>1.1. Name</title>", title="title", title__regex=r"(?:\d+\.?)* ?(.*)")[0]["value"] == ["Name"]
    assert found("<title>x</title>", title="title", title__match_multiple="true", title__require_next="true")[0]["match_multiple"]
    assert [t["value"][0] for t in found("<e><a>1</a><b>2</b></e>", t="\ne/a\ne/b\n")] == ["1", "2"]


def test_children():
    kids = {"t": "entry", "t__children": ".//*"}
    assert found(f"<entry><a>{SHORT}</a><b>{LONG}</b></entry>", **kids)[0]["value"] == [LONG, SHORT]
    assert found(f"<entry><p><b>{LONG}</b>{VALUE}<a>{SHORT}</a></p></entry>", **kids)[0]["value"] == [LONG, VALUE, SHORT]
    both = [[{"xpath": ".//fpage"}, {"value": "-"}, {"xpath": ".//lpage"}]]
    pages = f"<entry><p><a>{VALUE}</a><fpage>101</fpage><lpage>202</lpage></p></entry>"
    mapping = {"article": {"t": "entry", "t.children": ".//*", "t.children.concat": json.dumps(both)}}
    root = ET.fromstring(f"<article>{pages}</article>")
    assert X.targets_of(root, mapping)[0]["value"] == [VALUE, "101-202"]
    both[0][2]["xpath"] = ".//unknown"
    mapping["article"]["t.children.concat"] = json.dumps(both)
    assert X.targets_of(root, mapping)[0]["value"] == [VALUE, "101", "202"]
    ranges = [{"min": {"xpath": "fpage"}, "max": {"xpath": "lpage"}, "standalone": True}]
    mapping = {"article": {"t": "entry", "t.children": "fpage|lpage", "t.children.range": json.dumps(ranges)}}
    root = ET.fromstring("<article><entry><fpage>8</fpage><lpage>10</lpage></entry></article>")
    assert [t["value"] for t in X.targets_of(root, mapping)] == [["8"], ["9"], ["10"]]
    ranges[0].pop("standalone")
    mapping["article"]["t.children.range"] = json.dumps(ranges)
    assert X.targets_of(root, mapping)[0]["value"] == ["10", "8", "9"]


def test_order_subs_and_errors(spark):
    mapping = {"article": {"a": "x", "b": "y", "b.priority": "1", "b.sub.s": "./s"}}
    out = X.targets_of(ET.fromstring("<article><x>1</x><y><s>2</s></y></article>"), mapping)
    assert [t["name"] for t in out] == ["b", "a"] and out[0]["sub"] == [{"name": "s", "value": ["2"]}]
    with pytest.raises(ValueError, match="no mapping for <other>"):
        X.targets_of(ET.fromstring("<other/>"), mapping)
    rows = X.targets(spark.createDataFrame([("1", "<article><x>v</x></article>"), ("2", "<broken"), ("3", None)], "doc_id string, xml string"), mapping).collect()
    assert {r.doc_id: r.error is None for r in rows} == {"1": True, "2": False, "3": False}


def test_items_to_xml():
    item = lambda tag, text, subs=None: {"tag": tag, "text": text, "sub_items": [{"tag": t, "text": v} for t, v in subs or ()]}
    xml = ET.fromstring(X.items_to_xml([item("manuscript_title", "One"), item("manuscript_title", "two"), item(None, "x"), item("abstract", "A"), item("manuscript_title", "late"), item("author", "Ann B1,", [("surname", "B1,"), ("givennames", "Ann")]), item("author", "Cy 2*")]))
    assert xml.findtext("front/article-meta/title-group/article-title") == "One\ntwo" and xml.findtext("front/article-meta/abstract") == "A"
    authors = xml.findall("front/article-meta/contrib-group/contrib")
    assert authors[0].findtext("name/surname") == "B" and authors[1].text == "Cy "


def test_match_statistics():
    m = A.Match("abx", "aby", [(0, 0, 2)])
    assert (m.count(), m.ratio(), m.a_ratio(), m.b_gap_ratio()) == (2, 1.0, 2 / 3, 2 / 3)
    left, right = A.Match("abcd", "abcd", [(0, 0, 4)]).split_a(1)
    assert (left.blocks, right.blocks) == ([(0, 0, 1)], [(0, 1, 3)])
    left, right = A.Match("abcd", "abcd", [(0, 0, 4)]).split_b(3)
    assert (left.blocks, right.blocks) == ([(0, 0, 3)], [(3, 0, 1)])
    assert A.Match("", "", []).ratio() == 0.0


def test_alignment_scores_as_all_alignments_would():
    import random

    def best(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        top = 0
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1][j + 1] = max(0, h[i][j] + (2 if a[i] == b[j] else -1), h[i][j + 1] - 2, h[i + 1][j] - 2)
                top = max(top, h[i + 1][j + 1])
        return top

    r = random.Random(1)
    for _ in range(150):
        a, b = ("".join(r.choices("abc", k=r.randint(1, 14))) for _ in range(2))
        blocks = A.local_blocks(a, b)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in blocks)
        score = 0
        for k, (i, j, n) in enumerate(blocks):
            score += 2 * n
            if k:
                pi, pj, pn = blocks[k - 1]
                di, dj = i - pi - pn, j - pj - pn
                score -= min(di, dj) + 2 * abs(di - dj)
        assert score == best(a, b)


def test_many_alignments_are_single_ones():
    import random

    r = random.Random(2)
    texts = [tuple("".join(r.choices("abc d", k=r.randint(0, 70))) for _ in range(2)) for _ in range(120)] + [("日本語の文" * 9, "日本の文語" * 8)]
    want = [A.local_blocks(*t) for t in texts]
    for cells in (A.CELLS, 3000, 60):  # the small ones fill in stripes
        assert A.many_blocks(texts, cells) == want


def plain_count(a, b):
    """Matched characters of the best alignment, cell by cell."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if a[i] == b[j] else -1), h[i][j + 1] - 2, h[i + 1][j] - 2)
    top = max(map(max, h))
    i, j = next((i, j) for i, row in enumerate(h) for j, score in enumerate(row) if score == top)
    count = 0
    while h[i][j] > 0:
        same = a[i - 1] == b[j - 1]
        if h[i][j] == h[i - 1][j - 1] + (2 if same else -1):
            i, j, count = i - 1, j - 1, count + same
        elif h[i][j] == h[i - 1][j] - 2:
            i -= 1
        else:
            j -= 1
    return count


def test_statistics_of_whole_turns(spark, tmp_path):
    import random

    from folio.plans.document_queries import match_statistics

    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdef", k=r.randint(1, 7)))
    tail = [word() for _ in range(60)]
    turns = [" ".join([word() for _ in range(30)] + tail[k:]) + "." for k in range(5)] + ["ab", None, "x. ,y"]
    spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(turns)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x.turn: x for x in match_statistics(spark, str(tmp_path)).collect()}
    assert {k: x.match_count for k, x in got.items() if k > 4} == {6: None}
    for k in range(5):
        m = A.fuzzy_match(turns[k], turns[k + 1])
        assert (got[k].match_count, got[k].ratio, got[k].b_gap_ratio) == (m.count(), round(m.ratio(), 9), round(m.b_gap_ratio(), 9))
        assert got[k].match_count == (plain_count(turns[k], turns[k + 1]) if k < 4 else 0)
        if k < 4:
            assert got[k].match_count >= len(" ".join(tail[k + 1 :]))  # all of it lies beyond word 20


def annotated(spark, lines, *targets):
    rows = [("d", 0, n, k, w, None) for n, line in enumerate(lines) for k, w in enumerate(line.split(" "))]
    t = spark.createDataFrame(rows, "doc_id string, page_idx int, line_idx int, token_idx int, text string, tag string")
    wanted = [("d", k, g["name"], g["value"], len(g["value"]) > 1, g.get("many", False), g.get("bonding", False), g.get("next", False), g.get("sub", [])) for k, g in enumerate(targets)]
    schema = "doc_id string, target_ord int, name string, value array<string>, is_list boolean, match_multiple boolean, bonding boolean, require_next boolean, sub array<struct<name: string, value: array<string>>>"
    out = A.annotate(t, spark.createDataFrame(wanted, schema)).collect()
    return {(r.line_idx, r.token_idx): (r.tag, r.sub_tag) for r in out}


def test_annotate_one_line_and_two(spark):
    got = annotated(spark, ["this is before", "This is the Title", "of the paper now", "and after"], {"name": "title", "value": ["this is the title of the paper now"]})
    assert {k: v[0] for k, v in got.items()} == {(1, k): ("b-" if k == 0 else "i-") + "title" for k in range(4)} | {(2, k): "i-title" for k in range(4)}


def test_annotate_parts_of_a_line_with_sub_tags(spark):
    got = annotated(spark, ["some words John Smith and others"], {"name": "author", "value": ["john smith"], "sub": [{"name": "surname", "value": ["Smith"]}]})
    assert got == {(0, 2): ("b-author", None), (0, 3): ("i-author", "b-surname")}


def test_annotate_many_and_none(spark):
    got = annotated(spark, ["the keyword here", "other", "the keyword there"], {"name": "k", "value": ["keyword"], "many": True}, {"name": "z", "value": ["not to be found"]})
    assert {k: v[0] for k, v in got.items()} == {(0, 1): "b-k", (2, 1): "b-k"}


def test_labels_of_characters():
    assert A.labels_match("The scientific life of mice", "Title: The scientific life of mice") == "_" * 7 + "x" * 27
    assert A.labels_match("", "ab") == "__" and A.labels_match("zzzzz", "abcde") == "_____"


def test_a_band_holds_what_the_whole_table_holds(monkeypatch):
    import random

    monkeypatch.setattr(A, "MARGIN", 3)
    r, proven = random.Random(3), 0
    for k in range(150):
        a = "".join(r.choice("abcdefghij ") for _ in range(r.randint(20, 300)))
        b = list(a)
        for _ in range(r.randint(0, len(a) // 8)):
            at, what = r.randrange(len(b)), r.random()
            if what < 0.4:
                b[at] = r.choice("abcdefghij ")
            elif what < 0.7:
                b.insert(at, r.choice("abc"))
            else:
                del b[at]
        b = "".join(b)
        if k % 3 == 0:
            b = b[r.randint(0, len(b) // 3) :]
        found = A.banded_blocks(*((a, b) if k % 2 else (b, a)))
        if found is not None:
            proven += 1
            assert found == A.local_blocks(*((a, b) if k % 2 else (b, a)))
    assert proven > 50
    assert A.banded_blocks("x" * 300, "y" * 300) is None and A.banded_blocks("", "abc") is None


def test_long_texts_go_through_a_band():
    import random
    import time

    r = random.Random(1)
    a = "".join(r.choice("abcdefghijklmnop ") for _ in range(20_000))
    b = a[:7000] + "#" + a[7001:15_000] + a[15_003:]
    start = time.time()
    assert A.local_blocks(a, b) == [(0, 0, 7000), (7001, 7001, 7999), (15_003, 15_000, 4997)]
    assert time.time() - start < 30


def test_every_comparison_is_told(spark):
    rows = [("d", 0, k, j, w, None) for k, line in enumerate(["some big title", "goes on here", "unrelated"]) for j, w in enumerate(line.split())]
    tokens = spark.createDataFrame(rows, "doc_id string, page_idx int, line_idx int, token_idx int, text string, tag string")
    target = [("d", 0, "title", ["some big title goes on here"], False, False, False, False, [("first", ["some"])]), ("d", 1, "no", ["zzzzzz"], False, True, False, False, [])]
    wanted = spark.createDataFrame(target, "doc_id string, target_ord int, name string, value array<string>, is_list boolean, match_multiple boolean, bonding boolean, require_next boolean, sub array<struct<name: string, value: array<string>>>")
    got = A.match_debug(tokens, wanted).orderBy("id").collect()
    assert [c for c in got[0].asDict()][1:] == [c.split()[0] for c in A.DEBUG.split(", ")] and [r.id for r in got] == list(range(1, len(got) + 1))
    first, second = got[:2]
    assert (first.tag, first.choice_current, first.choice_next, first.accepted, first.reached_end, first.tag_value_pre) == ("title", "some big title", "goes on here", True, False, "")
    assert (second.start_index, second.tag_value_current, second.reached_end, second.accepted) == (15, "goes on here", True, True)
    assert "[some big title" in first.fm_current_detailed and first.fm_combined.startswith("matches=27")
    assert any(r.sub_annotation and r.accepted for r in got) and not any(r.accepted for r in got if r.tag == "no")
    assert {(r.line_idx, r.token_idx) for r in A.annotate(tokens, wanted).collect()} == {(k, j) for k in (0, 1) for j in range(3)}
