import pytest
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions import nested as N
from folio.functions import tags as T
from folio.functions import text as X


@pytest.fixture
def one(spark):
    row = spark.range(1)
    return lambda *columns: row.select(*columns).first() if len(columns) > 1 else row.select(*columns).first()[0]


@pytest.mark.parametrize(("given", "want"), [("A—b–c d", "a-b-c d"), ("it's", 'it"s'), ("&apos;X&apos;", '"x"'), ("", "")])
def test_normalise(one, given, want):
    assert one(X.normalise(F.lit(given))) == want


@pytest.mark.parametrize(("given", "want"), [("Mr Beam*", "Mr Beam"), ("Mr Beeeam", "Mr Beam"), ("a., b", "a b")])
def test_remove_junk(one, given, want):
    assert one(X.remove_junk(F.lit(given))) == want
    assert one(X.remove_junk(F.lit("P.O. Box"), X.DOT_JUNK)) == "PO Box"


@pytest.mark.parametrize(("given", "want"), [("a\t b", "a b"), ("a \n \n \n b", "a\nb"), ("a\r\nb", "a\nb"), ("a  b", "a b")])
def test_strip_whitespace(one, given, want):
    assert one(X.strip_whitespace(F.lit(given))) == want


def test_tokens(one):
    assert one(X.tokenise(F.lit("token1, token2,"))) == ["token1", ",", "token2", ","]
    assert one(X.tokenise(F.lit("  (a) “b”-c  "))) == ["(", "a", ")", "“", "b", "”", "-", "c"]
    assert one(X.tokenise(F.lit(""))) == []


@pytest.mark.parametrize(("given", "want"), [("Smith 1.,2*", "Smith "), ("J. R.", "J. R."), ("A,B2.", "A,B"), ("12", "")])
def test_authors(one, given, want):
    assert one(X.clean_author(F.lit(given))) == want


def test_patterns_and_paths(one):
    assert one(X.apply_pattern(F.lit("1.1. Title"), r"(?:\d+\.?)* ?(.*)")) == "Title"
    assert one(X.apply_pattern(F.lit("abc"), r"(\d+)")) == "abc"
    assert X.extract_with_regex("one 12 two", r"(\d+)") == ["one", "12", "two", "one 12 two"]
    assert tuple(one(X.path_head(F.lit("a/b/c")).alias("h"), X.path_tail(F.lit("a/b/c")).alias("t"))) == ("a/b", "c")
    assert X.parse_page_range("2-4") == (2, 4) and X.parse_page_range("3") == (3, 3) and X.parse_page_range(" ") is None
    with pytest.raises(ValueError):
        X.parse_page_range("1-2-3")


@pytest.mark.parametrize(("given", "pattern", "want"), [
    ("abc", r"(\w+)", ["abc"]), ("a, b", r"(\w)", ["a", "", "b", "a, b"]), ("page 7", r".*\b(\d+)\b.*", ["page", "7", "page 7"]), ("7", r".*\b(\d+)\b.*", ["7"]),
    ("no digit", r"(\d)", ["no digit"]), ("see [4] and [5]", r"\[(\d)\]", ["see [", "4", "and [", "5", "see [4] and [5]"]), ("ab", r"(x)?b", ["ab"]),
])
def test_extraction_by_groups(given, pattern, want):
    assert X.extract_with_regex(given, pattern) == want


def test_word_features(one):
    f = X.token_features(F.lit("HEad"))
    assert one(f["word.lower"]) == "head" and one(f["word[-3:]"]) == "Ead" and one(f["word[:1].isupper"]) and not one(f["word.isupper"])
    assert one(X.is_digit(F.lit("12"))) and not one(X.is_digit(F.lit("1a")))


def test_small_formats(one):
    assert tuple(one(X.colour_literal(F.lit("(1, 2, 3)")))) == (1, 2, 3) and tuple(one(X.colour_literal(F.lit("7")))) == (7, 7, 7)
    assert one(X.colour_literal(F.lit("red"))) is None
    assert one(X.page_image_name(F.lit(3))) == "/page_00003.jpg"
    assert one(X.to_list(F.lit(" a , b"))) == ["a", "b"] and one(X.to_list(F.lit(" "))) == []
    assert one(X.to_bool(F.lit("Yes"))) and not one(X.to_bool(F.lit("no")))
    assert one(X.annotated_extension(F.lit(True), F.lit(True))) == ".crf-cv.lxml.gz"
    assert one(X.skip_whitespace(F.lit("ab  c"), 2)) == 4


def test_palette_is_md5_modulo_its_size(one):
    import hashlib

    for tag in ("title", "abstract", "é"):
        assert one(X.colour_for_tag(F.lit(tag))) == X.PALETTE[int(hashlib.md5(tag.encode()).hexdigest(), 16) % len(X.PALETTE)]


def test_tags(one):
    assert one(T.tag_value(F.lit("b-title"))) == "title" and one(T.tag_prefix(F.lit("i-x"))) == "i" and one(T.tag_prefix(F.lit("x"))) is None
    assert one(T.with_prefix(F.lit("x"), "b")) == "b-x"
    assert T.scope_key("tag", "crf", 2) == "crf-level2_tag" and T.scope_key() == "tag"
    m = F.create_map(F.lit("tag"), F.lit("a"), F.lit("crf-tag"), F.lit("b"), F.lit("other"), F.lit("c"))
    assert one(T.by_scope(m)) == {"": "a", "crf": "b"}
    assert one(T.set_tag(m, F.lit(None).cast("string"), "tag")) == {"crf-tag": "b", "other": "c"}
    assert one(T.label(F.lit(""))) == "O"


def B(*v):
    return G.box(*[F.lit(x) for x in v])


def test_boxes(one):
    t = lambda c: tuple(one(c))
    assert t(G.union(B(0, 0, 2, 2), B(5, 5, 1, 1))) == (0, 0, 6, 6) and t(G.union(B(9, 9, 0, 0), B(5, 5, 1, 1))) == (5, 5, 1, 1)
    assert t(G.intersection(B(0, 0, 4, 4), B(2, 1, 9, 9))) == (2, 1, 2, 3)
    assert not one(G.intersects(B(0, 0, 2, 2), B(2, 0, 2, 2))) and one(G.intersects(B(0, 0, 3, 2), B(2, 0, 2, 2)))
    assert one(G.touches(B(0, 0, 16, 10), B(16, 0, 16, 10), 1)) and not one(G.touches(B(0, 0, 16, 10), B(18, 0, 16, 10), 1))
    assert t(G.expanded(B(10, 10, 4, 4), 4, 2)) == (6, 8, 12, 8) and t(G.shrunk(B(0, 0, 4, 4), 3, 1)) == (3, 1, 0, 2)
    assert t(G.rounded(B(0.5, 1.5, 2.5, 3.5))) == (0, 2, 2, 4)
    assert one(G.box_text(B(1, 2, 3, 4.5))) == "1.0 2.0 3.0 4.5" and t(G.parse_box(F.lit("1 2 3 4.5"))) == (1, 2, 3, 4.5)
    with pytest.raises(Exception, match="negative size"):
        one(G.validated(B(0, 0, -1, 1)))


def test_nested(one):
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    assert one(N.number_range(F.lit("3"), F.lit("6"))) == [3, 4, 5, 6] and one(N.number_range(F.lit("6"), F.lit("3"))) == [] and one(N.number_range(F.lit("x"), F.lit("3"))) == []
    assert one(N.longest_first(arr("a", "ccc", "bb", "dd"))) == ["ccc", "bb", "dd", "a"]
    assert [tuple(x) for x in one(N.zipped(arr(1, 2, 3), arr("a", "b")))] == [(1, "a"), (2, "b")]
    ranges = F.array(F.struct(F.lit(2).alias("s"), F.lit(4).alias("e")))
    assert [tuple(x) for x in one(N.inverted_ranges(ranges, F.lit(0), F.lit(6)))] == [(0, 2), (4, 6)]
    assert one(N.inverted(F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("y")))) == {"x": "a", "y": "b"}
    assert one(N.argmax(arr(0.1, 0.7, 0.7))) == 1 and one(N.one_hot(F.lit("z"), ["a", "b"])) == [0, 0, 1]
    assert one(N.append_new(arr("a"), F.lit("a"))) == ["a"] and one(N.keep_indices(arr("a", "b", "c"), arr(0, 2))) == ["a", "c"]
