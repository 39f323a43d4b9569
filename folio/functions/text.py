"""String columns: normalising, junk, white space, tokens, names and small formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The code points that separate tokens; each is a token of its own.
DELIMITERS = "\n\r\t\f\u00a0([ •*,:;?.!/)-−–‐\"“”‘’'`$]♦♥♣♠"
# Em and en dash, thin space and single quote, and what they are normalised to.
NORMALISE_FROM, NORMALISE_TO = "—–\u2009'", '-- "'
# White space that Python strips, as a regex class.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Colours for tags, by number.
PALETTE = ("maroon", "red", "purple", "#c0c", "green", "#0c0", "olive", "#cc0", "navy", "blue", "teal", "#0cc")


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def strip(column: Column | str) -> Column:
    """Without white space of any kind at its ends (``trim`` takes spaces only)."""
    return F.regexp_replace(_c(column), rf"^{SPACE}+|{SPACE}+$", "")


def rstrip(column: Column | str) -> Column:
    return F.regexp_replace(_c(column), rf"{SPACE}+$", "")


def normalise(column: Column | str) -> Column:
    """Lower case, plain dashes and spaces, one kind of quote."""
    return F.translate(F.replace(F.lower(_c(column)), F.lit("&apos;"), F.lit("'")), NORMALISE_FROM, NORMALISE_TO)


JUNK = r"(?s)(?<=\.)[ ,]|(?<=\p{L})\.|(?<=(.))\1|\*"
DOT_JUNK = r"\."


def remove_junk(column: Column | str, junk: str = JUNK) -> Column:
    """Without a space or comma after a dot, a dot after a letter, a repeat of the character before, and stars."""
    return F.regexp_replace(_c(column), junk, "")


def normalise_and_remove_junk(column: Column | str) -> Column:
    return remove_junk(normalise(column))


def strip_whitespace(column: Column | str) -> Column:
    """Tabs to spaces, carriage returns to line feeds; runs of either collapse; no spaces around line feeds."""
    out = _c(column)
    for pattern, to in (("\t", " "), (" {2,}", " "), ("\r", "\n"), (" +\n", "\n"), ("\n +", "\n"), ("\n{2,}", "\n")):
        out = F.regexp_replace(out, pattern, to)
    return out


def apply_pattern(column: Column | str, pattern: str) -> Column:
    """Group 1 of a match at the start, else the value."""
    c, anchored = _c(column), f"^(?:{pattern})"
    return F.when(c.rlike(anchored), F.regexp_extract(c, anchored, 1)).otherwise(c)


def extract_with_regex(value: str, pattern: str) -> list[str]:
    """Group 1 of every match and what stands between the groups, stripped, and last the whole value.

    A piece starts one character after the group before it, as in the conversions this must agree with. A value without
    a match, or that is one piece in all, comes alone. Matches in which the group has no part are passed over.
    """
    groups = [m.span(1) for m in re.finditer(pattern, value) if m.start(1) >= 0]
    if not groups:
        return [value]
    starts = [0, *(stop + 1 for _, stop in groups)]
    pieces = []
    for at, (start, stop) in zip(starts, [*groups, (len(value), None)], strict=True):
        if at < start:
            pieces.append(value[at:start].strip())
        if stop is not None:
            pieces.append(value[start:stop])
    return pieces if len(pieces) == 1 else [*pieces, value]


def extract_with_regex_udf(pattern: str):
    """The same as an Arrow UDF, since positions of groups are not to be had from built-in functions."""

    @F.udf(T.ArrayType(T.StringType()), useArrow=True)
    def run(value):
        return None if value is None else extract_with_regex(value, pattern)

    return run


def _class(chars: str) -> str:
    return "".join(f"\\u{ord(c):04x}" for c in chars)


def _token_pattern() -> str:
    """A run of characters that are no delimiters and not all white space, or a delimiter that is not white space.

    Common characters come first, one by one in classes of Latin-1 alone, which the regex engine looks up in a bit set;
    white space before a token is passed over inside the match.
    """
    every, solid = _class(DELIMITERS), _class("".join(c for c in DELIMITERS if not c.isspace()))
    blank = SPACE[1:-1]
    plain = _class("".join(c for c in map(chr, range(33, 256)) if c not in DELIMITERS and not c.isspace()))
    run = f"(?:[{plain}]++|[^{every}{blank}])(?:[{plain}]++|[^{every}])*+"
    return f"[ \\n]*+({run}|[{solid}]|[{blank}&&[^{every}]]++{run})"


TOKEN = _token_pattern()


def tokenise(column: Column | str) -> Column:
    """Tokens in order: delimiters are kept as tokens, blank tokens are not. One pass of one pattern."""
    c = _c(column)
    ended = F.when(F.right(c, F.lit(1)).rlike(SPACE), rstrip(c)).otherwise(c)
    return F.regexp_extract_all(ended, F.lit(TOKEN), F.lit(1))


def is_upper(column: Column) -> Column:
    """At least one cased character, and none of them lower."""
    return (F.upper(column) == column) & (F.lower(column) != column)


def is_title(column: Column) -> Column:
    """Words of letters start upper and go on lower, and there is at least one."""
    return column.rlike(r"\p{Lu}") & ~column.rlike(r"(?<!\p{L})\p{Ll}|(?<=\p{L})\p{Lu}")


def is_digit(column: Column) -> Column:
    return column.rlike(r"^\p{Nd}+$")


def token_features(column: Column | str) -> dict[str, Column]:
    """Features of a token for sequence models."""
    c = _c(column)
    return {
        "word.lower": F.lower(c),
        "word[:1]": F.substring(c, 1, 1),
        "word[-3:]": F.substring(c, -3, 3),
        "word[-2:]": F.substring(c, -2, 2),
        "word[:1].isupper": is_title(F.substring(c, 1, 1)),
        "word.isupper": is_upper(c),
        "word.isdigit": is_digit(c),
    }


def char_features(column: Column | str) -> dict[str, Column]:
    c = _c(column)
    return {"lower": F.lower(c), "isupper": is_upper(c), "istitle": is_title(c), "isdigit": is_digit(c)}


def clean_author(column: Column | str) -> Column:
    """Without trailing commas, plus signs, stars and digits, each with a dot after it or not."""
    return F.regexp_replace(_c(column), r"(?:[,+*0-9][.]?)+$", "")


def colour_for_tag(column: Column | str, colours: tuple[str, ...] = PALETTE) -> Column:
    """A palette colour by the tag's MD5 as one number, modulo the palette's size; folded digit by digit."""
    digits = F.split(F.md5(F.encode(_c(column), "UTF-8")), "(?<=.)(?=.)")
    number = F.aggregate(digits, F.lit(0), lambda acc, d: ((acc * 16 + F.conv(d, 16, 10).cast("int")) % len(colours)).cast("int"))
    return F.element_at(F.array(*[F.lit(c) for c in colours]), number + 1)


def path_head(column: Column | str) -> Column:
    return F.regexp_extract(_c(column), "^(?:(.*)/)?([^/]*)$", 1)


def path_tail(column: Column | str) -> Column:
    return F.regexp_extract(_c(column), "^(?:(.*)/)?([^/]*)$", 2)


def skip_whitespace(column: Column | str, start: Column | int) -> Column:
    """The index, from 0, of the first character from ``start`` on that is not white space; the length if there is none."""
    c, at = _c(column), start if isinstance(start, Column) else F.lit(start)
    rest = F.substring(c, at + 1, F.length(c))
    return F.length(c) - F.length(F.regexp_replace(rest, rf"^{SPACE}+", ""))


def to_bool(column: Column | str) -> Column:
    return F.lower(_c(column)).isin("yes", "true", "on", "1")


def to_list(column: Column | str) -> Column:
    """Comma-separated values, stripped; blank is an empty list."""
    c = _c(column)
    return F.when(strip(c) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(c, ","), strip))


def first_token(column: Column | str) -> Column:
    return F.substring_index(_c(column), " ", 1)


def colour_literal(column: Column | str) -> Column:
    """``n`` or ``(r, g, b)`` as a struct of three channels; null if neither."""
    c = strip(column)
    number = F.regexp_extract(c, r"^(\d+)$", 1)
    part = lambda k: F.regexp_extract(c, r"^\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)$", k)
    grey = F.struct(*[number.cast("int").alias(x) for x in "rgb"])
    rgb = F.struct(*[part(k).cast("int").alias(x) for k, x in enumerate("rgb", 1)])
    return F.when(number != "", grey).when(part(1) != "", rgb)


def page_uri(name: Column, page: Column, annotated: bool = False) -> Column:
    return F.concat(name, F.lit(".annot#page" if annotated else "#page"), page.cast("string"))


def page_image_name(page: Column) -> Column:
    return F.format_string("/page_%05d.jpg", page)


def annotated_extension(crf: Column, cv: Column) -> Column:
    """The output extension of the models that are on; at least one must be."""
    return F.when(crf & cv, ".crf-cv.lxml.gz").when(crf, ".crf.lxml.gz").when(cv, ".cv.lxml.gz").otherwise(F.raise_error(F.lit("neither model is on")).cast("string"))


def format_metrics(**values: Column) -> Column:
    """``name: value`` with three digits, joined by commas."""
    return F.concat_ws(", ", *[F.format_string(f"{k}: %.3f", v.cast("double")) for k, v in values.items()])


def parse_page_range(text: str | None) -> tuple[int, int] | None:
    """``a`` or ``a-b``, from 1; blank is no range."""
    if not text or not text.strip():
        return None
    first, *rest = (int(x) for x in text.split("-"))
    if len(rest) > 1:
        raise ValueError(f"not a page range: {text}")
    return first, rest[0] if rest else first
