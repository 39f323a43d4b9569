"""Tags: begin/inside prefixes, scopes and levels. A token's tags are a map from scope key to tag; '' is no scope."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_PREFIXED = r"^(b-|i-)?(.*)$"


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def tag_prefix(tag: Column | str) -> Column:
    """``b``, ``i`` or null."""
    t = _c(tag)
    found = F.regexp_extract(t, _PREFIXED, 1)
    return F.when(_in_lines(t), F.when(found != "", F.substring(found, 1, 1))).when(_prefixed(t), F.substring(t, 1, 1))


def tag_value(tag: Column | str) -> Column:
    t = _c(tag)
    return F.when(_in_lines(t), F.regexp_extract(t, _PREFIXED, 2)).when(_prefixed(t), F.substring(t, 3, 1 << 30)).otherwise(t)


def _prefixed(tag: Column) -> Column:
    return tag.startswith("b-") | tag.startswith("i-")


def _in_lines(tag: Column) -> Column:
    """Has the tag an end of a line, where a pattern says less than its beginning? Patterns are slow, so no other tag meets one."""
    return reduce(or_, [tag.contains(c) for c in "\n\r\x85\u2028\u2029"])


def with_prefix(tag: Column | str, prefix: Column | str | None) -> Column:
    p = F.lit(None) if prefix is None else F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.when(p.isNull() | (p == ""), _c(tag)).otherwise(F.concat_ws("-", p, _c(tag)))


def scope_key(name: str = "tag", scope: str | None = None, level: int | None = None) -> str:
    """The attribute that holds a tag: scope, then level, then name."""
    level_part = f"level{level}_" if level and level > 1 else ""
    return f"{scope}-{level_part}{name}" if scope else f"{level_part}{name}"


def get_tag(tags: Column | str, key: str = "") -> Column:
    return F.try_element_at(_c(tags), F.lit(key))


def set_tag(tags: Column | str, value: Column, key: str = "") -> Column:
    """With the tag set; a null value removes it."""
    others = F.map_filter(_c(tags), lambda k, _: k != key)
    return F.when(value.isNull(), others).otherwise(F.map_concat(others, F.create_map(F.lit(key), value)))


def by_scope(attributes: Column | str, name: str = "tag") -> Column:
    """The values of ``name`` by scope: ``crf-tag`` gives ``crf``, ``tag`` gives ''."""
    held = F.map_filter(_c(attributes), lambda k, _: (k == name) | k.endswith(f"-{name}"))
    return F.transform_keys(held, lambda k, _: F.when(k == name, F.lit("")).otherwise(F.regexp_replace(k, f"-{name}$", "")))


def prefixed_values(values: Column | str, prefix: str) -> Column:
    """Entries whose key starts with ``prefix``, which is taken off."""
    held = F.map_filter(_c(values), lambda k, _: k.startswith(prefix))
    return F.transform_keys(held, lambda k, _: F.substring(k, len(prefix) + 1, 1 << 20))


def extended_colours(colours: dict[str, int], tags: list[str]) -> dict[str, int]:
    """Colour numbers with one more for each tag that has none, from the largest on (from 1), in the order of ``tags``."""
    out = dict(colours)
    for tag in tags:
        out.setdefault(tag, max(out.values(), default=0) + 1)
    return out


def label(tag: Column | str) -> Column:
    """The tag, or O where there is none."""
    return F.coalesce(F.nullif(_c(tag), F.lit("")), F.lit("O"))
