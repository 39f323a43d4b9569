"""A small XPath over the standard library's trees: what the mapping language needs and ElementTree lacks.

Unions, ``.``, ``..`` excluded, ``/``, ``//``, ``*``, names and prefixed names, and predicates on attributes with ``=``,
``not()``, ``and``, ``or``. Results come in document order without repeats, one union at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from xml.etree.ElementTree import Element

_TOKEN = re.compile(r"\s*(not\(|\)|\(|and\b|or\b|=|@[\w:.-]+|\"[^\"]*\"|'[^']*')")
Predicate = Callable[[Element], bool]


def _predicate(text: str) -> Predicate:
    """Recursive descent: or, and, not() or an attribute with or without a value."""
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"predicate not understood: {text}")
        tokens.append(m.group(1))
        at = m.end()
    pos = 0

    def take(kind: str) -> bool:
        nonlocal pos
        if pos < len(tokens) and tokens[pos] == kind:
            pos += 1
            return True
        return False

    def either() -> Predicate:
        parts = [both()]
        while take("or"):
            parts.append(both())
        return lambda e: any(p(e) for p in parts)

    def both() -> Predicate:
        parts = [single()]
        while take("and"):
            parts.append(single())
        return lambda e: all(p(e) for p in parts)

    def single() -> Predicate:
        nonlocal pos
        if take("not("):
            inner = either()
            take(")")
            return lambda e: not inner(e)
        if take("("):
            inner = either()
            take(")")
            return inner
        name = tokens[pos][1:]
        pos += 1
        if take("="):
            value = tokens[pos][1:-1]
            pos += 1
            return lambda e: e.get(name) == value
        return lambda e: name in e.attrib

    return either()


def _split(text: str, mark: str) -> list[str]:
    """At ``mark``, but not inside brackets or quotes."""
    out, depth, quote, part = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[(":
            depth += 1
        elif c in "])":
            depth -= 1
        elif c == mark and not depth:
            out.append(part)
            part = ""
            continue
        part += c
    return [*out, part]


@lru_cache(maxsize=4096)
def _steps(path: str) -> tuple[tuple[bool, str, tuple[Predicate, ...]], ...]:
    """(at any depth, name, predicates) of each step."""
    out, deep = [], False
    parts = _split(path.strip(), "/")
    if parts[0] == "":  # from the root
        parts = parts[1:]
    for part in parts:
        if part == "":
            deep = True
            continue
        name, *rest = re.split(r"(?=\[)", part, maxsplit=1)
        tests = tuple(_predicate(p) for p in re.findall(r"\[((?:[^\[\]\"']|\"[^\"]*\"|'[^']*')*)\]", rest[0])) if rest else ()
        if name != "." or tests:
            out.append((deep, name, tests))
            deep = False
    return tuple(out)


def _named(e: Element, name: str) -> bool:
    if not isinstance(e.tag, str):
        return False
    return name in ("*", e.tag) or e.tag.startswith("{") and e.tag.rpartition("}")[2] == name.rpartition(":")[2]


def select(node: Element, xpath: str) -> list[Element]:
    """Nodes that a path, or a union of paths, selects from ``node``."""
    found: dict[int, Element] = {}
    for path in _split(xpath, "|"):
        now = [node]
        for deep, name, tests in _steps(path):
            nxt: dict[int, Element] = {}
            for e in now:
                for c in e.iter() if deep else [e] if name == "." else e:
                    if (not deep or c is not e) and (name == "." or _named(c, name)) and all(t(c) for t in tests):
                        nxt[id(c)] = c
            now = list(nxt.values())
        found |= {id(e): e for e in now}
    if len(found) > 1:
        place = {id(e): k for k, e in enumerate(node.iter())}
        return sorted(found.values(), key=lambda e: place.get(id(e), -1))
    return list(found.values())
