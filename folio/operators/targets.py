"""Target values from structured XML by a mapping: fields with paths, and suffixes that say how values are made.

A mapping is read from INI text, one section per root tag. Parsing runs row by row in Arrow batches: one XML at a time.
"""

from __future__ import annotations

import configparser
import json
import re
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.text import extract_with_regex
from folio.functions.xpath import select

SUB = "array<struct<name: string, value: array<string>>>"
SCHEMA = f"doc_id string, target_ord int, name string, value array<string>, is_list boolean, match_multiple boolean, bonding boolean, require_next boolean, sub {SUB}, error string"
_ARROW = pa.schema([
    ("doc_id", pa.string()), ("target_ord", pa.int32()), ("name", pa.string()), ("value", pa.list_(pa.string())), ("is_list", pa.bool_()), ("match_multiple", pa.bool_()),
    ("bonding", pa.bool_()), ("require_next", pa.bool_()), ("sub", pa.list_(pa.struct([("name", pa.string()), ("value", pa.list_(pa.string()))]))), ("error", pa.string()),
])


def parse_mapping(ini: str) -> dict[str, dict[str, str]]:
    parser = configparser.ConfigParser(interpolation=None)
    parser.read_string(ini)
    return {s: dict(parser.items(s)) for s in parser.sections()}


def stripped(text: str) -> str:
    """White space in its plain form; the same as the column function, for values met in here."""
    for pattern, to in (("\t", " "), (" {2,}", " "), ("\r", "\n"), (" +\n", "\n"), ("\n +", "\n"), ("\n{2,}", "\n")):
        text = re.sub(pattern, to, text)
    return text.strip()


def content(node: ET.Element, but: frozenset[int] = frozenset()) -> str:
    """Text of a node and all below, without what is inside nodes of ``but`` (their tails stay)."""

    def parts(e: ET.Element) -> Iterator[str]:
        if id(e) not in but:
            yield e.text or ""
            for c in e:
                yield from parts(c)
                yield c.tail or ""

    return stripped("".join(parts(node)))


def leaves(nodes: Iterable[ET.Element]) -> tuple[list[ET.Element], list[ET.Element]]:
    """Nodes that hold no other of them, and those that do."""
    nodes = list(nodes)
    chosen = {id(n) for n in nodes}
    holds = lambda n: any(id(c) in chosen and c is not n for c in n.iter())
    return [n for n in nodes if not holds(n)], [n for n in nodes if holds(n)]


def own_texts(node: ET.Element) -> list[str]:
    """The node's immediate texts: before its first child and after each."""
    texts = [node.text, *(c.tail for c in node)]
    return [s for t in texts if t and (s := stripped(t))]


def _concat(parent: ET.Element, sources: list[dict]) -> tuple[str | None, list[ET.Element]]:
    """The joined parts, and nodes used; None if a path finds nothing."""
    parts, used = [], []
    for source in sources:
        if "value" in source:
            parts.append(source["value"])
            continue
        nodes, _ = leaves(select(parent, source["xpath"]))
        if not nodes:
            return None, []
        used += nodes
        parts.append(" ".join(content(n) for n in nodes))
    return "".join(parts), used


def _range(parent: ET.Element, spec: dict) -> tuple[list[str], list[ET.Element]]:
    low, used_low = _concat(parent, [spec["min"]])
    high, used_high = _concat(parent, [spec["max"]])
    if low is None or high is None or not low.isdigit() or not high.isdigit():
        return [], []
    return [str(n) for n in range(int(low), int(high) + 1)], used_low + used_high


def children_values(parent: ET.Element, paths: list[str], concat: list, ranges: list, unmatched: bool) -> tuple[list[str], list[str]]:
    """Values of children, and values that stand alone."""
    joined, numbers, alone, used = [], [], [], set()
    for sources in concat:
        value, nodes = _concat(parent, sources)
        if value is not None:
            joined.append(value)
            used |= {id(n) for n in nodes}
    for spec in ranges:
        values, nodes = _range(parent, spec)
        (alone if spec.get("standalone") else numbers).extend(values)
        used |= {id(n) for n in nodes}
    nodes = [n for p in paths for n in select(parent, p)]
    own, parents = leaves(dict.fromkeys(nodes))
    own = [n for n in own if id(n) not in used]
    values = [t for n in own if (t := content(n))]
    values += [t for n in parents for t in own_texts(n)]
    values += joined + numbers
    if unmatched:
        rest = content(parent, frozenset(used | {id(n) for n in own} | {id(n) for n in parents}))
        if rest and rest not in values:
            values.append(rest)
    return values, alone


def _regex(value: str, pattern: str | None, extract: str | None) -> list[str]:
    """A value as its patterns leave it: group 1 of a match at the start first, then the pieces of an extraction."""
    if pattern and (m := re.match(pattern, value)):
        value = m.group(1) or ""
    if not value:
        return []
    return extract_with_regex(value, extract) if extract else [value]


def _sub(node: ET.Element, fields: dict[str, str], key: str) -> list[dict]:
    out = []
    prefix = f"{key}.sub."
    for name, path in fields.items():
        if name.startswith(prefix) and "." not in name[len(prefix) :]:
            extract = fields.get(f"{name}.extract-regex")
            for n in select(node, path):
                values = _regex(content(n), None, extract)
                if values:
                    out.append({"name": name[len(prefix) :], "value": values})
    return out


def targets_of(root: ET.Element, mapping: dict[str, dict[str, str]]) -> list[dict]:
    """Targets of a document, by priority (higher first), place in the document, and place in a range."""
    tag = root.tag.rpartition("}")[2]
    if tag not in mapping:
        raise ValueError(f"no mapping for <{tag}>; there are {', '.join(sorted(mapping))}")
    fields, place = mapping[tag], {id(e): k for k, e in enumerate(root.iter())}
    out = []
    for ordinal, key in enumerate(k for k in fields if "." not in k):
        get = lambda suffix: fields.get(f"{key}.{suffix}")  # noqa: B023, E731
        on = lambda suffix: get(suffix) == "true"
        paths = lambda text: [p for p in (x.strip() for x in (text or "").splitlines()) if p]
        children, concat, ranges = paths(get("children")), json.loads(get("children.concat") or "[]"), json.loads(get("children.range") or "[]")
        priority = int(get("priority") or 0)
        flags = {"match_multiple": on("match-multiple"), "bonding": on("bonding")}
        for path in paths(fields[key]):
            for node in select(root, path):
                if children:
                    texts, alone = children_values(node, children, concat, ranges, on("unmatched-parent-text"))
                else:
                    texts, alone = [content(node)], []
                values = [v for t in texts for v in _regex(t, get("regex"), get("extract-regex"))]
                at = (-priority, place[id(node)])
                base = {"name": key, **flags, "sub": _sub(node, fields, key)}
                if values:
                    order = sorted(values, key=len, reverse=True) if len(values) > 1 else values
                    out.append((*at, -1, ordinal, base | {"value": order, "is_list": len(order) > 1, "require_next": on("require-next")}))
                for i, v in enumerate(alone):
                    out.append((*at, i, ordinal, base | {"value": [v], "is_list": False, "require_next": False}))
    out.sort(key=lambda t: t[:4])
    return [t[4] for t in out]


def parse_xml(data: str | bytes) -> ET.Element:
    """Parsed after white space at the start is taken off and a dagger entity resolved."""
    text = data.decode("utf-8", "replace") if isinstance(data, bytes) else data
    return ET.fromstring(text.lstrip().replace("&dagger;", "&#x2020;"))


def targets(xmls: DataFrame, mapping: dict[str, dict[str, str]], id_col: str = "doc_id", xml_col: str = "xml") -> DataFrame:
    """A row per target of each XML; one that can't be read gives one row with its error, and the rest goes on."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, xml in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found = targets_of(parse_xml(xml or ""), mapping)
                except (ET.ParseError, ValueError) as e:
                    out.append({"doc_id": doc, "error": str(e)})
                    continue
                out += [t | {"doc_id": doc, "target_ord": k, "error": None} for k, t in enumerate(found)]
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return xmls.select(F.col(id_col).cast("string").alias("doc_id"), F.col(xml_col)).mapInArrow(rows, SCHEMA)


# Where items go in the XML that is made of them, and the tags that go there.
FIELD_PATHS = {
    "manuscript_title": ("front/article-meta/title-group/article-title", True),
    "abstract": ("front/article-meta/abstract", True),
    "author": ("front/article-meta/contrib-group/contrib", False),
    "author_aff": ("front/article-meta/contrib-group/aff", False),
}
SUB_PATHS = {"author": {"surname": "name/surname", "givennames": "name/given-names"}}


def _made(root: ET.Element, path: str) -> ET.Element:
    """A new node at the end of a path, whose parents are made if they are missing."""
    *parents, last = path.split("/")
    at = root
    for p in parents:
        found = at.find(p)
        at = ET.SubElement(at, p) if found is None else found
    return ET.SubElement(at, last)


def items_to_xml(items: list[dict]) -> bytes:
    """Items (tag, text, sub_items: tag, text) as article XML.

    A field with one node takes the first item of its tag, and those that follow an item of the same tag, on new lines.
    Tags without a place are passed over, and don't count as the item before.
    """
    author_text = lambda s: re.sub(r"(?:[,+*0-9][.]?)+$", "", s)
    root, last = ET.Element("article"), None
    for item in items:
        if not item["tag"] or item["tag"] not in FIELD_PATHS:
            continue
        path, single = FIELD_PATHS[item["tag"]]
        clean = author_text if item["tag"] == "author" else str
        if single:
            node = root.find(path)
            if node is None:
                _made(root, path).text = clean(item["text"])
            elif last == item["tag"]:
                node.text = f"{node.text}\n{clean(item['text'])}"
        else:
            node = _made(root, path)
            if item["tag"] == "author":
                node.set("contrib-type", "author")
            subs = [s for s in item.get("sub_items") or () if s["tag"]]
            if subs and item["tag"] in SUB_PATHS:
                for s in subs:
                    if s["tag"] in SUB_PATHS[item["tag"]]:
                        _made(node, SUB_PATHS[item["tag"]][s["tag"]]).text = clean(s["text"])
            else:
                node.text = clean(item["text"])
        last = item["tag"]
    return ET.tostring(root)


def documents_xml(items: DataFrame) -> DataFrame:
    """doc_id, xml from items (doc_id, item_ord, tag, text, sub_items): the items of one document come together."""
    ordered = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("item_ord", "tag", "text", "sub_items"))).alias("items"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([items_to_xml(x).decode() for x in b.column(1).to_pylist()])], names=["doc_id", "xml"])

    kind = items.schema["doc_id"].dataType.simpleString()
    return ordered.select("doc_id", "items").mapInArrow(rows, f"doc_id {kind}, xml string")


def graphics(root: ET.Element, directory: str = "") -> list[dict]:
    """Graphics of an XML: href, path, category and id of the nearest ancestor that has them."""
    up = {id(c): p for p in root.iter() for c in p}
    out = []
    for e in select(root, "//graphic"):
        href = next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == "href"), None)
        ancestors, at = [], e
        while (at := up.get(id(at))) is not None:
            ancestors.append(at)
        kind = next((a.tag for a in ancestors if a.tag in ("fig", "table-wrap", "disp-formula", "inline-formula", "boxed-text")), None)
        out.append({"href": href, "path": f"{directory}/{href}" if directory else href, "category": "table" if kind == "table-wrap" else "figure" if kind == "fig" else kind or "other", "related_id": next((a.get("id") for a in ancestors if a.get("id")), None)})
    return out


def documents_with_coords(xmls: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, xml: each document's XML with the places of its graphics; documents without any come back as they parse.

    ``xmls``: doc_id, xml. ``found``: doc_id, href, page_no, x, y, width, height. A null XML stays null.
    """
    box = F.struct("page_no", "x", "y", "width", "height")
    places = found.groupBy("doc_id", "href").agg(F.array_sort(F.collect_list(box)).alias("at")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("href", "at"))).alias("at"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for xml, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                boxes = {href: [tuple(p.values()) for p in places] for href, places in (at or ())}
                out.append(None if xml is None else with_coords(xml, boxes))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "xml"])

    kind = xmls.schema["doc_id"].dataType.simpleString()
    return xmls.select("doc_id", "xml").join(places, "doc_id", "left").mapInArrow(rows, f"doc_id {kind}, xml string")


def with_coords(xml: str, boxes: dict[str, list[tuple[int, float, float, float, float]]]) -> str:
    """The XML with a coords attribute on graphics, by href: page, x, y, width, height of each box."""
    root = parse_xml(xml)
    for e in select(root, "//graphic"):
        href = next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == "href"), None)
        if href in boxes:
            e.set("coords", ";".join(",".join(str(v) for v in b) for b in boxes[href]))
    return ET.tostring(root, encoding="unicode")
