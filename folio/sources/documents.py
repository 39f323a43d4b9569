"""Page documents to token rows: layout XML, zips of SVG pages, and the choice between them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX = pa.struct([(n, pa.float64()) for n in ("x", "y", "width", "height")])
TOKENS = pa.schema([
    ("doc_id", pa.string()), ("page_idx", pa.int32()), ("line_idx", pa.int32()), ("token_idx", pa.int32()), ("block_idx", pa.int32()), ("text", pa.string()), ("x_raw", pa.string()), ("bbox", BOX),
    ("font_size", pa.float64()), ("font_name", pa.string()), ("font_color", pa.string()), ("tags", pa.map_(pa.string(), pa.string())), ("page_width", pa.float64()), ("page_height", pa.float64()), ("error", pa.string()),
])
_BOX_SQL = "struct<x: double, y: double, width: double, height: double>"
TOKENS_SQL = f"doc_id string, page_idx int, line_idx int, token_idx int, block_idx int, text string, x_raw string, bbox {_BOX_SQL}, font_size double, font_name string, font_color string, tags map<string, string>, page_width double, page_height double, error string"

Reader = Callable[[bytes, int, int], Iterator[dict]]


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _number(v: str | None) -> float | None:
    try:
        return float(v) if v is not None else None
    except ValueError:
        return None


def _tags(e: ET.Element, bare: str | None = None) -> list[tuple[str, str]]:
    """Tags by scope key; the tag without a scope is under ''."""
    out = {}
    for k, v in e.attrib.items():
        name = k.rpartition("}")[2]
        if name == "tag":
            out[""] = v
        elif name.endswith("tag"):
            out[name] = v
    if bare:
        out[""] = bare
    return list(out.items())


def lxml_tokens(data: bytes, first: int = 0, last: int = 1 << 30) -> Iterator[dict]:
    """Tokens of layout XML, pages ``first`` to ``last`` - 1 (from 0); other pages are passed over unread."""
    root = ET.fromstring(data)
    for p, page in enumerate(e for e in root.iter() if _local(e) == "PAGE"):
        if not first <= p < last:
            continue
        blocks = {id(t): k for k, b in enumerate(e for e in page.iter() if _local(e) == "BLOCK") for t in b.iter()}
        for n, line in enumerate(e for e in page.iter() if _local(e) == "TEXT"):
            for t, token in enumerate(e for e in line if _local(e) == "TOKEN"):
                w, h = _number(token.get("width")), _number(token.get("height"))
                box = {"x": _number(token.get("x")) or 0.0, "y": _number(token.get("y")) or 0.0, "width": w, "height": h} if w is not None and h is not None else None
                yield {
                    "page_idx": p, "line_idx": n, "token_idx": t, "block_idx": blocks.get(id(line)), "text": token.text or "", "x_raw": token.get("x"), "bbox": box, "font_size": _number(token.get("font-size")),
                    "font_name": token.get("font-name"), "font_color": token.get("font-color"), "tags": _tags(token), "page_width": _number(page.get("width")), "page_height": _number(page.get("height")),
                }


def svg_page_tokens(data: bytes, page_idx: int) -> Iterator[dict]:
    """Tokens of an SVG page: texts in groups of class line, tags from classes."""
    root = ET.fromstring(data)
    view = [_number(v) for v in (root.get("viewBox") or "").split()]
    size = (view[2], view[3]) if len(view) == 4 else (None, None)
    lines = [e for e in root.iter() if _local(e) == "g" and "line" in (e.get("class") or "").split()]
    for n, line in enumerate(lines):
        for t, token in enumerate(e for e in line if _local(e) == "text"):
            text = token.text or ""
            given = next((v for k, v in token.attrib.items() if k.rpartition("}")[2] == "bounding-box"), None) or token.get("viewBox")
            font = _number(token.get("font-size"))
            x, y = _number(token.get("x")) or 0.0, _number(token.get("y")) or 0.0
            if given:
                box = dict(zip(("x", "y", "width", "height"), map(float, given.split()), strict=True))
            else:
                box = {"x": x, "y": y, "width": font * 0.8 * max(1, len(text)), "height": font} if font else None
            yield {"page_idx": page_idx, "line_idx": n, "token_idx": t, "block_idx": None, "text": text, "x_raw": token.get("x"), "bbox": box, "font_size": font, "font_name": token.get("font-family"), "font_color": token.get("fill"), "tags": _tags(token, token.get("class")), "page_width": size[0], "page_height": size[1]}


def svg_zip_tokens(data: bytes, first: int = 0, last: int = 1 << 30) -> Iterator[dict]:
    """Pages of a zip in the archive's order; those outside the range are not unpacked."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for p, name in enumerate(z.namelist()):
            if first <= p < last:
                yield from svg_page_tokens(z.read(name), p)


def tokens(files: DataFrame, pages: tuple[int, int] | None = None) -> DataFrame:
    """Token rows of files (path, content): zips are SVG pages, others layout XML. ``pages``: from 1, both included.

    A file that can't be read gives one row with its error and no token; the rest goes on.
    """
    first, last = (max(0, pages[0] - 1), pages[1]) if pages else (0, 1 << 30)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                read: Reader = svg_zip_tokens if path.endswith(".zip") else lxml_tokens
                try:
                    out = [t | {"doc_id": path, "error": None} for t in read(data, first, last)]
                except (ET.ParseError, zipfile.BadZipFile, ValueError) as e:
                    out = [{"doc_id": path, "error": str(e)}]
                for k in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_pylist(out[k : k + 10_000], schema=TOKENS)

    return files.select("path", "content").mapInArrow(rows, TOKENS_SQL)


def pages(token_rows: DataFrame) -> DataFrame:
    return token_rows.where("error IS NULL").groupBy("doc_id", "page_idx").agg(F.max("page_width").alias("width"), F.max("page_height").alias("height"))


def svg_of_page(rows: list[dict], width: float, height: float) -> str:
    """An SVG page of token rows: a line is a group, a tag a class; a white background first."""
    root = ET.Element("svg", {"xmlns": "http://www.w3.org/2000/svg", "viewBox": f"0 0 {width:g} {height:g}"})
    ET.SubElement(root, "rect", {"x": "0", "y": "0", "width": f"{width:g}", "height": f"{height:g}", "fill": "white", "class": "background"})
    line, group = None, root
    for r in rows:
        if r["line_idx"] != line:
            line, group = r["line_idx"], ET.SubElement(root, "g", {"class": "line"})
        b = r["bbox"] or {}
        at = {"x": str(b.get("x", 0)), "y": str(b.get("y", 0))}
        if r.get("font_size"):
            at["font-size"] = str(r["font_size"])
        if r["bbox"]:
            at["bounding-box"] = " ".join(str(b[n]) for n in ("x", "y", "width", "height"))
        if r.get("tag"):
            at["class"] = r["tag"]
        ET.SubElement(group, "text", at).text = r["text"]
    return ET.tostring(root, encoding="unicode")


def svg_pages(token_rows: DataFrame) -> DataFrame:
    """doc_id, page_idx, svg. A page's tokens are one group."""
    from folio.functions.tags import get_tag

    rows = token_rows.where("error IS NULL").withColumn("tag", get_tag("tags"))
    one = F.array_sort(F.collect_list(F.struct("line_idx", "token_idx", "text", "bbox", "font_size", "tag")))
    grouped = rows.groupBy("doc_id", "page_idx").agg(one.alias("t"), F.max("page_width").alias("w"), F.max("page_height").alias("h"))

    @F.udf("string", useArrow=True)
    def run(t, w, h):
        return svg_of_page([dict(x) if isinstance(x, dict) else x.asDict(True) for x in t], w or 0, h or 0)

    return grouped.select("doc_id", "page_idx", run("t", "w", "h").alias("svg"))


def styled_svg(svg: str) -> str:
    """The page with a style and a title for each tag."""
    from folio.functions.text import PALETTE
    import hashlib

    root = ET.fromstring(svg)
    nodes = [(e, t) for e in root.iter() if _local(e) == "text" for t in (e.get("class") or "").split()]
    colour = lambda t: PALETTE[int(hashlib.md5(t.encode()).hexdigest(), 16) % len(PALETTE)]
    style = ET.Element("style")
    style.text = "\n".join(f"text.{t} {{ fill: {colour(t)}; }}" for t in sorted({t for _, t in nodes}))
    root.insert(0, style)
    for e, t in nodes:
        ET.SubElement(e, "title").text = t
    return ET.tostring(root, encoding="unicode")
