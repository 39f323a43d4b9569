"""What a PDF says of its pages without being drawn: their media boxes, in points."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
_BOX = re.compile(rb"/MediaBox\s*\[([^\]]*)\]")


def _objects(pdf: bytes) -> dict[int, bytes]:
    """Objects by number, later ones over earlier; those packed in object streams are unpacked."""
    found = {int(m[1]): m[2] for m in _OBJECT.finditer(pdf)}
    for body in list(found.values()):
        if b"/ObjStm" not in body:
            continue
        head, _, data = body.partition(b"stream")
        first, n = (int(re.search(rb"/%s\s+(\d+)" % k, head)[1]) for k in (b"First", b"N"))
        data = data.lstrip(b"\r\n")
        plain = zlib.decompressobj().decompress(data) if b"FlateDecode" in head else data
        pairs = list(map(int, plain[:first].split()))[: 2 * n]
        places = pairs[1::2] + [len(plain) - first]
        for k, number in enumerate(pairs[::2]):
            found.setdefault(number, plain[first + places[k] : first + places[k + 1]])
    return found


def media_boxes(pdf: bytes) -> list[tuple[float, float, float, float]]:
    """x, y, width, height of each page in order; a page without a box of its own has its parent's."""
    objects = _objects(pdf)
    of = lambda name, body: [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", (re.search(rb"/%s\s*(\[[^\]]*\]|\d+\s+\d+\s+R)" % name, body) or [b"", b""])[1])]
    out: list[tuple[float, float, float, float]] = []

    def walk(number: int, box: bytes | None, above: frozenset[int]) -> None:
        body = objects.get(number, b"")
        if number in above:
            raise ValueError("a page is its own parent")
        own = _BOX.search(body)
        box = own[1] if own else box
        if re.search(rb"/Type\s*/Pages\b", body):
            for kid in of(b"Kids", body):
                walk(kid, box, above | {number})
        elif re.search(rb"/Type\s*/Page\b", body):
            x1, y1, x2, y2 = map(float, (box or b"0 0 612 792").split())
            out.append((min(x1, x2), min(y1, y2), abs(x2 - x1), abs(y2 - y1)))

    roots = [n for n, body in objects.items() if re.search(rb"/Type\s*/Pages\b", body) and not re.search(rb"/Parent\b", body)]
    if not roots:
        raise ValueError("no pages")
    for n in roots:
        walk(n, None, frozenset())
    return out


def page_boxes(files: DataFrame) -> DataFrame:
    """path, page_idx, x, y, width, height, error: a row a page of each PDF (path, content), or its error."""
    kinds = (pa.string(), pa.int32(), *[pa.float64()] * 4, pa.string())
    names = ["path", "page_idx", "x", "y", "width", "height", "error"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    out += [(path, k, *box, None) for k, box in enumerate(media_boxes(data or b""))]
                except Exception as e:  # whatever is wrong with one file is its row's error
                    out.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(rows, "path string, page_idx int, x double, y double, width double, height double, error string")
