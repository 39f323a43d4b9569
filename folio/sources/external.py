"""Adapters to programs and services that may be absent: one interface, a clear error, a timeout for each document."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: seconds for one document.
TIMEOUT = 20


def command(program: str, *args: str, suffix: str = ".pdf", timeout: float = TIMEOUT) -> Callable[[bytes], bytes]:
    """A converter that runs a program on a file (``{input}`` and ``{output}`` in args) and returns what it wrote.

    The files are the task's own and go with it. A missing program, a failure and an empty output raise.
    """

    def run(data: bytes) -> bytes:
        if shutil.which(program) is None:
            raise FileNotFoundError(f"{program} is not installed")
        with tempfile.TemporaryDirectory() as d:
            source, target = Path(d, f"input{suffix}"), Path(d, "output")
            source.write_bytes(data)
            subprocess.run([program, *(a.format(input=source, output=target) for a in args)], check=True, timeout=timeout, capture_output=True)
            out = target.read_bytes() if target.exists() else b""
        if not out:
            raise ValueError(f"{program} wrote nothing")
        return out

    return run


def converted(files: DataFrame, convert: Callable[[bytes], bytes]) -> DataFrame:
    """path, content, error of files put through a converter; errors are rows, so nothing else is lost."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    out.append((path, convert(data), None))
                except Exception as e:  # whatever a foreign program does is this row's error
                    out.append((path, None, f"{type(e).__name__}: {e}"))
            cols = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.string()), strict=True)], names=["path", "content", "error"])

    return files.select("path", "content").mapInArrow(rows, "path string, content binary, error string")


pdf_to_lxml = command("pdftoxml", "-blocks", "-noImage", "-noImageInline", "-fullFontName", "{input}", "{output}")


def pdf_pages(dpi: int | None = None, size: tuple[int, int] | None = None, pages: tuple[int, int] | None = None,
              longest: int | None = None, program: str = "pdftoppm", timeout: float = TIMEOUT) -> Callable[[bytes], list[bytes]]:
    """A converter of a PDF to PNG pages in order: pages from and to, both included; an exact size (width, height), the
    length of the longest side, or dpi.

    The document goes in by the program's standard input, pages come out as numbered files of the task's own folder.
    """
    args = ["-png"]
    if pages:
        args += ["-f", str(pages[0]), "-l", str(pages[1])]
    if size:
        args += ["-scale-to-x", str(size[0]), "-scale-to-y", str(size[1])]
    elif longest:
        args += ["-scale-to", str(longest)]
    elif dpi:
        args += ["-r", str(dpi)]

    def run(data: bytes) -> list[bytes]:
        if shutil.which(program) is None:
            raise FileNotFoundError(f"{program} is not installed")
        with tempfile.TemporaryDirectory() as d:
            subprocess.run([program, *args, "-", f"{d}/page"], input=data, check=True, timeout=timeout, capture_output=True)
            number = lambda p: int("".join(c for c in p.stem if c.isdigit()) or 0)
            return [p.read_bytes() for p in sorted(Path(d).iterdir(), key=number)]

    return run


def page_images(files: DataFrame, convert: Callable[[bytes], list[bytes]], first: int = 1) -> DataFrame:
    """path, page_no, png, error: a row per page; a file that can't be converted is one row with its error."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    out = [(path, first + k, png, None) for k, png in enumerate(convert(data))]
                except Exception as e:  # whatever a foreign program does is this row's error
                    out = [(path, None, None, f"{type(e).__name__}: {e}")]
                cols = zip(*out, strict=True) if out else ((), (), (), ())
                kinds = (pa.string(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["path", "page_no", "png", "error"])

    return files.select("path", "content").mapInArrow(rows, "path string, page_no int, png binary, error string")


def service(url: str, timeout: float = TIMEOUT) -> Callable[[bytes], bytes]:
    """A converter that posts to a service."""

    def run(data: bytes) -> bytes:
        from urllib.request import Request, urlopen

        with urlopen(Request(url, data=data, method="POST"), timeout=timeout) as r:
            return r.read()

    return run


_TEI = "{http://www.tei-c.org/ns/1.0}"


def _replaced(root: ET.Element, path: str, ask: Callable[[str], str], made: Callable[[ET.Element], list[ET.Element]]) -> None:
    """What a service says about the texts of all nodes at ``path``, in place of these nodes."""
    parent_path, _, tag = path.rpartition("/")
    nodes = root.findall(path)
    if not nodes:
        return
    answer = ET.fromstring(f"<answer>{ask(chr(10).join(n.text or '' for n in nodes))}</answer>")
    for parent in root.findall(parent_path):
        for n in parent.findall(tag):
            parent.remove(n)
    for node in made(answer):
        node.tag = tag
        root.find(parent_path).append(node)


def _named(tag: str, text: str | None) -> ET.Element:
    e = ET.Element(tag)
    e.text = text
    return e


def _people(answer: ET.Element) -> list[ET.Element]:
    out = []
    for person in answer.findall(f"{_TEI}persName"):
        node = ET.Element("author")
        node.extend(_named("surname", s.text) for s in person.findall(f"{_TEI}surname"))
        given = [f.text or "" for f in person.findall(f"{_TEI}forename")]
        if given:
            node.append(_named("given-names", " ".join(given)))
        out.append(node)
    return out


def _places(answer: ET.Element) -> list[ET.Element]:
    out = []
    for place in answer.findall("affiliation"):
        node = ET.Element("affiliation")
        for name in place.findall("orgName[@type='department']"):
            content = _named("named-content", name.text)
            content.set("content-type", "department")
            ET.SubElement(node, "addr-line").append(content)
        node.extend(_named("institution", name.text) for name in place.findall("orgName[@type='institution']"))
        out.append(node)
    return out


def enhanced(xml: bytes | str, names: Callable[[str], str], affiliations: Callable[[str], str]) -> bytes:
    """Article XML whose authors and affiliations are what services make of their texts, each asked once a document.

    ``names`` answers with TEI person names, ``affiliations`` with affiliations; both take the texts, one a line.
    """
    root = ET.fromstring(xml)
    _replaced(root, "front/article-meta/contrib-group/contrib", names, _people)
    _replaced(root, "front/article-meta/contrib-group/aff", affiliations, _places)
    return ET.tostring(root)
