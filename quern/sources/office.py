"""Pages of uploaded files: the bytes come through Spark's reader, each file is opened by itself, one that can't be read is a row too.

A document is read as its lines in order, each with its style, page and whether it is of a table; what is a heading or a
section is then decided on these rows. Formats: docx and pptx (zip archives of XML), html and plain text. A PDF or an
image needs a parser or OCR engine, which is passed as a function of (bytes) to lines; without one its status says so.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import files

Line = tuple[int, str, str, bool]  # page, style, text, whether it is a row of a table
SCHEMA = "path string, status string, error string, page_number int, pos int, style string, line string, is_table boolean"
_W, _A = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, content of a folder's files; a point read is a filter on path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "content")


def docx_lines(raw: bytes) -> Iterator[Line]:
    """Paragraphs with their style, rows of tables with their cells between bars; a page ends at an explicit break."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{_W}body")
    page = 1
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
    for block in body if body is not None else ():
        if block.tag == f"{_W}tbl":
            for row in block.iter(f"{_W}tr"):
                if any(cells := [text(c) for c in row.iter(f"{_W}tc")]):
                    yield page, "", " | ".join(cells), True
        elif block.tag == f"{_W}p":
            style = block.find(f"{_W}pPr/{_W}pStyle")
            if t := text(block):
                yield page, style.get(f"{_W}val", "") if style is not None else "", t, False
            page += sum(b.get(f"{_W}type") == "page" for b in block.iter(f"{_W}br"))


def pptx_lines(raw: bytes) -> Iterator[Line]:
    """The paragraphs of each slide, slides by number."""
    archive = zipfile.ZipFile(io.BytesIO(raw))
    slides = sorted((int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    for page, name in slides:
        for p in ElementTree.fromstring(archive.read(name)).iter(f"{_A}p"):
            if t := "".join(x.text or "" for x in p.iter(f"{_A}t")).strip():
                yield page, "", t, False


def html_lines(raw: bytes) -> Iterator[Line]:
    plain = re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", raw.decode("utf-8", "replace"))
    for tag, t in re.findall(r"(?is)<(h[1-6]|title|p|li|td|th|div)\b[^>]*>([^<]+)", plain):
        if t := " ".join(html.unescape(t).split()):
            yield 1, tag.lower(), t, tag.lower() in ("td", "th")


def text_lines(raw: bytes) -> Iterator[Line]:
    for page, part in enumerate(raw.decode("utf-8", "replace").split("\f"), 1):
        for t in part.splitlines():
            yield page, "", t.strip(), False


PARSERS: dict[str, Callable[[bytes], Iterator[Line]]] = {"docx": docx_lines, "pptx": pptx_lines, "html": html_lines, "htm": html_lines, "txt": text_lines, "md": text_lines}


def lines(uploads: DataFrame, more: dict[str, Callable[[bytes], Iterator[Line]]] | None = None) -> DataFrame:
    """The lines of uploads(path, content), by extension; further parsers can be given, in front of the own ones: if the first fails, the own one is tried. A file without a line has one row with its status: OK, EMPTY, NO_PARSER or FAILED."""
    first = more or {}

    def read(kind: str, raw: bytes) -> tuple[str, str | None, list[Line]]:
        found = [p for p in (first.get(kind), PARSERS.get(kind)) if p]
        error = None
        for parser in found:
            try:
                out = list(parser(raw))
                return ("OK" if out else "EMPTY"), None, out
            except Exception as e:  # a file that can't be read is a row, not a failed job
                error = type(e).__name__
        return ("FAILED" if found else "NO_PARSER"), error, []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
        for batch in batches:
            for path, kind, raw in zip(*(batch.column(c) for c in ("path", "extension", "content")), strict=True):
                status, error, found = read(kind.as_py(), raw.as_py())
                rows = [(path.as_py(), status, error, p, k, s, t, b) for k, (p, s, t, b) in enumerate(found)] or [(path.as_py(), status, error, None, None, None, None, None)]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return uploads.select("path", files.extension_of(F.col("path")).alias("extension"), "content").mapInArrow(run, SCHEMA)


def pages(parsed: DataFrame) -> DataFrame:
    """path, page_number, raw_text of parsed lines."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return parsed.where("status = 'OK'").groupBy("path", "page_number").agg(F.array_join(ordered, "\n").alias("raw_text"))


def style_level(style: Column) -> Column:
    """The level of a styled heading ('Heading 2', 'Heading2', 'h2': 2; 'Title': 1), null for other styles."""
    number = F.nullif(F.regexp_extract(style, r"(?i)^(?:heading ?|h)([1-9])$", 1), F.lit(""))
    return F.when(number.isNotNull(), number.cast("int")).when(F.lower(style) == "title", 1)
