"""Text blocks of pptx slides with their places: what a shape doesn't say itself, its placeholder on the layout or the master does.

A slide's own text shapes count; shapes within groups have their place on the slide by the groups' transforms and say that they
are grouped. Slides come in the order of the presentation. A file that can't be read is a row with its status.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

_P, _A = "{http://schemas.openxmlformats.org/presentationml/2006/main}", "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R, _REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}", "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
#: English Metric Units of a point; the size of text that nothing gives one.
POINT, PLAIN = 12700, 18.0
TITLES = ("title", "ctrTitle")
SCHEMA = "path string, status string, error string, page_number int, block_id int, kind string, grouped boolean, text string, x double, y double, width double, height double, font_size double, bold boolean, italic boolean"
Box = tuple[float, float, float, float]


class Deck:
    """The parts of a presentation, each parsed once."""

    def __init__(self, raw: bytes):
        self.archive, self.parsed = zipfile.ZipFile(io.BytesIO(raw)), {}

    def part(self, name: str) -> ElementTree.Element:
        if name not in self.parsed:
            self.parsed[name] = ElementTree.fromstring(self.archive.read(name))
        return self.parsed[name]

    def targets(self, name: str) -> dict[str, tuple[str, str]]:
        """id: (kind, part) of what a part refers to."""
        folder, file = posixpath.split(name)
        try:
            found = self.part(f"{folder}/_rels/{file}.rels").iter(_REL)
        except KeyError:
            return {}
        return {r.get("Id"): (r.get("Type", "").rpartition("/")[2], posixpath.normpath(posixpath.join(folder, r.get("Target", ""))).lstrip("/")) for r in found}

    def slides(self) -> list[str]:
        refs = self.targets("ppt/presentation.xml")
        return [refs[s.get(f"{_R}id")][1] for s in self.part("ppt/presentation.xml").iter(f"{_P}sldId")]

    def above(self, name: str) -> list[ElementTree.Element]:
        """The layout of a slide, and its master."""
        out = []
        for kind in ("slideLayout", "slideMaster"):
            name = next((part for k, part in self.targets(name).values() if k == kind), None)
            if not name:
                break
            out.append(self.part(name))
        return out


def holder(shape: ElementTree.Element) -> tuple[str, str] | None:
    """Type and index of a placeholder."""
    ph = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
    return None if ph is None else (ph.get("type", "body"), ph.get("idx", ""))


def inherited(shape: ElementTree.Element, above: list[ElementTree.Element]) -> list[ElementTree.Element]:
    """The shape and the placeholders that it takes after: by index on the layout, by type else, and on the master."""
    out, own = [shape], holder(shape)
    for part in above if own else ():
        known = [(s, h) for s in part.iter(f"{_P}sp") if (h := holder(s))]
        alike = ("title", "ctrTitle") if own[0] in TITLES else (own[0], "body") if own[0] in ("subTitle", "obj") else (own[0],)
        found = next((s for s, h in known if own[1] and h[1] == own[1]), None)
        if found is None:
            found = next((s for s, h in known if h[0] in alike), None)
        if found is not None:
            out.append(found)
    return out


def box(shapes: list[ElementTree.Element]) -> Box | None:
    """Place and size, in points, of the first that has one."""
    for s in shapes:
        xfrm = s.find(f"{_P}spPr/{_A}xfrm")
        if xfrm is not None and (off := xfrm.find(f"{_A}off")) is not None and (ext := xfrm.find(f"{_A}ext")) is not None:
            return tuple(int(node.get(k, 0)) / POINT for node, k in ((off, "x"), (off, "y"), (ext, "cx"), (ext, "cy")))
    return None


def moved(place: Box, group: ElementTree.Element) -> Box:
    """A place within a group, on what the group lies on: the group's child frame is stretched over its own."""
    xfrm = group.find(f"{_P}grpSpPr/{_A}xfrm")
    if xfrm is None or any(xfrm.find(f"{_A}{k}") is None for k in ("off", "ext", "chOff", "chExt")):
        return place
    n = {k: [int(v) / POINT for v in xfrm.find(f"{_A}{k}").attrib.values()] for k in ("off", "ext", "chOff", "chExt")}
    scale = [own / inner if inner else 1.0 for own, inner in zip(n["ext"], n["chExt"], strict=True)]
    at = [n["off"][i] + (place[i] - n["chOff"][i]) * scale[i] for i in (0, 1)]
    return (*at, place[2] * scale[0], place[3] * scale[1])


def styled(run: ElementTree.Element | None, level: int, shapes: list[ElementTree.Element], above: list[ElementTree.Element], name: str) -> str | None:
    """An attribute of a run's characters: its own, else its level's in the list styles of the shape and those it takes after, else the master's for its kind of text."""
    if run is not None and run.get(name):
        return run.get(name)
    kind = holder(shapes[0])
    style = "titleStyle" if kind and kind[0] in TITLES else "bodyStyle" if kind else "otherStyle"
    lists = [s.find(f"{_P}txBody/{_A}lstStyle") for s in shapes] + [part.find(f"{_P}txStyles/{_P}{style}") for part in above]
    for node in lists:
        found = node.find(f"{_A}lvl{level + 1}pPr/{_A}defRPr") if node is not None else None
        if found is not None and found.get(name):
            return found.get(name)
    return None


def blocks_of(raw: bytes) -> Iterator[tuple]:
    """page, block, kind, grouped, text, x, y, width, height, font_size, bold, italic of each text shape that says something."""
    deck = Deck(raw)
    for page, name in enumerate(deck.slides(), 1):
        above, k = deck.above(name), 0
        waiting = [(shape, []) for shape in deck.part(name).find(f"{_P}cSld/{_P}spTree")]
        while waiting:
            shape, groups = waiting.pop(0)
            if shape.tag == f"{_P}grpSp":
                waiting[:0] = [(child, [shape, *groups]) for child in shape]
                continue
            body = shape.find(f"{_P}txBody") if shape.tag == f"{_P}sp" else None
            if body is None:
                continue
            chain = inherited(shape, above)
            paragraphs, sizes, bold, italic = [], [], False, False
            for p in body.iter(f"{_A}p"):
                level = p.find(f"{_A}pPr")
                level = int(level.get("lvl", 0)) if level is not None else 0
                runs = [r for r in p if r.tag in (f"{_A}r", f"{_A}fld")]
                paragraphs.append(" ".join("".join(t.text or "" for r in runs for t in r.iter(f"{_A}t")).split()))
                for r in runs:
                    own = r.find(f"{_A}rPr")
                    sizes.append(int(styled(own, level, chain, above, "sz") or PLAIN * 100) / 100)
                    bold |= styled(own, level, chain, above, "b") in ("1", "true")
                    italic |= styled(own, level, chain, above, "i") in ("1", "true")
            if text := " ".join(filter(None, paragraphs)):
                place = box(chain) or (0.0, 0.0, 0.0, 0.0)
                for g in groups:
                    place = moved(place, g)
                kind = holder(shape)
                yield page, k, "SLIDE_TITLE" if kind and kind[0] in TITLES else "SLIDE_CONTENT", bool(groups), text, *place, sum(sizes) / len(sizes) if sizes else 12.0, bold, italic
                k += 1


def blocks(uploads: DataFrame) -> DataFrame:
    """The text blocks of uploads(path, content) of pptx files."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.string()] * 3 + [pa.int32()] * 2 + [pa.string(), pa.bool_(), pa.string()] + [pa.float64()] * 5 + [pa.bool_()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    rows = [(path, "OK", None, *b) for b in blocks_of(raw.as_py())] or [(path, "EMPTY", *[None] * 13)]
                except Exception as e:  # a file that can't be read is a row, not a failed job
                    rows = [(path, "FAILED", type(e).__name__, *[None] * 12)]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return uploads.select("path", "content").mapInArrow(run, SCHEMA)
