"""A deck made here: inherited places and sizes, groups, the order of slides, and the titles that follow."""

import io
import zipfile

from pyspark.sql import functions as F

from quern.operators import layout
from quern.sources import slides

NS = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
PT = 12700


def shape(text, at=None, ph=None, size=None, bold=False, style="", size_at=(100, 20)):
    place = f'<a:xfrm><a:off x="{at[0] * PT}" y="{at[1] * PT}"/><a:ext cx="{size_at[0] * PT}" cy="{size_at[1] * PT}"/></a:xfrm>' if at else ""
    holder = f"<p:ph {ph}/>" if ph else ""
    attributes = (f' sz="{size * 100}"' if size else "") + (' b="1"' if bold else "")
    paragraphs = "".join(f"<a:p><a:r><a:rPr{attributes}/><a:t>{t}</a:t></a:r></a:p>" for t in text.split("|"))
    return f"<p:sp><p:nvSpPr><p:nvPr>{holder}</p:nvPr></p:nvSpPr><p:spPr>{place}</p:spPr><p:txBody><a:lstStyle>{style}</a:lstStyle>{paragraphs}</p:txBody></p:sp>"


def group(inner, off, ext, child_off, child_ext):
    x = lambda tag, v, names: f'<a:{tag} {names[0]}="{v[0] * PT}" {names[1]}="{v[1] * PT}"/>'
    return f"<p:grpSp><p:grpSpPr><a:xfrm>{x('off', off, 'xy')}{x('ext', ext, ('cx', 'cy'))}{x('chOff', child_off, 'xy')}{x('chExt', child_ext, ('cx', 'cy'))}</a:xfrm></p:grpSpPr>{inner}</p:grpSp>"


def level(size):
    return f'<a:lvl1pPr><a:defRPr sz="{size * 100}"/></a:lvl1pPr>'


def part(tag, shapes, more=""):
    return f"<p:{tag} {NS}><p:cSld><p:spTree>{''.join(shapes)}</p:spTree></p:cSld>{more}</p:{tag}>"


def rels(**targets):
    return '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{k}" Type="http://x/{kind}" Target="{t}"/>' for k, (kind, t) in targets.items()) + "</Relationships>"


def deck(some):
    """A presentation of these lists of shapes, whose files are numbered from the last."""
    files = {
        "ppt/slideLayouts/l.xml": part("sldLayout", [shape("t", ph='type="title"', at=(5, 7)), shape("b", ph='type="body" idx="3"', at=(5, 60), style=level(28)), shape("c", ph='type="body" idx="9"')]),
        "ppt/slideLayouts/_rels/l.xml.rels": rels(r1=("slideMaster", "../slideMasters/m.xml")),
        "ppt/slideMasters/m.xml": part("sldMaster", [shape("b", ph='type="body" idx="1"', at=(1, 90))], f"<p:txStyles><p:titleStyle>{level(44)}</p:titleStyle><p:bodyStyle>{level(20)}</p:bodyStyle></p:txStyles>"),
    }
    ids, refs = "", {}
    for k, shapes in enumerate(some):
        n = len(some) - k
        files[f"ppt/slides/slide{n}.xml"] = part("sld", shapes)
        files[f"ppt/slides/_rels/slide{n}.xml.rels"] = rels(r1=("slideLayout", "../slideLayouts/l.xml"))
        ids += f'<p:sldId id="{k}" r:id="s{k}"/>'
        refs[f"s{k}"] = ("slide", f"slides/slide{n}.xml")
    files["ppt/presentation.xml"], files["ppt/_rels/presentation.xml.rels"] = f"<p:presentation {NS}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>", rels(**refs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_places_sizes_and_titles_of_a_deck(spark):
    long = "Headingwithoutspaces" * 6  # many words would make it a sentence
    raw = deck([
        [shape("Body text", ph='type="body" idx="3"'), shape("The|Title", ph='type="title"'), shape("Largest", at=(0, 0), size=60)],
        [shape("small top", at=(0, 1), size=10), shape("Large Below", at=(0, 50), size=30, bold=True), shape("The sentence is not a title.", at=(0, 2), size=90), shape("12", at=(0, 0), size=99)],
        [shape(long, at=(0, 9), size=80), shape("Lower", at=(0, 40), size=20), shape("Upper", at=(0, 20), size=12)],
        [group(group(shape("In groups", at=(30, 40), size=9), (20, 20), (100, 100), (20, 20), (50, 50)), (100, 200), (50, 50), (0, 0), (100, 100)), shape("From the master", ph='type="body" idx="9"')],
        [shape("https://example.com", at=(0, 0)), shape("  ", at=(0, 0))],
    ])
    files = spark.createDataFrame([("a.pptx", raw), ("bad.pptx", b"no zip"), ("none.pptx", deck([]))], "path string, content binary")
    got = slides.blocks(files)
    assert sorted((r.path, r.status, r.error) for r in got.where("status <> 'OK'").collect()) == [("bad.pptx", "FAILED", "BadZipFile"), ("none.pptx", "EMPTY", None)]
    by = {r.text: r for r in got.where("status = 'OK'").collect()}
    assert (by["Body text"].x, by["Body text"].y, by["Body text"].font_size, by["Body text"].page_number) == (5, 60, 28, 1)
    assert (by["The Title"].kind, by["The Title"].y, by["The Title"].font_size) == ("SLIDE_TITLE", 7, 44)
    assert by["Large Below"].bold and not by["small top"].bold and by["small top"].width == 100
    inner = by["In groups"]  # (30 - 20) * 2 + 20 = 40, then halved and moved by 100
    assert (inner.grouped, inner.x, inner.y, inner.width, inner.height) == (True, 120, 230, 100, 20)
    assert (by["From the master"].y, by["From the master"].font_size, by["From the master"].grouped) == (90, 20, False)
    own = got.where("status = 'OK' AND NOT grouped").withColumn("document_id", F.col("path"))
    titles = {r.page_number: r.title for r in layout.slide_titles(own).collect()}
    assert titles == {1: "The Title", 2: "Large Below", 3: "Upper", 4: "From the master", 5: None}
