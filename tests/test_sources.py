"""Uploaded files of each format as lines and pages; model providers."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.sources import views as V
from quern.functions import providers
from quern.sources import office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def archive(path, **parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/"), body)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("uploads")
    p = lambda t, style="": f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"
    body = p("Report", "Title") + p("Scope", "Heading2") + p("all of it") + f"<w:tbl>{row('a', 'b')}{row('', '')}{row('1', '2')}</w:tbl>" + '<w:p><w:r><w:br w:type="page"/></w:r></w:p>' + p("second page")
    archive(d / "a.docx", **{"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})
    slide = lambda *ts: f"<x {A}>" + "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in ts) + "</x>"
    archive(d / "b.pptx", **{"ppt/slides/slide10.xml": slide("ten"), "ppt/slides/slide2.xml": slide("two", " ", "more")})
    (d / "c.html").write_text("<html><style>p{}</style><h1>Head &amp; more</h1><p>para</p><script>x</script>")
    (d / "d.txt").write_text("one\ntwo\fthree")
    (d / "e.docx").write_bytes(b"not a zip")
    (d / "f.pdf").write_bytes(b"%PDF-1.4")
    return str(d)


def test_lines_and_pages_of_uploads(spark, folder):
    parsed = office.lines(office.contents(spark, folder)).cache()
    by = {}
    for r in parsed.orderBy("path", "pos").collect():
        by.setdefault(r.path[-6:], []).append((r.status, r.page_number, r.style, r.line, r.is_table))
    assert by["a.docx"] == [("OK", 1, "Title", "Report", False), ("OK", 1, "Heading2", "Scope", False), ("OK", 1, "", "all of it", False), ("OK", 1, "", "a | b", True), ("OK", 1, "", "1 | 2", True), ("OK", 2, "", "second page", False)]
    assert [x[1:4:2] for x in by["b.pptx"]] == [(2, "two"), (2, "more"), (10, "ten")]
    assert [x[2:4] for x in by["c.html"]] == [("h1", "Head & more"), ("p", "para")]
    assert by["e.docx"] == [("FAILED", None, None, None, None)] and by["/f.pdf"] == [("NO_PARSER", None, None, None, None)]
    text = {(r.path[-5:], r.page_number): r.raw_text for r in office.pages(parsed).collect()}
    assert text["d.txt", 1] == "one\ntwo" and text["d.txt", 2] == "three" and text[".docx", 2] == "second page"
    levels = {r.line: r.level for r in parsed.select("line", office.style_level(F.col("style")).alias("level")).where("level is not null").collect()}
    assert levels == {"Report": 1, "Scope": 2, "Head & more": 1}


def test_a_given_parser_comes_first_and_falls_back(spark, folder):
    def bad(raw):
        raise OSError("no")

    def pdf(raw):
        yield 1, "", raw.decode()[:4], False

    got = {r.path[-5:]: (r.status, r.line) for r in office.lines(office.contents(spark, folder).where("path like '%.pdf' or path like '%.txt'"), {"txt": bad, "pdf": pdf}).where("pos = 0").collect()}
    assert got == {"d.txt": ("OK", "one"), "f.pdf": ("OK", "%PDF")}


def test_model_providers(spark):
    def make():
        failed = []

        def model(texts):
            if not failed:  # the first call fails once
                failed.append(1)
                raise OSError
            return np.array([[len(t), 1.0] for t in texts])

        return model

    df = spark.createDataFrame([("abc",), (None,), ("",)], "t string").coalesce(1)
    got = [r.v for r in df.select(providers.encoder(make, 2)("t").alias("v")).collect()]
    assert got[1] is None and all(abs(sum(x * x for x in v) - 1) < 1e-6 for v in (got[0], got[2])) and abs(got[0][0] / got[0][1] - 3) < 1e-5
    score = providers.scorer(lambda: lambda pairs: [float(len(q) + len(p)) for q, p in pairs])
    assert [r.s for r in df.select(score("t", F.lit("xy")).alias("s")).collect()] == [5.0, 2.0, 2.0]
    assert df.select(providers.provider(providers.RERANKERS, "overlap")(F.lit("a b"), F.lit("b b c")).alias("s")).first().s == 1.0
    with pytest.raises(ValueError, match="overlap"):
        providers.provider(providers.RERANKERS, "none")


def test_vector_text_rounds_the_exact_value(spark):
    """Halves at the ninth decimal, and floats whose shortest digits end in 5 there though they lie below or above."""
    values = [0.001953125, -0.001953125, 0.005859375, 0.0, -1e-12, 1.5, 9999999.0, 16777216.0, *(float(np.float32(k / 1e9)) for k in range(5, 200_000, 1970))]
    df = spark.createDataFrame([(values,)], "v array<float>")
    assert df.select(V.vector_text(F.col("v"))).first()[0] == f"[{','.join('%.8f' % x for x in values)}]"
