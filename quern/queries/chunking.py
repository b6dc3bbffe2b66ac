"""Queries of sections, their pages and paragraphs, and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import chunking as C
from quern.registry import LINES, query
from quern.sources import store as S
from quern.sources import views as V

# Pages of two lines each of the agreements; a section begins at each labelled line, its parent is the one before the last.
_PG = f"""{S.AGREEMENTS}, ln AS (SELECT document_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM agreements),
pages AS (SELECT document_id, CAST(1 + pos // 2 AS INTEGER) AS page_number, string_agg(line, chr(10) || chr(10) ORDER BY pos) AS raw_text FROM ln GROUP BY ALL), last AS (SELECT document_id, max(page_number) AS last_page FROM pages GROUP BY 1),
hd AS (SELECT document_id, pos, split_part(line, ':', 1) AS heading, CAST(1 + pos // 2 AS INTEGER) AS start_page, row_number() OVER (PARTITION BY document_id ORDER BY pos) AS k FROM ln WHERE contains(line, ': ') AND length(split_part(line, ':', 1)) < 20),
sections AS (SELECT h.document_id, CAST(h.document_id * 100 + h.k AS BIGINT) AS section_id, CASE WHEN h.k % 3 = 0 THEN CAST(h.document_id * 100 + h.k - 1 AS BIGINT) END AS parent_id, h.heading, h.start_page, CASE WHEN h.k % 2 = 0 THEN l.last_page END AS end_page FROM hd h JOIN last l ON l.document_id = h.document_id)"""
_EFF = f"{_PG}, sx AS (SELECT *, coalesce(start_page, 1) AS st, coalesce(end_page, start_page, 1) AS en FROM sections), eff AS (SELECT s.document_id, s.section_id, s.heading, s.st, least(s.en, coalesce(min(o.start_page), s.en)) AS effective_end FROM sx s LEFT JOIN sections o ON o.document_id = s.document_id AND o.section_id <> s.section_id AND o.start_page > s.st AND o.start_page <= s.en AND (o.parent_id IS NULL OR o.parent_id IS NOT DISTINCT FROM s.parent_id) GROUP BY s.document_id, s.section_id, s.heading, s.st, s.en)"""
_SP = f"{_EFF}, sp AS (SELECT e.document_id, e.section_id, e.heading, e.st, p.page_number, p.raw_text FROM eff e JOIN pages p ON p.document_id = e.document_id AND p.page_number BETWEEN e.st AND e.effective_end)"
_PA = rf"""{_SP}, ow AS (SELECT *, CASE WHEN contains(raw_text, heading) THEN substr(raw_text, instr(raw_text, heading) + length(heading)) ELSE raw_text END AS own FROM sp),
ct AS (SELECT o.document_id, o.section_id, o.st, o.page_number, o.own, list(h.heading ORDER BY h.section_id) FILTER (WHERE h.section_id IS NOT NULL) AS hs FROM ow o LEFT JOIN sections h ON h.document_id = o.document_id AND h.start_page = o.page_number AND h.section_id <> o.section_id AND h.heading <> '' GROUP BY o.document_id, o.section_id, o.st, o.page_number, o.own),
bd AS (SELECT *, CASE WHEN hs IS NULL THEN own ELSE list_reduce(list_prepend(own, hs), lambda t, h: CASE WHEN contains(t, h) THEN split_part(t, h, 1) ELSE t END) END AS body FROM ct),
pp AS (SELECT document_id, section_id, st, page_number, list_filter(list_transform(string_split_regex(body, '\n\s*\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS ps FROM bd),
para AS (SELECT document_id, section_id, page_number, CAST(unnest(range(len(ps))) AS INTEGER) AS "at", unnest(ps) AS paragraph FROM pp)"""


def pages(spark, sf):
    lines = S.agreements(spark, sf).select("document_id", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line")).withColumn("page_number", (F.floor(F.col("pos") / 2) + 1).cast("int"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return lines.groupBy("document_id", "page_number").agg(F.array_join(ordered, "\n\n").alias("raw_text"))


def sections(spark, sf):
    head = F.substring_index("line", ":", 1)
    found = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("pos"))), lambda s: s["line"].contains(": ") & (F.length(F.substring_index(s["line"], ":", 1)) < 20))
    h = S.agreements(spark, sf).select("document_id", (F.floor((F.size(F.split("text", "\n")) - 1) / 2) + 1).cast("int").alias("last_page"), F.posexplode_outer(found).alias("k0", "s")).where("s is not null").select("document_id", "last_page", (F.col("k0") + 1).alias("k"), "s.line", "s.pos")
    ident = (F.col("document_id") * 100 + F.col("k")).cast("long")
    return h.select("document_id", ident.alias("section_id"), F.when(F.col("k") % 3 == 0, ident - 1).alias("parent_id"), head.alias("heading"), (F.floor(F.col("pos") / 2) + 1).cast("int").alias("start_page"), F.when(F.col("k") % 2 == 0, F.col("last_page")).alias("end_page"))


@query(f"WITH {_EFF} SELECT document_id, section_id, effective_end FROM eff")
def join_section_self(spark, sf):
    """Where a section really ends: at the first of its peers that begins inside its range."""
    return C.effective_ends(sections(spark, sf)).select("document_id", "section_id", "effective_end")


@query(f"WITH {_SP} SELECT document_id, section_id, page_number FROM sp")
def join_section_page_range(spark, sf):
    return C.section_pages(sections(spark, sf), pages(spark, sf)).select("document_id", "section_id", "page_number")


@query(f"WITH {_SP} SELECT document_id, section_id, string_agg(raw_text, chr(10) ORDER BY page_number) AS body FROM sp GROUP BY ALL")
def join_section_body(spark, sf):
    """A section's text: its pages, one after another."""
    p = C.section_pages(sections(spark, sf), pages(spark, sf))
    return p.groupBy("document_id", "section_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "raw_text"))), lambda x: x["raw_text"]), "\n").alias("body"))


@query(f"WITH {_PA} SELECT * FROM para")
def join_paragraphs_for_section(spark, sf):
    """What stands in each section: after its own heading, before the others of the page."""
    return C.paragraphs(sections(spark, sf), pages(spark, sf)).select("document_id", "section_id", "page_number", "at", "paragraph")


# greedy packing in SQL: a recursive walk over the numbered pieces of each group
_WALK = """RECURSIVE walk AS (SELECT g, k, n AS size, 0 AS chunk FROM items WHERE k = 1 UNION ALL SELECT i.g, i.k, CASE WHEN w.size + i.n > {most} THEN i.n ELSE w.size + i.n END, CASE WHEN w.size + i.n > {most} THEN w.chunk + 1 ELSE w.chunk END FROM walk w JOIN items i ON i.g = w.g AND i.k = w.k + 1)"""
_COUNT = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"


@query(
    rf"""WITH RECURSIVE {_PA}, items AS (SELECT section_id AS g, row_number() OVER (PARTITION BY section_id ORDER BY page_number, "at") AS k, document_id, page_number, paragraph, {_COUNT.format('paragraph')} AS n FROM para), {_WALK.format(most=30).removeprefix('RECURSIVE ')},
j AS (SELECT i.*, w.chunk FROM walk w JOIN items i ON i.g = w.g AND i.k = w.k), t AS (SELECT document_id, g AS section_id, chunk, arg_min(page_number, k) AS page_number, string_agg(paragraph, ' ' ORDER BY k) AS chunk_text FROM j GROUP BY ALL) SELECT document_id, section_id, chunk, page_number, chunk_text, {_COUNT.format('chunk_text')} AS token_count FROM t"""
)
def pack_paragraphs(spark, sf):
    """Paragraphs packed into chunks of thirty tokens at most (the agreements' lines are short), each with the page of its first."""
    whole = C.paragraphs(sections(spark, sf), pages(spark, sf)).where(T.count_tokens(F.col("paragraph")) > 0)
    return C.chunks(whole, 30)


@query(rf"WITH {LINES}, t AS (SELECT document_id, pos, line, {_COUNT.format('line')} AS n FROM lines WHERE line <> '') SELECT document_id, pos, n > 30 AS oversize FROM t")
def oversize_paragraphs(spark, sf):
    """Which paragraphs must be split by sentences before they are packed."""
    line = F.col("line")
    return V.lines(spark, sf).where("line <> ''").select("document_id", "pos", (T.count_tokens(line) > 30).alias("oversize"))


@query(rf"WITH {LINES}, b AS (SELECT document_id * 1000000 + pos AS g, line FROM lines WHERE line <> '' AND {_COUNT.format('line')} > 30), s AS (SELECT g, list_filter(list_transform(string_split(regexp_replace(line, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM b), items AS (SELECT g, k, x AS sentence, {_COUNT.format('x')} AS n FROM (SELECT g, unnest(range(1, len(ss) + 1)) AS k, unnest(ss) AS x FROM s)), w AS (SELECT * FROM (WITH {_WALK.format(most=30)} SELECT * FROM walk)), j AS (SELECT i.g, i.k, i.sentence, w.chunk FROM w JOIN items i ON i.g = w.g AND i.k = w.k) SELECT g, CAST(chunk AS INTEGER) AS piece, string_agg(sentence, ' ' ORDER BY k) AS text FROM j GROUP BY ALL")
def split_oversize(spark, sf):
    """Paragraphs of more than thirty tokens, split at sentences; a longer sentence stays whole."""
    line = F.col("line")
    big = V.lines(spark, sf).where("line <> ''").where(T.count_tokens(line) > 30)
    return big.select((F.col("document_id") * 1_000_000 + F.col("pos")).alias("g"), F.posexplode(C.pieces(line, 30)).alias("piece", "text"))
