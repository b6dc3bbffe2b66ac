"""Queries of text rules, layout, extraction and the single-document analyser."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as T
from quern.operators import extraction, layout
from quern.registry import CHUNKS, LINES, query
from quern.sources import views as V

_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '^\s*$') THEN 0 ELSE greatest(1, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))) END AS n_tokens, len(regexp_extract_all(lower(text), '[0-9a-z]+')) AS n_simple FROM documents")
def token_counts(spark, sf):
    t = F.col("text")
    return V.table(spark, sf, "documents").select("doc_id", T.count_tokens(t).alias("n_tokens"), F.size(T.simple_tokens(t)).alias("n_simple"))


@query(f"WITH {CHUNKS} SELECT document_id, pos, chunk_text, token_count FROM tokens")
def sentence_split(spark, sf):
    return V.chunks(spark, sf)


@query(r"WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS ps FROM documents) SELECT doc_id, len(ps) AS n_paragraphs, md5(array_to_string(ps, chr(10))) AS digest FROM p")
def paragraph_split(spark, sf):
    p = T.paragraphs(F.col("text"))
    return V.table(spark, sf, "documents").select("doc_id", F.size(p).alias("n_paragraphs"), F.md5(F.array_join(p, "\n")).alias("digest"))


_HEADING = r"(line <> '' AND (starts_with(line, '#') OR regexp_matches(line, '^(\d+(?:\.\d+)*)[.)]?\s+\S') OR (len(regexp_extract_all(line, '\S+')) <= 12 AND length(line) <= 120 AND NOT regexp_matches(line, '[.,;:]$') AND substr(line, 1, 1) = upper(substr(line, 1, 1)) AND substr(line, 1, 1) <> lower(substr(line, 1, 1)))))"
_LEVEL = r"CASE WHEN regexp_matches(line, '^(\d+(?:\.\d+)*)[.)]?\s+\S') THEN length(regexp_extract(line, '^(\d+(?:\.\d+)*)[.)]?\s+\S', 1)) - length(replace(regexp_extract(line, '^(\d+(?:\.\d+)*)[.)]?\s+\S', 1), '.', '')) + 1 ELSE 1 END"


@query(f"WITH {LINES} SELECT document_id, pos, line AS heading, {_LEVEL} AS level FROM lines WHERE {_HEADING}")
def heading_lines(spark, sf):
    return layout.headings(V.lines(spark, sf)).select("document_id", "pos", "heading", "level")


@query(f"""WITH {LINES}, h AS (SELECT document_id, pos, 1 + pos // 40 AS start_page, {_LEVEL} AS level FROM lines WHERE {_HEADING}),
last AS (SELECT document_id, max(1 + pos // 40) AS last_page FROM lines GROUP BY document_id),
up AS (SELECT a.document_id, a.pos, max(b.pos) AS parent_pos FROM h a LEFT JOIN h b ON a.document_id = b.document_id AND b.pos < a.pos AND b.level < a.level GROUP BY ALL),
nx AS (SELECT a.document_id, a.pos, min(b.pos) AS next_pos FROM h a LEFT JOIN h b ON a.document_id = b.document_id AND b.pos > a.pos AND b.level <= a.level GROUP BY ALL)
SELECT h.document_id, h.pos, h.level, up.parent_pos, h.start_page, CASE WHEN nx.next_pos IS NULL THEN last.last_page ELSE greatest(h.start_page, 1 + nx.next_pos // 40) END AS end_page
FROM h JOIN up USING (document_id, pos) JOIN nx USING (document_id, pos) JOIN last USING (document_id)""")
def section_tree(spark, sf):
    return layout.sections(V.lines(spark, sf))


@query(f"""WITH {LINES}, p AS (SELECT document_id, 1 + pos // 40 AS page_number, string_agg(line, chr(10) ORDER BY pos) AS raw_text FROM lines GROUP BY ALL)
SELECT document_id, CAST(page_number AS INTEGER) AS page_number, length(trim(raw_text)) < 80 AS scanned FROM p""")
def scanned_pages(spark, sf):
    return layout.pages(V.lines(spark, sf)).select("document_id", "page_number", (F.length(F.trim("raw_text")) < 80).alias("scanned"))


@query(
    f"""WITH RECURSIVE {CHUNKS}, items AS (SELECT document_id AS g, pos + 1 AS k, chunk_text, token_count AS n FROM tokens), walk AS (SELECT g, k, n AS size, 0 AS chunk FROM items WHERE k = 1 UNION ALL SELECT i.g, i.k, CASE WHEN w.size + i.n > 500 THEN i.n ELSE w.size + i.n END, CASE WHEN w.size + i.n > 500 THEN w.chunk + 1 ELSE w.chunk END FROM walk w JOIN items i ON i.g = w.g AND i.k = w.k + 1)
SELECT w.g AS document_id, w.chunk, string_agg(i.chunk_text, ' ' ORDER BY i.k) AS text, sum(i.n)::BIGINT AS token_count FROM walk w JOIN items i ON i.g = w.g AND i.k = w.k GROUP BY ALL"""
)
def pack_chunks(spark, sf):
    """Greedy packing of sentences into chunks of 500 tokens at most; a single longer one stays whole."""
    return layout.packed(V.chunks(spark, sf), 500)


@query(r"""WITH q AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\S+')) AS term FROM benchmark)
SELECT term, length(term) BETWEEN 3 AND 64 AND regexp_matches(term, '[0-9]') AS identifier, CASE WHEN length(term) BETWEEN 3 AND 64 AND regexp_matches(term, '[0-9]') THEN 'trigram' ELSE 'keyword' END AS route FROM q""")
def identifier_routing(spark, sf):
    terms = V.table(spark, sf, "benchmark").select(F.explode(T.extract_all(F.col("text"), r"\S+")).alias("term")).distinct()
    is_id = T.is_identifier_like(F.col("term"))
    return terms.select("term", is_id.alias("identifier"), F.when(is_id, "trigram").otherwise("keyword").alias("route"))


@query(r"""SELECT doc_id, len(list_distinct(list_concat(list_transform(regexp_extract_all(text, '"([^"]+)"', 1), lambda x: trim(x)), list_filter(regexp_extract_all(text, '\b[A-Za-z0-9]+(?:-[A-Za-z0-9]+)+\b'), lambda x: regexp_matches(x, '[0-9]')), regexp_extract_all(text, '(?i)(?:[$€£]\s?\d[\d,]*(?:\.\d+)?|\b\d[\d,]*(?:\.\d+)?\s?(?:USD|EUR|INR)\b)'), regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\b')))) AS n_terms FROM documents""")
def verbatim_terms(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.size(T.verbatim_terms(F.col("text"))).alias("n_terms"))


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM documents),
c AS (SELECT doc_id, len(list_filter(ws, lambda x: list_contains({_LIST(T.POSITIVE)}, x))) AS positive, len(list_filter(ws, lambda x: list_contains({_LIST(T.NEGATIVE)}, x))) AS negative FROM w)
SELECT doc_id, positive, negative, CASE WHEN positive + negative = 0 THEN 'neutral' WHEN (positive - negative) / (positive + negative) > 0.15 THEN 'positive' WHEN (positive - negative) / (positive + negative) < -0.15 THEN 'negative' ELSE 'neutral' END AS label,
round(CASE WHEN positive + negative = 0 THEN 0.85 ELSE least(0.98, 0.70 + (positive + negative) * 0.05) END::DOUBLE, 6) AS confidence FROM c""")
def sentiment(spark, sf):
    s = V.table(spark, sf, "documents").select("doc_id", T.sentiment(F.col("text")).alias("s"))
    return s.select("doc_id", "s.positive", "s.negative", "s.label", F.round("s.confidence", 6).alias("confidence"))


_TOPIC = ", ".join(f"CASE WHEN len(list_filter({_LIST(words)}, lambda k: contains(lower(text), k))) > 0 THEN '{topic}' END" for topic, words in T.TOPICS.items())


@query(f"WITH t AS (SELECT doc_id, list_filter([{_TOPIC}], lambda x: x IS NOT NULL) AS found FROM documents) SELECT doc_id, array_to_string(CASE WHEN len(found) > 0 THEN found ELSE {_LIST(T.NO_TOPICS)} END, '|') AS topics FROM t")
def topics(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.array_join(T.topics(F.col("text")), "|").alias("topics"))


_CASE = " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in words)} THEN {{{k}}}" for k, (_, _, words) in enumerate(T.TYPES))


@query(f"SELECT doc_id, CASE {_CASE.format(*(repr(t) for t, _, _ in T.TYPES))} ELSE 'other' END AS document_type, CAST(CASE {_CASE.format(*(c for _, c, _ in T.TYPES))} ELSE CASE WHEN contains(lower(text), 'ambiguous') OR length(trim(text)) < 40 THEN 0.35 ELSE 0.55 END END AS DOUBLE) AS confidence, CAST(CASE {_CASE.format(*(c for _, c, _ in T.TYPES))} ELSE CASE WHEN contains(lower(text), 'ambiguous') OR length(trim(text)) < 40 THEN 0.35 ELSE 0.55 END END AS DOUBLE) < 0.5 AS low_confidence FROM documents")
def classify_documents(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", T.document_type(F.col("text")).alias("t"))
    return d.select("doc_id", F.col("t.type").alias("document_type"), "t.confidence", (F.col("t.confidence") < 0.5).alias("low_confidence"))


@query(f"""WITH {CHUNKS}, two AS (SELECT document_id AS doc_id, string_agg(chunk_text, ' ' ORDER BY pos) AS t FROM chunks WHERE pos < 2 GROUP BY document_id)
SELECT doc_id, CASE WHEN length(t) <= 150 THEN t ELSE regexp_replace(substr(t, 1, 150), ' [^ ]*$', '') || '...' END AS summary FROM two""")
def summary(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", T.summary(F.col("text")).alias("summary")).where("summary <> ''")


@query(r"""WITH e AS (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+') AS names, regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?%?') AS numbers FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(names, numbers)))[1:8], '|') AS entities FROM e""")
def entities(spark, sf):
    """The first eight capitalised phrases and numbers, sorted."""
    t = F.col("text")
    found = F.concat(T.extract_all(t, r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"), T.extract_all(t, r"\d[\d,]*(?:\.\d+)?%?"))
    return V.table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(F.array_sort(F.array_distinct(found)), 1, 8), "|").alias("entities"))


@query(f"""WITH {LINES}, s AS (SELECT document_id, pos, line, lag(line) OVER w AS prev, lead(line) OVER w AS next FROM lines WINDOW w AS (PARTITION BY document_id ORDER BY pos)),
t AS (SELECT *, list_filter(regexp_extract_all(line, '[A-Za-z]+'), lambda x: length(x) > 2) AS ws FROM s),
r AS (SELECT *, CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda x: regexp_matches(x, '^[A-Z]'))) / len(ws) ELSE 0 END AS share FROM t)
SELECT document_id, pos, CAST(CASE WHEN coalesce(prev, '') = '' THEN 2 ELSE 0 END + CASE WHEN coalesce(next, '') = '' THEN 2 ELSE 0 END + CASE WHEN share >= 0.8 THEN 3 WHEN share >= 0.5 THEN 2 ELSE 0 END + CASE WHEN len(regexp_extract_all(line, '\\S+')) <= 6 THEN 2 ELSE 0 END + CASE WHEN contains(line, '?') THEN 2 ELSE 0 END AS INTEGER) AS score FROM r WHERE line <> ''""")
def text_heading_score(spark, sf):
    return layout.heading_scores(V.lines(spark, sf))


@query(r"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
n AS (SELECT doc_id, line, lower(line) AS low, length(regexp_replace(line, '\D', '', 'g')) AS digits FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE low = '' OR (regexp_matches(line, '^[+()\-\s\d.]+$') AND digits BETWEEN 8 AND 15) OR regexp_matches(low, '^(page|slide)?\s*\d{1,4}$') OR regexp_matches(low, 'https?://|www\.') OR contains(low, '@')) AS n_noise FROM n GROUP BY doc_id""")
def noise_lines(spark, sf):
    line = F.col("line")
    return V.lines(spark, sf).groupBy(F.col("document_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(T.is_noise(line)).alias("n_noise"))


_CUT = "CASE WHEN length(rest) <= 200 THEN length(rest) WHEN contains(substr(rest, 1, 200), ' ') THEN 201 - instr(reverse(substr(rest, 1, 200)), ' ') ELSE 200 END"


@query(f"WITH RECURSIVE cut AS (SELECT conv_id, turn, -1 AS pos, '' AS piece, text AS rest FROM conversations UNION ALL SELECT conv_id, turn, pos + 1, substr(rest, 1, {_CUT}), substr(rest, {_CUT} + 1) FROM cut WHERE length(rest) > 0) SELECT conv_id, turn, pos, piece FROM cut WHERE pos >= 0")
def token_chunking(spark, sf):
    """Answer text in pieces of 200 characters at most, cut after a space, numbered."""
    return V.table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(T.pieces(F.col("text"))).alias("pos", "piece"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}')) AS n_mails,
coalesce(regexp_replace(lower(trim(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}', 0))), '^[^@]+', '***'), '') AS first_masked FROM documents""")
def email_normalize_mask(spark, sf):
    mail = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}"
    return V.table(spark, sf, "documents").select("doc_id", F.size(T.extract_all(F.col("text"), mail)).alias("n_mails"), F.regexp_replace(F.lower(F.trim(F.regexp_extract("text", mail, 0))), "^[^@]+", "***").alias("first_masked"))


@query(r"""SELECT doc_id, regexp_extract(text, '\b(\d{4}-\d{2}-\d{2})\b', 1) AS first_date, regexp_extract(text, '(?i)(\d+)\s+days\s+(?:written\s+)?notice', 1) AS notice_days, len(regexp_extract_all(text, '([A-Za-z][A-Za-z ]{0,40}):\s*\$\s?\d[\d,]*')) AS n_amounts,
coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '') AS title FROM documents""")
def extract_fields(spark, sf):
    return extraction.fields(V.table(spark, sf, "documents"))


@query(f"""WITH {LINES}, f AS (SELECT document_id, lower(line) AS key, line, pos, row_number() OVER (PARTITION BY document_id, lower(line) ORDER BY pos) AS rn FROM lines WHERE line <> '') SELECT document_id, pos, line FROM f WHERE rn = 1""")
def dedupe_fields(spark, sf):
    """The first line of each document and normalised value."""
    return extraction.first_of(V.lines(spark, sf).where("line <> ''").select("document_id", "pos", "line"), ["document_id", F.lower("line")], ["pos"])


@query(f"""WITH {CHUNKS}, q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[0-9a-z]+')) AS qt FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)),
s AS (SELECT document_id, pos, chunk_text, len(list_intersect(list_distinct(regexp_extract_all(lower(chunk_text), '[0-9a-z]+')), qt)) AS overlap FROM chunks, q),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY overlap DESC, pos) AS rn FROM s)
SELECT document_id, pos, chunk_text AS answer, overlap, round(CAST(least(0.96, 0.75 + 0.08 * overlap) AS DOUBLE), 6) AS confidence FROM r WHERE rn = 1""")
def extractive_qa(spark, sf):
    """For each document the sentence that shares most words with the question: the first benchmark item."""
    q = V.table(spark, sf, "benchmark").orderBy("item_id").limit(1).select(F.array_distinct(T.simple_tokens(F.col("text"))).alias("qt"))
    s = V.chunks(spark, sf).join(F.broadcast(q)).withColumn("overlap", F.size(F.array_intersect(F.array_distinct(T.simple_tokens(F.col("chunk_text"))), "qt")))
    best = s.groupBy("document_id").agg(F.max(F.struct("overlap", (-F.col("pos")).alias("p"), "chunk_text")).alias("b"))
    return best.select("document_id", (-F.col("b.p")).alias("pos"), F.col("b.chunk_text").alias("answer"), F.col("b.overlap").alias("overlap"), F.round(F.least(F.lit(0.96), 0.75 + 0.08 * F.col("b.overlap")), 6).alias("confidence"))


#: SQL of T.bare_words; there is no lookaround, so the text's runs of letters, digits and underscores are taken, and of them those in a-z and digits.
_BARE = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[0-9a-z]+'))"


@query(f"""WITH {CHUNKS}, c AS (SELECT b.item_id, b.text AS passage, s.pos, s.chunk_text FROM benchmark b JOIN chunks s ON s.document_id = b.item_id),
w AS (SELECT *, list_filter({_BARE.format("chunk_text")}, lambda x: NOT list_contains({_LIST(T.STOPWORDS)}, x) AND length(x) > 2) AS cw, {_BARE.format("passage")} AS pw FROM c)
SELECT item_id, pos, contains(lower(passage), trim(lower(chunk_text))) OR (len(cw) > 0 AND len(list_filter(cw, lambda x: list_contains(pw, x))) >= 0.25 * len(cw)) AS supported FROM w""")
def claim_text_support(spark, sf):
    """Whether each sentence of a document is supported by the benchmark passage of the same number."""
    passages = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("document_id"), F.col("text").alias("passage"), T.bare_words(F.col("text")).alias("tokens"))
    sentences = V.chunks(spark, sf).select("document_id", "pos", "chunk_text", T.claim_words(F.col("chunk_text")).alias("words"))
    return sentences.join(passages, "document_id").select(F.col("document_id").alias("item_id"), "pos", T.text_support(F.col("chunk_text"), F.col("words"), F.col("passage"), F.col("tokens")).alias("supported"))


@query(f"WITH {LINES} SELECT document_id, string_agg(line, chr(10) ORDER BY pos) AS clean FROM lines WHERE line <> '' AND NOT regexp_matches(lower(line), '^(page|slide)?\\s*\\d{{1,4}}$') AND NOT contains(line, '@') AND NOT regexp_matches(lower(line), 'https?://|www\\.') AND NOT (regexp_matches(line, '^[+()\\-\\s\\d.]+$') AND length(regexp_replace(line, '\\D', '', 'g')) BETWEEN 8 AND 15) GROUP BY document_id")
def clean_page_text(spark, sf):
    kept = V.lines(spark, sf).where(~T.is_noise(F.col("line")))
    return kept.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("clean"))


@query(r"WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents) SELECT doc_id, substr(text, 1, 200) AS excerpt, len(ls) >= 2 OR length(trim(text)) >= 40 AS meaningful FROM documents JOIN l USING (doc_id)")
def excerpts(spark, sf):
    t = F.col("text")
    return V.table(spark, sf, "documents").select("doc_id", F.substring(t, 1, 200).alias("excerpt"), ((F.size(F.filter(T.lines(t), lambda x: x != "")) >= 2) | (F.length(F.trim(t)) >= 40)).alias("meaningful"))


@query("WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) SELECT conv_id, turn, role FROM r WHERE rn <= 3")
def history_last_n(spark, sf):
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return V.table(spark, sf, "conversations").withColumn("rn", F.row_number().over(last)).where("rn <= 3").select("conv_id", "turn", "role")


@query(r"""WITH q AS (SELECT conv_id, turn, lower(text) AS t, text FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN length(trim(text)) = 0 OR length(text) > 2000 THEN 'error' WHEN regexp_matches(t, 'different|difference|compare|versus| vs ') THEN 'comparison' WHEN contains(t, 'summar') THEN 'summary' WHEN regexp_matches(t, 'across documents|cross-document|which documents') THEN 'cross-document' ELSE 'fact' END AS kind FROM q""")
def classify_question(spark, sf):
    t = F.lower("text")
    kind = F.when((F.length(F.trim("text")) == 0) | (F.length("text") > 2000), "error").when(t.rlike("different|difference|compare|versus| vs "), "comparison").when(t.contains("summar"), "summary").when(t.rlike("across documents|cross-document|which documents"), "cross-document").otherwise("fact")
    return V.table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", kind.alias("kind"))
