"""Queries of questions, extracted fields, headings, noise and modules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import rules as R
from quern.functions import text as T
from quern.operators import extraction, layout
from quern.registry import LINES, query
from quern.sources import store as S
from quern.sources import views as V

A, C, B = S.AGREEMENTS, S.CLAUSES, S.BLOCKS

# questions: users' turns, and agreements' titles as more of them
_Q = """q AS (SELECT conv_id * 1000 + turn AS question_id, text AS question FROM conversations WHERE role = 'user' UNION ALL SELECT -1 - o_orderkey, CASE CAST(o_orderkey % 8 AS INTEGER) WHEN 0 THEN 'What is the expiry date of DOC-' || o_orderkey || ' and "Blue Harbour"?' WHEN 1 THEN 'Compare these papers versus those' WHEN 2 THEN 'Please summarise it' WHEN 3 THEN 'Which documents name Vela?' WHEN 4 THEN 'What''s different between these two contracts?' WHEN 5 THEN 'AB-' || o_orderkey WHEN 6 THEN '  ' ELSE 'was it $1,200.50 on 2001-06-30' END FROM orders)"""


def questions(spark, sf):
    k = F.col("o_orderkey")
    number = k.cast("string")
    made = F.when(k % 8 == 0, F.concat(F.lit("What is the expiry date of DOC-"), number, F.lit(' and "Blue Harbour"?'))).when(k % 8 == 1, "Compare these papers versus those").when(k % 8 == 2, "Please summarise it").when(k % 8 == 3, "Which documents name Vela?").when(k % 8 == 4, "What's different between these two contracts?").when(k % 8 == 5, F.concat(F.lit("AB-"), number)).when(k % 8 == 6, "  ").otherwise("was it $1,200.50 on 2001-06-30")
    asked = V.table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))
    return asked.unionByName(V.table(spark, sf, "orders").select((-1 - k).alias("question_id"), made.alias("question")))


_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in R.QUERY_STOPWORDS) + "]"
_KEYS = f"array_to_string(list_filter(regexp_extract_all(question, '[0-9A-Za-z]+(?:-[0-9A-Za-z]+)*'), lambda w: NOT list_contains({_STOP}, lower(w))), ' ')"
_KIND = "CASE WHEN contains(lower(question), 'what''s different between these two contracts?') OR contains(lower(question), 'different') OR contains(lower(question), 'difference') OR contains(lower(question), 'compare') OR contains(lower(question), 'versus') OR contains(lower(question), ' vs ') THEN 'comparison' WHEN contains(lower(question), 'summar') THEN 'summary' WHEN contains(lower(question), 'across documents') OR contains(lower(question), 'cross-document') OR contains(lower(question), 'which documents') THEN 'cross-document' ELSE 'fact' END"
_TERMS = r"list_distinct(list_concat(list_transform(regexp_extract_all(question, '\"([^\"]+)\"', 1), lambda x: trim(x)), list_filter(regexp_extract_all(question, '\b[A-Za-z0-9]+(?:-[A-Za-z0-9]+)+\b'), lambda x: regexp_matches(x, '[0-9]')), regexp_extract_all(question, '(?i)(?:[$€£]\s?\d[\d,]*(?:\.\d+)?|\b\d[\d,]*(?:\.\d+)?\s?(?:USD|EUR|INR)\b)'), regexp_extract_all(question, '\b\d{4}-\d{2}-\d{2}\b')))".replace('\\"', '"')
_SORTED = "array_to_string(list_sort({0}), '|')"


@query(f"WITH {_Q} SELECT question_id, {_KEYS} AS words FROM q")
def keyword_style(spark, sf):
    return questions(spark, sf).select("question_id", R.keyword_style(F.col("question")).alias("words"))


@query(f"WITH {_Q}, k AS (SELECT *, {_KIND} AS kind, {_KEYS} AS own FROM q) SELECT question_id, kind, CASE WHEN contains(lower(question), 'different between these two contracts?') THEN 'termination clauses, obligations, key differences' WHEN kind = 'comparison' THEN 'key differences, obligations, terms' WHEN kind = 'summary' THEN 'summary of key terms and obligations' WHEN kind = 'cross-document' THEN 'documents mentioning the same entities and facts' WHEN own = '' THEN question ELSE own END AS rewritten FROM k")
def rewrite_question(spark, sf):
    q = F.col("question")
    return questions(spark, sf).select("question_id", R.question_kind(q).alias("kind"), R.rewritten(q).alias("rewritten"))


@query(f"WITH {_Q}, t AS (SELECT question_id, {_KEYS} AS words, list_filter({_TERMS}, lambda t: NOT contains({_KEYS}, t)) AS missing FROM q) SELECT question_id, length(words) AS n, {_SORTED.format('missing')} AS added FROM t")
def preserve_terms(spark, sf):
    """Terms that must be searched word by word and that the rewritten question has lost are put back."""
    q = F.col("question")
    full = R.preserve_terms(R.keyword_style(q), T.verbatim_terms(q))
    t = questions(spark, sf).select("question_id", R.keyword_style(q).alias("w"), T.verbatim_terms(q).alias("terms"), full.alias("full"))
    added = F.filter("terms", lambda x: ~F.col("w").contains(x))
    return t.where(F.col("full").startswith(F.col("w"))).select("question_id", F.length("w").alias("n"), F.array_join(F.array_sort(added), "|").alias("added"))


@query(f"WITH {_Q} SELECT question_id, CASE WHEN trim(question) = '' THEN 'EMPTY' WHEN length(question) > 2000 THEN 'TOO_LONG' END AS refused, CASE WHEN trim(question) = '' OR length(question) > 2000 THEN NULL WHEN {_KIND} = 'comparison' AND question_id % 3 = 0 THEN 'fact' ELSE {_KIND} END AS kind FROM q")
def classify_question_scoped(spark, sf):
    """The kind of each question; a comparison needs two documents in scope, else it asks for a fact."""
    q, n_docs = F.col("question"), F.when(F.col("question_id") % 3 == 0, 1).otherwise(2)
    refused = F.when(F.trim(q) == "", "EMPTY").when(F.length(q) > 2000, "TOO_LONG")
    kind = F.when((R.question_kind(q) == "comparison") & (n_docs <= 1), "fact").otherwise(R.question_kind(q))
    return questions(spark, sf).select("question_id", refused.alias("refused"), F.when(refused.isNull(), kind).alias("kind"))


@query(f"WITH {_Q} SELECT question_id, length(trim(question)) BETWEEN 3 AND 64 AND regexp_matches(question, '[0-9]') AND NOT regexp_matches(trim(question), '\\s') AS pure FROM q")
def pure_identifier(spark, sf):
    return questions(spark, sf).select("question_id", R.is_pure_identifier(F.col("question")).alias("pure"))


@query(f"WITH {_Q}, t AS (SELECT question_id, unnest(list_distinct({_TERMS})) AS term FROM q WHERE trim(question) <> ''), n AS (SELECT question_id, term, length(term) BETWEEN 3 AND 64 AND regexp_matches(term, '[0-9]') AND (contains(term, '-') OR NOT regexp_matches(term, '\\s')) AS id FROM t) SELECT question_id, trim(question) AS search, CASE WHEN length(trim(question)) BETWEEN 3 AND 64 AND regexp_matches(question, '[0-9]') AND NOT regexp_matches(trim(question), '\\s') THEN 'trigram' ELSE 'keyword' END AS route FROM q WHERE trim(question) <> '' UNION SELECT question_id, CASE WHEN id THEN term ELSE '\"' || term || '\"' END, CASE WHEN id THEN 'trigram' ELSE 'keyword' END FROM n".replace('\\"', '"'))
def keyword_channel_terms(spark, sf):
    """The searches of the keyword channel: the question and each of its verbatim terms, an identifier by trigrams, others as a phrase."""
    q = questions(spark, sf).where(F.trim("question") != "")
    whole = q.select("question_id", F.trim("question").alias("search"), F.when(R.is_pure_identifier(F.col("question")), "trigram").otherwise("keyword").alias("route"))
    term = q.select("question_id", F.explode(T.verbatim_terms(F.col("question"))).alias("term"))
    is_id = T.is_identifier_like(F.col("term"))
    return whole.unionByName(term.select("question_id", F.when(is_id, F.col("term")).otherwise(F.concat(F.lit('"'), "term", F.lit('"'))).alias("search"), F.when(is_id, "trigram").otherwise("keyword").alias("route"))).distinct()


@query("WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) SELECT conv_id, 'Classify the question.' || chr(10) || string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS prompt FROM r WHERE rn <= 3 GROUP BY conv_id")
def classification_prompt(spark, sf):
    """The classifier's prompt: the last three turns, no text of a document."""
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    few = V.table(spark, sf, "conversations").withColumn("rn", F.row_number().over(last)).where("rn <= 3")
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("t")))), lambda x: x["t"])
    return few.groupBy("conv_id").agg(F.concat(F.lit("Classify the question.\n"), F.array_join(said, "\n")).alias("prompt"))


# fields

_COMP = r"regexp_extract_all(chunk_text, '\b([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*\s+(?:Corp|Ltd|LLC|Inc)\.?)\b', 1)"
_FIRSTS = "array_to_string(list_filter(list_transform(range(1, len({0}) + 1), lambda i: CASE WHEN list_position({0}, {0}[i]) = i THEN {0}[i] END), lambda x: x IS NOT NULL), ', ')"
_UNI = r"""uni AS (
SELECT chunk_id, document_id, page_number, 'Title' AS field_name, list_filter(list_transform(string_split(chunk_text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS field_value, CAST(0.9 AS DOUBLE) AS confidence FROM clauses
UNION ALL SELECT chunk_id, document_id, page_number, 'Parties', coalesce(nullif(trim(regexp_extract(chunk_text, 'parties?:\s*([^\n.]+)', 1, 'i')), ''), %s), 0.97 FROM clauses
UNION ALL SELECT chunk_id, document_id, page_number, 'Effective Date', coalesce(nullif(regexp_extract(chunk_text, 'Effective Date[:\s]+(\d{4}-\d{2}-\d{2})', 1, 'i'), ''), regexp_extract(chunk_text, '\b(\d{4}-\d{2}-\d{2})\b', 1)), 0.97 FROM clauses
UNION ALL SELECT chunk_id, document_id, page_number, 'Reference Numbers', regexp_extract(chunk_text, '\b(?:ref(?:erence)?|agreement)\s*(?:#|no\.?)?\s*([A-Z0-9-]{4,})\b', 1, 'i'), 0.8 FROM clauses
UNION ALL SELECT chunk_id, document_id, page_number, 'Topics', trim(regexp_extract(chunk_text, 'topics?:\s*([^\n]+)', 1, 'i')), 0.75 FROM clauses
UNION ALL SELECT chunk_id, document_id, page_number, 'Amounts', unnest(list_transform(list_zip(regexp_extract_all(chunk_text, '([A-Za-z ]{3,30}):\s*(\$[\d,]+(?:\.\d{2})?)', 1), regexp_extract_all(chunk_text, '([A-Za-z ]{3,30}):\s*(\$[\d,]+(?:\.\d{2})?)', 2)), lambda p: trim(p[1]) || ': ' || p[2])), 0.85 FROM clauses),
univ AS (SELECT * FROM uni WHERE trim(field_value) <> '')""" % _FIRSTS.format(_COMP)


def universal(spark, sf):
    """Every chunk's universal fields as rows, with the chunk and page they come from."""
    # outer: an inner one would make the fields three times, to find out whether there is one
    return S.clauses(spark, sf).select("chunk_id", "document_id", "page_number", F.inline_outer(R.universal_fields(F.col("chunk_text")))).where("field_name is not null")


@query(f"WITH {C}, {_UNI} SELECT chunk_id, document_id, page_number, field_name, 'universal' AS field_category, field_value, confidence FROM univ")
def extract_universal_rules(spark, sf):
    return universal(spark, sf)


def _kind_of():
    return T.document_type(F.col("chunk_text"))["type"]


_TYPE = "CASE WHEN contains(lower(chunk_text), 'revenue') OR contains(lower(chunk_text), 'ebitda') OR contains(lower(chunk_text), 'financial report') OR contains(lower(chunk_text), 'forecast') THEN 'financial_report' WHEN contains(lower(chunk_text), 'master services agreement') OR contains(lower(chunk_text), 'termination') OR contains(lower(chunk_text), 'contract') THEN 'contract' WHEN contains(lower(chunk_text), 'proposal') OR contains(lower(chunk_text), 'statement of work') THEN 'proposal' WHEN contains(lower(chunk_text), 'policy') THEN 'policy' ELSE 'other' END"
_AFTER = r"trim(regexp_extract(chunk_text, '{0}\s*[:\s]+([^\n.]+)', 1, 'i'))"
_MONEY = r"regexp_extract(chunk_text, '{0}\s*[:\s]+\$?([\d,]+(?:\.\d{{2}})?)', 1, 'i')"
_BY = " UNION ALL ".join(f"SELECT chunk_id, '{name}', {(_MONEY if money else _AFTER).format(label)}, CAST({c} AS DOUBLE), '{kind}_specific' FROM typed WHERE kind = '{kind}'" for kind, rules in R.BY_TYPE.items() for name, c, label, money in rules)


@query(rf"""WITH {C}, typed AS (SELECT *, {_TYPE} AS kind, regexp_extract(chunk_text, '(\d+\s+days?)\s+(?:written\s+)?notice', 1, 'i') AS notice FROM clauses), f AS (
SELECT chunk_id, 'Obligations' AS field_name, 'Perform services per agreement.' AS field_value, CAST(0.84 AS DOUBLE) AS confidence, 'contract_specific' AS field_category FROM typed WHERE kind = 'contract' AND (contains(lower(chunk_text), 'obligation') OR contains(lower(chunk_text), 'shall'))
UNION ALL SELECT chunk_id, 'Termination Terms', coalesce(nullif(notice, ''), '30 days'), 0.81, 'contract_specific' FROM typed WHERE kind = 'contract' AND (contains(lower(chunk_text), 'termination') OR contains(lower(chunk_text), 'notice'))
UNION ALL SELECT chunk_id, 'Termination Notice Period', notice, 0.81, 'contract_specific' FROM typed WHERE kind = 'contract' AND (contains(lower(chunk_text), 'termination') OR contains(lower(chunk_text), 'notice'))
UNION ALL {_BY}) SELECT * FROM f WHERE trim(field_value) <> ''""")
def extract_type_specific_rules(spark, sf):
    return S.clauses(spark, sf).select("chunk_id", F.inline_outer(R.type_fields(F.col("chunk_text"), _kind_of()))).where("field_name is not null")


@query(f"WITH {C}, {_UNI}, r AS (SELECT *, row_number() OVER (PARTITION BY document_id, field_name, lower(trim(field_value)) ORDER BY page_number, chunk_id, field_value) AS rn FROM univ) SELECT document_id, field_name, field_value, page_number, chunk_id, confidence FROM r WHERE rn = 1")
def dedupe_extracted_fields(spark, sf):
    """Of equal fields of a document (category, name and value without case) the first by page and chunk."""
    f = universal(spark, sf).select("document_id", "field_name", "field_value", "page_number", "chunk_id", "confidence")
    return extraction.first_of(f, ["document_id", F.lower("field_name"), F.lower(F.trim("field_value"))], ["page_number", "chunk_id", "field_value"])


@query(f"WITH {C}, {_UNI} SELECT field_name, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM univ WHERE page_number >= 1 GROUP BY 1")
def validate_provenance(spark, sf):
    """Fields with a value and a page of 1 or more, counted by name."""
    return universal(spark, sf).where("page_number >= 1 AND trim(field_value) <> ''").groupBy("field_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(f"WITH {C}, r AS (SELECT document_id, page_number, chunk_id, chunk_text, row_number() OVER (PARTITION BY document_id ORDER BY page_number, chunk_id) AS rn FROM clauses) SELECT document_id, md5(string_agg('[chunk:' || chunk_id || ' page=' || page_number || '] ' || chunk_text, chr(10) ORDER BY page_number, chunk_id)) AS digest, count(*) AS n FROM r WHERE rn <= 50 GROUP BY document_id")
def classification_text(spark, sf):
    """The classifier's text of each document: its first fifty chunks by page, with their tags. (The limit is the classifier's.)"""
    w = Window.partitionBy("document_id").orderBy("page_number", "chunk_id")
    c = S.clauses(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn <= 50")
    part = F.struct("page_number", "chunk_id", F.concat(F.lit("[chunk:"), F.col("chunk_id").cast("string"), F.lit(" page="), F.col("page_number").cast("string"), F.lit("] "), "chunk_text").alias("t"))
    return c.groupBy("document_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n")).alias("digest"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {C}, {_UNI}, p AS (SELECT chunk_id, unnest(list_transform(string_split_regex(field_value, '(?i),|\\band\\b'), lambda x: trim(x, ' .'))) AS name FROM univ WHERE field_name IN ('Parties', 'Topics')) SELECT chunk_id, name, count(*) AS n FROM p WHERE name <> '' GROUP BY ALL")
def split_parties(spark, sf):
    names = universal(spark, sf).where("field_name IN ('Parties', 'Topics')").select("chunk_id", F.explode(R.split_names(F.col("field_value"))).alias("name"))
    return names.groupBy("chunk_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query(rf"WITH {C}, {_UNI} SELECT chunk_id, field_value, CASE WHEN contains(field_value, ':') AND trim(split_part(field_value, ':', 1)) <> '' AND NOT regexp_matches(trim(split_part(field_value, ':', 1)), '^[0-9]|[$₹]') THEN lower(trim(split_part(field_value, ':', 1))) ELSE lower(field_name) END AS label, replace(regexp_extract(field_value, '([\d,]+(?:\.\d+)?)', 1), ',', '') AS number, CASE WHEN contains(field_value, '$') THEN 'USD' ELSE '' END AS currency FROM univ WHERE field_name IN ('Amounts', 'Title')")
def parse_amount(spark, sf):
    v = F.col("field_value")
    return universal(spark, sf).where("field_name IN ('Amounts', 'Title')").select("chunk_id", "field_value", R.amount_label(F.col("field_name"), v).alias("label"), R.parse_amount(v)["number"].alias("number"), R.parse_amount(v)["currency"].alias("currency"))


@query(f"WITH {C}, {_UNI} SELECT chunk_id, field_value, CASE WHEN contains(lower(field_value), 'expir') THEN 'expiry date' WHEN contains(lower(field_value), 'effective') THEN 'effective date' ELSE lower(trim(field_value)) END AS label FROM univ WHERE field_name = 'Title'")
def canonical_date_label(spark, sf):
    return universal(spark, sf).where("field_name = 'Title'").select("chunk_id", "field_value", R.date_label(F.col("field_value")).alias("label"))


@query(f"WITH {C} SELECT chunk_id, coalesce(nullif(regexp_extract(chunk_text, 'documentType=([a-z_]+)', 1), ''), 'other') AS given, {_TYPE} || '_specific' AS category FROM clauses")
def type_category(spark, sf):
    given = F.coalesce(R.first(F.col("chunk_text"), r"documentType=([a-z_]+)"), F.lit("other"))
    return S.clauses(spark, sf).select("chunk_id", given.alias("given"), F.concat(_kind_of(), F.lit("_specific")).alias("category"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN substr(md5(url), 1, 8) || '-' || substr(md5(url), 9, 4) || '-' || substr(md5(url), 13, 4) || '-' || substr(md5(url), 17, 4) || '-' || substr(md5(url), 21, 12) END AS id FROM pages")
def uuid_or_none(spark, sf):
    h = F.md5("url")
    full = F.concat_ws("-", *(F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return V.table(spark, sf, "pages").select("page_id", R.uuid_or_none(F.when(F.col("page_id") % 2 == 0, F.upper(full)).otherwise(F.concat(full, F.lit("0")))).alias("id"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'The file could not be read.' WHEN 'click' THEN 'The scanned pages could not be recognised.' WHEN 'view' THEN 'The document could not be indexed.' ELSE 'Processing failed.' END AS message FROM events WHERE event_id % 4 = 2")
def user_safe_message(spark, sf):
    """What a user reads when a stage fails: by the class of the failure, never its details."""
    code = F.when(F.col("stage") == "error", "PARSE").when(F.col("stage") == "click", "OCR").when(F.col("stage") == "view", "INDEX").otherwise("X")
    return S.jobs(spark, sf).where("status = 'FAILED'").select(F.col("job_id").alias("event_id"), R.safe_message(code).alias("message"))


# noise, headings, modules

_LOW = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"
_PHONE = "(regexp_matches(trim(text), '^[+()\\-\\s\\d.]+$') AND length(regexp_replace(text, '\\D', '', 'g')) BETWEEN 8 AND 15)"
_NOISE = f"({_LOW} = '' OR {_PHONE} OR regexp_matches({_LOW}, 'knowledge\\s*\\.\\s*insight\\s*\\.\\s*action') OR regexp_matches({_LOW}, '^(page|slide)?\\s*\\d+$') OR regexp_matches({_LOW}, 'https?://|www\\.') OR contains({_LOW}, '@') OR {_LOW} IN ('confidential', 'thank you', 'thankyou', 'contact us', 'www'))"
_WORDS = "len(regexp_extract_all(text, '\\S+'))"
_SENT = f"(regexp_matches(trim(text), '[.!;,]$') OR ({_WORDS} >= 8 AND regexp_matches(text, '(?i)\\b(is|are|was|were|has|have|had|will|would|can|could|should|may|might|must)\\b')))"
_ALPHA = "list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x) > 2)"
_SHARE = f"(CASE WHEN len({_ALPHA}) > 0 THEN len(list_filter({_ALPHA}, lambda x: regexp_matches(x, '^[A-Z]'))) / len({_ALPHA}) ELSE 0 END)"
_SCORE = f"""scored AS (SELECT block_id, document_id, page_number, y, text, CASE WHEN trim(text) = '' OR {_WORDS} > 12 OR {_NOISE} THEN 0 ELSE
CASE WHEN font_size / top >= 0.9 THEN 5 WHEN font_size / top >= 0.75 THEN 4 WHEN font_size / top >= 0.6 THEN 2 ELSE 0 END + CASE WHEN bold THEN 3 ELSE 0 END + CASE WHEN {_WORDS} <= 6 THEN 2 WHEN {_WORDS} <= 10 THEN 1 ELSE 0 END
+ CASE WHEN {_SHARE} >= 0.6 THEN 2 WHEN {_SHARE} >= 0.4 THEN 1 ELSE 0 END + CASE WHEN trim(text) LIKE '%?' THEN 2 ELSE 0 END - CASE WHEN {_SENT} THEN 4 ELSE 0 END END AS score FROM (SELECT *, max(font_size) OVER (PARTITION BY document_id, page_number) AS top FROM blocks) b)"""


def _scored(spark, sf):
    top = F.max("font_size").over(Window.partitionBy("document_id", "page_number"))
    return S.blocks(spark, sf).withColumn("top", top).withColumn("score", R.module_score(F.col("text"), F.col("font_size"), F.col("top"), F.col("bold")))


@query(f"WITH {B}, {_SCORE} SELECT block_id, CAST(score AS INTEGER) AS score FROM scored")
def module_score(spark, sf):
    return _scored(spark, sf).select("block_id", F.col("score").cast("int").alias("score"))


_NUM = r"regexp_extract(trim(text), '^(\d+(?:\.\d+)*)[.)]?\s+(\S.*)$', {0})"
_MODS = f"""{_SCORE}, named AS (SELECT *, {_NUM.format(1)} AS number, CASE WHEN {_NUM.format(1)} <> '' THEN {_NUM.format(2)} ELSE trim(text) END AS name FROM scored WHERE score >= 7),
firsts AS (SELECT *, row_number() OVER (PARTITION BY document_id, number, regexp_replace(lower(name), '\\s+', ' ', 'g') ORDER BY page_number, coalesce(y, 0), block_id) AS rn FROM named), mods AS (SELECT * FROM firsts WHERE rn = 1)"""


def visual_modules(spark, sf):
    """Blocks that look like headings, in reading order: number, name; of equal ones the first."""
    t = F.trim("text")
    number = F.regexp_extract(t, R.NUMBERED, 1)
    named = _scored(spark, sf).where("score >= 7").select("document_id", "page_number", F.coalesce("y", F.lit(0.0)).alias("y"), "block_id", number.alias("number"), F.when(number != "", F.regexp_extract(t, R.NUMBERED, 2)).otherwise(t).alias("name"))
    return extraction.first_of(named, ["document_id", "number", F.regexp_replace(F.lower("name"), r"\s+", " ")], ["page_number", "y", "block_id"])


@query(f"WITH {B}, {_MODS} SELECT document_id, page_number, block_id, number, name FROM mods")
def modules_from_visual_blocks(spark, sf):
    return visual_modules(spark, sf).drop("y")


@query(f"WITH {B}, {_MODS}, p AS (SELECT document_id, number, min(block_id) AS block_id FROM mods WHERE number <> '' GROUP BY ALL) SELECT m.document_id, m.block_id, m.number, p.block_id AS parent_block FROM mods m LEFT JOIN p ON p.document_id = m.document_id AND p.number = regexp_replace(m.number, '\\.?\\d+$', '') WHERE m.number <> ''")
def module_hierarchy(spark, sf):
    """The numbered modules and their parents: the number without its last part; without one it is a root."""
    n = visual_modules(spark, sf).where("number <> ''").select("document_id", "block_id", "number")
    up = n.groupBy("document_id", F.col("number").alias("up")).agg(F.min("block_id").alias("parent_block"))
    return n.withColumn("up", F.regexp_replace("number", r"\.?\d+$", "")).join(up, ["document_id", "up"], "left").select("document_id", "block_id", "number", "parent_block")


@query(f"WITH {B}, {_MODS}, w AS (SELECT DISTINCT document_id, CAST(v AS VARCHAR) AS wanted FROM blocks, (VALUES ('1'), ('2.1'), ('9')) t(v)) SELECT w.document_id, w.wanted, min(m.block_id) AS block_id FROM w LEFT JOIN mods m ON m.document_id = w.document_id AND m.number = w.wanted GROUP BY ALL")
def find_module(spark, sf):
    wanted = S.blocks(spark, sf).select("document_id").distinct().select("document_id", F.explode(T.strings(["1", "2.1", "9"])).alias("wanted"))
    at = visual_modules(spark, sf).where("number <> ''").groupBy("document_id", F.col("number").alias("wanted")).agg(F.min("block_id").alias("block_id"))
    return wanted.join(at, ["document_id", "wanted"], "left")


@query(f"WITH {B}, t AS (SELECT document_id, page_number, trim(text) AS name, row_number() OVER (PARTITION BY document_id, regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') ORDER BY page_number, block_id) AS rn FROM blocks WHERE kind = 'SLIDE_TITLE' AND NOT {_NOISE}) SELECT document_id, page_number, name FROM t WHERE rn = 1")
def modules_from_slide_titles(spark, sf):
    t = S.blocks(spark, sf).where((F.col("kind") == "SLIDE_TITLE") & ~R.is_noise_slide(F.col("text"))).select("document_id", "page_number", "block_id", F.trim("text").alias("name"))
    return extraction.first_of(t, ["document_id", F.regexp_replace(F.lower("name"), r"\s+", " ")], ["page_number", "block_id"]).drop("block_id")


@query(f"WITH {B}, {_MODS}, s AS (SELECT document_id, count(*) AS n FROM mods WHERE document_id % 3 <> 0 GROUP BY 1), t AS (SELECT document_id, count(DISTINCT {_LOW}) AS n FROM blocks WHERE kind = 'SLIDE_TITLE' AND NOT {_NOISE} GROUP BY 1) SELECT document_id, 'blocks' AS source, n FROM s UNION ALL SELECT document_id, 'text', n FROM t WHERE document_id NOT IN (SELECT document_id FROM s)")
def extract_modules_router(spark, sf):
    """The modules by layout; where a document has none, those by its text."""
    by_layout = visual_modules(spark, sf).where("document_id % 3 <> 0").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    by_text = modules_from_slide_titles(spark, sf).groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).join(by_layout, "document_id", "left_anti")
    return by_layout.withColumn("source", F.lit("blocks")).unionByName(by_text.withColumn("source", F.lit("text")))


@query(f"WITH {B} SELECT block_id, {_NOISE} AS noise, {_SENT} AS sentence FROM blocks")
def slide_noise(spark, sf):
    t = F.col("text")
    return S.blocks(spark, sf).select("block_id", R.is_noise_slide(t).alias("noise"), R.is_sentence_slide(t).alias("sentence"))


_PLAIN = "trim(regexp_replace(replace(text, chr(160), ' '), '\\s+', ' ', 'g'))"
_PNOISE = f"(trim(text) = '' OR contains(lower({_PLAIN}), 'knowledge. insight. action') OR regexp_matches(trim(text), '^[A-Za-z0-9+_.-]+@[A-Za-z0-9.-]+$') OR regexp_matches(trim(text), '(?i)^(https?://|www\\.)\\S+$') OR (regexp_matches(trim(text), '^[+()\\-\\s\\d]{{8,25}}$') AND length(regexp_replace(text, '\\D', '', 'g')) BETWEEN 8 AND 15) OR regexp_matches(trim(text), '^\\d{{1,4}}$'))"
_PSENT = f"(trim(text) <> '' AND (regexp_matches(trim(text), '[.;:]$') OR {_WORDS} > 14 OR regexp_matches(lower(trim(text)), '^(the|this|it is|a|an) ')))"


@query(f"WITH {B} SELECT block_id, {_PNOISE} AS noise, {_PSENT} AS sentence, length({_PLAIN}) AS n FROM blocks")
def page_noise(spark, sf):
    t = F.col("text")
    return S.blocks(spark, sf).select("block_id", R.is_noise_page(t).alias("noise"), R.is_sentence_page(t).alias("sentence"), F.length(R.plain_space(t)).alias("n"))


@query(f"WITH {B}, l AS (SELECT document_id, page_number, text, block_id FROM blocks), k AS (SELECT document_id, page_number, count(*) FILTER (WHERE NOT {_PNOISE}) AS n, coalesce(sum(CASE WHEN NOT {_PNOISE} THEN length({_PLAIN}) END), 0) AS c FROM l GROUP BY ALL) SELECT document_id, page_number, n >= 2 OR c >= 40 AS meaningful FROM k")
def meaningful_text(spark, sf):
    """Whether a page's own text suffices, or it must be recognised from its image."""
    pages = S.blocks(spark, sf).groupBy("document_id", "page_number").agg(F.array_join(F.collect_list("text"), "\n").alias("t"))
    return pages.select("document_id", "page_number", R.is_meaningful(F.col("t")).alias("meaningful"))


@query(f"WITH {B}, m AS (SELECT document_id, page_number, block_id, trim(text) AS text, row_number() OVER (PARTITION BY document_id, page_number ORDER BY block_id) AS rn FROM blocks WHERE NOT {_PNOISE}), t AS (SELECT * FROM m WHERE rn <= 3 AND length(text) BETWEEN 4 AND 90 AND NOT {_PSENT} AND length(regexp_replace(text, '[^.,:;!?()\\[\\]{{}}=/\\\\]', '', 'g')) <= 5), f AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY rn) AS k FROM t) SELECT document_id, page_number, text AS title FROM f WHERE k = 1")
def ocr_title(spark, sf):
    """A recognised page's title: the first of its first three lines with content that looks like one."""
    w = Window.partitionBy("document_id", "page_number").orderBy("block_id")
    m = S.blocks(spark, sf).where(~R.is_noise_page(F.col("text"))).select("document_id", "page_number", "block_id", F.trim("text").alias("title")).withColumn("rn", F.row_number().over(w))
    return extraction.first_of(m.where((F.col("rn") <= 3) & R.is_ocr_title(F.col("title"))), ["document_id", "page_number"], ["rn"]).select("document_id", "page_number", "title")


@query(f"WITH {B}, m AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY block_id) AS rn FROM blocks WHERE NOT {_PNOISE}) SELECT document_id, page_number, block_id, CASE WHEN rn = 1 THEN 'PAGE_TITLE' ELSE 'PAGE' END AS kind, CAST(25 * (rn - 1) AS INTEGER) AS y, CASE WHEN rn = 1 THEN 24 ELSE 12 END AS font_size FROM m")
def ocr_blocks(spark, sf):
    """Recognised lines as blocks, 25 apart; the first one is the page's title."""
    w = Window.partitionBy("document_id", "page_number").orderBy("block_id")
    m = S.blocks(spark, sf).where(~R.is_noise_page(F.col("text"))).select("document_id", "page_number", "block_id", F.row_number().over(w).alias("rn"))
    return m.select("document_id", "page_number", "block_id", F.when(F.col("rn") == 1, "PAGE_TITLE").otherwise("PAGE").alias("kind"), (25 * (F.col("rn") - 1)).alias("y"), F.when(F.col("rn") == 1, 24).otherwise(12).alias("font_size"))


@query(f"WITH {B}, b AS (SELECT *, lag(text) OVER (PARTITION BY document_id ORDER BY page_number, coalesce(y, 0), block_id) AS prev FROM blocks WHERE NOT {_PNOISE}) SELECT document_id, block_id, text FROM b WHERE prev IS NULL OR prev <> text")
def pdf_blocks(spark, sf):
    """Text blocks in order without noise, and without one that repeats the block before."""
    w = Window.partitionBy("document_id").orderBy("page_number", F.coalesce("y", F.lit(0.0)), "block_id")
    b = S.blocks(spark, sf).where(~R.is_noise_page(F.col("text"))).withColumn("prev", F.lag("text").over(w))
    return b.where("prev IS NULL OR prev <> text").select("document_id", "block_id", "text")


@query(f"WITH {B}, c AS (SELECT *, kind = 'SLIDE_TITLE' AS holder, NOT {_PNOISE} AND NOT {_PSENT} AS fits FROM blocks WHERE trim(text) <> ''), h AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY coalesce(y, 0), block_id) AS rn FROM c WHERE holder), l AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY coalesce(font_size, 12) DESC, coalesce(y, 0), block_id) AS rn FROM c WHERE fits), o AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY coalesce(y, 0), block_id) AS rn FROM c WHERE fits AND length(text) <= 100), p AS (SELECT DISTINCT document_id, page_number FROM c) SELECT p.document_id, p.page_number, coalesce(h.text, CASE WHEN length(l.text) <= 100 THEN l.text END, o.text) AS title FROM p LEFT JOIN h ON h.document_id = p.document_id AND h.page_number = p.page_number AND h.rn = 1 LEFT JOIN l ON l.document_id = p.document_id AND l.page_number = p.page_number AND l.rn = 1 LEFT JOIN o ON o.document_id = p.document_id AND o.page_number = p.page_number AND o.rn = 1")
def pptx_titles(spark, sf):
    """A slide's title: its placeholder, else the largest text that is neither noise nor a sentence, else the topmost short one."""
    return layout.slide_titles(S.blocks(spark, sf))


@query(f"WITH {LINES}, s AS (SELECT document_id, pos, line AS text, line, lag(line) OVER w AS prev, lead(line) OVER w AS next FROM lines WINDOW w AS (PARTITION BY document_id ORDER BY pos)), g AS (SELECT document_id, pos, line, regexp_extract(line, '^(\\d+(?:\\.\\d+)*)[.)]?\\s+(\\S.*)$', 1) AS number, CASE WHEN coalesce(prev, '') = '' THEN 2 ELSE 0 END + CASE WHEN coalesce(next, '') = '' THEN 2 ELSE 0 END + CASE WHEN {_SHARE} >= 0.8 THEN 3 WHEN {_SHARE} >= 0.5 THEN 2 ELSE 0 END + CASE WHEN {_WORDS} <= 6 THEN 2 ELSE 0 END + CASE WHEN contains(line, '?') THEN 2 ELSE 0 END AS score FROM s WHERE line <> '' AND NOT {_NOISE}) SELECT document_id, pos, number, line AS name FROM g WHERE number <> '' OR score >= 5")
def modules_from_text(spark, sf):
    """Lines that head a module: numbered ones, and those with a heading's score of 5 or more; noise never."""
    w = Window.partitionBy("document_id").orderBy("pos")
    line, share = F.col("line"), T.title_case_share(F.col("line"))
    blank = lambda c: F.when(F.coalesce(c, F.lit("")) == "", 2).otherwise(0)
    around = V.lines(spark, sf).withColumn("around", blank(F.lag("line").over(w)) + blank(F.lead("line").over(w))).where((line != "") & ~R.is_noise_slide(line))
    score = F.col("around") + F.when(share >= 0.8, 3).when(share >= 0.5, 2).otherwise(0) + F.when(R.words(line) <= 6, 2).otherwise(0) + F.when(line.contains("?"), 2).otherwise(0)
    return around.withColumn("number", F.regexp_extract(line, R.NUMBERED, 1)).where((F.col("number") != "") | (score >= 5)).select("document_id", "pos", "number", line.alias("name"))


@query(f"WITH {B} SELECT document_id, block_id, regexp_extract(trim(text), '^(\\d+(?:\\.\\d+)*)[.)]?\\s+(\\S.*)$', 1) AS number, regexp_extract(trim(text), '^(\\d+(?:\\.\\d+)*)[.)]?\\s+(\\S.*)$', 2) AS name FROM blocks WHERE regexp_matches(trim(text), '^(\\d+(?:\\.\\d+)*)[.)]?\\s+(\\S.*)$')")
def numbered_modules(spark, sf):
    t = F.trim("text")
    return S.blocks(spark, sf).where(t.rlike(R.NUMBERED)).select("document_id", "block_id", F.regexp_extract(t, R.NUMBERED, 1).alias("number"), F.regexp_extract(t, R.NUMBERED, 2).alias("name"))


@query(f"WITH {B}, r AS (SELECT document_id, page_number, floor(coalesce(y, 0) / 10) AS row, string_agg(text, ' | ' ORDER BY block_id) AS cells FROM blocks WHERE text <> '' GROUP BY ALL) SELECT document_id, page_number, string_agg(cells, chr(10) ORDER BY row) AS body FROM r GROUP BY ALL")
def render_table(spark, sf):
    """Cells joined by bars, rows by line ends; empty rows are left out."""
    cells = lambda by, what, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, what))), lambda x: x[what]), sep)
    rows = S.blocks(spark, sf).where("text <> ''").groupBy("document_id", "page_number", F.floor(F.coalesce("y", F.lit(0.0)) / 10).alias("row")).agg(cells("block_id", "text", " | ").alias("cells"))
    return rows.groupBy("document_id", "page_number").agg(cells("row", "cells", "\n").alias("body"))
