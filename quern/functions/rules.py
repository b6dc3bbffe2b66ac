"""Rules on questions, fields, headings and noise as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import text as T

# Patterns, stop words, phrases and confidences of the rules.
QUERY_STOPWORDS = ["a", "an", "the", "what", "whats", "what's", "is", "are", "was", "were", "can", "you", "please", "tell", "me", "about", "of", "for", "to", "in", "on", "do", "does", "did"]
CODE_WORD = "[0-9A-Za-z]+(?:-[0-9A-Za-z]+)*"
PARTIES = r"(?i)parties?:\s*([^\n.]+)"
# possessive where what follows can't be what was taken: a word or its space is never given back
COMPANY = r"\b([A-Z][A-Za-z]++(?:\s++[A-Z][A-Za-z]++)*\s++(?:Corp|Ltd|LLC|Inc)\.?)\b"
EFFECTIVE = r"(?i)Effective Date[:\s]+(\d{4}-\d{2}-\d{2})"
ANY_DATE = r"\b(\d{4}-\d{2}-\d{2})\b"
AMOUNT_BEHIND, LABEL_BEFORE = r"^\s*\$([\d,]+(?:\.\d{2})?)", r"([A-Za-z ]{3,})\z"
REFERENCE = r"(?i)\b(?:ref(?:erence)?|agreement)\s*(?:#|no\.?)?\s*([A-Z0-9-]{4,})\b"
TOPICS = r"(?i)topics?:\s*([^\n]+)"
NOTICE = r"(?i)(\d+\s+days?)\s+(?:written\s+)?notice"
AFTER_LABEL = r"(?i){0}\s*[:\s]+([^\n.]+)"
AMOUNT_AFTER = r"(?i){0}\s*[:\s]+\$?([\d,]+(?:\.\d{{2}})?)"
UNIVERSAL = {"Title": 0.9, "Parties": 0.97, "Effective Date": 0.97, "Amounts": 0.85, "Reference Numbers": 0.8, "Topics": 0.75}
#: Of each document type: field, confidence, label, whether an amount follows.
BY_TYPE = {
    "financial_report": [("Revenue", 0.92, "revenue", True), ("EBITDA", 0.9, "ebitda", True), ("Forecast Period", 0.86, "forecast period", False), ("Reporting Period", 0.86, "reporting period", False)],
    "proposal": [("Customer", 0.8, "customer", False), ("Offering", 0.8, "offering", False), ("Price", 0.78, "price", True)],
    "policy": [("Policy Scope", 0.77, "policy scope", False), ("Policy Owner", 0.77, "policy owner", False)],
}
REWRITES = {"comparison": "key differences, obligations, terms", "summary": "summary of key terms and obligations", "cross-document": "documents mentioning the same entities and facts"}
TWO_CONTRACTS = ["what's different between these two contracts?", "what is different between these two contracts?"]
TWO_CONTRACTS_REWRITE = "termination clauses, obligations, key differences"
COMPARISON, CROSS = ["different", "difference", "compare", "versus", " vs "], ["across documents", "cross-document", "which documents"]
AUXILIARY = r"(?i)\b(is|are|was|were|has|have|had|will|would|can|could|should|may|might|must)\b"
FOOTER = r"knowledge\s*\.\s*insight\s*\.\s*action"
BOILERPLATE = ["confidential", "thank you", "thankyou", "contact us", "www"]
MAIL_LINE, URL_LINE, PAGE_LINE, PHONE_LINE = r"^[A-Za-z0-9+_.-]+@[A-Za-z0-9.-]+$", r"(?i)^(https?://|www\.)\S+$", r"^\d{1,4}$", r"^[+()\-\s\d]{8,25}$"
OPENINGS = ["the ", "this ", "it is ", "a ", "an "]
NUMBERED = r"^(\d+(?:\.\d+)*)[.)]?\s+(\S.*)$"
MESSAGES = {"PARSE": "The file could not be read.", "OCR": "The scanned pages could not be recognised.", "INDEX": "The document could not be indexed."}
OTHER_MESSAGE = "Processing failed."


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def some(text: Column, words: list[str]) -> Column:
    return F.exists(T.strings(words), lambda w: text.contains(w))


def words(text: Column) -> Column:
    """How many words a text has."""
    return F.size(T.extract_all(text, r"\S+"))


# questions


def is_pure_identifier(text: Column) -> Column:
    return T.is_identifier_like(text) & ~F.trim(text).rlike(r"\s")


def keyword_style(question: Column) -> Column:
    """The question's words without stop words; hyphenated ones stay whole, repeats stay."""
    return F.array_join(F.filter(T.extract_all(question, CODE_WORD), lambda w: ~F.lower(w).isin(QUERY_STOPWORDS)), " ")


def question_kind(question: Column) -> Column:
    low = F.lower(question)
    return F.when(some(low, [*TWO_CONTRACTS, *COMPARISON]), "comparison").when(low.contains("summar"), "summary").when(some(low, CROSS), "cross-document").otherwise("fact")


def rewritten(question: Column) -> Column:
    """The search text of a question: a fixed one by its kind, or its own words."""
    kind, own = question_kind(question), keyword_style(question)
    out = F.when(some(F.lower(question), TWO_CONTRACTS), TWO_CONTRACTS_REWRITE)
    for name, phrase in REWRITES.items():
        out = out.when(kind == name, phrase)
    return out.otherwise(F.when(own == "", question).otherwise(own))


def preserve_terms(query: Column, terms: Column) -> Column:
    """The query, and after it the terms that it lacks."""
    missing = F.filter(terms, lambda t: ~query.contains(t))
    return F.when(F.size(missing) > 0, F.concat_ws(" ", query, F.array_join(missing, " "))).otherwise(query)


# fields: array<struct<name, category, value, confidence>>


def field(name: str, value: Column, confidence: float, category: str = "universal") -> Column:
    return F.struct(F.lit(name).alias("field_name"), F.lit(category).alias("field_category"), value.alias("field_value"), F.lit(confidence).alias("confidence"))


def with_values(fields: Column) -> Column:
    """The fields that have a value: filtered when they are made, so each rule runs once."""
    return F.filter(fields, lambda f: F.trim(f["field_value"]) != "")


def parties(text: Column) -> Column:
    companies = F.array_distinct(T.extract_all(text, COMPANY, 1))
    return F.coalesce(F.trim(first(text, PARTIES)), F.nullif(F.array_join(companies, ", "), F.lit("")))


def effective_date(text: Column) -> Column:
    return F.coalesce(first(text, EFFECTIVE), first(text, ANY_DATE))


def amounts(text: Column) -> Column:
    """'label: $n' of every labelled amount: matched once, and only where there is a dollar sign."""
    parts = F.split(text, ":")
    near = F.filter(F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda i: F.struct(F.right(F.get(parts, i), F.lit(30)).alias("label"), F.get(parts, i + 1).alias("value"))), lambda p: p["value"].rlike(AMOUNT_BEHIND))
    found = F.transform(F.filter(near, lambda p: p["label"].rlike(LABEL_BEFORE)), lambda p: F.concat(F.trim(F.regexp_extract(p["label"], LABEL_BEFORE, 1)), F.lit(": $"), F.regexp_extract(p["value"], AMOUNT_BEHIND, 1)))
    return F.when(~text.contains("$") | ~text.contains(":"), F.array().cast("array<string>")).otherwise(found)


def reference(text: Column) -> Column:
    return first(text, REFERENCE)


def topics_line(text: Column) -> Column:
    return F.trim(first(text, TOPICS))


def notice_period(text: Column) -> Column:
    return first(text, NOTICE)


def after_label(text: Column, label: str) -> Column:
    return F.trim(first(text, AFTER_LABEL.format(label)))


def amount_after(text: Column, label: str) -> Column:
    return first(text, AMOUNT_AFTER.format(label))


def first_line(text: Column) -> Column:
    return F.get(F.filter(T.lines(text), lambda x: x != ""), 0)


def single_values(text: Column) -> dict[str, Column]:
    """The universal fields that a text has once."""
    return {"Title": first_line(text), "Parties": parties(text), "Effective Date": effective_date(text), "Reference Numbers": reference(text), "Topics": topics_line(text)}


def universal_fields(text: Column, wanted: Callable[[str], bool] = lambda name: True) -> Column:
    """The fields of any document; wanted: of which names."""
    c = UNIVERSAL
    found = F.concat(F.array(*(field(n, v, c[n]) for n, v in single_values(text).items() if wanted(n))), F.transform(amounts(text), lambda a: field("Amounts", a, c["Amounts"])))
    return with_values(found)


def type_fields(text: Column, kind: Column) -> Column:
    """The fields of the document's type; the category names it."""
    low, notice = F.lower(text), notice_period(text)
    ended = low.contains("termination") | low.contains("notice")
    contract = [
        field("Obligations", F.when(low.contains("obligation") | low.contains("shall"), "Perform services per agreement."), 0.84, "contract_specific"),
        field("Termination Terms", F.when(ended, F.coalesce(notice, F.lit("30 days"))), 0.81, "contract_specific"),
        field("Termination Notice Period", F.when(ended, notice), 0.81, "contract_specific"),
    ]
    out = F.when(kind == "contract", F.array(*contract))
    for name, rules in BY_TYPE.items():
        out = out.when(kind == name, F.array(*(field(n, (amount_after if money else after_label)(text, label), c, f"{name}_specific") for n, c, label, money in rules)))
    return with_values(F.coalesce(out, F.array(field("", F.lit(""), 0.0))))


def typed_values(text: Column, low: Column, kind: Column) -> dict[str, Column]:
    """The values of the types' fields but a contract's, null where the text is of another type. low: the text in lower case, which has a field's label in any case."""
    take = lambda label, money: (amount_after if money else after_label)(text, label)
    return {n: F.when((kind == name) & low.contains(label), take(label, money)) for name, rules in BY_TYPE.items() for n, _, label, money in rules}


# lines and blocks


def is_noise_slide(text: Column) -> Column:
    """A block that is no module: blank, phone, footer, page or slide number, address, boilerplate."""
    t = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return (t == "") | T.is_phone(text) | t.rlike(FOOTER) | t.rlike(r"^(page|slide)?\s*\d+$") | t.rlike(r"https?://|www\.") | t.contains("@") | t.isin(BOILERPLATE)


def is_phone_line(text: Column) -> Column:
    t = F.trim(text)
    return t.rlike(PHONE_LINE) & F.length(F.regexp_replace(t, r"\D", "")).between(8, 15)


def plain_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, "\u00a0", " "), r"\s+", " "))


def is_noise_page(text: Column) -> Column:
    """A line of a page that is no content: blank, footer, mail or web address, phone, page number."""
    t = F.trim(text)
    return (t == "") | F.lower(plain_space(text)).contains("knowledge. insight. action") | t.rlike(MAIL_LINE) | t.rlike(URL_LINE) | is_phone_line(text) | t.rlike(PAGE_LINE)


def is_sentence_slide(text: Column) -> Column:
    t = F.trim(text)
    return t.rlike(r"[.!;,]$") | ((words(t) >= 8) & t.rlike(AUXILIARY))


def is_sentence_page(text: Column) -> Column:
    t = F.trim(text)
    opens = F.lit(False)
    for o in OPENINGS:
        opens |= F.lower(t).startswith(o)
    return (t != "") & (t.rlike("[.;:]$") | (words(t) > 14) | opens)


def is_ocr_title(line: Column) -> Column:
    marks = F.length(F.regexp_replace(line, r"[^.,:;!?()\[\]{}=/\\]", ""))
    return F.length(line).between(4, 90) & ~(is_phone_line(line) | line.rlike(MAIL_LINE) | line.rlike(URL_LINE)) & ~is_sentence_page(line) & (marks <= 5)


def is_meaningful(text: Column) -> Column:
    """Whether a page has content: two lines, or forty characters, that are no noise."""
    kept = F.filter(F.transform(F.split(text, r"\r?\n"), plain_space), lambda x: ~is_noise_page(x))
    return (F.size(kept) >= 2) | (F.aggregate(kept, F.lit(0), lambda n, x: n + F.length(x)) >= 40)


def module_score(text: Column, font: Column, largest: Column, bold: Column) -> Column:
    """How much a block looks like a heading; 7 and more is one."""
    t, n, share = F.trim(text), words(text), T.title_case_share(text)
    ratio = F.when(largest > 0, font / largest)
    score = F.when(ratio >= 0.9, 5).when(ratio >= 0.75, 4).when(ratio >= 0.6, 2).otherwise(0) + F.when(bold, 3).otherwise(0) + F.when(n <= 6, 2).when(n <= 10, 1).otherwise(0)
    score += F.when(share >= 0.6, 2).when(share >= 0.4, 1).otherwise(0) + F.when(t.endswith("?"), 2).otherwise(0) - F.when(is_sentence_slide(t), 4).otherwise(0)
    return F.when((t == "") | (n > 12) | is_noise_slide(t), 0).otherwise(score)


# graph values


def split_names(value: Column) -> Column:
    """The names of a list, parted by commas and 'and'."""
    return F.filter(F.transform(F.split(value, r"(?i),|\band\b"), lambda x: F.btrim(x, F.lit(" ."))), lambda x: x != "")


def date_label(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return F.when(low.contains("expir"), "expiry date").when(low.contains("effective"), "effective date").otherwise(low)


def amount_label(name: Column, value: Column) -> Column:
    """What stands before the colon of an amount, unless it is a number or has a currency sign; else the field's name."""
    prefix = F.trim(F.substring_index(value, ":", 1))
    named = value.contains(":") & (prefix != "") & ~prefix.rlike("^[0-9]") & ~prefix.rlike("[$₹]")
    return F.when(named, F.lower(prefix)).otherwise(F.lower(F.trim(name)))


def parse_amount(value: Column) -> Column:
    """struct(number, currency): digits without commas, '' where there are none; INR before USD before EUR."""
    up = F.upper(value)
    currency = F.when(value.contains("₹") | up.contains("INR"), "INR").when(value.contains("$") | up.contains("USD"), "USD").when(value.contains("€") | up.contains("EUR"), "EUR").otherwise("")
    return F.struct(F.replace(F.regexp_extract(value, r"([\d,]+(?:\.\d+)?)", 1), F.lit(","), F.lit("")).alias("number"), currency.alias("currency"))


def uuid_or_none(text: Column) -> Column:
    return F.when(text.rlike("^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lower(text))


def safe_message(code: Column) -> Column:
    """What a user is told of a failure: a fixed sentence by its class."""
    out = F.lit(OTHER_MESSAGE)
    for name, message in MESSAGES.items():
        out = F.when(code == name, message).otherwise(out)
    return F.when(code.isNotNull(), out)
