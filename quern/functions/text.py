"""Text rules as Column expressions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lexicons, topics, document types, stop words and patterns of the text rules.
POSITIVE = ["growth", "increase", "profit", "success", "innovative", "excellent", "improved", "positive", "strong", "outperform", "leading", "benefit", "efficient"]
NEGATIVE = ["decline", "loss", "risk", "failure", "delay", "negative", "poor", "drop", "decrease", "threat", "vulnerability", "deficit", "issue"]
TOPICS = {
    "Financial Growth": ["revenue", "margin", "quarter", "fiscal", "profit", "earnings"],
    "Microservices Architecture": ["microservices", "api", "spring boot", "fastapi", "react", "docker"],
    "Cloud & Database": ["supabase", "postgres", "database", "cloud", "security"],
    "AI & Intelligence": ["ai", "document", "summarization", "extraction", "nlp", "processing"],
    "Operational Execution": ["strategy", "roadmap", "deployment", "pipeline", "ci/cd"],
}
NO_TOPICS = ["General Information", "Document Processing"]
TYPES = [
    ("financial_report", 0.88, ["revenue", "ebitda", "financial report", "forecast"]),
    ("contract", 0.93, ["master services agreement", "termination", "contract"]),
    ("proposal", 0.82, ["proposal", "statement of work"]),
    ("policy", 0.8, ["policy"]),
]
STOPWORDS = ["a", "an", "the", "in", "on", "of", "for", "to", "and", "or", "is", "are", "was", "were", "be", "been", "by", "that", "this", "it", "as", "at", "with"]
WORDS_AND_MARKS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
TOKEN = "[0-9a-z]+"
BARE_WORD = r"(?<![\p{L}\p{N}_])[0-9a-z]+(?![\p{L}\p{N}_])"
HEADING_NUMBER = r"^(\d+(?:\.\d+)*)[.)]?\s+\S"
HYPHENATED = r"\b[A-Za-z0-9]+(?:-[A-Za-z0-9]+)+\b"
AMOUNT = r"(?i)(?:[$€£]\s?\d[\d,]*(?:\.\d+)?|\b\d[\d,]*(?:\.\d+)?\s?(?:USD|EUR|INR)\b)"
ISO_DATE = r"\b\d{4}-\d{2}-\d{2}\b"


def strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def count_tokens(text: Column) -> Column:
    """Words and single marks: 0 for a blank text, else at least 1."""
    return F.when(text.rlike(r"^\s*$"), 0).otherwise(F.greatest(F.lit(1), F.size(extract_all(text, WORDS_AND_MARKS))))


def simple_tokens(text: Column) -> Column:
    return extract_all(F.lower(text), TOKEN)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")


def lines(text: Column) -> Column:
    return F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))


def is_scanned(page: Column, least: int = 80) -> Column:
    """Whether a page has so little text that it was scanned."""
    return F.length(F.trim(F.coalesce(page, F.lit("")))) < least


def is_heading(line: Column) -> Column:
    first = F.substring(line, 1, 1)
    plain = (F.size(extract_all(line, r"\S+")) <= 12) & (F.length(line) <= 120) & ~line.rlike("[.,;:]$") & (first == F.upper(first)) & (first != F.lower(first))
    return (line != "") & (line.startswith("#") | line.rlike(HEADING_NUMBER) | plain)


def heading_level(line: Column) -> Column:
    number = F.regexp_extract(line, HEADING_NUMBER, 1)
    return F.when(number != "", F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1).otherwise(1)


def is_identifier_like(text: Column) -> Column:
    t = F.trim(text)
    return F.length(t).between(3, 64) & t.rlike("[0-9]") & (t.contains("-") | ~t.rlike(r"\s"))


def verbatim_terms(text: Column) -> Column:
    """Quoted terms, hyphenated codes with a digit, amounts, ISO dates; each once, in this order."""
    codes = F.filter(extract_all(text, HYPHENATED), lambda x: x.rlike("[0-9]"))
    return F.array_distinct(F.concat(F.transform(extract_all(text, '"([^"]+)"', 1), lambda x: F.trim(x)), codes, extract_all(text, AMOUNT), extract_all(text, ISO_DATE)))


def normalize_entity(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")


def sentiment(text: Column) -> Column:
    """struct(label, confidence, positive, negative)."""
    words = extract_all(F.lower(text), r"[\p{L}\p{N}_]+")
    pos, neg = F.size(F.filter(words, lambda w: w.isin(POSITIVE))), F.size(F.filter(words, lambda w: w.isin(NEGATIVE)))
    n = pos + neg
    label = F.when(n == 0, "neutral").when((pos - neg) / n > 0.15, "positive").when((pos - neg) / n < -0.15, "negative").otherwise("neutral")
    return F.struct(label.alias("label"), F.when(n == 0, 0.85).otherwise(F.least(F.lit(0.98), 0.70 + n * 0.05)).alias("confidence"), pos.alias("positive"), neg.alias("negative"))


def topics(text: Column) -> Column:
    low = F.lower(text)
    hit = lambda words: F.exists(strings(words), lambda w: low.contains(w))
    found = F.filter(F.array(*(F.when(hit(words), topic) for topic, words in TOPICS.items())), lambda t: t.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(strings(NO_TOPICS))


def document_type(text: Column) -> Column:
    """struct(type, confidence): the first rule that matches."""
    low, out = F.lower(text), F
    for kind, confidence, words in TYPES:
        rule = low.contains(words[0])
        for w in words[1:]:
            rule |= low.contains(w)
        out = out.when(rule, F.struct(F.lit(kind).alias("type"), F.lit(confidence).alias("confidence")))
    unsure = low.contains("ambiguous") | (F.length(F.trim(low)) < 40)
    return out.otherwise(F.struct(F.lit("other").alias("type"), F.when(unsure, 0.35).otherwise(0.55).alias("confidence")))


def summary(text: Column, longest: int = 150) -> Column:
    """The first two sentences; if they are longer, cut at a space."""
    two = F.array_join(F.slice(sentences(text), 1, 2), " ")
    return F.when(F.length(two) <= longest, two).otherwise(F.concat(F.regexp_replace(F.substring(two, 1, longest), " [^ ]*$", ""), F.lit("...")))


def is_phone(text: Column) -> Column:
    t = F.trim(text)
    return t.rlike(r"^[+()\-\s\d.]+$") & F.length(F.regexp_replace(t, r"\D", "")).between(8, 15)


def is_noise(line: Column) -> Column:
    """Blank, phone, page or slide number, URL or mail address."""
    low = F.lower(F.trim(line))
    return (low == "") | is_phone(line) | low.rlike(r"^(page|slide)?\s*\d{1,4}$") | low.rlike(r"https?://|www\.") | low.contains("@")


def title_case_share(line: Column) -> Column:
    words = F.filter(extract_all(line, r"[A-Za-z]+"), lambda w: F.length(w) > 2)
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: w.rlike("^[A-Z]"))) / F.size(words)).otherwise(0.0)


def bare_words(text: Column) -> Column:
    """Runs of a-z and digits that no other letter, digit or underscore touches."""
    return extract_all(F.lower(text), BARE_WORD)


def claim_words(claim: Column) -> Column:
    """The significant words of a claim."""
    return F.filter(bare_words(claim), lambda w: ~w.isin(STOPWORDS) & (F.length(w) > 2))


def text_support(claim: Column, words: Column, passage: Column, tokens: Column, least: float = 0.25) -> Column:
    """Whether a passage supports a claim: as a substring, or by the share of its significant words.

    words are claim_words of the claim, tokens bare_words of the passage: columns of their own, below the join that brings
    the two together, or they would be taken anew for each pair.
    """
    c, p = F.trim(F.lower(claim)), F.lower(passage)
    held = F.filter(words, lambda w: F.array_contains(tokens, w))
    return (c != "") & (F.trim(p) != "") & (p.contains(c) | ((F.size(words) > 0) & (F.size(held) >= least * F.size(words))))


def pieces(text: Column, width: int = 200) -> Column:
    """Pieces of `width` characters at most, cut after the last space: each round finds where the next piece begins, and no text is copied but the pieces."""
    head = lambda at: F.substr(text, at, F.lit(width))
    # of a full head: its length up to the last space, all of it where there is none
    size = lambda at: F.when(F.length(text) - at + 1 <= width, F.length(text) - at + 1).otherwise(width + 1 - F.coalesce(F.nullif(F.locate(" ", F.reverse(head(at))), F.lit(0)), F.lit(1)))
    starts = F.struct(F.array(F.lit(1)).alias("at"), F.lit(1).alias("next"))
    # two pieces in a row have more than `width` characters
    rounds = F.sequence(F.lit(0), F.length(text) + width, F.lit(max(1, width // 2)))
    step = lambda a, _: F.when(a["next"] > F.length(text), a).otherwise(F.struct(F.array_append(a["at"], a["next"] + size(a["next"])).alias("at"), (a["next"] + size(a["next"])).alias("next")))
    cuts = F.aggregate(rounds, starts, step, lambda a: a["at"])
    return F.transform(F.slice(cuts, F.lit(1), F.size(cuts) - 1), lambda at, i: F.substr(text, at, F.element_at(cuts, i + 2) - at))
