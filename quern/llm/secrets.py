"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

One pass over the texts finds the candidates: the base kinds (assign, access,
hex) and `token`, any run of TOKEN characters that mixes cases and digits. Each
candidate's value is hashed; the hashes are counted by distinct repositories
(documents) and distinct owners (sources), first within each owner, so that a
value that a third of all rows hold is reduced before it meets itself. A value is
a widely copied example where SHARED owners or more hold it, or where COPIED
repositories or more do, of whatever owner (a licence header, a template); one that
one or two owners hold in fewer repositories looks live. Base spans always stay. The method adds the `token` spans, outside
base spans, whose value looks live.

A span's place is the length of all pieces and matches before it, a running sum
over the matches of one row. Defined results: a null or empty text has no spans
and the checksum of the empty string. Rows with the same doc_id, or none, are
judged one by one, and count as one repository of their source; a null source counts
as no owner. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import written

#: Owners, and repositories, from which on a value is a widely copied example.
SHARED, COPIED = 3, 100
# The patterns and the least lengths of the kinds. Upper and lower case are spelt out: (?i) would take characters beyond ASCII as well in some engines.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # as AKIA[A-Z0-9]+ of 20 or more characters
HEX = r"[0-9a-f]{24,}"  # as [0-9a-f]+ of 24 or more characters
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: What every span has in it: a text without it has none, of any kind.
SUSPECT = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}|[pPsStTaA](?:(?<=[pP])[aA][sS][sS][wW]|(?<=[sS])[eE][cC][rR][eE][tT]|(?<=[tT])[oO][kK][eE][nN]|(?<=[aA])[pP][iI]_?[kK][eE][yY])"
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24), ("token", TOKEN, 0, 20))
ORDER = {name: k for k, (name, *_) in enumerate(KINDS)}


def found_in(docs: DataFrame) -> DataFrame:
    """A row per row of docs(doc_id, text, source) and kind with matches, and one per row: rid, doc_id, source, kind (null: the row), sizes, lengths, values."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), text.alias("text"))

    def matches(kind: int, pattern: str, group: int):
        p = F.lit(pattern)
        return F.when(
            F.col("text").rlike(pattern),
            F.struct(
                F.lit(kind).alias("kind"),
                # what lies before each match, and the matches themselves
                F.transform(F.split("text", pattern, -1), lambda x: F.length(x)).alias("gaps"),
                F.transform(F.regexp_extract_all("text", p, F.lit(0)), lambda x: F.length(x)).alias("lengths"),
                F.regexp_extract_all("text", p, F.lit(group)).alias("values"),
            ),
        )

    none = F.struct(F.lit(-1).alias("kind"), F.array().cast("array<int>").alias("gaps"), F.array().cast("array<int>").alias("lengths"), F.array().cast("array<string>").alias("values"))
    marked = base.select("rid", "doc_id", "source", F.filter(F.array(none, *(matches(k, p, g) for k, (_, p, g, _) in enumerate(KINDS))), lambda x: x.isNotNull()).alias("found"))
    return marked.select("rid", "doc_id", "source", F.inline_outer("found"))  # outer: without a filter that would find everything twice


def spans_of(found: DataFrame) -> DataFrame:
    """rid, doc_id, source, kind, start, end, value of every match that is long enough."""
    one = found.where("kind >= 0").select("rid", "doc_id", "source", "kind", F.posexplode(F.arrays_zip(F.slice("gaps", F.lit(1), F.size("lengths")).alias("gap"), F.col("lengths").alias("length"), F.col("values").alias("value"))).alias("k", "m")).select("rid", "doc_id", "source", "kind", "k", "m.*")
    upto = Window.partitionBy("rid", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    placed = one.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(upto).cast("long")).withColumn("start", F.col("end") - F.col("length"))
    least = F.element_at(F.array(*(F.lit(n) for *_, n in KINDS)), F.col("kind") + 1)
    mixed = (F.col("kind") < ORDER["token"]) | (F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[0-9]"))
    return placed.where((F.length("value") >= least) & mixed).select("rid", "doc_id", "source", "kind", "start", "end", "value")


def ownership(spans: DataFrame) -> DataFrame:
    """hash, repositories, owners of every candidate value: distinct ones, counted owner by owner before the owners meet."""
    hashed = spans.select(F.sha2("value", 256).alias("hash"), "source", "doc_id")
    held = hashed.distinct().groupBy("hash", "source").agg(F.count(F.lit(1)).alias("n"))
    return held.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("source").alias("owners"))


def scan(docs: DataFrame, shared: int = SHARED, copied: int = COPIED) -> DataFrame:
    """A row for each row of docs: rid, doc_id, spans (array of kind, start, end, live; the kept ones, by start and kind)."""
    found = written(found_in(docs), "candidates")
    spans = written(spans_of(found), "spans")
    counts = ownership(spans)
    judged = spans.withColumn("hash", F.sha2("value", 256)).join(counts, "hash").select("rid", F.struct("start", F.col("kind").alias("order"), "end", ((F.col("owners") < shared) & (F.col("repositories") < copied)).alias("live")).alias("span"))
    # token spans count where no base span overlaps them: the base spans' furthest end before, and their next start
    flat = judged.select("rid", "span.*", (F.col("span.order") < ORDER["token"]).alias("base"))
    by_start = Window.partitionBy("rid").orderBy("start", "order")
    last_end = F.max(F.when(F.col("base"), F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    next_start = F.min(F.when(F.col("base"), F.col("start"))).over(by_start.rowsBetween(0, Window.unboundedFollowing))
    free = (F.coalesce(last_end, F.lit(0)) <= F.col("start")) & (F.coalesce(next_start, F.col("end")) >= F.col("end"))
    same = F.max(F.col("base").cast("int")).over(Window.partitionBy("rid", "start")) == 0
    kept = flat.withColumn("ok", F.col("base") | (F.col("live") & free & same)).where("ok")
    lists = kept.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "order", "end", "live"))).alias("spans"))
    rows = found.where("kind < 0").select("rid", "doc_id")
    empty = F.array().cast("array<struct<start:bigint,order:int,end:bigint,live:boolean>>")
    return rows.join(lists, "rid", "left").select("rid", "doc_id", F.coalesce("spans", empty).alias("spans"))


def digests(docs: DataFrame) -> DataFrame:
    names = F.array(*(F.lit(n) for n, *_ in KINDS))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["order"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["order"] < ORDER["token"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["order"] == ORDER[k])).cast("long")
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long")
    return scan(docs).select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), live.alias("n_live"))
