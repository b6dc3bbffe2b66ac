"""Queries of the document catalogue, jobs and exports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as T
from quern.operators import writes
from quern.registry import DOCS, query
from quern.sources import files
from quern.sources import views as V
from quern.streaming import jobs


@query(f"WITH {DOCS} SELECT document_id, file_name, workspace_id, group_id FROM docs WHERE processing_status = 'READY'")
def doc_search_active(spark, sf):
    return V.documents(spark, sf).where("processing_status = 'READY'").select("document_id", "file_name", "workspace_id", "group_id")


@query(f"WITH {DOCS}, r AS (SELECT DISTINCT user_id AS document_id FROM events) SELECT r.document_id, CASE WHEN d.document_id IS NULL THEN 'SCOPE_VIOLATION' WHEN d.processing_status = 'READY' THEN 'READY' ELSE 'EXCLUDED' END AS verdict FROM r LEFT JOIN docs d ON d.document_id = r.document_id")
def scope_guard_split(spark, sf):
    """Requested ids, the users of events, against the documents there are."""
    asked = V.table(spark, sf, "events").select(F.col("user_id").alias("document_id")).distinct()
    d = V.documents(spark, sf).select("document_id", "processing_status")
    verdict = F.when(F.col("processing_status").isNull(), "SCOPE_VIOLATION").when(F.col("processing_status") == "READY", "READY").otherwise("EXCLUDED")
    return asked.join(d, "document_id", "left").select("document_id", verdict.alias("verdict"))


@query(f"WITH {DOCS}, g AS (SELECT DISTINCT workspace_id FROM docs), m AS (SELECT w.workspace_id, l.lang AS group_id FROM g w, (SELECT DISTINCT lang FROM documents) l), c AS (SELECT workspace_id, group_id, count(*) AS n FROM docs GROUP BY ALL) SELECT m.workspace_id, m.group_id, coalesce(c.n, 0) AS files_count FROM m LEFT JOIN c USING (workspace_id, group_id)")
def module_counts(spark, sf):
    """Documents of every module of every workspace, empty ones too: workspaces and modules are few rows."""
    d = V.table(spark, sf, "documents").select(F.col("source").alias("workspace_id"), F.col("lang").alias("group_id"))
    n = d.groupBy("workspace_id", "group_id").agg(F.count(F.lit(1)).alias("n"))
    modules = d.select("workspace_id").distinct().crossJoin(d.select("group_id").distinct())  # a row for each pair is what is asked for
    return modules.join(n, ["workspace_id", "group_id"], "left").select("workspace_id", "group_id", F.coalesce("n", F.lit(0)).alias("files_count"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def audit_top20(spark, sf):
    return V.table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id", "event_type")


@query("WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id AS document_id, event_id AS job_id, event_type AS stage FROM r WHERE rn = 1")
def latest_job(spark, sf):
    """Each document's latest job: a partial maximum, no sort."""
    e = V.table(spark, sf, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("j"))
    return e.select(F.col("user_id").alias("document_id"), F.col("j.event_id").alias("job_id"), F.col("j.event_type").alias("stage"))


@query("SELECT user_id AS document_id, event_type AS stage, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY ALL")
def stream_job_status(spark, sf):
    """The status table that the stream keeps, after all files."""
    return jobs.run_once(spark, sf)


@query("WITH g AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events), s AS (SELECT user_id, CASE WHEN prev IS NULL OR ts - prev > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS starts FROM g) SELECT user_id, sum(starts)::BIGINT AS n_sessions, count(*) AS n_events FROM s GROUP BY user_id")
def job_sessions(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    starts = F.when(F.lag("ts").over(w).isNull() | (F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 30 MINUTES")), 1).otherwise(0)
    return V.table(spark, sf, "events").withColumn("starts", starts).groupBy("user_id").agg(F.sum("starts").alias("n_sessions"), F.count(F.lit(1)).alias("n_events"))


@query("SELECT DISTINCT event_type AS tag FROM events WHERE event_type IS NOT NULL AND event_type <> ''")
def ui_distinct_tags(spark, sf):
    return V.table(spark, sf, "events").where("event_type <> ''").select(F.col("event_type").alias("tag")).distinct()


@query("SELECT d.doc_id AS document_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def ui_unassigned(spark, sf):
    return V.table(spark, sf, "documents").select(F.col("doc_id").alias("document_id")).join(V.table(spark, sf, "labels").select(F.col("doc_id").alias("document_id")), "document_id", "left_anti")


@query("SELECT c.c_custkey AS user_id FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def member_check(spark, sf):
    return V.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")).join(V.table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id")), "user_id", "left_semi")


@query("SELECT r.r_name AS tenant, n.n_name AS workspace, count(*) AS n_chunks, count(DISTINCT o.o_orderkey) AS n_documents FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY ALL")
def join_citation_chain(spark, sf):
    """Tenant, workspace, member, document, chunk: four equi-joins and a left one, the chunks counted before they are joined."""
    r, n, c, o, x = (V.table(spark, sf, t) for t in ("region", "nation", "customer", "orders", "lineitem"))
    chunks = x.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("k"))
    docs = o.select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(chunks, "o_orderkey", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    place = n.select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey")).join(r, "r_regionkey").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("workspace"), F.col("r_name").alias("tenant"))
    member = c.select("c_custkey", "c_nationkey").join(place, "c_nationkey")
    return docs.join(member, "c_custkey").groupBy("tenant", "workspace").agg(F.sum("k").alias("n_chunks"), F.count_distinct("o_orderkey").alias("n_documents"))


@query("SELECT source AS workspace_id, md5(text) AS name, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def unique_name_check(spark, sf):
    return V.table(spark, sf, "documents").groupBy(F.col("source").alias("workspace_id"), F.md5("text").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[,"\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field FROM documents""")
def csv_escape(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", files.csv_field(F.col("text")).alias("field"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([^/?#]+)/', 1) AS folder, lower(regexp_extract(regexp_extract(url, '^https?://[^?#]+', 0), '\.([^./]+)$', 1)) AS extension FROM pages")
def top_level_folder(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/]+/([^/?#]+)/", 1).alias("folder"), F.lower(F.regexp_extract(F.regexp_extract("url", "^https?://[^?#]+", 0), r"\.([^./]+)$", 1)).alias("extension"))


@query("SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT DISTINCT item_id, 1, 0 FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels)")
def seed_insert_on_conflict(spark, sf):
    """New rows join the old ones; where a key is there, its row stays as it is."""
    new = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")).distinct()
    return writes.insert_missing(V.table(spark, sf, "labels").select("doc_id", "quality", "toxic"), new, ["doc_id"])


@query("SELECT d.doc_id, CASE WHEN b.item_id IS NULL THEN md5(d.text) ELSE md5(b.text) END AS digest FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def replace_by_document(spark, sf):
    """Documents replaced by new versions of the same number: anti-join and union."""
    new = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.md5("text").alias("digest"))
    docs = V.table(spark, sf, "documents")
    return docs.join(new.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.md5("text").alias("digest")).unionByName(new.join(docs.select("doc_id"), "doc_id", "left_semi"))


@query("SELECT conv_id, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS turns, count(*) AS n FROM conversations GROUP BY conv_id")
def session_detail(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(":"), F.length("text").cast("string")).alias("t"))))
    return V.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), ",").alias("turns"), F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ordinal FROM conversations WHERE role = 'assistant'")
def citations_ordinal(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return V.table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", (F.row_number().over(w) - 1).alias("ordinal"))


@query("WITH t AS (SELECT source, lang, length(text) AS n FROM documents) SELECT coalesce(source, 'all') AS source, coalesce(lang, 'all') AS lang, count(*) AS n_documents, sum(n)::BIGINT AS n_chars FROM t GROUP BY ROLLUP (source, lang)")
def catalogue_rollup(spark, sf):
    t = V.table(spark, sf, "documents").select("source", "lang", F.length("text").alias("n"))
    r = t.rollup("source", "lang").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_chars"))
    return r.withColumns({"source": F.coalesce("source", F.lit("all")), "lang": F.coalesce("lang", F.lit("all"))})


@query("SELECT doc_id, n_chars, CASE WHEN n_chars = 0 THEN 'EMPTY' WHEN n_chars > 20000 THEN 'TOO_LARGE' END AS reject_code FROM documents")
def upload_accept(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", "n_chars", files.reject_code(F.col("n_chars"), 20_000).alias("reject_code"))


@query("SELECT count(*) AS n_lines, count(*) FILTER (WHERE w > 0) AS with_mail FROM (SELECT len(regexp_extract_all(text, '@')) AS w FROM conversations)")
def mail_lines(spark, sf):
    return V.table(spark, sf, "conversations").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.size(T.extract_all(F.col("text"), "@")) > 0).alias("with_mail"))
