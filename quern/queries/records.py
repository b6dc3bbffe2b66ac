"""Queries of the store's writes: each gives the rows that a table has, or gains, after the write."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as T
from quern.operators import embedding as EM
from quern.operators import writes as W
from quern.registry import query
from quern.sources import files
from quern.sources import store as S
from quern.sources import views as V
from quern.streaming import stages
from quern.streaming.jobs import base_folder

A, C, B, J = S.AGREEMENTS, S.CLAUSES, S.BLOCKS, S.JOBS


@query(f"WITH {A} SELECT document_id, CASE WHEN document_id % 5 = 0 THEN 'text/x-given' WHEN file_type = 'pdf' THEN 'application/pdf' WHEN file_type = 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/octet-stream' END AS media_type FROM agreements")
def media_type(spark, sf):
    """The stored type, else by extension."""
    stored = F.when(F.col("document_id") % 5 == 0, "text/x-given").when(F.col("document_id") % 5 == 1, "")
    return S.agreements(spark, sf).select("document_id", files.media_type(stored, F.col("file_type")).alias("media_type"))


@query(f"WITH {A}, n AS (SELECT document_id, CASE WHEN document_id % 4 = 0 THEN './a' WHEN document_id % 4 = 1 THEN 'legal\\2024/x.' || file_type WHEN document_id % 4 = 2 THEN '/sales/y.' || upper(file_type) ELSE 'z.' || file_type END AS p, file_size % 50000000 * CASE WHEN document_id % 31 = 0 THEN 0 ELSE 1 END AS size FROM agreements) SELECT document_id, CASE WHEN size = 0 THEN 'EMPTY' WHEN size > 20971520 THEN 'TOO_LARGE' WHEN document_id % 4 = 0 OR lower(p) NOT SIMILAR TO '.*\\.(pdf|docx)' THEN 'EXTENSION' END AS reject_code, CASE document_id % 4 WHEN 1 THEN 'legal' WHEN 2 THEN 'sales' END AS module_name FROM n")
def upload_batch(spark, sf):
    """Every file of a batch is judged on its own: size, extension, module by its folder."""
    k, kind = F.col("document_id"), F.col("file_type")
    path = F.when(k % 4 == 0, "./a").when(k % 4 == 1, F.concat(F.lit("legal\\2024/x."), kind)).when(k % 4 == 2, F.concat(F.lit("/sales/y."), F.upper(kind))).otherwise(F.concat(F.lit("z."), kind))
    size = F.when(k % 31 == 0, 0).otherwise(F.col("file_size") % 50_000_000)
    return S.agreements(spark, sf).select("document_id", files.verdict(path, size).alias("reject_code"), files.module_of(path).alias("module_name"))


@query(f"WITH {A} SELECT document_id, 'm1' AS group_id, 'workspace/' || workspace_id || '/document/' || CAST(document_id AS VARCHAR) || '/original.' || file_type AS storage_path FROM agreements WHERE file_type IN ('pdf', 'docx') AND file_size BETWEEN 1 AND 20971520")
def upload_to_module(spark, sf):
    """Accepted files as rows of one module, with the path that the original takes."""
    a = S.agreements(spark, sf).where(files.verdict(F.concat(F.lit("f."), F.col("file_type")), F.col("file_size")).isNull())
    return a.select("document_id", F.lit("m1").alias("group_id"), files.storage_path(F.col("workspace_id"), F.col("document_id"), F.col("file_type")).alias("storage_path"))


_F = "fields AS (SELECT event_id AS field_id, user_id AS document_id, event_type AS field_name, CASE WHEN event_id % 13 = 0 THEN '  ' ELSE substr(props, 2, 3) || CAST(event_id AS VARCHAR) END AS field_value, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 100 END AS confidence, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 3 + 1 AS INTEGER) END AS source_page, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id * 3 END AS source_chunk_id, CASE event_id % 6 WHEN 0 THEN 'REMOVED' WHEN 1 THEN 'CORRECTED' ELSE 'AI_GENERATED' END AS status, ts AS created_at FROM events)"


def fields(spark, sf):
    """Extracted fields: an event is a field of its user's document."""
    e = F.col("event_id")
    return V.table(spark, sf, "events").select(
        e.alias("field_id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("field_name"), F.when(e % 13 == 0, "  ").otherwise(F.concat(F.substring("props", 2, 3), e.cast("string"))).alias("field_value"),
        F.when(e % 7 != 0, F.col("value") / 100).alias("confidence"), F.when(e % 5 != 0, (e % 3 + 1).cast("int")).alias("source_page"), F.when(e % 11 != 0, e * 3).alias("source_chunk_id"),
        F.when(e % 6 == 0, "REMOVED").when(e % 6 == 1, "CORRECTED").otherwise("AI_GENERATED").alias("status"), F.col("ts").alias("created_at"),
    )


@query(f"WITH {_F} SELECT field_id, document_id, field_value, coalesce(confidence, 0) AS confidence, coalesce(source_page, 1) AS source_page FROM fields WHERE source_chunk_id IS NOT NULL AND trim(field_value) <> ''")
def field_scan_nonblank(spark, sf):
    return fields(spark, sf).where("source_chunk_id IS NOT NULL AND trim(field_value) <> ''").select("field_id", "document_id", "field_value", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("source_page", F.lit(1)).alias("source_page"))


@query(f"WITH {C}, {A} SELECT chunk_id, document_id FROM clauses WHERE document_id NOT IN (SELECT document_id FROM agreements WHERE processing_status = 'FAILED')")
def clear_artifacts(spark, sf):
    """Chunks go with the documents that are processed anew."""
    gone = S.agreements(spark, sf).where("processing_status = 'FAILED'").select("document_id")
    return W.delete(S.clauses(spark, sf).select("chunk_id", "document_id"), gone)


@query("SELECT e.vec_id, CASE WHEN n.vec_id IS NOT NULL THEN list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) / 2) ELSE CAST(e.embedding AS DOUBLE[]) END AS embedding FROM embeddings e LEFT JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0) n ON n.vec_id = e.vec_id")
def update_embeddings(spark, sf):
    e = V.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    new = e.where("vec_id % 3 = 0").select("vec_id", F.transform("embedding", lambda x: x / 2).alias("embedding"))
    return W.update(e, new, ["vec_id"]).select("vec_id", "embedding")


@query(f"WITH {A} SELECT document_id, CASE WHEN contains(lower(text), 'revenue') THEN 'financial_report' WHEN document_id % 2 = 0 THEN 'unknown' END AS document_type, CASE WHEN contains(lower(text), 'revenue') THEN 'Overview of ' || title || '.' END AS overview FROM agreements")
def update_classification(spark, sf):
    """The classifier's columns are taken over for the documents that it has judged."""
    a = S.agreements(spark, sf).withColumn("document_type", F.when(F.col("document_id") % 2 == 0, "unknown")).withColumn("overview", F.lit(None).cast("string"))
    new = a.where(F.lower("text").contains("revenue")).select("document_id", F.lit("financial_report").alias("document_type"), F.concat(F.lit("Overview of "), "title", F.lit(".")).alias("overview"))
    return W.update(a, new, ["document_id"]).select("document_id", "document_type", "overview")


@query(f"WITH {C} SELECT document_id, page_number, CASE WHEN length(trim(chunk_text)) < 80 THEN 'ocr ' || CAST(document_id AS VARCHAR) ELSE chunk_text END AS raw_text, length(trim(chunk_text)) < 80 AS was_ocr FROM clauses")
def ocr_page_update(spark, sf):
    """Sparse pages get the recognised text and the mark."""
    pages = S.clauses(spark, sf).select("document_id", "page_number", F.col("chunk_text").alias("raw_text"), F.lit(False).alias("was_ocr"))
    found = pages.where(T.is_scanned(F.col("raw_text"))).select("document_id", "page_number", F.concat(F.lit("ocr "), F.col("document_id").cast("string")).alias("raw_text"), F.lit(True).alias("was_ocr"))
    return W.update(pages, found, ["document_id", "page_number"])


_LATEST = "r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY started_at DESC NULLS LAST, job_id DESC) AS rn FROM jobs)"


def _latest_jobs(spark, sf):
    return W.latest(S.jobs(spark, sf), ["document_id"], [F.col("started_at"), F.col("job_id")])


@query(f"WITH {J}, {_LATEST}, n AS (SELECT l_orderkey % 400 AS document_id, max(l_returnflag) AS stage FROM lineitem GROUP BY 1) SELECT coalesce(r.document_id, n.document_id) AS document_id, r.job_id, coalesce(n.stage, r.stage) AS stage, CASE WHEN n.stage IS NOT NULL THEN 'RUNNING' ELSE r.status END AS status FROM (SELECT * FROM r WHERE rn = 1) r FULL JOIN n ON n.document_id = r.document_id")
def job_status_upsert(spark, sf):
    """A document's latest job (one that hasn't started last) takes the new stage; a document without a job gets one."""
    new = V.table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 400).alias("document_id")).agg(F.max("l_returnflag").alias("stage")).withColumn("status", F.lit("RUNNING"))
    last = _latest_jobs(spark, sf).select("document_id", "job_id", "stage", "status")
    return W.insert_missing(W.update(last, new, ["document_id"]), new.withColumn("job_id", F.lit(None).cast("long")), ["document_id"])


@query(f"WITH {A} SELECT document_id, deleted OR workspace_id = 'w3' AS deleted, workspace_id FROM agreements")
def doc_soft_delete(spark, sf):
    a = S.agreements(spark, sf).select("document_id", "workspace_id", "deleted")
    return W.update(a, a.where("workspace_id = 'w3'").select("document_id", F.lit(True).alias("deleted")), ["document_id"])


@query(f"WITH {A} SELECT document_id, 'PARSING' AS processing_status, 'PENDING' AS job_status FROM agreements WHERE NOT deleted AND processing_status = 'FAILED'")
def doc_retry(spark, sf):
    """Only a failed document may go back to parsing; each gets a new pending job."""
    return S.live(spark, sf).where("processing_status = 'FAILED'").select("document_id", F.lit("PARSING").alias("processing_status"), F.lit("PENDING").alias("job_status"))


@query(f"WITH {A}, g AS (SELECT DISTINCT workspace_id, group_id FROM agreements WHERE group_id IS NOT NULL), m AS (SELECT document_id, workspace_id, group_id, CASE WHEN document_id % 3 = 0 THEN NULL WHEN document_id % 3 = 1 THEN '2' ELSE 'none' END AS wish FROM agreements) SELECT m.document_id, CASE WHEN m.wish IS NULL THEN NULL WHEN g.group_id IS NOT NULL THEN m.wish ELSE m.group_id END AS group_id FROM m LEFT JOIN g ON g.workspace_id = m.workspace_id AND g.group_id = m.wish")
def doc_assign_module(spark, sf):
    """A document moves to a module of its own workspace; no module clears it; a foreign one is refused."""
    k = F.col("document_id")
    a = S.agreements(spark, sf).select("document_id", "workspace_id", "group_id", F.when(k % 3 == 1, "2").when(k % 3 == 2, "none").alias("wish"))
    modules = a.where("group_id is not null").select("workspace_id", F.col("group_id").alias("wish"), F.lit(True).alias("there")).distinct()
    granted = a.join(modules, ["workspace_id", "wish"], "left").where("wish is null or there").select("document_id", F.col("wish").alias("group_id"))
    return W.update(a.select("document_id", "group_id"), granted, ["document_id"], nulls=True)


@query(f"WITH {A}, w AS (SELECT DISTINCT workspace_id, CAST(substr(workspace_id, 2) AS INTEGER) % 6 = 0 AS archived FROM agreements) SELECT a.document_id, w.workspace_id, CASE WHEN w.archived THEN 'ARCHIVED' ELSE 'ACTIVE' END AS workspace_status, a.deleted OR w.archived AS deleted, CASE WHEN w.archived THEN NULL ELSE a.group_id END AS group_id FROM agreements a JOIN w ON w.workspace_id = a.workspace_id")
def workspace_archive_cascade(spark, sf):
    """An archived workspace's documents are archived and its modules deleted."""
    a = S.agreements(spark, sf).select("document_id", "workspace_id", "group_id", "deleted")
    gone = a.select("workspace_id").distinct().where("CAST(substr(workspace_id, 2) AS INT) % 6 = 0").withColumn("archived", F.lit(True))
    bad = F.coalesce("archived", F.lit(False))
    return a.join(gone, "workspace_id", "left").select("document_id", "workspace_id", F.when(bad, "ARCHIVED").otherwise("ACTIVE").alias("workspace_status"), (F.col("deleted") | bad).alias("deleted"), F.when(~bad, F.col("group_id")).alias("group_id"))


@query(f"WITH {A}, h AS (SELECT document_id, unnest(range(len(string_split(text, chr(10))))) AS idx, unnest(string_split(text, chr(10))) AS line FROM agreements), s AS (SELECT document_id, idx, substr(line, 1, 1024) AS heading FROM h WHERE contains(line, ': ')), n AS (SELECT *, lag(idx) OVER (PARTITION BY document_id ORDER BY idx) AS parent FROM s) SELECT a.document_id, coalesce(n.heading, 'Document') AS heading, CAST(a.document_id * 100 + coalesce(n.idx, 0) AS BIGINT) AS section_id, CAST(a.document_id * 100 + n.parent AS BIGINT) AS parent_section_id FROM agreements a LEFT JOIN n ON n.document_id = a.document_id")
def persist_sections(spark, sf):
    """Sections with the ids of their parents; a document without any has one of the name Document; headings are cut at 1024 characters."""
    a = S.agreements(spark, sf).select("document_id", F.posexplode(F.split("text", "\n")).alias("idx", "line")).where(F.col("line").contains(": "))
    w = Window.partitionBy("document_id").orderBy("idx")
    s = a.select("document_id", "idx", F.substring("line", 1, 1024).alias("heading"), F.lag("idx").over(w).alias("parent"))
    ident = lambda c: (F.col("document_id") * 100 + F.col(c)).cast("long")
    out = S.agreements(spark, sf).select("document_id").join(s, "document_id", "left").withColumn("idx", F.coalesce("idx", F.lit(0)))
    return out.select("document_id", F.coalesce("heading", F.lit("Document")).alias("heading"), ident("idx").alias("section_id"), ident("parent").alias("parent_section_id"))


@query("SELECT conv_id AS session_id, turn, role, coalesce(nullif(text, ''), '(empty)') AS content, CASE WHEN role = 'assistant' THEN 'retrieval_plus_graph' END AS answer_mode, CASE WHEN role = 'assistant' THEN 0.5 END AS confidence, false AS is_not_found FROM conversations")
def message_persist(spark, sf):
    """Messages with defaults: an answer has a mode and a confidence, a question neither."""
    answer = F.col("role") == "assistant"
    return V.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.coalesce(F.nullif("text", F.lit("")), F.lit("(empty)")).alias("content"), F.when(answer, "retrieval_plus_graph").alias("answer_mode"), F.when(answer, 0.5).alias("confidence"), F.lit(False).alias("is_not_found"))


@query(f"WITH {A} SELECT document_id, CASE WHEN processing_status = 'INDEXING' THEN 'PARSING' ELSE processing_status END AS processing_status, CASE WHEN processing_status = 'INDEXING' THEN 'PENDING' END AS new_job FROM agreements")
def mark_parsing(spark, sf):
    start = F.col("processing_status") == "INDEXING"
    return S.agreements(spark, sf).select("document_id", F.when(start, "PARSING").otherwise(F.col("processing_status")).alias("processing_status"), F.when(start, "PENDING").alias("new_job"))


@query(f"WITH {A} SELECT document_id, CASE WHEN l.toxic = 1 THEN 'FAILED' WHEN l.quality = 1 THEN 'READY' ELSE processing_status END AS processing_status FROM agreements a LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = a.document_id")
def status_update(spark, sf):
    a = S.agreements(spark, sf).select("document_id", "processing_status")
    new = V.table(spark, sf, "labels").groupBy(F.col("doc_id").alias("document_id")).agg(F.max("toxic").alias("t"), F.max("quality").alias("q"))
    return W.update(a, new.select("document_id", F.when(F.col("t") == 1, "FAILED").when(F.col("q") == 1, "READY").alias("processing_status")), ["document_id"])


_N = "new AS (SELECT document_id, sha256('Title|' || title) AS field_id, 'Title' AS field_name, title AS field_value, 'AI_GENERATED' AS status FROM agreements WHERE NOT deleted)"


@query(f"WITH {A}, {_N} SELECT * FROM new")
def fields_to_records(spark, sf):
    """Extracted values become rows with an id and the first status."""
    return S.live(spark, sf).select("document_id", F.sha2(F.concat(F.lit("Title|"), "title"), 256).alias("field_id"), F.lit("Title").alias("field_name"), F.col("title").alias("field_value"), F.lit("AI_GENERATED").alias("status"))


@query(f"WITH {A}, {_F}, {_N} SELECT document_id, field_name, field_value, status FROM fields UNION ALL SELECT document_id, field_name, field_value, status FROM new")
def field_insert(spark, sf):
    return fields(spark, sf).select("document_id", "field_name", "field_value", "status").unionByName(fields_to_records(spark, sf).select("document_id", "field_name", "field_value", "status"))


@query(f"WITH {A}, {_F} SELECT field_id, document_id FROM fields WHERE document_id NOT IN (SELECT document_id FROM agreements WHERE processing_status = 'INDEXING')")
def clear_fields(spark, sf):
    """A document's fields go before they are extracted again."""
    again = S.agreements(spark, sf).where("processing_status = 'INDEXING'").select("document_id")
    return W.delete(fields(spark, sf).select("field_id", "document_id"), again)


@query(f"WITH {_F} SELECT field_id, document_id, field_name, CASE WHEN event_type IS NOT NULL THEN 'fixed' ELSE field_value END AS field_value, CASE WHEN event_type = 'error' THEN 'REMOVED' WHEN event_type IS NOT NULL THEN 'CORRECTED' ELSE status END AS status FROM fields LEFT JOIN (SELECT event_id, event_type FROM events WHERE event_id % 9 = 0) l ON l.event_id = field_id")
def field_correct(spark, sf):
    """A log of corrections and removals applied to the fields."""
    log = V.table(spark, sf, "events").where("event_id % 9 = 0").select(F.col("event_id").alias("field_id"), F.lit("fixed").alias("field_value"), F.when(F.col("event_type") == "error", "REMOVED").otherwise("CORRECTED").alias("status"))
    return W.update(fields(spark, sf).select("field_id", "document_id", "field_name", "field_value", "status"), log, ["field_id"])


@query("SELECT vec_id, CAST(label AS BIGINT) AS document_id, round(CAST(embedding[1] AS DOUBLE), 4) AS first, len(embedding) AS n FROM embeddings")
def chunk_row_mapper(spark, sf):
    """A vector that is stored as text, and an id as text, back in their types."""
    text = V.vector_text(F.col("embedding"))
    stored = V.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("d"), text.alias("v"))
    e = V.vector_of("v")
    return stored.select(F.col("id").cast("long").alias("vec_id"), F.col("d").cast("long").alias("document_id"), F.round(e[0], 4).alias("first"), F.size(e).alias("n"))


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.8f', CAST(x AS DOUBLE))), ',') || ']' AS literal FROM embeddings")
def vector_literal_codec(spark, sf):
    """The text of a vector: eight decimals in brackets."""
    return V.table(spark, sf, "embeddings").select("vec_id", V.vector_text(F.col("embedding")).alias("literal"))


@query(f"WITH {C} SELECT document_id, string_agg(chunk_text, chr(10) || chr(10) ORDER BY page_number) AS content, count(*) AS n_pages FROM clauses WHERE trim(chunk_text) <> '' GROUP BY document_id")
def append_page_content(spark, sf):
    pages = S.clauses(spark, sf).where("trim(chunk_text) <> ''").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "chunk_text"))).alias("p"))
    return pages.select("document_id", F.array_join(F.col("p.chunk_text"), "\n\n").alias("content"), F.size("p").cast("long").alias("n_pages"))


@query(f"WITH {B} SELECT document_id, page_number, round(coalesce(avg(font_size), 12), 6) AS font_size, bool_or(bold) AS bold, bool_or(italic) AS italic FROM blocks GROUP BY ALL")
def shape_font_stats(spark, sf):
    """A shape's mean font (12 where none is given), and whether any run of it is bold or italic."""
    return S.blocks(spark, sf).groupBy("document_id", "page_number").agg(F.round(F.coalesce(F.avg("font_size"), F.lit(12.0)), 6).alias("font_size"), F.bool_or("bold").alias("bold"), F.bool_or("italic").alias("italic"))


@query("WITH m AS (SELECT n_nationkey AS id, n_regionkey AS workspace_id, n_name AS name FROM nation), w AS (SELECT s_suppkey AS id, CAST(s_nationkey % 5 AS INTEGER) AS workspace_id, trim(CASE WHEN s_suppkey % 3 = 0 THEN ' NATION_' || s_nationkey || ' ' WHEN s_suppkey % 7 = 1 THEN '  ' ELSE s_name END) AS name FROM supplier), f AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, name ORDER BY id) AS rn FROM w WHERE length(name) BETWEEN 1 AND 255) SELECT f.id, f.workspace_id, f.name FROM f WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM m WHERE m.workspace_id = f.workspace_id AND m.name = f.name)")
def module_create_rename(spark, sf):
    """New modules: names trimmed, of 1 to 255 characters, not yet in their workspace; of equal wishes the first."""
    name = F.trim(F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" NATION_"), F.col("s_nationkey").cast("string"), F.lit(" "))).when(F.col("s_suppkey") % 7 == 1, "  ").otherwise(F.col("s_name")))
    wishes = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5).cast("int").alias("workspace_id"), name.alias("name")).where(F.length("name").between(1, 255))
    there = V.table(spark, sf, "nation").select(F.col("n_regionkey").alias("workspace_id"), F.col("n_name").alias("name"))
    return wishes.groupBy("workspace_id", "name").agg(F.min("id").alias("id")).join(there, ["workspace_id", "name"], "left_anti")


@query("SELECT 'workspace' AS kind, n_nationkey AS workspace_id, 'ACTIVE' AS value FROM nation UNION ALL SELECT 'member', n_nationkey, 'OWNER' FROM nation")
def workspace_create(spark, sf):
    """A workspace comes with the membership of who makes it."""
    rows = F.array(F.struct(F.lit("workspace").alias("kind"), F.lit("ACTIVE").alias("value")), F.struct(F.lit("member").alias("kind"), F.lit("OWNER").alias("value")))
    return V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("workspace_id"), F.explode(rows).alias("r")).select("r.kind", "workspace_id", "r.value")


@query("SELECT n_nationkey AS workspace_id, CASE WHEN n_nationkey % 2 = 0 THEN 'renamed' ELSE n_name END AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status FROM nation")
def workspace_patch(spark, sf):
    """Only what a patch gives is changed."""
    n = V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("workspace_id"), F.col("n_name").alias("name"), F.lit("ACTIVE").alias("status"))
    w = F.col("workspace_id")
    return W.update(n, n.select("workspace_id", F.when(w % 2 == 0, "renamed").alias("name"), F.when(w % 3 == 0, "ARCHIVED").alias("status")), ["workspace_id"])


_SD = "sd AS (SELECT DISTINCT conv_id AS session_id, unnest([conv_id % 97, conv_id * 7 % 211, conv_id % 97]) AS document_id FROM conversations)"


def session_documents(spark, sf):
    """The bridge of sessions to their documents, each pair once."""
    c = F.col("conv_id")
    return V.table(spark, sf, "conversations").select(c.alias("session_id"), F.explode(F.array(c % 97, c * 7 % 211, c % 97)).alias("document_id")).distinct()


@query(f"WITH {_SD} SELECT * FROM sd")
def session_documents_write(spark, sf):
    return session_documents(spark, sf)


@query(f"WITH {_SD} SELECT * FROM sd WHERE session_id NOT IN (SELECT conv_id FROM conversations WHERE turn >= 3)")
def session_documents_delete(spark, sf):
    long = V.table(spark, sf, "conversations").where("turn >= 3").select(F.col("conv_id").alias("session_id"))
    return W.delete(session_documents(spark, sf), long)


@query(f"WITH {_F} SELECT field_id, field_name, field_value FROM fields WHERE status <> 'REMOVED'")
def export_fields(spark, sf):
    """What an export holds: removed fields are left out."""
    return fields(spark, sf).where("status <> 'REMOVED'").select("field_id", "field_name", "field_value")


def hashed_bags():
    """A stand-in for a model: texts to counts of their words' hashes, over 64 slots."""
    import hashlib
    import re

    import numpy as np

    def encode(texts):
        out = np.zeros((len(texts), 64), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall("[0-9a-z]+", t.lower()):
                out[i, int(hashlib.sha256(w.encode()).hexdigest()[:8], 16) % 64] += 1
        return out

    return encode


@query(f"WITH {C}, e AS (SELECT chunk_id, CASE WHEN bool_or(document_id % 2 = 0) OVER (PARTITION BY chunk_text) THEN 1 ELSE 2 END AS version, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(lower(chunk_text), '[0-9a-z]+'), lambda w: ('0x' || substr(sha256(w), 1, 8))::BIGINT % 64))), ',') AS slots FROM clauses) SELECT chunk_id, version, slots, 0 AS n_again FROM e")
def embed_missing(spark, sf):
    """Chunks get vectors in two runs, of the even documents and of all; the second encodes only what lacks one, and a third finds nothing."""
    c = S.clauses(spark, sf).select("chunk_id", "document_id", "chunk_text")
    root = f"{base_folder(spark)}/vectors-{uuid.uuid4().hex[:12]}"
    EM.encode_missing(root, c.where("document_id % 2 = 0"), hashed_bags, 64)
    EM.encode_missing(root, c, hashed_bags, 64)
    again = EM.encode_missing(root, c, hashed_bags, 64)
    slots = F.filter(F.transform("embedding", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    return EM.with_vectors(c, root).select("chunk_id", "version", F.array_join(slots.cast("array<string>"), ",").alias("slots"), F.lit(again).alias("n_again"))


_STAGES = """ev AS (SELECT document_id, job_id AS event_id, stage, status FROM jobs), st AS (SELECT document_id, stage, arg_max(status, event_id) AS status, max(event_id) AS last, count(DISTINCT CASE WHEN status = 'FAILED' THEN event_id END) AS failures FROM ev GROUP BY ALL),
pl AS (SELECT *, CASE stage WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 END AS place FROM st),
dn AS (SELECT document_id, max(last) AS last_event, min(CASE WHEN status = 'FAILED' AND failures >= 3 THEN place END) AS given_up, min(CASE WHEN status = 'FAILED' THEN place END) AS failing, list(place) FILTER (WHERE status = 'COMPLETED' AND place IS NOT NULL) AS done FROM pl GROUP BY 1),
op AS (SELECT *, list_min(list_filter([1, 2, 3], lambda p: NOT coalesce(list_contains(done, p), false))) AS open FROM dn)"""


@query(f"WITH {J}, {_STAGES} SELECT document_id, CASE WHEN given_up IS NOT NULL THEN 'FAILED' WHEN failing IS NOT NULL THEN 'RETRYING' WHEN open IS NOT NULL THEN 'PROCESSING' ELSE 'READY' END AS status, ['click', 'purchase', 'view'][coalesce(given_up, failing, open)] AS stage, last_event FROM op")
def stage_stream(spark, sf):
    """Each document's status from a stream of its stages' events, with state by document and retries."""
    read = spark.readStream.schema(V.table(spark, sf, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    job = S._JOB
    events = read.selectExpr(f"{job['document_id']} document_id", f"{job['job_id']} event_id", f"{job['stage']} stage", f"{job['status']} status", "cast(ts as timestamp) ts")
    return stages.run(spark, events, f"{base_folder(spark)}/stages-{uuid.uuid4().hex[:12]}", stall_ms=1 << 42)
