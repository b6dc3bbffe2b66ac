"""Queries of filters, scopes, joins and aggregates over the store."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as T
from quern.operators import fusion, scope
from quern.queries import records as R
from quern.registry import DOCS, LINES, query
from quern.sources import store as S
from quern.sources import views as V

A, C, B, J = S.AGREEMENTS, S.CLAUSES, S.BLOCKS, S.JOBS


@query(f"WITH {A} SELECT document_id, title, row_number() OVER (ORDER BY created_at DESC, document_id DESC) AS place FROM agreements WHERE workspace_id = 'w1' AND NOT deleted AND group_id = '2' AND file_type = 'pdf'")
def doc_search_filtered(spark, sf):
    """A workspace's live documents by module and type, newest first."""
    few = S.live(spark, sf).where("workspace_id = 'w1' AND group_id = '2' AND file_type = 'pdf'")
    return few.select("document_id", "title", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("document_id"))).alias("place"))


@query(f"WITH {A} SELECT document_id, title FROM agreements WHERE document_id IN (3, 29, 58, 64) AND NOT deleted")
def doc_active_by_id(spark, sf):
    return S.live(spark, sf).where("document_id IN (3, 29, 58, 64)").select("document_id", "title")


@query(f"WITH {A} SELECT document_id FROM agreements WHERE workspace_id = 'w2' AND (group_id = '1' OR document_id IN (SELECT DISTINCT user_id FROM events))")
def doc_by_workspace_module_or_ids(spark, sf):
    """Of a workspace: the documents of a module, and those of a list of ids."""
    a = S.agreements(spark, sf).where("workspace_id = 'w2'").select("document_id", "group_id")
    ids = V.table(spark, sf, "events").select(F.col("user_id").alias("document_id")).distinct().withColumn("listed", F.lit(True))
    return a.join(ids, "document_id", "left").where("group_id = '1' OR listed").select("document_id")


def requests(spark, sf):
    """Scope requests: a nation asks for its workspace, a supplier for a module, a customer for a list of documents."""
    none = F.lit(None)
    n = V.table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("request_id"), F.concat(F.lit("w"), (F.col("n_nationkey") + 2).cast("string")).alias("workspace_id"), F.lit("WORKSPACE").alias("scope_type"), none.cast("string").alias("group_id"), none.cast("array<bigint>").alias("ids"))
    k = F.col("s_suppkey")
    s = V.table(spark, sf, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("request_id"), F.concat(F.lit("w"), (k % 25).cast("string")).alias("workspace_id"), F.lit("MODULE").alias("scope_type"), (k % 7).cast("string").alias("group_id"), none.cast("array<bigint>").alias("ids"))
    c = F.col("c_custkey")
    ids = F.when(c % 5 == 0, F.array(c, c + 25, c + 1)).when(c % 5 == 1, F.array(c, c, c + 50)).otherwise(F.array(c))
    d = V.table(spark, sf, "customer").select(F.concat(F.lit("c"), c.cast("string")).alias("request_id"), F.concat(F.lit("w"), (c % 25).cast("string")).alias("workspace_id"), F.lit("DOCUMENTS").alias("scope_type"), none.cast("string").alias("group_id"), ids.alias("ids"))
    return n.unionByName(s).unionByName(d)


_REQ = """req AS (SELECT 'n' || n_nationkey AS request_id, 'w' || (n_nationkey + 2) AS workspace_id, 'WORKSPACE' AS scope_type, NULL AS group_id, NULL::BIGINT[] AS ids FROM nation
UNION ALL SELECT 's' || s_suppkey, 'w' || (s_suppkey % 25), 'MODULE', CAST(s_suppkey % 7 AS VARCHAR), NULL FROM supplier
UNION ALL SELECT 'c' || c_custkey, 'w' || (c_custkey % 25), 'DOCUMENTS', NULL, list_distinct(CASE c_custkey % 5 WHEN 0 THEN [c_custkey, c_custkey + 25, c_custkey + 1] WHEN 1 THEN [c_custkey, c_custkey, c_custkey + 50] ELSE [c_custkey] END) FROM customer)"""


def _scope_sql(kind: str, where: str, code: str) -> str:
    return f"""WITH {A}, {_REQ}, f AS (SELECT r.request_id, len(r.ids) AS asked, count(a.document_id) AS n, list(a.document_id ORDER BY a.document_id) FILTER (WHERE a.processing_status = 'READY') AS found FROM req r LEFT JOIN agreements a ON a.workspace_id = r.workspace_id AND NOT a.deleted AND ({where}) WHERE r.scope_type = '{kind}' GROUP BY r.request_id, r.ids), c AS (SELECT request_id, CASE {code} WHEN found IS NULL THEN 'EMPTY_SCOPE' ELSE 'OK' END AS code, found FROM f)
SELECT request_id, code, array_to_string(CASE WHEN code = 'OK' THEN found ELSE [] END, ',') AS ids FROM c"""


#: After how many rows, at least and at most, a writer looks at the size of its page and block. By default after 100 to 10,000, as it
#: guesses from the rows before: behind requests without documents come lists of megabytes.
WRITER = {f"parquet.{part}.size.row.check.{end}": n for part in ("page", "block") for end, n in (("min", "1"), ("max", "16"))}


def _resolved(spark, sf, kind):
    for name, rows in WRITER.items():
        spark.conf.set(name, rows)
    shown = lambda ids: F.array_join(ids.cast("array<string>"), ",")
    return scope.resolve(requests(spark, sf).where(F.col("scope_type") == kind), S.agreements(spark, sf), shown).withColumnRenamed("document_ids", "ids")


@query(_scope_sql("WORKSPACE", "true", ""))
def scope_resolve_workspace(spark, sf):
    return _resolved(spark, sf, "WORKSPACE")


@query(_scope_sql("MODULE", "a.group_id = r.group_id", "WHEN n = 0 THEN 'MODULE_NOT_FOUND'"))
def scope_resolve_module(spark, sf):
    return _resolved(spark, sf, "MODULE")


@query(_scope_sql("DOCUMENTS", "list_contains(r.ids, a.document_id)", "WHEN n <> asked THEN 'SCOPE_OUTSIDE_WORKSPACE'"))
def scope_resolve_documents(spark, sf):
    return _resolved(spark, sf, "DOCUMENTS")


@query(f"WITH {A}, {_REQ}, q AS (SELECT request_id, workspace_id, unnest(ids) AS document_id FROM req WHERE scope_type = 'DOCUMENTS') SELECT q.request_id, q.document_id, CASE WHEN a.document_id IS NULL THEN 'SCOPE_VIOLATION' WHEN a.processing_status = 'READY' THEN 'READY' ELSE 'EXCLUDED' END AS verdict FROM q LEFT JOIN agreements a ON a.document_id = q.document_id AND a.workspace_id = q.workspace_id AND NOT a.deleted")
def scope_guard(spark, sf):
    asked = requests(spark, sf).where("scope_type = 'DOCUMENTS'").select("request_id", "workspace_id", F.explode("ids").alias("document_id"))
    return scope.guard(asked, S.agreements(spark, sf))


_MEM = "members AS (SELECT DISTINCT o_custkey AS user_id, 'w' || (o_orderkey % 25) AS workspace_id FROM orders WHERE o_orderkey % 3 = 0), ws AS (SELECT 'w' || n_nationkey AS workspace_id, n_nationkey % 4 <> 0 AS active, n_nationkey AS age FROM nation)"


def _members(spark, sf):
    return V.table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("user_id"), F.concat(F.lit("w"), (F.col("o_orderkey") % 25).cast("string")).alias("workspace_id")).distinct()


def _workspaces(spark, sf):
    return V.table(spark, sf, "nation").select(F.concat(F.lit("w"), F.col("n_nationkey").cast("string")).alias("workspace_id"), (F.col("n_nationkey") % 4 != 0).alias("active"), F.col("n_nationkey").alias("age"))


@query(f"WITH {_MEM} SELECT m.user_id, string_agg(w.workspace_id, ',' ORDER BY w.age DESC) AS workspaces FROM members m JOIN ws w ON w.workspace_id = m.workspace_id WHERE w.active GROUP BY m.user_id")
def list_my_workspaces(spark, sf):
    """Every user's active workspaces, newest first."""
    mine = _members(spark, sf).join(_workspaces(spark, sf).where("active"), "workspace_id")
    return mine.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("age", "workspace_id")), False), lambda x: x["workspace_id"]), ",").alias("workspaces"))


@query(f"WITH {_MEM} SELECT user_id, count(*) AS n_workspaces FROM members GROUP BY 1")
def members_by_user(spark, sf):
    return _members(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_workspaces"))


@query(f"WITH {_MEM} SELECT workspace_id, row_number() OVER (ORDER BY age DESC) AS place FROM ws WHERE active AND workspace_id IN (SELECT workspace_id FROM members WHERE user_id < 50)")
def workspaces_in_status(spark, sf):
    some = _members(spark, sf).where("user_id < 50").select("workspace_id")
    return _workspaces(spark, sf).where("active").join(some, "workspace_id", "left_semi").select("workspace_id", F.row_number().over(Window.orderBy(F.desc("age"))).alias("place"))  # a row for each workspace


@query(f"WITH {R._F} SELECT document_id, field_id, field_name, field_value, row_number() OVER (PARTITION BY document_id ORDER BY created_at, field_id) AS place FROM fields WHERE status <> 'REMOVED'")
def fields_not_removed(spark, sf):
    w = Window.partitionBy("document_id").orderBy("created_at", "field_id")
    return R.fields(spark, sf).where("status <> 'REMOVED'").select("document_id", "field_id", "field_name", "field_value", F.row_number().over(w).alias("place"))


@query(f"WITH {R._F}, {A}, {_MEM} SELECT f.field_id, f.field_name, f.field_value, coalesce(f.confidence, 0) AS confidence FROM fields f JOIN agreements a ON a.document_id = f.document_id AND NOT a.deleted JOIN members m ON m.workspace_id = a.workspace_id AND m.user_id = 7 WHERE f.status <> 'REMOVED'")
def list_fields(spark, sf):
    """The fields that a member may see: of live documents of the member's workspaces, none that is removed."""
    mine = _members(spark, sf).where("user_id = 7").select("workspace_id")
    docs = S.live(spark, sf).join(mine, "workspace_id", "left_semi").select("document_id")
    return R.fields(spark, sf).where("status <> 'REMOVED'").join(docs, "document_id", "left_semi").select("field_id", "field_name", "field_value", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


@query("SELECT c_custkey AS user_id FROM customer WHERE lower(c_name) IN ('customer#000000005', 'customer#000000017')")
def email_ci_lookup(spark, sf):
    """Equality without regard to case: both sides in lower case, so it is an equi-join."""
    asked = spark.createDataFrame([("CUSTOMER#000000005",), ("Customer#000000017",)], "name string").select(F.lower("name").alias("key"))
    return V.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.lower("c_name").alias("key")).join(asked, "key", "left_semi").select("user_id")


@query("SELECT conv_id AS session_id, turn, role, text AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations")
def messages_by_session(spark, sf):
    w = Window.partitionBy("session_id").orderBy("turn")
    return V.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content")).withColumn("place", F.row_number().over(w))


@query(f"WITH {R._SD} SELECT session_id, string_agg(CAST(document_id AS VARCHAR), ',' ORDER BY document_id) AS documents FROM sd GROUP BY 1")
def session_documents(spark, sf):
    return R.session_documents(spark, sf).groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list("document_id")).cast("array<string>"), ",").alias("documents"))


@query(f"WITH {R._SD}, {A} SELECT session_id, document_id FROM sd WHERE document_id IN (SELECT document_id FROM agreements WHERE NOT deleted)")
def active_session_docs(spark, sf):
    return R.session_documents(spark, sf).join(S.live(spark, sf).select("document_id"), "document_id", "left_semi")


@query(f"WITH {A} SELECT document_id, title FROM agreements WHERE group_id = '3' AND contains(lower(title), 'policy') AND NOT deleted")
def ui_filter_files(spark, sf):
    wanted = F.lower(F.trim(F.lit("  Policy ")))
    return S.live(spark, sf).where((F.col("group_id") == "3") & F.lower("title").contains(wanted)).select("document_id", "title")


@query(f"WITH {A} SELECT document_id, title FROM agreements WHERE NOT deleted ORDER BY created_at DESC, document_id DESC LIMIT 5")
def ui_recent5(spark, sf):
    return S.live(spark, sf).orderBy(F.desc("created_at"), F.desc("document_id")).limit(5).select("document_id", "title")


@query(f"WITH {A} SELECT document_id, workspace_id, row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, document_id DESC) AS place FROM agreements WHERE group_id IS NULL AND NOT deleted")
def ui_orphaned(spark, sf):
    """Documents without a module, newest first in each workspace."""
    w = Window.partitionBy("workspace_id").orderBy(F.desc("created_at"), F.desc("document_id"))
    return S.live(spark, sf).where("group_id is null").select("document_id", "workspace_id", F.row_number().over(w).alias("place"))


@query(f"WITH {A} SELECT document_id, workspace_id, title, file_type, processing_status, 0 AS page_count FROM agreements WHERE NOT deleted")
def document_get(spark, sf):
    return S.live(spark, sf).select("document_id", "workspace_id", "title", "file_type", "processing_status", F.lit(0).alias("page_count"))


@query("WITH s AS (SELECT DISTINCT conv_id AS session_id, conv_id % 5 AS workspace_id FROM conversations) SELECT workspace_id, session_id, row_number() OVER (PARTITION BY workspace_id ORDER BY session_id DESC) AS place FROM s")
def sessions_by_workspace(spark, sf):
    s = V.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), (F.col("conv_id") % 5).alias("workspace_id")).distinct()
    return s.withColumn("place", F.row_number().over(Window.partitionBy("workspace_id").orderBy(F.desc("session_id"))))


@query("SELECT n_regionkey AS workspace_id, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS by_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS newest FROM nation")
def folders_by_workspace(spark, sf):
    w = Window.partitionBy("workspace_id")
    n = V.table(spark, sf, "nation").withColumnRenamed("n_regionkey", "workspace_id")
    return n.select("workspace_id", F.col("n_name").alias("name"), F.row_number().over(w.orderBy("n_name")).alias("by_name"), F.row_number().over(w.orderBy(F.desc("n_nationkey"))).alias("newest"))


@query("SELECT doc_id AS document_id, length(text) AS n_chars, len(string_split(text, ' ')) AS n_words FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def analysis_by_document(spark, sf):
    """The stored analysis of each document that has one."""
    has = V.table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"))
    return V.table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.length("text").alias("n_chars"), F.size(F.split("text", " ")).alias("n_words")).join(has, "document_id", "left_semi")


@query("WITH q AS (SELECT item_id, CASE WHEN item_id % 4 = 0 THEN '   ' ELSE text END AS text, CASE WHEN item_id % 5 = 0 THEN 0 ELSE 20 END AS k, CASE WHEN item_id % 7 = 0 THEN 0 ELSE 3 END AS n_scope FROM benchmark) SELECT item_id, CASE WHEN k <= 0 THEN 'K' WHEN n_scope = 0 THEN 'SCOPE' WHEN trim(text) = '' THEN 'QUERY' END AS refused FROM q")
def search_guards(spark, sf):
    """Searches that have no result whatever the data: no k, no scope, no words."""
    i = F.col("item_id")
    q = V.table(spark, sf, "benchmark").select("item_id", F.when(i % 4 == 0, "   ").otherwise(F.col("text")).alias("text"), F.when(i % 5 == 0, 0).otherwise(20).alias("k"), F.when(i % 7 == 0, 0).otherwise(3).alias("n_scope"))
    return q.select("item_id", F.when(F.col("k") <= 0, "K").when(F.col("n_scope") == 0, "SCOPE").when(F.trim("text") == "", "QUERY").alias("refused"))


# joins


@query(f"WITH {C}, {A} SELECT c.chunk_id, c.document_id, c.page_number FROM clauses c JOIN agreements a ON a.document_id = c.document_id WHERE a.workspace_id = 'w4' AND a.processing_status = 'READY' AND NOT a.deleted AND c.document_id % 2 = 0")
def join_chunk_document_scoped(spark, sf):
    """The chunks of a workspace's live READY documents of a list."""
    docs = S.ready(spark, sf).where("workspace_id = 'w4' AND document_id % 2 = 0").select("document_id")
    return S.clauses(spark, sf).join(docs, "document_id", "left_semi").select("chunk_id", "document_id", "page_number")


@query(f"WITH {C}, {A}, ids AS (SELECT DISTINCT l_partkey AS chunk_id FROM lineitem) SELECT c.chunk_id, c.document_id FROM clauses c JOIN ids USING (chunk_id) JOIN agreements a ON a.document_id = c.document_id WHERE a.processing_status = 'READY' AND NOT a.deleted")
def join_chunks_by_ids(spark, sf):
    ids = V.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("chunk_id")).distinct()
    return S.clauses(spark, sf).select("chunk_id", "document_id").join(ids, "chunk_id", "left_semi").join(S.ready(spark, sf).select("document_id"), "document_id", "left_semi")


@query(f"WITH {C}, {R._F} SELECT c.chunk_id, count(f.field_id) AS n_fields FROM clauses c LEFT JOIN fields f ON f.source_chunk_id = c.chunk_id GROUP BY 1")
def join_fields_to_chunks(spark, sf):
    n = R.fields(spark, sf).where("source_chunk_id is not null").groupBy(F.col("source_chunk_id").alias("chunk_id")).agg(F.count(F.lit(1)).alias("n"))
    return S.clauses(spark, sf).select("chunk_id").join(n, "chunk_id", "left").select("chunk_id", F.coalesce("n", F.lit(0)).alias("n_fields"))


@query(f"WITH {C}, {A} SELECT c.chunk_id, coalesce(a.title, '') AS document_name, CASE WHEN c.page_number = 2 THEN 'Annex to Document ' || c.document_id END AS section_heading FROM clauses c LEFT JOIN agreements a ON a.document_id = c.document_id AND NOT a.deleted")
def join_name_headings(spark, sf):
    """A chunk's document name (empty if the document is gone) and section heading (none if it has no section)."""
    names = S.live(spark, sf).select("document_id", "title")
    sections = S.clauses(spark, sf).where("page_number = 2").select("document_id", "page_number", F.split("chunk_text", "\n")[0].alias("section_heading"))
    c = S.clauses(spark, sf).select("chunk_id", "document_id", "page_number").join(names, "document_id", "left").join(sections, ["document_id", "page_number"], "left")
    return c.select("chunk_id", F.coalesce("title", F.lit("")).alias("document_name"), "section_heading")


@query(f"WITH {A}, m AS (SELECT n_nationkey AS g, n_name FROM nation WHERE n_nationkey <> 3) SELECT a.document_id, m.n_name AS module_name FROM agreements a LEFT JOIN m ON CAST(m.g AS VARCHAR) = a.group_id WHERE NOT a.deleted")
def join_doc_module_name(spark, sf):
    m = V.table(spark, sf, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").cast("string").alias("group_id"), F.col("n_name").alias("module_name"))
    return S.live(spark, sf).select("document_id", "group_id").join(m, "group_id", "left").select("document_id", "module_name")


@query(f"WITH {A}, m AS (SELECT DISTINCT 'w' || n_nationkey AS workspace_id, CAST(g AS VARCHAR) AS group_id FROM nation, range(1, 7) t(g)) SELECT m.workspace_id, m.group_id, count(a.document_id) AS files_count, coalesce(string_agg(a.document_id || ':' || upper(a.file_type), ',' ORDER BY a.created_at DESC, a.document_id DESC), '') AS files FROM m LEFT JOIN agreements a ON a.workspace_id = m.workspace_id AND a.group_id = m.group_id AND NOT a.deleted GROUP BY ALL")
def agg_module_files(spark, sf):
    """Every module with its files, newest first, and their number; empty modules too."""
    m = V.table(spark, sf, "nation").select(F.concat(F.lit("w"), F.col("n_nationkey").cast("string")).alias("workspace_id"), F.explode(F.expr("transform(sequence(1, 6), g -> CAST(g AS STRING))")).alias("group_id")).distinct()
    one = F.struct("created_at", "document_id", F.concat(F.col("document_id").cast("string"), F.lit(":"), F.upper("file_type")).alias("shown"))
    files = S.live(spark, sf).groupBy("workspace_id", "group_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(one), False), lambda x: x["shown"]), ",").alias("f"))
    return m.join(files, ["workspace_id", "group_id"], "left").select("workspace_id", "group_id", F.coalesce("n", F.lit(0)).alias("files_count"), F.coalesce("f", F.lit("")).alias("files"))


@query(f"WITH {A}, e AS (SELECT DISTINCT workspace_id, document_id FROM agreements WHERE processing_status = 'READY' AND NOT deleted), got AS (SELECT DISTINCT l_orderkey AS document_id FROM lineitem WHERE l_quantity > 25) SELECT e.workspace_id, e.document_id FROM e WHERE document_id NOT IN (SELECT document_id FROM got)")
def anti_missing_docs(spark, sf):
    """Resolved documents that no candidate comes from."""
    got = V.table(spark, sf, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("document_id")).distinct()
    return S.ready(spark, sf).select("workspace_id", "document_id").join(got, "document_id", "left_anti")


@query(f"WITH {C} SELECT c.chunk_id, c.document_id FROM clauses c WHERE trim(c.chunk_text) <> '' AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = c.chunk_id AND e.embedding IS NOT NULL)")
def anti_missing_embeddings(spark, sf):
    """Chunks with words that have no embedding: the gate of indexing, which lets a document through where none is left."""
    has = V.table(spark, sf, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("chunk_id"))
    return S.clauses(spark, sf).where(F.trim("chunk_text") != "").select("chunk_id", "document_id").join(has, "chunk_id", "left_anti")


@query("SELECT a.conv_id AS session_id, a.turn, row_number() OVER (PARTITION BY a.conv_id ORDER BY a.turn) - 1 AS ordinal FROM conversations a WHERE a.role = 'assistant' AND EXISTS (SELECT 1 FROM conversations q WHERE q.conv_id = a.conv_id AND q.role = 'user')")
def join_citations_for_message(spark, sf):
    """Citations in order, of messages whose session there is."""
    asked = V.table(spark, sf, "conversations").where("role = 'user'").select("conv_id")
    w = Window.partitionBy("session_id").orderBy("turn")
    return V.table(spark, sf, "conversations").where("role = 'assistant'").join(asked, "conv_id", "left_semi").select(F.col("conv_id").alias("session_id"), "turn").withColumn("ordinal", F.row_number().over(w) - 1)


# aggregates


@query(f"WITH {C}, t AS (SELECT chunk_id, document_id FROM clauses WHERE chunk_id % 3 = 0), k AS (SELECT document_id % 25 AS package, document_id, count(*) AS n FROM t GROUP BY ALL) SELECT package, string_agg(document_id || '=' || n, ',' ORDER BY document_id) AS counts FROM k GROUP BY package")
def agg_per_document_counts(spark, sf):
    """How many chunks of each document a package holds, as a map."""
    n = S.clauses(spark, sf).where("chunk_id % 3 = 0").groupBy((F.col("document_id") % 25).alias("package"), "document_id").agg(F.count(F.lit(1)).alias("n"))
    shown = F.transform(F.array_sort(F.map_entries(F.map_from_entries(F.collect_list(F.struct("document_id", "n"))))), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string")))
    return n.groupBy("package").agg(F.array_join(shown, ",").alias("counts"))


@query(f"WITH {DOCS} SELECT sum(n)::BIGINT AS total FROM (SELECT group_id, count(*) AS n FROM docs GROUP BY 1)")
def agg_ui_sum(spark, sf):
    return V.table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("total"))


@query(f"WITH {R._F} SELECT document_id, count(*) AS n_fields, round(avg(coalesce(confidence, 0)), 6) AS mean_confidence FROM fields WHERE status <> 'REMOVED' GROUP BY 1")
def agg_avg_confidence(spark, sf):
    return R.fields(spark, sf).where("status <> 'REMOVED'").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_fields"), F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 6).alias("mean_confidence"))


@query("SELECT l_partkey AS chunk_id, max(l_discount) AS score, count(*) AS n_seen FROM lineitem GROUP BY 1")
def agg_max_score_dedupe(spark, sf):
    """A chunk that several lists give keeps its best score."""
    return V.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("chunk_id")).agg(F.max("l_discount").alias("score"), F.count(F.lit(1)).alias("n_seen"))


@query(f"WITH {C} SELECT document_id, sum(CASE WHEN chunk_id % 4 = 0 THEN greatest(1, len(regexp_extract_all(trim(chunk_text), '\\S+'))) ELSE len(regexp_extract_all(chunk_text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) END)::BIGINT AS n_tokens FROM clauses GROUP BY 1")
def agg_token_sum(spark, sf):
    """Tokens of each document; a chunk without a count has its words counted, one at least."""
    stored = F.when(F.col("chunk_id") % 4 != 0, T.count_tokens(F.col("chunk_text")))
    words = F.greatest(F.lit(1), F.size(T.extract_all(F.col("chunk_text"), r"\S+")))
    return S.clauses(spark, sf).groupBy("document_id").agg(F.sum(F.coalesce(stored, words)).alias("n_tokens"))


@query("SELECT l_orderkey AS page, round(coalesce(avg(CASE WHEN l_tax > 0.02 THEN 1 - l_discount END), 0), 6) AS confidence FROM lineitem GROUP BY 1")
def agg_ocr_conf(spark, sf):
    """A page's mean of its lines' confidences, 0 where none is known."""
    known = F.when(F.col("l_tax") > 0.02, 1 - F.col("l_discount"))
    return V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.round(F.coalesce(F.avg(known), F.lit(0.0)), 6).alias("confidence"))


@query(f"WITH {B}, s AS (SELECT document_id, list_sort(list(font_size)) AS f FROM blocks WHERE font_size IS NOT NULL GROUP BY 1) SELECT document_id, f[len(f) // 2 + 1] AS median_font FROM s")
def agg_median_font(spark, sf):
    """The upper median: of 2n values the (n+1)-th. A document's font sizes are few, so they are counted by size first."""
    n = S.blocks(spark, sf).where("font_size is not null").groupBy("document_id", "font_size").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("document_id").orderBy("font_size"))
    half = F.floor(F.sum("n").over(Window.partitionBy("document_id")) / 2)
    return n.select("document_id", "font_size", upto.alias("upto"), half.alias("half")).where("upto > half").groupBy("document_id").agg(F.min("font_size").alias("median_font"))


@query(f"WITH {B} SELECT document_id, page_number, max(font_size) AS max_font, count(*) AS n_blocks FROM blocks GROUP BY ALL")
def agg_max_font_page(spark, sf):
    return S.blocks(spark, sf).groupBy("document_id", "page_number").agg(F.max("font_size").alias("max_font"), F.count(F.lit(1)).alias("n_blocks"))


@query(f"WITH {J} SELECT stage, count(*) AS n, round(sum(elapsed_ms), 4) AS total_ms, round(max(elapsed_ms), 6) AS max_ms, count(*) FILTER (WHERE status = 'FAILED') AS n_failed FROM jobs GROUP BY 1")
def agg_stage_duration(spark, sf):
    """What each stage took, and how often it failed."""
    return S.jobs(spark, sf).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("elapsed_ms"), 4).alias("total_ms"), F.round(F.max("elapsed_ms"), 6).alias("max_ms"), F.count_if(F.col("status") == "FAILED").alias("n_failed"))


# order


@query(f"WITH {B} SELECT block_id, document_id, page_number, row_number() OVER (PARTITION BY document_id, page_number ORDER BY coalesce(y, 0), block_id) AS place FROM blocks")
def reading_order(spark, sf):
    w = Window.partitionBy("document_id", "page_number").orderBy(F.coalesce("y", F.lit(0.0)), "block_id")
    return S.blocks(spark, sf).select("block_id", "document_id", "page_number", F.row_number().over(w).alias("place"))


@query(f"WITH {LINES} SELECT document_id, lower(line) AS heading, min(1 + pos // 40) AS first_page FROM lines WHERE length(line) BETWEEN 1 AND 40 GROUP BY ALL")
def first_seen_page(spark, sf):
    return V.lines(spark, sf).where(F.length("line").between(1, 40)).groupBy("document_id", F.lower("line").alias("heading")).agg(F.min("page_number").cast("long").alias("first_page"))


@query(f"WITH {B}, s AS (SELECT block_id, document_id, nullif(CAST(page_number AS INTEGER), 3) AS start_page, text AS heading FROM blocks WHERE bold) SELECT block_id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(start_page, 1), coalesce(heading, ''), block_id) AS place FROM s")
def order_sections(spark, sf):
    w = Window.partitionBy("document_id").orderBy(F.coalesce("start_page", F.lit(1)), F.coalesce("heading", F.lit("")), "block_id")
    s = S.blocks(spark, sf).where("bold").select("block_id", "document_id", F.nullif(F.col("page_number").cast("int"), F.lit(3)).alias("start_page"), F.col("text").alias("heading"))
    return s.select("block_id", "document_id", F.row_number().over(w).alias("place"))


@query(f"WITH {B}, h AS (SELECT block_id, document_id, text AS heading FROM blocks WHERE bold AND text <> ''), f AS (SELECT document_id, lower(text) AS key, min(page_number) AS page FROM blocks WHERE page_number > 2 GROUP BY ALL), d AS (SELECT document_id, min(page_number) AS first FROM blocks GROUP BY 1) SELECT h.block_id, h.heading, coalesce(f.page, d.first) AS start_page FROM h LEFT JOIN f ON f.document_id = h.document_id AND f.key = lower(h.heading) JOIN d ON d.document_id = h.document_id")
def sections_from_styled_headings(spark, sf):
    """A styled heading's page is the first on which its text is seen, else the document's first."""
    b = S.blocks(spark, sf)
    seen = b.where("page_number > 2").groupBy("document_id", F.lower("text").alias("key")).agg(F.min("page_number").alias("page"))
    first = b.groupBy("document_id").agg(F.min("page_number").alias("first"))
    h = b.where("bold AND text <> ''").select("block_id", "document_id", F.col("text").alias("heading"), F.lower("text").alias("key"))
    return h.join(seen, ["document_id", "key"], "left").join(first, "document_id").select("block_id", "heading", F.coalesce("page", "first").alias("start_page"))


# candidates


_CAND = "cand AS (SELECT l_suppkey AS question_id, l_partkey AS chunk_id, l_orderkey % 40 AS document_id, max(l_discount * 100 + l_tax) AS score FROM lineitem GROUP BY ALL)"


def _candidates(spark, sf):
    """Scored candidates of many questions: suppliers ask, parts are chunks."""
    return V.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("question_id"), F.col("l_partkey").alias("chunk_id"), (F.col("l_orderkey") % 40).alias("document_id")).agg(F.max(F.col("l_discount") * 100 + F.col("l_tax")).alias("score"))


@query(f"WITH {_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id, document_id) AS rank FROM cand) SELECT question_id, chunk_id, document_id, rank FROM r WHERE rank <= 40")
def cap_candidates(spark, sf):
    return fusion.top(_candidates(spark, sf), 40, [F.desc("score"), F.col("chunk_id"), F.col("document_id")], ["question_id"]).select("question_id", "chunk_id", "document_id", "rank")


@query(f"WITH {_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id, document_id) AS rank FROM cand), n AS (SELECT question_id, chunk_id, document_id, round(CAST((chunk_id * 7919 + question_id) % 100 AS DOUBLE) / 100, 2) AS rerank FROM r WHERE rank <= 30) SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rerank DESC, chunk_id, document_id) AS place FROM n")
def rerank_window(spark, sf):
    """Only the first thirty of a question are scored anew; the others go."""
    few = fusion.top(_candidates(spark, sf), 30, [F.desc("score"), F.col("chunk_id"), F.col("document_id")], ["question_id"])
    again = few.select("question_id", "chunk_id", "document_id", F.round((F.col("chunk_id") * 7919 + F.col("question_id")) % 100 / 100, 2).alias("rerank"))
    return again.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("rerank"), "chunk_id", "document_id")))


@query(f"WITH {_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id, document_id) AS rank FROM cand) SELECT question_id, chunk_id, document_id FROM r WHERE rank <= 8")
def select_top(spark, sf):
    return fusion.top(_candidates(spark, sf), 8, [F.desc("score"), F.col("chunk_id"), F.col("document_id")], ["question_id"]).select("question_id", "chunk_id", "document_id")


@query(f"WITH {_CAND}, d AS (SELECT DISTINCT question_id, document_id FROM cand), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id, document_id) AS rank FROM cand), s AS (SELECT DISTINCT question_id, document_id FROM r WHERE rank <= 8), m AS (SELECT question_id, document_id FROM d WHERE document_id < 6 EXCEPT SELECT * FROM s), e AS (SELECT c.*, row_number() OVER (PARTITION BY c.question_id, c.document_id ORDER BY c.score DESC, c.chunk_id) AS rn FROM cand c JOIN m USING (question_id, document_id)) SELECT question_id, document_id, chunk_id FROM e WHERE rn <= 2")
def fanout_missing(spark, sf):
    """For the resolved documents of a question that its candidates lack, the best two of each: without a loop over documents."""
    c, by = _candidates(spark, sf), [F.desc("score"), F.col("chunk_id"), F.col("document_id")]
    have = fusion.top(c, 8, by, ["question_id"]).select("question_id", "document_id").distinct()
    return fusion.top(c.where("document_id < 6").join(have, ["question_id", "document_id"], "left_anti"), 2, by[:2], ["question_id", "document_id"]).select("question_id", "document_id", "chunk_id")
