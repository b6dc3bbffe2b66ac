"""Queries of ranking, fusion, selection and the whole retrieval plan."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import similarity as S
from quern.functions import text as T
from quern.operators import fusion
from quern.operators import textindex as TI
from quern.plans import hybrid
from quern.registry import CHUNKS, DOCS, query
from quern.sources import views as V

_COS = "1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_Q = "q AS (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


def _distances(spark, sf):
    """The distance of every chunk's embedding to the question's: the vector with the smallest vec_id."""
    e = V.table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    q = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    return e.join(F.broadcast(q)).select("vec_id", "label", S.cosine_distance(F.col("embedding"), F.col("q")).alias("distance"))  # q: one row


@query(f"WITH {_Q}, d AS (SELECT e.vec_id, {_COS} AS distance FROM embeddings e, q) SELECT vec_id, round(distance, 6) AS distance, CAST(row_number() OVER (ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d ORDER BY d.distance, vec_id LIMIT 20")
def topk_vector(spark, sf):
    return fusion.top(_distances(spark, sf).select("vec_id", "distance"), 20, [F.col("distance"), F.col("vec_id")]).withColumn("distance", F.round("distance", 6))


@query(f"WITH {_Q}, d AS (SELECT e.vec_id, e.label, {_COS} AS distance FROM embeddings e, q), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank FROM d) SELECT vec_id, label, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def fanout(spark, sf):
    """The five nearest chunks of every document: retrieval document by document, without a loop."""
    return fusion.top(_distances(spark, sf), 5, [F.col("distance"), F.col("vec_id")], ["label"]).withColumn("distance", F.round("distance", 6))


@query(f"WITH {_Q}, d AS (SELECT e.vec_id, e.label AS document_id, 1 - ({_COS}) AS score, e.vec_id % 3 AS sec FROM embeddings e, q), r AS (SELECT *, row_number() OVER (PARTITION BY sec ORDER BY score DESC, vec_id) AS rn FROM d) SELECT vec_id, round(score, 6) AS score FROM r ORDER BY rn > 1, r.score DESC, vec_id LIMIT 12")
def select_diverse(spark, sf):
    scored = _distances(spark, sf).select("vec_id", F.col("label").alias("document_id"), (1 - F.col("distance")).alias("score"), (F.col("vec_id") % 3).alias("sec"))
    return fusion.diverse(scored, "sec", "vec_id", 12).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_Q}, d AS (SELECT e.vec_id, e.label AS document_id, 1 - ({_COS}) AS score FROM embeddings e, q), r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, vec_id) AS rn FROM d),
n AS (SELECT document_id, count(*) AS n FROM d GROUP BY 1), f AS (SELECT count(*) AS docs, count(*) FILTER (WHERE n > 5) AS over FROM n) SELECT vec_id, document_id, rn FROM r, f WHERE rn <= 5 OR docs = 1 OR over = 1 ORDER BY rn, document_id LIMIT 8""")
def select_quota(spark, sf):
    scored = _distances(spark, sf).select("vec_id", F.col("label").alias("document_id"), (1 - F.col("distance")).alias("score"))
    return fusion.quota(scored, "vec_id", 8, 0.6).select("vec_id", "document_id", "rn")


@query(f"""WITH {_Q}, d AS (SELECT e.vec_id, {_COS} AS distance FROM embeddings e, q),
v AS (SELECT vec_id, 'vector' AS channel, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM d QUALIFY rank <= 20), k AS (SELECT vec_id, 'keyword' AS channel, row_number() OVER (ORDER BY vec_id) AS rank FROM d WHERE distance < 1 QUALIFY rank <= 20),
b AS (SELECT vec_id, channel, min(rank) AS rank FROM (SELECT * FROM v UNION ALL SELECT * FROM k) GROUP BY ALL) SELECT vec_id, round(sum(1.0 / (60 + rank)), 9) AS rrf_score, string_agg(channel, ',' ORDER BY channel DESC) AS provenance FROM b GROUP BY vec_id""")
def rrf_merge(spark, sf):
    """Two rankings of chunks, twenty of each, fused."""
    d = _distances(spark, sf)
    lists = {"vector": fusion.top(d.select("vec_id", "distance"), 20, [F.col("distance"), F.col("vec_id")]), "keyword": fusion.top(d.where("distance < 1").select("vec_id", "distance"), 20, [F.col("vec_id")])}
    both = [x.select("vec_id", "rank", F.lit(name).alias("channel")) for name, x in lists.items()]
    return fusion.rrf(both[0].unionByName(both[1]), ["vec_id"]).withColumn("rrf_score", F.round("rrf_score", 9))


_ONE = "one AS (SELECT text AS question, list_distinct(regexp_extract_all(lower(text), '[0-9a-z]+')) AS qt FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark))"
_TG = "list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[0-9a-z]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _question(spark, sf):
    return V.table(spark, sf, "benchmark").orderBy("item_id").limit(1).select(F.col("text").alias("question"), F.array_distinct(T.simple_tokens(F.col("text"))).alias("qt"))


@query(f"""WITH {CHUNKS}, {_ONE}, s AS (SELECT document_id, pos, len(list_filter(regexp_extract_all(lower(chunk_text), '[0-9a-z]+'), lambda t: list_contains(qt, t))) / len(qt) AS score FROM chunks, one) SELECT document_id, pos, round(score, 6) AS score FROM s ORDER BY s.score DESC, document_id, pos LIMIT 30""")
def rerank_overlap(spark, sf):
    s = V.chunks(spark, sf).join(F.broadcast(_question(spark, sf))).select("document_id", "pos", fusion.overlap(F.col("qt"), T.simple_tokens(F.col("chunk_text"))).alias("score"))
    return s.orderBy(F.desc("score"), "document_id", "pos").limit(30).withColumn("score", F.round("score", 6))


#: The searches, benchmark items whose id is divisible by 50, against every sentence; only sizes that allow the similarity are compared.
_ALIKE = f"""ca AS (SELECT document_id, pos, {_TG.format("chunk_text")} AS a FROM chunks), ib AS (SELECT item_id, {_TG.format("text")} AS b FROM benchmark WHERE item_id % 50 = 0), near AS (SELECT *, len(list_intersect(a, b)) AS o FROM ca JOIN ib ON len(a) > 0 AND len(a) >= 0.3 * len(b) AND len(b) >= 0.3 * len(a)),
t AS (SELECT item_id, document_id, pos, o / (len(a) + len(b) - o) AS similarity FROM near WHERE o / (len(a) + len(b) - o) > 0.3)"""


_ALIKE_ALL = _ALIKE.replace(" WHERE item_id % 50 = 0", "")


def alike(spark, sf, searches="item_id % 50 = 0"):
    """item_id, document_id, pos, similarity above 0.3 of the searches, items whose id is divisible by 50 if not said otherwise, with every sentence."""
    items = V.table(spark, sf, "benchmark").where(searches).select(F.col("item_id").alias("question_id"), F.col("text").alias("query"))
    key = ["document_id", "pos"]
    sentences = V.chunks(spark, sf).select(*key, "chunk_text")
    return TI.similar(items, None, sentences, key).select(F.col("question_id").alias("item_id"), *key, F.col("score").alias("similarity"))


@query(f"""WITH {CHUNKS}, {_ALIKE}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, document_id, pos) AS rank FROM t) SELECT item_id, document_id, pos, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 20""")
def trigram_search(spark, sf):
    """For every search the twenty sentences that are most similar by trigrams, above 0.3."""
    return fusion.top(alike(spark, sf), 20, [F.desc("similarity"), F.col("document_id"), F.col("pos")], ["item_id"]).select("item_id", "document_id", "pos", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"""WITH {CHUNKS}, t AS (SELECT document_id, pos, regexp_extract_all(lower(chunk_text), '[0-9a-z]+') AS ws FROM chunks) SELECT document_id, pos, len(ws) AS n FROM t WHERE list_contains(ws, 'the') AND list_contains(ws, 'and')""")
def keyword_match(spark, sf):
    """Chunks that have all terms of a two-word query."""
    words = T.simple_tokens(F.col("chunk_text"))
    return V.chunks(spark, sf).where(F.array_contains(words, "the") & F.array_contains(words, "and")).select("document_id", "pos", F.size(words).alias("n"))


@query(f"""WITH {CHUNKS}, t AS (SELECT document_id, pos, ' ' || array_to_string(regexp_extract_all(lower(chunk_text), '[0-9a-z]+'), ' ') || ' ' AS ws FROM chunks) SELECT document_id, pos FROM t WHERE contains(ws, ' of the ')""")
def phrase_search(spark, sf):
    words = F.concat(F.lit(" "), F.array_join(T.simple_tokens(F.col("chunk_text")), " "), F.lit(" "))
    return V.chunks(spark, sf).where(words.contains(" of the ")).select("document_id", "pos")


@query(f"""WITH {CHUNKS}, c AS (SELECT document_id AS question_id, pos, token_count, pos % 7 AS score, pos = 0 AS protected FROM tokens), w AS (SELECT *, sum(token_count) OVER (PARTITION BY question_id) AS total, coalesce(sum(CASE WHEN protected THEN 0 ELSE token_count END) OVER (PARTITION BY question_id ORDER BY score, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT question_id, pos, score, token_count FROM w WHERE protected OR total - before <= 300""")
def trim_tokens(spark, sf):
    """The sentences of each document cut to 300 tokens by a score; the first one is protected."""
    c = V.chunks(spark, sf).select(F.col("document_id").alias("question_id"), "pos", "token_count", (F.col("pos") % 7).alias("score"), (F.col("pos") == 0).alias("protected"))
    return fusion.trim(c, "pos", 300).select("question_id", "pos", "score", "token_count")


@query(f"""WITH {CHUNKS}, c AS (SELECT document_id, sum(token_count) AS n_tokens, count(*) AS n_chunks FROM tokens GROUP BY 1), {DOCS} SELECT d.workspace_id, count(*) AS n_documents, sum(c.n_chunks) AS n_chunks, sum(c.n_tokens) AS n_tokens FROM c JOIN docs d ON d.document_id = c.document_id WHERE d.processing_status = 'READY' GROUP BY 1""")
def join_chunk_document(spark, sf):
    """Chunks of READY documents, counted by workspace: chunks are reduced to a row a document before the join."""
    c = V.chunks(spark, sf).groupBy("document_id").agg(F.sum("token_count").alias("t"), F.count(F.lit(1)).alias("c"))
    d = V.documents(spark, sf).where("processing_status = 'READY'").select("document_id", "workspace_id")
    return c.join(d, "document_id").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("c").alias("n_chunks"), F.sum("t").alias("n_tokens"))


@query(f"""WITH {CHUNKS}, r AS (SELECT document_id, pos, token_count, row_number() OVER (PARTITION BY document_id ORDER BY token_count DESC, pos) AS rn FROM tokens) SELECT document_id, pos, token_count FROM r WHERE rn <= 2""")
def protect_floor(spark, sf):
    return fusion.top(V.chunks(spark, sf).select("document_id", "pos", "token_count"), 2, [F.desc("token_count"), F.col("pos")], ["document_id"]).drop("rank")


_SLOT = "list_transform(CASE WHEN len(regexp_extract_all(lower({0}), '[0-9a-z]+')) = 0 THEN [''] ELSE regexp_extract_all(lower({0}), '[0-9a-z]+') END, lambda t: CASE WHEN t = '' THEN 0 ELSE ('0x' || substr(sha256(t), 1, 8))::BIGINT % 1024 END)"


@query(f"""WITH {CHUNKS}, one AS (SELECT text AS question, list_distinct(regexp_extract_all(lower(text), '[0-9a-z]+')) AS qt, {_SLOT.format("text")} AS qs FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)),
c AS (SELECT document_id, pos, len(list_filter(regexp_extract_all(lower(chunk_text), '[0-9a-z]+'), lambda t: list_contains(qt, t))) / len(qt) AS k, {_SLOT.format("chunk_text")} AS cs, qs FROM chunks, one),
n AS (SELECT document_id, pos, k, list_sum(list_transform(list_distinct(list_intersect(cs, qs)), lambda v: len(list_filter(cs, lambda x: x = v)) * len(list_filter(qs, lambda x: x = v)))) / (sqrt(list_sum(list_transform(list_distinct(cs), lambda v: len(list_filter(cs, lambda x: x = v)) ** 2))) * sqrt(list_sum(list_transform(list_distinct(qs), lambda v: len(list_filter(qs, lambda x: x = v)) ** 2)))) AS cosine FROM c),
v AS (SELECT document_id, pos, 'vector' AS channel, row_number() OVER (ORDER BY round(coalesce(cosine, 0), 9) DESC, document_id, pos) AS rank FROM n QUALIFY rank <= 20),
w AS (SELECT document_id, pos, 'keyword' AS channel, row_number() OVER (ORDER BY round(k, 9) DESC, document_id, pos) AS rank FROM n QUALIFY rank <= 20),
f AS (SELECT document_id, pos, sum(1.0 / (60 + rank)) AS rrf_score, CASE WHEN count(*) = 2 THEN 'vector,keyword' ELSE min(channel) END AS provenance FROM (SELECT * FROM v UNION ALL SELECT * FROM w) GROUP BY ALL)
SELECT document_id, pos, round(rrf_score, 9) AS rrf_score, provenance FROM f ORDER BY f.rrf_score DESC, document_id, pos LIMIT 8""")
def hybrid_retrieval(spark, sf):
    """The flagship: for one question, vector and keyword channels over every chunk, fused, the best eight."""
    return hybrid.retrieve(V.chunks(spark, sf), V.table(spark, sf, "benchmark").orderBy("item_id").limit(1).select("text"))


@query(f"""WITH {DOCS}, m AS (SELECT group_id AS mode, processing_status = 'READY' AS ok FROM docs) SELECT mode, count(*) AS n_questions, count(*) FILTER (WHERE ok) AS n_correct, round(count(*) FILTER (WHERE ok) / count(*) - (SELECT count(*) FILTER (WHERE ok) / count(*) FROM m), 6) AS delta FROM m GROUP BY mode""")
def ready_by_language(spark, sf):
    """READY documents by language, and each language's difference to the whole."""
    by = V.documents(spark, sf).groupBy(F.col("group_id").alias("mode")).agg(F.count(F.lit(1)).alias("n_questions"), F.count_if(F.col("processing_status") == "READY").alias("n_correct"))
    every = Window.partitionBy(F.lit(1))  # a row for each mode
    return by.withColumn("delta", F.round(F.col("n_correct") / F.col("n_questions") - F.sum("n_correct").over(every) / F.sum("n_questions").over(every), 6))
