"""The evaluation of retrieval: benchmark items as questions, the documents that hold their sentences as what should be found."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import evaluation as EV
from quern.operators import fusion
from quern.queries import answers as AQ
from quern.queries import retrieval as RQ
from quern.registry import CHUNKS, query
from quern.sources import views as V

MODES = ["keyword", "trigram", "hybrid"]
_GOLD = r"""it AS (SELECT item_id, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS sentence FROM benchmark),
gold AS (SELECT DISTINCT i.item_id AS question_id, c.document_id FROM it i JOIN chunks c ON c.chunk_text = i.sentence WHERE len(regexp_extract_all(lower(i.sentence), '[0-9a-z]+')) >= 5)"""
_RANKED = """rk AS (SELECT 'keyword' AS mode, question_id, document_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id, pos) AS rank FROM kr QUALIFY rank <= 20 UNION ALL SELECT 'trigram', item_id, document_id, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, document_id, pos) AS rank FROM t QUALIFY rank <= 20),
bd AS (SELECT mode, question_id, document_id, row_number() OVER (PARTITION BY mode, question_id ORDER BY min(rank), document_id) AS rank FROM rk GROUP BY mode, question_id, document_id),
hy AS (SELECT 'hybrid' AS mode, question_id, document_id, row_number() OVER (PARTITION BY question_id ORDER BY round(sum(1.0 / (60 + rank)), 12) DESC, document_id) AS rank FROM bd GROUP BY question_id, document_id),
rd AS (SELECT * FROM bd UNION ALL SELECT * FROM hy)"""
_MEANS = """ge AS (SELECT question_id, count(*) AS n, list_sum(list_transform(range(1, least(count(*), 10)::INTEGER + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM gold GROUP BY 1), ev AS (SELECT ge.*, unnest(['keyword', 'trigram', 'hybrid']) AS mode FROM ge),
ht AS (SELECT r.mode, r.question_id, count(*) AS found, sum(1 / log2(r.rank + 1)) AS dcg, min(r.rank) AS place FROM rd r JOIN gold g ON g.question_id = r.question_id AND g.document_id = r.document_id WHERE r.rank <= 10 GROUP BY ALL),
mn AS (SELECT e.mode, count(*) AS n_questions, avg(coalesce(found / n, 0)) AS recall, avg(coalesce(dcg / ideal, 0)) AS ndcg, avg(CASE WHEN place = 1 THEN 1.0 ELSE 0 END) AS first FROM ev e LEFT JOIN ht h ON h.mode = e.mode AND h.question_id = e.question_id GROUP BY 1)"""


def gold(spark, sf):
    """question_id, document_id: the documents that have a sentence of an item, of five words or more."""
    items = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.explode_outer(T.sentences(F.col("text"))).alias("chunk_text")).where(F.size(T.simple_tokens(F.col("chunk_text"))) >= 5).distinct()
    return V.chunks(spark, sf).select("document_id", "chunk_text").join(items, "chunk_text").select("question_id", "document_id").distinct()


def rankings(spark, sf):
    """mode, question_id, document_id, rank: documents by words, by trigrams, and by both fused."""
    words, grams = AQ.topk_keyword(spark, sf).select(F.lit("keyword").alias("mode"), "question_id", "document_id", "rank"), fusion.top(RQ.alike(spark, sf, "true"), 20, [F.desc("similarity"), F.col("document_id"), F.col("pos")], ["item_id"]).select(F.lit("trigram").alias("mode"), F.col("item_id").alias("question_id"), "document_id", "rank")
    plain = EV.by_document(words.unionByName(grams))
    fused = plain.groupBy("question_id", "document_id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 12).alias("rrf"))
    hybrid = fusion.top(fused, 1 << 30, [F.desc("rrf"), F.col("document_id")], ["question_id"])
    return plain.unionByName(hybrid.select(F.lit("hybrid").alias("mode"), "question_id", "document_id", "rank"))


@query(f"WITH {CHUNKS}, {AQ._SEARCHES}, {AQ._RUN}, {RQ._ALIKE_ALL}, {_GOLD}, {_RANKED}, {_MEANS}, b AS (SELECT * FROM mn WHERE mode = 'keyword') SELECT mn.mode, mn.n_questions, round(mn.recall, 6) AS recall, round(mn.ndcg, 6) AS ndcg, round(mn.first, 6) AS first, round(mn.recall - b.recall, 6) AS recall_delta, round(mn.ndcg - b.ndcg, 6) AS ndcg_delta, round(mn.first - b.first, 6) AS first_delta FROM mn, b")
def evaluation_report(spark, sf):
    """Recall, nDCG at ten and the first hit of each mode of retrieval, and each mode's difference to the keyword channel."""
    return EV.report(rankings(spark, sf), gold(spark, sf), MODES)
