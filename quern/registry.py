"""Queries by name, each with the SQL that it must equal."""

from __future__ import annotations

import functools
from collections.abc import Callable

#: Most bytes of a side that is broadcast by estimate, and by what its shuffle was measured to hold. The texts are made of
#: narrow columns, and an estimate from those is short by a factor of fifty: larger sides must be measured first.
ESTIMATED, MEASURED = 256 << 10, 10 << 20

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = measured(f)
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def measured(f: Callable) -> Callable:
    """f, whose session broadcasts no side of a join that is large by anything but a measurement."""

    @functools.wraps(f)
    def run(spark, sf_dir):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", ESTIMATED)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", MEASURED)
        return f(spark, sf_dir)

    return run


#: Relations of quern.sources.views, as common table expressions.
DOCS = """docs AS (SELECT d.doc_id AS document_id, d.source AS workspace_id, d.lang AS group_id, 'doc-' || d.doc_id AS file_name,
 CASE WHEN l.quality = 0 THEN 'INDEXING' ELSE 'READY' END AS processing_status, d.text
 FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id)"""
CHUNKS = r"""parts AS (SELECT doc_id AS document_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents),
chunks AS (SELECT document_id, unnest(range(len(s))) AS pos, unnest(s) AS chunk_text FROM parts),
tokens AS (SELECT *, greatest(1, len(regexp_extract_all(chunk_text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))) AS token_count FROM chunks)"""
LINES = r"""cut AS (SELECT doc_id AS document_id, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS l FROM documents),
lines AS (SELECT document_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM cut)"""
FACTS = """ev AS (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
facts AS (SELECT max(event_id) AS node_id, user_id % 20 AS workspace_id, user_id AS document_id, event_type AS label, max_by(k, event_id) AS value FROM ev WHERE k IS NOT NULL GROUP BY user_id, event_type)"""
