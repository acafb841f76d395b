"""The model's tables in DuckDB SQL, for oracles."""

from __future__ import annotations

import re

BEGUN = "(TIMESTAMP '2024-01-01 00:00:00' + n * INTERVAL 1 HOUR)"

TABLES = {
    "docs": f"""
  SELECT CASE WHEN n % 10 = 3 THEN 'globex' ELSE 'acme' END AS customer_id, 'doc:' || source || ':' || n AS doc_id, CAST(version AS BIGINT) AS version,
    source AS source_system, CAST(n AS VARCHAR) AS source_id, 'https://example.com/' || source || '/items/' || n AS source_url,
    CASE n % 3 WHEN 0 THEN 'message' WHEN 1 THEN 'issue' ELSE 'page' END AS doc_type, substr(split_part(text, chr(10), 1), 1, 60) AS title,
    CASE WHEN n % 5 = 0 AND version = 1 THEN substr(text, 1, CAST(floor(length(text) / 2) AS INTEGER)) ELSE text END AS body,
    CASE WHEN n % 11 = 0 THEN 'unknown' WHEN n % 7 = 0 THEN NULL ELSE 'p' || (n % 50) END AS author_id,
    CASE WHEN n % 4 = 3 THEN NULL ELSE 'k' || (n % 3) END AS source_key, CASE WHEN n % 13 = 0 THEN 'draft' ELSE 'approved' END AS visibility,
    {BEGUN} AS created_at, {BEGUN} + (10 * (version - 1)) * INTERVAL 1 DAY AS valid_from,
    CASE WHEN n % 5 = 0 AND version = 1 THEN {BEGUN} + INTERVAL 10 DAY END AS valid_to, {BEGUN} + (10 * (version - 1)) * INTERVAL 1 DAY AS updated_at,
    {BEGUN} + (10 * (version - 1)) * INTERVAL 1 DAY + INTERVAL 5 MINUTE AS ingested_at,
    CASE WHEN n % 17 = 0 AND NOT (n % 5 = 0 AND version = 1) THEN {BEGUN} + INTERVAL 20 DAY END AS deleted_at, lang AS language
  FROM (SELECT doc_id AS n, text, lang, source, unnest(CASE WHEN doc_id % 5 = 0 THEN [1, 2] ELSE [1] END) AS version FROM documents)""",
    "pieces": """
  SELECT *, array_to_string(tokens[chunk_index * 448 + 1 : chunk_index * 448 + 512], ' ') AS content, len(tokens[chunk_index * 448 + 1 : chunk_index * 448 + 512]) AS n_tokens
  FROM (SELECT *, unnest(range(0, CAST(ceil(greatest(len(tokens) - 512, 0) / 448.0) AS BIGINT) + 1)) AS chunk_index
        FROM (SELECT *, regexp_extract_all(body, '[^ \\t\\n\\r]+') AS tokens FROM docs) WHERE len(tokens) > 0)""",
    "chunks": """
  SELECT *, doc_id || ':c_' || substr(content_hash, 1, 16) AS chunk_id FROM (
    SELECT customer_id, doc_id, sha256(content) AS content_hash, max(chunk_index) AS chunk_index, min(version) AS first_seen_version, max(version) AS last_seen_version,
      min(content) AS content, min(title) AS title, min(visibility) AS visibility, min(valid_from) AS valid_from,
      nullif(max(coalesce(valid_to, TIMESTAMP '9999-01-01 00:00:00')), TIMESTAMP '9999-01-01 00:00:00') AS valid_to, max(n_tokens) AS n_tokens
    FROM pieces GROUP BY customer_id, doc_id, sha256(content))""",
    "vectors": """
  SELECT vec_id, 'src' || label AS source_system, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding, TIMESTAMP '2024-01-01 00:00:00' + ((vec_id * 37) % 1000) * INTERVAL 1 HOUR AS updated_at FROM embeddings""",
    "edges": """
  SELECT edge_type, from_id, to_id, (['AMBIGUOUS', 'INFERRED', 'EXTRACTED'])[max(tier) + 1] AS confidence, max(tier) AS tier, min(valid_from) AS valid_from, max(open) = 1 AS live FROM (
    SELECT 'AUTHORED' AS edge_type, 'Person:' || o_custkey AS from_id, 'Document:' || o_orderkey AS to_id, 2 AS tier, o_orderdate AS valid_from, 1 AS open FROM orders
    UNION ALL SELECT 'TOUCHES', 'Document:' || l_orderkey, 'Repo:' || l_partkey, CASE l_returnflag WHEN 'N' THEN 2 WHEN 'A' THEN 1 ELSE 0 END, l_shipdate, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END FROM lineitem
    UNION ALL SELECT 'ASSIGNED_TO', 'Document:' || l_orderkey, 'Service:' || l_suppkey, CASE l_returnflag WHEN 'N' THEN 2 WHEN 'A' THEN 1 ELSE 0 END, l_shipdate, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END FROM lineitem
    UNION ALL SELECT 'DISCUSSES', 'Document:' || o_orderkey, 'Document:' || (o_orderkey // 4), 1, o_orderdate, 1 FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey > 0 AND o_orderkey // 4 IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'CALLS', 'Service:' || s_suppkey, 'Service:' || (s_suppkey % 7 + 1), CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END, TIMESTAMP '2024-01-01 00:00:00', 1 FROM supplier WHERE s_suppkey % 7 + 1 <> s_suppkey)
  GROUP BY edge_type, from_id, to_id""",
    "sym": """
  SELECT from_id AS a, to_id AS b, edge_type, confidence, tier, live, valid_from FROM edges
  UNION ALL SELECT to_id, from_id, edge_type, confidence, tier, live, valid_from FROM edges WHERE from_id <> to_id""",
    "nodes": """
  SELECT label, canonical_id, name, coalesce(d.degree, 0) AS degree, updated_at FROM (
    SELECT 'Document' AS label, 'Document:' || o_orderkey AS canonical_id, 'Order ' || o_orderkey AS name, o_orderdate AS updated_at FROM orders
    UNION ALL SELECT 'Person', 'Person:' || c_custkey, c_name, NULL FROM customer
    UNION ALL SELECT 'Service', 'Service:' || s_suppkey, s_name, NULL FROM supplier
    UNION ALL SELECT 'Repo', 'Repo:' || p_partkey, p_name, NULL FROM part)
  LEFT JOIN (SELECT a, count(*) AS degree FROM sym GROUP BY a) d ON d.a = canonical_id""",
    "sourced": """
  SELECT *, 'src' || (CAST(split_part(from_id, ':', 2) AS BIGINT) % 5) AS source_system FROM edges""",
    "provenance": """
  SELECT canonical_id, source_system, min(valid_from) AS first_seen, max(valid_from) AS last_seen
  FROM (SELECT from_id AS canonical_id, source_system, valid_from FROM sourced UNION ALL SELECT to_id, source_system, valid_from FROM sourced) GROUP BY ALL""",
    "usage": """
  SELECT event_id, user_id, ts AS occurred_at, value AS latency_ms, event_type, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN user_id % 3 = 0 THEN 'agent' ELSE 'human' END AS caller_kind, concat_ws(' ', event_type, props) AS summary FROM events""",
    "history": """
  SELECT event_id, user_id, event_type, row_number() OVER w AS version, ts AS valid_from, lead(ts) OVER w AS valid_to FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "queue": """
  SELECT event_id AS queue_id, CASE WHEN user_id % 10 = 3 THEN 'globex' ELSE 'acme' END AS customer_id, 'src' || (user_id % 5) AS source_system, user_id AS source_event_id,
    CASE event_type WHEN 'purchase' THEN 100 WHEN 'error' THEN 75 ELSE 50 END AS priority, (['pending', 'processing', 'done', 'dlq'])[event_id % 4 + 1] AS status, ts AS created_at,
    CAST(event_id % 7 AS INTEGER) AS attempts, 'raw/' || event_id AS payload_key FROM events""",
}


def with_tables(body: str) -> str:
    """Puts the common tables that a statement names before it; it may begin with its own WITH-less `name AS (...)` list and a SELECT."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(TABLES[name])
                if name not in needed:
                    needed.append(name)

    need(body)
    own = body.strip()
    if own.upper().startswith("WITH RECURSIVE "):
        common = ", ".join(f"{n} AS ({TABLES[n]})" for n in needed)
        return f"WITH RECURSIVE {common}, {own[15:]}" if common else own
    common = ", ".join(f"{n} AS ({TABLES[n]})" for n in needed)
    if own.upper().startswith("WITH "):
        return f"WITH {common}, {own[5:]}" if common else own
    return f"WITH {common} {own}" if common else own
