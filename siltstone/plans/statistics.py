"""Queries of usage, ingestion and serving statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from siltstone.model.frames import Frames
from siltstone.operators import statistics
from siltstone.plans.registry import query

_USAGE = """SELECT '{level}' AS level, {name} AS name, count(*) AS calls, count(*) FILTER (status = 'error') AS errors,
  CAST(trunc(quantile_cont(latency_ms, 0.5) FILTER (status = 'ok')) AS BIGINT) AS p50, CAST(trunc(quantile_cont(latency_ms, 0.95) FILTER (status = 'ok')) AS BIGINT) AS p95 FROM usage {where} GROUP BY ALL"""


def _usage(where: str = "") -> str:
    return " UNION ALL ".join(_USAGE.format(level=level, name=name, where=where) for level, name in (("overall", "'*'"), ("caller_kind", "caller_kind"), ("event_type", "event_type")))


@query(_usage())
def usage_statistics(f: Frames) -> DataFrame:
    return statistics.usage_statistics(f.usage, "all", "2024-07-01 00:00:00")


@query(_usage("WHERE occurred_at >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 7 DAY"))
def usage_statistics_week(f: Frames) -> DataFrame:
    return statistics.usage_statistics(f.usage, "7d", "2024-02-01 00:00:00")


@query("SELECT event_id, caller_kind, event_type FROM usage WHERE caller_kind = 'agent' AND list_contains(regexp_extract_all(lower(summary), '[a-z0-9_]+'), 'purchase') ORDER BY occurred_at DESC, event_id LIMIT 50")
def usage_feed(f: Frames) -> DataFrame:
    return statistics.usage_feed(f.usage, ["Purchase"], "agent", 50)


@query("""WITH alive AS (SELECT * FROM docs WHERE valid_to IS NULL AND deleted_at IS NULL), d AS (SELECT source_system, count(*) AS documents FROM alive GROUP BY 1),
c AS (SELECT a.source_system, count(*) AS chunks FROM chunks k JOIN alive a USING (customer_id, doc_id) WHERE k.valid_to IS NULL GROUP BY 1),
q AS (SELECT source_system, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'dlq') AS dlq FROM queue GROUP BY 1)
SELECT source_system, coalesce(documents, 0) AS documents, coalesce(chunks, 0) AS chunks, coalesce(pending, 0) AS pending, coalesce(processing, 0) AS processing, coalesce(dlq, 0) AS dlq FROM d FULL JOIN c USING (source_system) FULL JOIN q USING (source_system)""")
def ingestion_statistics(f: Frames) -> DataFrame:
    return statistics.ingestion_statistics(f.documents, f.chunks, f.queue).drop("last_ingested")


@query("SELECT source_system, count(*) AS documents, strftime(max(ingested_at), '%Y-%m-%d %H:%M:%S') AS last_ingested FROM docs WHERE valid_to IS NULL AND deleted_at IS NULL GROUP BY 1")
def documents_by_source(f: Frames) -> DataFrame:
    alive = f.documents.where("valid_to is null and deleted_at is null")
    return alive.groupBy("source_system").agg(F.count(F.lit(1)).alias("documents"), F.date_format(F.max("ingested_at"), "yyyy-MM-dd HH:mm:ss").alias("last_ingested"))


@query("SELECT source_system, status, count(*) AS n FROM queue GROUP BY ALL")
def queue_depth(f: Frames) -> DataFrame:
    return statistics.queue_depth(f.queue)


@query("""WITH f AS (SELECT q.*, (SELECT count(*) / 8 FROM events) - coalesce(b.busy, 0) AS room FROM queue q LEFT JOIN (SELECT customer_id, count(*) AS busy FROM queue WHERE status = 'processing' GROUP BY 1) b USING (customer_id) WHERE q.status = 'pending')
SELECT queue_id, customer_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY priority DESC, created_at, queue_id) AS place FROM f WHERE room > 0) WHERE place <= room ORDER BY priority DESC, created_at, queue_id LIMIT 50""")
def queue_claim(f: Frames) -> DataFrame:
    cap = f.table("events").count() / 8
    return statistics.claimable(f.queue, cap, 50)


@query("SELECT user_id, n FROM (SELECT user_id, max(occurred_at) AS last, count(*) AS n FROM usage GROUP BY 1) WHERE last < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1440 MINUTE")
def idle_sessions(f: Frames) -> DataFrame:
    return statistics.idle_sessions(f.usage, "2024-01-31 00:00:00", 1440)


_CLAUSES = """clauses AS (SELECT p_partkey AS clause_id, 'p' || (p_partkey % 9) AS author, p_partkey % 11 = 0 AS published, CASE p_partkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'proposed' ELSE 'retired' END AS status,
  p_partkey % 4 AS specificity, TIMESTAMP '2024-01-01 00:00:00' + (p_partkey % 100) * INTERVAL 1 HOUR AS updated_at FROM part),
support AS (SELECT l_partkey AS clause_id, count(DISTINCT l_suppkey % 6) AS backers FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus = 'O' AND l_discount > 0.08 GROUP BY 1),
visible AS (SELECT c.*, coalesce(s.backers, 0) AS backers FROM clauses c LEFT JOIN support s USING (clause_id) WHERE coalesce(s.backers, 0) >= 2 OR author = 'p3' OR published)"""


def _clauses(f: Frames) -> DataFrame:
    scope = F.expr("CASE p_partkey % 4 WHEN 0 THEN '{}' WHEN 1 THEN '{\"a\":1}' WHEN 2 THEN '{\"a\":1,\"b\":2}' ELSE '{\"a\":1,\"b\":2,\"c\":3}' END")
    clauses = f.table("part").select(F.col("p_partkey").alias("clause_id"), F.expr("concat('p', p_partkey % 9)").alias("author"), F.expr("p_partkey % 11 = 0").alias("published"), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'proposed' ELSE 'retired' END").alias("status"), scope.alias("scope"), F.expr("timestampadd(HOUR, CAST(p_partkey % 100 AS INT), timestamp'2024-01-01 00:00:00')").alias("updated_at"))
    backers = f.table("lineitem").where("l_discount > 0.08").select(F.col("l_partkey").alias("clause_id"), (F.col("l_suppkey") % 6).alias("author"), F.expr("l_returnflag = 'R'").alias("tainted"), F.expr("CASE WHEN l_linestatus = 'O' THEN 'human' ELSE 'agent' END").alias("kind"))
    return statistics.visible_clauses(clauses, backers, "p3")


@query(f"WITH {_CLAUSES} SELECT clause_id, backers FROM visible")
def visible_clauses(f: Frames) -> DataFrame:
    return _clauses(f).select("clause_id", "backers")


@query(f"WITH {_CLAUSES} SELECT clause_id, specificity, status FROM visible ORDER BY specificity DESC, CASE status WHEN 'active' THEN 0 WHEN 'proposed' THEN 1 ELSE 2 END, updated_at DESC, clause_id LIMIT 20")
def served_clauses(f: Frames) -> DataFrame:
    return statistics.serve_clauses(_clauses(f), 20).select("clause_id", F.col("specificity").cast("long").alias("specificity"), "status")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (valid_to IS NULL) AS live, max(version) AS top FROM history GROUP BY 1")
def version_history(f: Frames) -> DataFrame:
    return f.history.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("valid_to").isNull()).alias("live"), F.max("version").alias("top"))


@query("SELECT user_id, event_type, version FROM history WHERE valid_from <= TIMESTAMP '2024-01-15 00:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15 00:00:00')")
def history_as_of(f: Frames) -> DataFrame:
    from siltstone.expr.temporal import Temporal, document_predicate

    return f.history.where(document_predicate(Temporal("AS_OF", at="2024-01-15 00:00:00"))).select("user_id", "event_type", "version")


@query("SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (role = 'user') AS user_turns FROM conversations GROUP BY 1")
def session_summaries(f: Frames) -> DataFrame:
    return f.sessions.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("role") == "user").alias("user_turns"))
