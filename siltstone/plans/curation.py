"""Queries of clauses, suggestions and validated edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from siltstone.model.frames import Frames
from siltstone.operators import curation, retrieval, writes
from siltstone.plans.registry import query
from siltstone.plans.retrieval import VECTOR


def _drafts(f: Frames) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = f.table("part")
    clauses = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("long").alias("clause_id"), F.col("p_name").alias("text"), F.lit(None).cast("long").alias("conflicts_with"))
    evidence = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("long").alias("clause_id"), F.lit("owner").alias("author"))
    relation = F.expr("CASE p_partkey % 6 WHEN 1 THEN 'same' WHEN 3 THEN 'conflict' ELSE 'new' END")
    drafts = part.where("p_partkey % 2 = 1").select((F.col("p_partkey") + 1_000_000).cast("long").alias("draft_id"), F.col("p_name").alias("text"), F.expr("concat('p', p_partkey % 5)").alias("author"), relation.alias("relation"), F.expr("CASE WHEN p_partkey % 6 <> 5 THEN CAST(p_partkey + 1 AS BIGINT) END").alias("related_id"))
    return clauses, evidence, drafts


@query("""SELECT CAST(p_partkey AS BIGINT) AS clause_id, CASE WHEN (p_partkey - 1) % 6 = 3 THEN CAST(p_partkey - 1 + 1000000 AS BIGINT) END AS conflicts_with FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey + 1000000, CASE WHEN p_partkey % 6 = 3 THEN p_partkey + 1 END FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 6 <> 1""")
def clause_declaration(f: Frames) -> DataFrame:
    return curation.declare_clauses(*_drafts(f))[0].select("clause_id", "conflicts_with")


@query("""SELECT author, count(*) AS n FROM (SELECT p_partkey AS c, 'owner' AS author FROM part WHERE p_partkey % 2 = 0 UNION SELECT CASE WHEN p_partkey % 6 = 1 THEN p_partkey + 1 ELSE p_partkey + 1000000 END, 'p' || (p_partkey % 5) FROM part WHERE p_partkey % 2 = 1) GROUP BY 1""")
def clause_evidence(f: Frames) -> DataFrame:
    return curation.declare_clauses(*_drafts(f))[1].groupBy("author").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT edge_type, CASE WHEN edge_type = 'GUESSES' THEN 'unknown type' WHEN k % 7 = 0 THEN 'missing end' WHEN k % 3 = 0 THEN 'off topic' END AS dropped, count(*) AS n
FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'GUESSES' ELSE 'RESOLVES' END AS edge_type FROM orders) GROUP BY ALL""")
def inferred_edge_validation(f: Frames) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    orders = f.table("orders")
    nodes = orders.select(F.concat(F.lit("a:"), k).alias("canonical_id"), F.concat(F.lit("Billing gateway outage "), k).alias("name")).unionByName(orders.where("o_orderkey % 7 <> 0").select(F.concat(F.lit("b:"), k).alias("canonical_id"), F.lit("Runbook").alias("name")))
    why = F.when(F.col("o_orderkey") % 3 == 0, "both mention x9 things").otherwise("the gateway outage in billing")
    edges = orders.select(F.when(F.col("o_orderkey") % 5 == 0, "GUESSES").otherwise("RESOLVES").alias("edge_type"), F.concat(F.lit("a:"), k).alias("from_id"), F.concat(F.lit("b:"), k).alias("to_id"), why.alias("why"))
    return curation.validated_edges(edges, nodes).groupBy("edge_type", "dropped").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'S' AS label, 'p' || (s_suppkey % 10) AS primary_id, 'a' || s_suppkey AS alias, round(0.5 + (s_suppkey % 50) / 100.0, 6) AS confidence FROM supplier WHERE 0.5 + (s_suppkey % 50) / 100.0 >= 0.75 AND s_suppkey % 4 <> 0")
def merge_suggestions(f: Frames) -> DataFrame:
    s = f.table("supplier")
    pair = s.select("s_suppkey", F.lit("S").alias("label"), F.expr("concat('p', s_suppkey % 10)").alias("primary"), F.expr("concat('a', s_suppkey)").alias("alias"), F.expr("round(0.5D + (s_suppkey % 50) / 100.0D, 6)").alias("confidence"), F.lit("r").alias("rationale"))
    made = curation.suggest_merges(pair.where("s_suppkey % 4 = 0"), pair.drop("s_suppkey"), 0.75)
    return made.select("label", F.col("primary").alias("primary_id"), "alias", "confidence")


@query("""WITH gone AS (SELECT * FROM edges WHERE edge_type = 'ASSIGNED_TO' AND confidence = 'AMBIGUOUS'), d AS (SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM edges UNION ALL SELECT to_id FROM edges) GROUP BY 1), fall AS (SELECT id, count(*) AS fall FROM (SELECT from_id AS id FROM gone UNION ALL SELECT to_id FROM gone) GROUP BY 1)
SELECT id AS canonical_id, degree - coalesce(fall, 0) AS degree FROM d LEFT JOIN fall USING (id) WHERE starts_with(id, 'Service:')""")
def degree_decrement(f: Frames) -> DataFrame:
    removed = f.edges.where("edge_type = 'ASSIGNED_TO' AND confidence = 'AMBIGUOUS'")
    _, after = curation.remove_edges(f.edges, writes.degrees(f.edges), removed)
    return after.where(F.col("canonical_id").startswith("Service:"))


@query("SELECT event_id, event_type FROM usage WHERE occurred_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY")
def pending_within_time_to_live(f: Frames) -> DataFrame:
    rows = f.usage.withColumnRenamed("occurred_at", "parked_at")
    return curation.kept_pending(rows, "2024-01-31 00:00:00", 7).select("event_id", "event_type")


@query("SELECT user_id, event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 1, FALSE) AS odd FROM events")
def json_cells(f: Frames) -> DataFrame:
    odd = F.get_json_object("props", "$.k").cast("long") % 2 == 1
    return f.table("events").select("user_id", "event_id", F.coalesce(odd, F.lit(False)).alias("odd"))


@query(f"SELECT clause_id, status, similarity FROM (SELECT vec_id AS clause_id, source_system AS status, round(coalesce(list_cosine_similarity(embedding, {VECTOR}::DOUBLE[]), 0), 6) AS similarity FROM vectors WHERE vec_id % 3 <> 0 ORDER BY similarity DESC, clause_id LIMIT 25) WHERE similarity >= 0.2")
def clause_nearest_neighbours(f: Frames) -> DataFrame:
    clauses = f.vectors.select(F.col("vec_id").alias("clause_id"), F.col("source_system").alias("status"), F.when(F.col("vec_id") % 3 == 0, "old").otherwise("new").alias("model"), "embedding")
    return retrieval.clause_neighbours(clauses, VECTOR, "new", 25, 0.2)
