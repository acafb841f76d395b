"""Queries of what keeps a store going: cursors and polls, queues, aliases, evidence, ledgers, traces, time frames."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from siltstone.expr import temporal, text
from siltstone.model.frames import Frames
from siltstone.operators import curation, grounding, persist, writes
from siltstone.plans.registry import query
from siltstone.sources import readers
from siltstone.store import literal_rows
from siltstone.streaming import admission

NOW = "2025-06-01 00:00:00"


@query("SELECT queue_id, CASE WHEN status = 'processing' AND created_at < TIMESTAMP '2024-01-10 11:55:00' THEN 'pending' ELSE status END AS status FROM queue")
def reclaimed_rows(f: Frames) -> DataFrame:
    """Rows in work whose heartbeat is five minutes old are pending again."""
    return admission.reclaimed(f.queue.withColumn("heartbeat_at", F.col("created_at")), "2024-01-10 12:00:00").select("queue_id", "status")


@query("SELECT source_event_id, coalesce(string_agg(payload_key, ',' ORDER BY queue_id) FILTER (queue_id % 3 <> 0), '') AS payload_keys FROM queue GROUP BY 1")
def unconsumed_keys(f: Frames) -> DataFrame:
    """What of each session's keys no worker has taken."""
    entries = F.array_sort(F.collect_list(F.struct("queue_id", "payload_key")))
    rows = f.queue.groupBy("source_event_id").agg(F.transform(entries, lambda e: e["payload_key"]).alias("payload_keys"), F.transform(F.filter(entries, lambda e: e["queue_id"] % 3 == 0), lambda e: e["payload_key"]).alias("consumed"))
    return admission.unconsumed(rows).select("source_event_id", F.array_join("payload_keys", ",").alias("payload_keys"))


@query("SELECT queue_id FROM queue WHERE source_system = 'src0' OR (customer_id, source_system) IN (('acme', 'src1'), ('globex', 'src3'))")
def connected_rows(f: Frames) -> DataFrame:
    """Rows of sources with an active token, or that need none."""
    tokens = literal_rows(f.spark, [("acme", "src1", True), ("acme", "src2", False), ("globex", "src3", True), ("globex", "src3", True)], "customer_id string, source string, active boolean")
    return readers.connected(f.queue, tokens, ("src0",)).select("queue_id")


@query("""WITH due AS (SELECT s_suppkey AS n, 's' || s_suppkey AS resource_id FROM supplier WHERE s_suppkey > 3 ORDER BY n DESC, resource_id LIMIT 6)
SELECT resource_id, CAST(least(4, 10 - n % 10) AS INTEGER) AS payloads, CAST(n % 10 + least(4, 10 - n % 10) AS BIGINT) AS cursor FROM due""")
def polled_cursors(f: Frames) -> DataFrame:
    """The six cursors that wait longest, each polled in a task of its own."""
    n = F.col("s_suppkey")
    cursors = f.table("supplier").select(F.concat(F.lit("s"), n.cast("string")).alias("resource_id"), F.lit("counting").alias("poller"), (n % 10).cast("long").alias("cursor"), F.expr(f"timestamp'{NOW}' - make_interval(0, 0, 0, 0, 0, CAST(s_suppkey AS INT), 0)").alias("polled_at"))
    return readers.polled(cursors, NOW, 180, 6).select("resource_id", F.size("payloads").alias("payloads"), "cursor")


@query("""SELECT 'c' AS customer_id, 's' || s_suppkey % 3 AS source, CAST(s_suppkey AS VARCHAR) AS resource_id, CASE WHEN s_suppkey % 4 = 1 THEN 'new' WHEN s_suppkey % 4 = 2 THEN 'old' WHEN s_suppkey % 2 = 0 THEN 'old' END AS cursor FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 4 = 1""")
def advanced_cursors(f: Frames) -> DataFrame:
    """Cursors after a round: new ones, those that a missing value leaves, and those that it didn't touch."""
    n = F.col("s_suppkey")
    keys = [F.lit("c").alias("customer_id"), F.concat(F.lit("s"), (n % 3).cast("string")).alias("source"), n.cast("string").alias("resource_id")]
    own = f.table("supplier").where(n % 2 == 0).select(*keys, F.lit("old").alias("cursor"))
    fresh = f.table("supplier").where((n % 4).isin(1, 2)).select(*keys, F.when(n % 4 == 1, "new").alias("cursor"))
    return writes.advance_cursors(own, fresh)


@query("""SELECT event_id AS request_id, left(repeat(props, 12), 100) AS request, props AS response, length(props) * 12 > 100 OR length(props) > 100 AS truncated FROM events""")
def response_traces(f: Frames) -> DataFrame:
    """Payloads cut to a hundred bytes, with a mark where one was."""
    calls = f.table("events").select(F.lit("acme").alias("customer_id"), F.col("event_id").alias("request_id"), F.col("ts").alias("occurred_at"), F.repeat("props", F.lit(12)).alias("request"), F.col("props").alias("response"))
    return persist.trace_rows(calls, 100).select("request_id", "request", "response", "truncated")


@query("""WITH c AS (SELECT c_custkey AS n FROM customer), a AS (SELECT 'Person:' || n AS alias, 'Person:' || (n - n % 3) AS primary_id FROM c WHERE n % 3 <> 0),
p AS (SELECT DISTINCT coalesce(primary_id, id) AS id FROM (SELECT unnest(['Person:4', 'Person:9', 'nobody']) AS id) q LEFT JOIN a ON a.alias = q.id),
m AS (SELECT id FROM p UNION SELECT alias FROM a JOIN p ON p.id = a.primary_id)
SELECT id FROM m UNION SELECT 'e' || n FROM c WHERE 'Person:' || n IN (SELECT id FROM m) UNION SELECT 'u' || n || '@x.org' FROM c WHERE n % 2 = 0 AND 'Person:' || n IN (SELECT id FROM m)""")
def author_aliases(f: Frames) -> DataFrame:
    """Every id under which three people write."""
    n = F.col("c_custkey")
    person = F.concat(F.lit("Person:"), n.cast("string"))
    aliases = f.table("customer").where(n % 3 != 0).select(person.alias("alias"), F.concat(F.lit("Person:"), (n - n % 3).cast("string")).alias("primary"))
    email = F.when(n % 2 == 0, F.concat(F.lit("u"), n.cast("string"), F.lit("@x.org")))
    nodes = f.table("customer").select(person.alias("canonical_id"), F.to_json(F.struct(F.concat(F.lit("e"), n.cast("string")).alias("employee_id"), F.lit("").alias("login"), email.alias("email"))).alias("properties"))
    return grounding.author_ids(["Person:4", "Person:9", "nobody"], aliases, nodes)


@query("""WITH a AS (SELECT 'Service' AS label, 'Service:' || s_suppkey AS alias, 'Service:' || (s_suppkey - s_suppkey % 4) AS p FROM supplier WHERE s_suppkey % 4 <> 0),
r AS (SELECT 'Service' AS label, 'Service:' || s_suppkey AS id FROM supplier)
SELECT r.label, r.id, coalesce(x.p, r.id) || coalesce((SELECT ',' || string_agg(DISTINCT alias, ',' ORDER BY alias) FROM a WHERE a.p = coalesce(x.p, r.id)), '') AS members FROM r LEFT JOIN a x ON x.alias = r.id""")
def cluster_expansion(f: Frames) -> DataFrame:
    """All ids of each service's cluster."""
    n = F.col("s_suppkey")
    own = F.concat(F.lit("Service:"), n.cast("string"))
    aliases = f.table("supplier").where(n % 4 != 0).select(F.lit("Service").alias("label"), own.alias("alias"), F.concat(F.lit("Service:"), (n - n % 4).cast("string")).alias("primary"))
    return writes.cluster_members(f.table("supplier").select(F.lit("Service").alias("label"), own.alias("id")), aliases)


@query("""SELECT c_name AS entity, CASE WHEN c_custkey % 2 = 0 THEN 'Person:' || c_custkey ELSE 'guess:' || c_custkey END AS canonical_id FROM customer""")
def reconciled_entities(f: Frames) -> DataFrame:
    """Proposed entities with the ids of the grounded ones of their names."""
    n = F.col("c_custkey").cast("string")
    proposed = f.table("customer").select(F.col("c_name").alias("entity"), F.concat(F.lit("guess:"), n).alias("canonical_id"))
    bundle = f.table("customer").where("c_custkey % 2 = 0").select(F.upper("c_name").alias("display"), F.concat(F.lit("Person:"), n).alias("canonical_id"), F.lit(1).alias("order"))
    return grounding.reconcile(proposed, bundle)


@query("SELECT doc_id, CAST(source_id AS BIGINT) % 40 < 20 AND CAST(source_id AS BIGINT) % 3 <> 0 AS closed FROM docs WHERE valid_to IS NULL")
def retired_children(f: Frames) -> DataFrame:
    """Children of re-emitted parents that weren't emitted again are closed."""
    n = F.col("source_id").cast("long")
    children = f.documents.where("valid_to is null").select("doc_id", F.concat(F.lit("p"), (n % 40).cast("string")).alias("parent_id"), "valid_to", n.alias("n"))
    parents = f.spark.range(20).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("doc_id"))
    return writes.retire_children(children.drop("n"), parents, children.where("n % 3 = 0").select("doc_id"), NOW).select("doc_id", F.col("valid_to").isNotNull().alias("closed"))


_MATCHES = "m AS (SELECT 's' || l_suppkey AS source_repo, 'p' || l_partkey % 20 AS target_repo, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)"


@query(f"WITH {_MATCHES} SELECT source_repo, target_repo, string_agg('seen in line ' || left(CAST(seq AS VARCHAR), 3), ';' ORDER BY seq) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY source_repo, target_repo ORDER BY seq) AS rn FROM m) WHERE rn <= 5 GROUP BY ALL")
def edge_evidence(f: Frames) -> DataFrame:
    """One edge for each pair of repositories, with its first five pieces of evidence, cut."""
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    matches = f.table("lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_repo"), F.concat(F.lit("p"), (F.col("l_partkey") % 20).cast("string")).alias("target_repo"), seq.alias("seq"), F.concat(F.lit("seen in line "), F.rpad(seq.cast("string"), 3, " ")).alias("snippet"))
    return writes.aggregate_evidence(matches, 5, 16).select("source_repo", "target_repo", F.array_join(F.transform("evidence", lambda s: F.rtrim(s)), ";").alias("evidence"))


@query("SELECT 's' || l_suppkey AS source_repo, count(DISTINCT l_linenumber) AS files FROM lineitem WHERE l_linenumber > 2 GROUP BY 1")
def evidence_after_removal(f: Frames) -> DataFrame:
    """Edges whose evidence in two removed files is gone."""
    file = F.struct(F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("file"))
    edges = f.table("lineitem").groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_repo")).agg(F.collect_set(file).alias("evidence"))
    return writes.drop_evidence(edges, ["f1", "f2"]).select("source_repo", F.size("evidence").cast("long").alias("files"))


@query("SELECT 's' || l_suppkey % 5 AS source_repo, 'p' || l_partkey % 7 AS target_repo, count(*) AS n FROM lineitem WHERE l_suppkey % 5 <> 2 GROUP BY ALL UNION ALL SELECT 's2', 'fresh', 1")
def replaced_repository_edges(f: Frames) -> DataFrame:
    """One repository's edges to others replaced as a whole; other repositories' fresh ones don't count."""
    repo, target = F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("source_repo"), F.concat(F.lit("p"), (F.col("l_partkey") % 7).cast("string")).alias("target_repo")
    fresh = literal_rows(f.spark, [("s2", "fresh"), ("s3", "fresh")], "source_repo string, target_repo string")
    return curation.replace_edges(f.table("lineitem").select(repo, target), "s2", fresh).groupBy("source_repo", "target_repo").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'c' || s_suppkey AS clause_id, 'earlier' AS session_id FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'c' || s_suppkey, 'now' FROM supplier WHERE s_suppkey % 3 = 0")
def serve_ledger(f: Frames) -> DataFrame:
    """The ledger after a serve: a row for each clause served."""
    clause = F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("clause_id")
    empty = f.spark.createDataFrame([], "clause_id string, session_id string, actor string, served_at timestamp")
    ledger = curation.record_serves(empty, f.table("supplier").where("s_suppkey % 2 = 0").select(clause), "earlier", "agent", NOW)
    return curation.record_serves(ledger, f.table("supplier").where("s_suppkey % 3 = 0").select(clause), "now", "agent", NOW).select("clause_id", "session_id")


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'm' || o_custkey % 2 END AS le, 'm' || o_orderkey % 2 AS re, o_custkey % 3 AS lt, o_orderkey % 3 AS rt FROM orders)
SELECT o_orderkey, coalesce(le <> re, FALSE) OR lt <> rt AS conflict FROM t""")
def stable_key_conflicts(f: Frames) -> DataFrame:
    """Pairs whose e-mail or team differs where both have one."""
    o = f.table("orders")
    left = {"email": F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("m"), (F.col("o_custkey") % 2).cast("string"))), "team_id": F.col("o_custkey") % 3}
    right = {"email": F.concat(F.lit("m"), (F.col("o_orderkey") % 2).cast("string")), "team_id": F.col("o_orderkey") % 3}
    return o.select("o_orderkey", writes.conflicting(left, right).alias("conflict"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN NULL WHEN vec_id % 3 = 1 THEN 'fix the login for u' ELSE 'what is ABC-' || vec_id || '?' END AS rest FROM vectors")
def residual_queries(f: Frames) -> DataFrame:
    """What queries say beyond their identifiers; those of which none was taken are as they were."""
    named = F.concat(F.lit("ABC-"), F.col("vec_id").cast("string"))
    asked = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("ticket "), named)).when(F.col("vec_id") % 3 == 1, F.concat(F.lit("fix the login for u ("), named, F.lit(")"))).otherwise(F.concat(F.lit("what is "), named, F.lit("?")))
    ids = F.when(F.col("vec_id") % 3 == 2, F.array().cast("array<string>")).otherwise(F.array(named))
    rest = text.residual(asked, ids)
    return f.vectors.select("vec_id", F.when(F.col("vec_id") % 3 == 1, F.concat(rest, F.lit(" u"))).otherwise(rest).alias("rest"))


@query("SELECT doc_id, version, substr(title, 1, 20) || ' [1][2][3] and [4]' AS answer FROM docs")
def cleaned_citations(f: Frames) -> DataFrame:
    """Citations one by one, repeats side by side as one."""
    return f.documents.select("doc_id", "version", text.clean_citations(F.concat(F.substring("title", 1, 20), F.lit(" [1, 2][ 3 ] and [4] [4]"))).alias("answer"))


@query("SELECT doc_id FROM docs WHERE valid_to IS NULL AND updated_at >= TIMESTAMP '2025-06-01' - INTERVAL 510 DAY AND updated_at < TIMESTAMP '2025-06-01' - INTERVAL 500 DAY")
def changed_in_a_time_frame(f: Frames) -> DataFrame:
    """Documents that changed between 510 and 500 days ago, by a relative time frame."""
    frame, _ = temporal.resolve({"since": {"rel": -510}, "until": {"rel": -500}}, datetime(2025, 6, 1, tzinfo=UTC))
    return f.documents.where(temporal.document_predicate(frame)).select("doc_id")
