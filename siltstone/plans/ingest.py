"""Queries of ingestion: versioned writes, graph upserts, admission."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from siltstone.expr import text
from siltstone.functions import udfs
from siltstone.model.frames import Frames
from siltstone.operators import incremental, persist, provenance, writes
from siltstone.plans.registry import query
from siltstone.sources import connectors
from siltstone.store import shared_folder, written
from siltstone.streaming import admission, queue_state
from siltstone.tables import Change, TableSet

NOW = "2025-06-01 00:00:00"

_CHANGES = """state AS (SELECT doc_id, version, sha256(body) AS content_hash, valid_from, valid_to, deleted_at FROM docs),
incoming AS (SELECT doc_id, sha256(CASE WHEN CAST(source_id AS BIGINT) % 3 = 0 THEN body || '!' ELSE body END) AS new_hash FROM docs WHERE valid_to IS NULL AND CAST(source_id AS BIGINT) % 2 = 0 UNION ALL SELECT doc_id || ':new', sha256(body) FROM docs WHERE version = 1 AND CAST(source_id AS BIGINT) % 50 = 1)"""


def _incoming(f: Frames) -> DataFrame:
    n = F.col("source_id").cast("long")
    live = f.documents.where("valid_to is null").where(n % 2 == 0).select("doc_id", F.lit(1).alias("seq"), F.sha2(F.when(n % 3 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")), 256).alias("content_hash"))
    fresh = f.documents.where("version = 1").where(n % 50 == 1).select(F.concat("doc_id", F.lit(":new")).alias("doc_id"), F.lit(1).alias("seq"), F.sha2("body", 256).alias("content_hash"))
    return live.unionByName(fresh)


@query(f"""WITH {_CHANGES}, changed AS (SELECT s.doc_id FROM state s JOIN incoming i USING (doc_id) WHERE s.valid_to IS NULL AND (s.content_hash <> i.new_hash OR s.deleted_at IS NOT NULL)),
after AS (SELECT s.doc_id, s.version, s.content_hash, s.valid_to IS NULL AND s.doc_id NOT IN (SELECT doc_id FROM changed) AS live FROM state s
  UNION ALL SELECT i.doc_id, coalesce(t.top, 0) + 1, i.new_hash, TRUE FROM incoming i LEFT JOIN (SELECT doc_id, max(version) AS top FROM state GROUP BY 1) t USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.doc_id = i.doc_id AND s.valid_to IS NULL AND s.deleted_at IS NULL AND s.content_hash = i.new_hash))
SELECT doc_id, version, content_hash, live FROM after""")
def document_upsert(f: Frames) -> DataFrame:
    state = f.documents.select("doc_id", "version", F.sha2("body", 256).alias("content_hash"), "valid_from", "valid_to", "deleted_at")
    return writes.upsert_documents(state, _incoming(f), NOW).select("doc_id", "version", "content_hash", F.col("valid_to").isNull().alias("live"))


_PLAN = """live AS (SELECT DISTINCT doc_id, content_hash FROM chunks WHERE valid_to IS NULL),
incoming AS (SELECT doc_id, sha256(content) AS content_hash, max(chunk_index) AS chunk_index FROM pieces WHERE version = 1 GROUP BY ALL)"""


@query(f"WITH {_PLAN} SELECT CASE WHEN l.doc_id IS NOT NULL AND i.doc_id IS NOT NULL THEN 'reused' WHEN i.doc_id IS NOT NULL THEN 'added' ELSE 'removed' END AS action, count(*) AS n FROM live l FULL JOIN incoming i ON l.doc_id = i.doc_id AND l.content_hash = i.content_hash GROUP BY 1")
def chunk_plan(f: Frames) -> DataFrame:
    return _plan(f).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def _plan(f: Frames) -> DataFrame:
    from siltstone.model.frames import windows
    from siltstone.model.vocabulary import CHUNK_OVERLAP, CHUNK_TOKENS

    first = windows(f.documents.where("version = 1"), "body", CHUNK_TOKENS, CHUNK_OVERLAP, "doc_id")
    incoming = first.select("doc_id", F.sha2("content", 256).alias("content_hash"), "chunk_index")
    return writes.plan_chunks(f.chunks.where("valid_to is null"), incoming)


@query(f"""WITH {_PLAN}, plan AS (SELECT coalesce(l.doc_id, i.doc_id) AS doc_id, coalesce(l.content_hash, i.content_hash) AS content_hash, i.chunk_index, i.doc_id IS NOT NULL AS present FROM live l FULL JOIN incoming i ON l.doc_id = i.doc_id AND l.content_hash = i.content_hash)
SELECT coalesce(c.doc_id, p.doc_id) AS doc_id, coalesce(c.content_hash, p.content_hash) AS content_hash, CAST(CASE WHEN c.doc_id IS NOT NULL THEN c.chunk_index ELSE p.chunk_index END AS BIGINT) AS chunk_index,
  CASE WHEN p.present THEN 9 ELSE c.last_seen_version END AS last_seen_version, CASE WHEN p.present THEN TRUE WHEN p.doc_id IS NOT NULL THEN FALSE ELSE c.valid_to IS NULL END AS live
FROM chunks c FULL JOIN plan p ON c.doc_id = p.doc_id AND c.content_hash = p.content_hash""")
def chunk_apply(f: Frames) -> DataFrame:
    table = f.chunks.select("doc_id", "content_hash", "chunk_index", "first_seen_version", "last_seen_version", "valid_to")
    versions = f.documents.select("doc_id").distinct().withColumn("version", F.lit(9).cast("long"))
    return writes.apply_chunks(table, _plan(f), versions, NOW).select("doc_id", "content_hash", "chunk_index", "last_seen_version", F.col("valid_to").isNull().alias("live"))


@query("SELECT source_event_id AS doc_id, max(queue_id) AS queue_id FROM queue GROUP BY 1 HAVING max(queue_id) > (SELECT count(*) / 2 FROM events)")
def ordered_admission(f: Frames) -> DataFrame:
    rows = f.queue.select(F.col("source_event_id").alias("doc_id"), "queue_id")
    half = f.table("events").count() / 2
    applied = rows.select("doc_id").distinct().withColumn("applied_id", F.lit(half))
    return writes.admit_in_order(rows, applied)


@query("""WITH e AS (SELECT event_id, user_id, unnest(json_keys(props)) AS key, props FROM events), v AS (SELECT user_id, key, arg_max(json_extract_string(props, '$.' || key), event_id) AS value FROM e GROUP BY ALL)
SELECT user_id, string_agg(key || '=' || value, ',' ORDER BY key) AS merged FROM v GROUP BY 1""")
def property_merge(f: Frames) -> DataFrame:
    rows = f.table("events").select("user_id", F.col("event_id").alias("seq"), F.col("props").alias("properties"))
    merged = writes.merge_properties(rows, "user_id").select("user_id", F.from_json("properties", "map<string,string>").alias("m"))
    pairs = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return merged.select("user_id", F.concat_ws(",", pairs).alias("merged"))


_INCOMING_EDGES = """aliased AS (SELECT edge_type, from_id, CASE WHEN to_id IN ('Service:2', 'Service:4') THEN 'Service:1' ELSE to_id END AS to_id, CASE WHEN to_id IN ('Service:2', 'Service:4') THEN to_id ELSE '' END AS alias_to, tier, valid_from FROM edges WHERE edge_type = 'ASSIGNED_TO')"""


def _upserted(f: Frames) -> tuple[DataFrame, DataFrame]:
    own = f.edges.where("edge_type = 'ASSIGNED_TO'").withColumn("seq", F.xxhash64("from_id", "to_id"))
    incoming = own.select("edge_type", "from_id", "to_id", "confidence", "valid_from", F.lit(None).cast("timestamp").alias("valid_to"), F.lit("s").alias("source_system"), "seq")
    empty = incoming.limit(0).drop("seq").withColumns({"alias_from": F.lit(""), "alias_to": F.lit("")})
    aliases = f.spark.createDataFrame([("Service:2", "Service:1"), ("Service:4", "Service:1")], "alias string, primary string")
    known = f.named_nodes.where("label <> 'Service' OR canonical_id IN ('Service:1', 'Service:3', 'Service:5', 'Service:6')")
    return writes.upsert_edges(empty, incoming, aliases, known.select("canonical_id"))


@query(f"WITH {_INCOMING_EDGES} SELECT to_id, alias_to, (['AMBIGUOUS', 'INFERRED', 'EXTRACTED'])[tier + 1] AS confidence, count(*) AS n FROM aliased WHERE to_id IN ('Service:1', 'Service:3', 'Service:5', 'Service:6') GROUP BY ALL")
def edge_upsert(f: Frames) -> DataFrame:
    return _upserted(f)[0].groupBy("to_id", "alias_to", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_INCOMING_EDGES} SELECT to_id, count(*) AS n FROM aliased WHERE to_id NOT IN ('Service:1', 'Service:3', 'Service:5', 'Service:6') GROUP BY 1")
def pending_edges(f: Frames) -> DataFrame:
    return _upserted(f)[1].groupBy("to_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_INCOMING_EDGES} SELECT to_id, count(*) AS n FROM aliased WHERE to_id IN ('Service:7', 'Service:8') GROUP BY 1")
def drained_edges(f: Frames) -> DataFrame:
    ready, _ = writes.drain_pending(_upserted(f)[1], f.named_nodes.where("label <> 'Service' OR canonical_id IN ('Service:7', 'Service:8')"))
    return ready.groupBy("to_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH gone AS (SELECT DISTINCT canonical_id FROM provenance WHERE source_system = 'src3' AND canonical_id NOT IN (SELECT canonical_id FROM provenance WHERE source_system <> 'src3')),
after AS (SELECT 'documents' AS name, (SELECT count(*) FROM docs) AS before, (SELECT count(*) FROM docs WHERE source_system = 'src3') AS removed
UNION ALL SELECT 'chunks', (SELECT count(*) FROM chunks), (SELECT count(*) FROM chunks WHERE doc_id IN (SELECT doc_id FROM docs WHERE source_system = 'src3'))
UNION ALL SELECT 'provenance', (SELECT count(*) FROM provenance), (SELECT count(*) FROM provenance WHERE source_system = 'src3')
UNION ALL SELECT 'nodes', (SELECT count(*) FROM nodes), (SELECT count(*) FROM nodes WHERE canonical_id IN (SELECT canonical_id FROM gone))
UNION ALL SELECT 'edges', (SELECT count(*) FROM sourced), (SELECT count(*) FROM sourced WHERE source_system = 'src3' OR from_id IN (SELECT canonical_id FROM gone) OR to_id IN (SELECT canonical_id FROM gone)))
SELECT * FROM after""")
def source_purge(f: Frames) -> DataFrame:
    tables = {"documents": f.documents, "chunks": f.chunks, "provenance": f.provenance, "nodes": f.nodes, "edges": f.sourced_edges}
    return provenance.removed_counts(tables, provenance.purged(tables, "src3"))


@query("""WITH pick AS (SELECT q.customer_id, q.source_system FROM queue q LEFT JOIN (SELECT customer_id, count(*) AS busy FROM queue WHERE status = 'processing' GROUP BY 1) b USING (customer_id) WHERE q.status = 'pending' AND coalesce(busy, 0) < (SELECT count(*) / 8 FROM events) ORDER BY priority DESC, created_at, queue_id LIMIT 1)
SELECT queue_id, q.customer_id, q.source_system FROM queue q JOIN pick USING (customer_id, source_system) WHERE status = 'pending' ORDER BY priority DESC, created_at, queue_id LIMIT 50""")
def queue_claim_batch(f: Frames) -> DataFrame:
    return persist.claimed_batch(f.queue, int(f.table("events").count() / 8)).select("queue_id", "customer_id", "source_system")


@query("SELECT customer_id, 'doc:' || (source_event_id % 40) AS anchor_doc_id, min(queue_id) AS queue_id FROM queue WHERE status = 'pending' AND attempts < 5 GROUP BY ALL ORDER BY min(created_at), min(queue_id) LIMIT 30")
def inferred_edge_claim(f: Frames) -> DataFrame:
    none = F.lit(None).cast("timestamp")
    rows = f.queue.select("customer_id", F.concat(F.lit("doc:"), (F.col("source_event_id") % 40).cast("string")).alias("anchor_doc_id"), "queue_id", F.col("created_at").alias("enqueued_at"), "attempts", F.when(F.col("status") == "processing", F.col("created_at")).otherwise(none).alias("started_at"), F.when(F.col("status").isin("done", "dlq"), F.col("created_at")).otherwise(none).alias("done_at"))
    return persist.claimed_anchors(rows, 30).select("customer_id", "anchor_doc_id", "queue_id")


@query("SELECT customer_id, source_system FROM queue WHERE status = 'pending' ORDER BY customer_id, source_system LIMIT 1")
def backfill_claim(f: Frames) -> DataFrame:
    return persist.claimed_backfill(f.queue.select("customer_id", "source_system", "status").distinct())


def _batch(f: Frames) -> dict[str, DataFrame]:
    """All tables after a batch that changes every third document of src1 and brings every fourth one that isn't there."""
    n = F.col("source_id").cast("long")
    live = f.documents.where("valid_to is null and source_system = 'src1'").withColumn("content_hash", F.md5("body"))
    none = F.lit(None).cast("timestamp")
    held = live.where(n % 4 != 0)
    documents = held.select("doc_id", F.lit(1).cast("long").alias("version"), "content_hash", "valid_from", none.alias("valid_to"), none.alias("deleted_at"))
    chunks = held.select("doc_id", "content_hash", F.lit(0).cast("long").alias("chunk_index"), F.lit(1).cast("long").alias("first_seen_version"), F.lit(1).cast("long").alias("last_seen_version"), none.alias("valid_to"))
    fresh = live.withColumn("content_hash", F.when(n % 3 == 0, F.concat(F.lit("new"), "content_hash")).otherwise(F.col("content_hash")))
    nodes = held.select(F.lit("Document").alias("label"), F.col("doc_id").alias("canonical_id"), F.lit('{"a":"1"}').alias("properties"))
    edges = fresh.select(F.lit("AUTHORED").alias("edge_type"), F.coalesce("author_id", F.lit("nobody")).alias("from_id"), F.col("doc_id").alias("to_id"), F.lit("EXTRACTED").alias("confidence"), "valid_from", none.alias("valid_to"), F.lit("src1").alias("source_system"), n.alias("seq"))
    people = fresh.where("author_id is not null").groupBy("author_id").agg(F.min(n).alias("seq")).select(F.lit("Person").alias("label"), F.col("author_id").alias("canonical_id"), F.lit("{}").alias("properties"), "seq")
    batch = {
        "documents": fresh.select("doc_id", n.alias("seq"), "content_hash"),
        "chunks": fresh.select("doc_id", "content_hash", F.lit(0).cast("long").alias("chunk_index")),
        "nodes": fresh.select(F.lit("Document").alias("label"), F.col("doc_id").alias("canonical_id"), F.lit('{"b":"2"}').alias("properties"), n.alias("seq")).unionByName(people),
        "edges": edges,
    }
    empty = edges.limit(0)
    aliases = f.spark.createDataFrame([], "label string, alias string, primary string")
    lanes = {"alias_from": F.lit(""), "alias_to": F.lit("")}
    tables = {"documents": documents, "chunks": chunks, "nodes": nodes, "edges": empty.drop("seq").withColumns(lanes), "pending": empty.withColumns(lanes), "aliases": aliases}
    return persist.persisted(tables, batch, NOW)


@query("""WITH l AS (SELECT doc_id, CAST(source_id AS BIGINT) AS n, coalesce(author_id, 'nobody') AS author, author_id FROM docs WHERE valid_to IS NULL AND source_system = 'src1')
SELECT 'documents' AS name, count(*) + (SELECT count(*) FROM l WHERE n % 4 <> 0 AND n % 3 = 0) AS n FROM l UNION ALL SELECT 'live documents', count(*) FROM l
UNION ALL SELECT 'chunks', count(*) + (SELECT count(*) FROM l WHERE n % 4 <> 0 AND n % 3 = 0) FROM l UNION ALL SELECT 'live chunks', count(*) FROM l
UNION ALL SELECT 'nodes', count(*) + (SELECT count(DISTINCT author_id) FROM l WHERE author_id IS NOT NULL) FROM l UNION ALL SELECT 'edges', count(*) FILTER (author_id IS NOT NULL) FROM l UNION ALL SELECT 'pending', count(*) FILTER (author_id IS NULL) FROM l""")
def persisted_batch(f: Frames) -> DataFrame:
    after = _batch(f)
    live = {f"live {name}": after[name].where("valid_to is null") for name in ("documents", "chunks")}
    counts = [table.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, table in (after | live).items()]
    return reduce(DataFrame.unionByName, counts)


def _versions(f: Frames) -> TableSet:
    """Two versions of the knowledge tables: src1's documents but for every fourth, then a batch of all of them, every third changed; half of a batch's documents coalesce, every fifth one held is complete."""
    n, none = F.col("source_id").cast("long"), F.lit(None).cast("timestamp")
    live = written(f.documents.where("valid_to is null and source_system = 'src1'").select("doc_id", "source_id", "author_id", "valid_from", F.md5("body").alias("content_hash")), "live")
    held, one = live.where(n % 4 != 0), F.lit(1).cast("long")
    tables = TableSet(f.spark, f"{shared_folder(f.spark)}/runs/knowledge-{uuid.uuid4().hex}", incremental.with_buckets(incremental.KNOWLEDGE, 16))
    start = {
        "documents": held.select("doc_id", one.alias("version"), "content_hash", (n % 5 == 0).alias("complete"), "valid_from", none.alias("valid_to"), none.alias("deleted_at")),
        "chunks": held.select("doc_id", "content_hash", F.lit(0).cast("long").alias("chunk_index"), one.alias("first_seen_version"), one.alias("last_seen_version"), none.alias("valid_to")),
        "nodes": held.select(F.lit("Document").alias("label"), F.col("doc_id").alias("canonical_id"), F.lit('{"a":"1"}').alias("properties")),
        "provenance": held.select(F.col("doc_id").alias("canonical_id"), F.lit("src1").alias("source_system"), F.col("valid_from").alias("first_seen"), F.col("valid_from").alias("last_seen")),
        "aliases": f.spark.createDataFrame([("Person", "p7", "p8")], "label string, alias string, primary string"),
    }
    tables.write("start", lambda s: {name: Change(rows, tuple(range(16))) for name, rows in start.items()})
    fresh = live.withColumn("content_hash", F.when(n % 3 == 0, F.concat(F.lit("new"), "content_hash")).otherwise(F.col("content_hash")))
    people = fresh.where("author_id is not null").groupBy("author_id").agg(F.min(n).alias("seq")).select(F.lit("Person").alias("label"), F.col("author_id").alias("canonical_id"), F.lit("{}").alias("properties"), "seq")
    batch = {
        "documents": fresh.select("doc_id", n.alias("seq"), "content_hash", (n % 2 == 0).alias("coalesce"), (n % 7 == 0).alias("complete")),
        "chunks": fresh.select("doc_id", "content_hash", F.lit(0).cast("long").alias("chunk_index")),
        "nodes": fresh.select(F.lit("Document").alias("label"), F.col("doc_id").alias("canonical_id"), F.lit('{"b":"2"}').alias("properties"), n.alias("seq")).unionByName(people).withColumn("source_system", F.lit("src1")),
        "edges": fresh.select(F.lit("AUTHORED").alias("edge_type"), F.coalesce("author_id", F.lit("nobody")).alias("from_id"), F.col("doc_id").alias("to_id"), F.lit("EXTRACTED").alias("confidence"), "valid_from", none.alias("valid_to"), F.lit("src1").alias("source_system"), n.alias("seq")),
    }
    incremental.persist_batch(tables, "batch", batch, NOW)
    return tables


_STATES = """WITH l AS (SELECT doc_id, CAST(source_id AS BIGINT) AS n, CASE author_id WHEN 'p7' THEN 'p8' ELSE author_id END AS author, author_id, md5(body) AS h, valid_from FROM docs WHERE valid_to IS NULL AND source_system = 'src1'),
b AS (SELECT *, n % 4 <> 0 AS held, n % 3 = 0 AS changed, n % 4 <> 0 AND n % 3 = 0 AND n % 2 = 0 AND n % 5 <> 0 AS placed FROM l),
e AS (SELECT * FROM b WHERE author IS NOT NULL)
SELECT 1 AS version, 'documents' AS name, doc_id || '@1' AS id, h || ' live' AS state FROM b WHERE held
UNION ALL SELECT 2, 'documents', doc_id || '@1', CASE WHEN NOT held AND changed OR placed THEN 'new' ELSE '' END || h || CASE WHEN held AND changed AND NOT placed THEN ' closed' ELSE ' live' END FROM b
UNION ALL SELECT 2, 'documents', doc_id || '@2', 'new' || h || ' live' FROM b WHERE held AND changed AND NOT placed
UNION ALL SELECT 1, 'chunks', doc_id || ' ' || h, '1-1 live' FROM b WHERE held
UNION ALL SELECT 2, 'chunks', doc_id || ' ' || h, CASE WHEN changed THEN '1-1 closed' ELSE '1-1 live' END FROM b WHERE held
UNION ALL SELECT 2, 'chunks', doc_id || ' ' || CASE WHEN changed THEN 'new' ELSE '' END || h, CASE WHEN held AND NOT placed THEN '2-2 live' ELSE '1-1 live' END FROM b WHERE changed OR NOT held
UNION ALL SELECT 1, 'nodes', doc_id, '{"a":"1"}' FROM b WHERE held
UNION ALL SELECT 2, 'nodes', doc_id, CASE WHEN held THEN '{"a":"1","b":"2"}' ELSE '{"b":"2"}' END FROM b
UNION ALL SELECT DISTINCT 2, 'nodes', author, '{}' FROM e
UNION ALL SELECT 2, 'edges', author || '>' || doc_id, 'EXTRACTED ' || CASE WHEN author_id <> author THEN author_id ELSE '' END FROM e
UNION ALL SELECT 2, 'pending', 'nobody>' || doc_id, 'EXTRACTED ' FROM b WHERE author IS NULL
UNION ALL SELECT 1, 'provenance', doc_id, strftime(valid_from, '%Y-%m-%d') || ' ' || strftime(valid_from, '%Y-%m-%d') FROM b WHERE held
UNION ALL SELECT 2, 'provenance', doc_id, CASE WHEN held THEN strftime(valid_from, '%Y-%m-%d') ELSE '2025-06-01' END || ' 2025-06-01' FROM b
UNION ALL SELECT DISTINCT 2, 'provenance', author, '2025-06-01 2025-06-01' FROM e
UNION ALL SELECT 2, 'degrees', doc_id, '1' FROM e UNION ALL SELECT 2, 'degrees', author, CAST(count(*) AS VARCHAR) FROM e GROUP BY author
UNION ALL SELECT 2, 'two_way', author || '>' || doc_id, 'EXTRACTED' FROM e UNION ALL SELECT 2, 'two_way', doc_id || '>' || author, 'EXTRACTED' FROM e"""


@query(_STATES)
def persisted_versions(f: Frames) -> DataFrame:
    """Every row of the knowledge tables before and after a batch, by version."""
    tables, live = _versions(f), F.when(F.col("valid_to").isNull(), "live").otherwise("closed")
    lane = F.concat_ws(">", "from_id", "to_id")
    shown = {
        "documents": (F.concat_ws("@", "doc_id", "version"), F.concat_ws(" ", "content_hash", live)),
        "chunks": (F.concat_ws(" ", "doc_id", "content_hash"), F.concat_ws(" ", F.concat_ws("-", "first_seen_version", "last_seen_version"), live)),
        "nodes": (F.col("canonical_id"), F.col("properties")),
        "edges": (lane, F.concat_ws(" ", "confidence", "alias_from")),
        "pending": (lane, F.concat_ws(" ", "confidence", "alias_from")),
        "provenance": (F.col("canonical_id"), F.concat_ws(" ", *(F.date_format(c, "yyyy-MM-dd") for c in ("first_seen", "last_seen")))),
        "degrees": (F.col("canonical_id"), F.col("degree").cast("string")),
        "two_way": (F.concat_ws(">", "a", "b"), F.col("confidence")),
    }
    return reduce(DataFrame.unionByName, [tables.read(name, v).select(F.lit(v).alias("version"), F.lit(name).alias("name"), i.alias("id"), state.alias("state")) for v in (1, 2) for name, (i, state) in shown.items()])


_NEXT = """after AS (SELECT edge_type, from_id, to_id FROM edges WHERE edge_type <> 'CALLS' OR tier = 2)"""


def _edge_deltas(f: Frames) -> TableSet:
    """All edges but TOUCHES, then a write that brings those and takes the calls that aren't sure; degrees and directions follow by deltas."""
    tables = TableSet(f.spark, f"{shared_folder(f.spark)}/runs/edges-{uuid.uuid4().hex}", incremental.with_buckets({k: incremental.KNOWLEDGE[k] for k in ("edges", "degrees", "two_way")}, max(32, f.edges.count() // 500_000)))
    lanes = {c: F.lit("") for c in ("alias_from", "alias_to")}
    rows = f.edges.select("edge_type", "from_id", "to_id", "confidence", "valid_from", F.lit(None).cast("timestamp").alias("valid_to"), F.lit("s").alias("source_system")).withColumns(lanes)

    none = rows.limit(0).select(*incremental.LANES)
    tables.write("first", lambda s: incremental.replaced_edges(s, rows.where("edge_type <> 'TOUCHES'"), none))
    tables.write("second", lambda s: incremental.replaced_edges(s, rows.where("edge_type = 'TOUCHES'"), rows.where("edge_type = 'CALLS' and confidence <> 'EXTRACTED'").select(*incremental.LANES)))
    return tables


@query(f"WITH {_NEXT} SELECT canonical_id, count(*) AS degree FROM (SELECT from_id AS canonical_id FROM after UNION ALL SELECT to_id FROM after WHERE from_id <> to_id) GROUP BY 1")
def degrees_by_deltas(f: Frames) -> DataFrame:
    """Degrees after two writes, each of which counted only what came and went."""
    return _edge_deltas(f).read("degrees")


@query("""WITH c AS (SELECT chunk_id, CASE WHEN chunk_index = 0 THEN content || ' another ending' ELSE content END AS content FROM chunks WHERE valid_to IS NULL AND doc_id NOT LIKE '%7')
SELECT term, count(*) AS df, sum(tf) AS tf FROM (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(list_filter(regexp_extract_all(lower(content), '[a-z0-9_]+'), lambda x: length(x) >= 2)) AS term FROM c) GROUP BY ALL) GROUP BY 1""")
def postings_by_deltas(f: Frames) -> DataFrame:
    """Postings and document frequencies after a write that changed each document's first chunk and removed some documents, from those chunks alone."""
    tables = TableSet(f.spark, f"{shared_folder(f.spark)}/runs/postings-{uuid.uuid4().hex}", incremental.with_buckets(incremental.POSTED, 32))
    live = f.chunks.where("valid_to is null and chunk_id is not null").select("chunk_id", "doc_id", "chunk_index", "content")
    tables.write("first", lambda s: incremental.text_changes(s, live.select("chunk_id", "content")))
    left = F.when(~F.col("doc_id").like("%7"), F.concat("content", F.lit(" another ending")))
    incoming = live.where("chunk_index = 0 OR doc_id LIKE '%7'").select("chunk_id", left.alias("content"))
    tables.write("second", lambda s: incremental.text_changes(s, incoming))
    return tables.read("frequencies").join(tables.read("postings").groupBy("term").agg(F.sum("tf").alias("tf")), "term")


@query("""WITH changed AS (SELECT canonical_id FROM nodes WHERE label = 'Service'), parked AS (SELECT edge_type, from_id, to_id FROM edges WHERE edge_type IN ('ASSIGNED_TO', 'CALLS') AND tier = 1)
SELECT edge_type, count(*) AS n FROM (SELECT DISTINCT edge_type, from_id, to_id FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY edge_type, from_id, to_id) AS place FROM (SELECT *, unnest(CASE WHEN from_id = to_id THEN [from_id] ELSE [from_id, to_id] END) AS e FROM parked) WHERE e IN (SELECT canonical_id FROM changed)) WHERE place <= 20) GROUP BY 1""")
def post_write_drain(f: Frames) -> DataFrame:
    parked = f.edges.where("edge_type in ('ASSIGNED_TO', 'CALLS') and tier = 1").select("edge_type", "from_id", "to_id", F.lit(NOW).cast("timestamp").alias("parked_at"))
    nodes = f.named_nodes.withColumn("embedding", F.lit(None).cast("array<double>"))
    return persist.after_write(nodes.where("label = 'Service'").select("canonical_id"), nodes, parked, most=20)[1].groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id AS request_id, status, summary, octet_length(encode(summary)) < 512 AS whole, '{}' AS metadata FROM (SELECT event_id, status, CASE WHEN event_id % 50 = 0 THEN left(repeat(summary, 100), 512) ELSE summary END AS summary FROM usage)""")
def usage_event_rows(f: Frames) -> DataFrame:
    none = F.lit(None).cast("string")
    long = F.when(F.col("event_id") % 50 == 0, F.repeat("summary", F.lit(100))).otherwise(F.col("summary"))
    calls = f.usage.select(F.lit("acme").alias("customer_id"), "occurred_at", "caller_kind", "event_type", F.col("event_id").alias("request_id"), F.lit("/query").alias("endpoint"), "status", none.alias("error_class"), "latency_ms", F.lit(1).alias("result_count"), long.alias("summary"), none.alias("metadata"), none.alias("counters"))
    return persist.usage_rows(calls).select("request_id", "status", "summary", (F.octet_length("summary") < 512).alias("whole"), "metadata")


@query("SELECT customer_id, source_system, source_event_id, count(*) AS version, string_agg(payload_key, ',' ORDER BY created_at, payload_key) AS payload_keys FROM queue GROUP BY ALL")
def session_coalescing(f: Frames) -> DataFrame:
    events = f.queue.withColumnRenamed("created_at", "received_at")
    return admission.coalesced(events).withColumn("payload_keys", F.concat_ws(",", "payload_keys"))


@query("SELECT customer_id, source_system, source_event_id, min(queue_id) AS queue_id FROM queue GROUP BY ALL")
def idempotent_admission(f: Frames) -> DataFrame:
    """The batch form of admission; on streams `admitted` is the same."""
    return admission.admitted_batch(f.queue.withColumnRenamed("created_at", "received_at")).select("customer_id", "source_system", "source_event_id", "queue_id")


@query("SELECT CASE WHEN queue_id % 6 = 0 THEN CASE WHEN queue_id % 12 = 0 AND attempts + 1 < 5 THEN 'pending' ELSE 'dlq' END ELSE status END AS status, CAST(sum(attempts + CASE WHEN queue_id % 6 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS attempts, count(*) AS n FROM queue GROUP BY 1")
def retries_and_dead_letters(f: Frames) -> DataFrame:
    errors = f.queue.where("queue_id % 6 = 0").select("queue_id", F.expr("queue_id % 12 = 0").alias("transient"))
    after = admission.after_errors(f.queue, errors)
    return after.groupBy("status").agg(F.sum("attempts").alias("attempts"), F.count(F.lit(1)).alias("n"))


@query("SELECT CASE status WHEN 'dlq' THEN 'pending' ELSE status END AS status, CAST(sum(CASE status WHEN 'dlq' THEN 0 ELSE attempts END) AS BIGINT) AS attempts, count(*) AS n FROM queue GROUP BY 1")
def dead_letter_replay(f: Frames) -> DataFrame:
    return admission.replayed(f.queue).groupBy("status").agg(F.sum("attempts").alias("attempts"), F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN queue_id % 5 = 0 THEN CASE WHEN queue_id % 10 = 0 THEN 'done' ELSE 'pending' END ELSE status END AS status, count(*) AS n FROM queue GROUP BY 1")
def compare_and_set_completion(f: Frames) -> DataFrame:
    queue = f.queue.withColumn("version", F.lit(2))
    done = f.queue.where("queue_id % 5 = 0").select("queue_id", F.expr("CASE WHEN queue_id % 10 = 0 THEN 2 ELSE 1 END").alias("version"))
    return admission.completed(queue, done).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_name || '/' || 'my-' || p_partkey || '-repo' AS full_name, 'my-' || p_partkey || '-repo,my_' || p_partkey || '_repo,my' || p_partkey || 'Repo,My' || p_partkey || 'Repo,MY_' || p_partkey || '_REPO,' || p_name || '/my-' || p_partkey || '-repo' AS variants FROM part")
def repository_name_variants(f: Frames) -> DataFrame:
    full = F.concat("p_name", F.lit("/my-"), F.col("p_partkey").cast("string"), F.lit("-repo"))
    return f.table("part").select("p_partkey", full.alias("full_name"), F.concat_ws(",", text.repo_variants(full)).alias("variants"))


@query("SELECT page_id, url AS source_url, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS body FROM pages")
def upload_normalisation(f: Frames) -> DataFrame:
    return connectors.upload_documents(f.table("pages")).select(F.col("source_id").cast("long").alias("page_id"), "source_url", "title", "body")


@query("SELECT conv_id, string_agg(upper(role) || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1")
def session_documents(f: Frames) -> DataFrame:
    return connectors.session_documents(f.sessions).select(F.col("source_id").cast("long").alias("conv_id"), "body")


@query("""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn, role, length(coalesce(text, '')) AS size FROM conversations),
walk AS (SELECT conv_id, n, 0 AS segment, turn AS first_turn, size FROM t WHERE n = 1
  UNION ALL SELECT t.conv_id, t.n, CASE WHEN w.size + t.size > 1500 AND t.role = 'user' OR w.size + t.size > 2250 THEN w.segment + 1 ELSE w.segment END,
    CASE WHEN w.size + t.size > 1500 AND t.role = 'user' OR w.size + t.size > 2250 THEN t.turn ELSE w.first_turn END, CASE WHEN w.size + t.size > 1500 AND t.role = 'user' OR w.size + t.size > 2250 THEN t.size ELSE w.size + t.size END
  FROM walk w JOIN t ON t.conv_id = w.conv_id AND t.n = w.n + 1),
s AS (SELECT conv_id, segment, first_turn, count(*) AS turns FROM walk GROUP BY ALL), k AS (SELECT *, greatest(max(segment) OVER (PARTITION BY conv_id) - 15, 0) AS first FROM s)
SELECT conv_id, segment - first AS segment, first_turn, turns, CAST(coalesce((SELECT sum(s.turns) FROM s WHERE s.conv_id = k.conv_id AND s.segment < k.first), 0) AS BIGINT) AS left_out FROM k WHERE segment >= first""")
def session_segments(f: Frames) -> DataFrame:
    return udfs.segmented(f.sessions, 1500)


@query("""WITH l AS (SELECT doc_id, chunk_index, chunk_id, content, string_split(content, ' ') AS t, lag(string_split(content, ' ')) OVER (PARTITION BY doc_id ORDER BY chunk_index, chunk_id) AS b FROM chunks WHERE valid_to IS NULL),
p AS (SELECT doc_id, chunk_index, chunk_id, CASE WHEN b IS NULL THEN content WHEN len(b) >= 64 AND len(t) >= 64 AND b[-64:] = t[1:64] THEN CASE WHEN len(t) > 64 THEN ' ' || array_to_string(t[65:], ' ') ELSE '' END ELSE chr(10) || chr(10) || content END AS piece FROM l)
SELECT doc_id, sha256(string_agg(piece, '' ORDER BY chunk_index, chunk_id)) AS text, length(string_agg(piece, '' ORDER BY chunk_index, chunk_id)) - length(replace(string_agg(piece, '' ORDER BY chunk_index, chunk_id), chr(10), '')) + 1 AS lines FROM p GROUP BY doc_id""")
def chunk_reconstruction(f: Frames) -> DataFrame:
    return udfs.reconstructed(f.chunks).select("doc_id", F.sha2("text", 256).alias("text"), "lines")


@query("WITH d AS (SELECT doc_id, ' ' || substr(title, 1, 20) || ' ABC-' || (CAST(source_id AS BIGINT) % 9) || ' and DEF-7, ABC-' || (CAST(source_id AS BIGINT) % 4) || ' ' AS t, 'ABC-' || (CAST(source_id AS BIGINT) % 4) AS own FROM docs WHERE version = 1) SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(t, '\\b([A-Z]{2,10}-[0-9]+)\\b', 1)), lambda x: x <> own)), ',') AS refs FROM d")
def issue_references(f: Frames) -> DataFrame:
    n = F.col("source_id").cast("long")
    made = F.concat(F.lit(" "), F.substring("title", 1, 20), F.lit(" ABC-"), (n % 9).cast("string"), F.lit(" and DEF-7, ABC-"), (n % 4).cast("string"), F.lit(" "))
    refs = text.issue_references(made, F.concat(F.lit("ABC-"), (n % 4).cast("string")))
    return f.documents.where("version = 1").select("doc_id", F.concat_ws(",", F.array_sort(refs)).alias("refs"))


@query("SELECT 'x' || p_partkey AS from_name, CASE WHEN p_partkey % 2 = 0 THEN 'mod.f' || p_partkey ELSE 'any.f' || p_partkey END AS to_name, p_partkey % 2 = 1 AS ambiguous FROM part")
def symbol_promotion(f: Frames) -> DataFrame:
    part = f.table("part")
    symbols = part.where("p_partkey % 2 = 0").select(F.expr("concat('mod.f', p_partkey)").alias("qualified_name"))
    edges = part.select(F.expr("concat('x', p_partkey)").alias("from_name"), F.expr("concat('any.f', p_partkey)").alias("to_name"), F.lit(True).alias("ambiguous"))
    return writes.promote_single_matches(edges, symbols)


@query("""WITH m AS (SELECT 'q' || queue_id AS session, queue_id % 6 AS k, payload_key, created_at AS t FROM queue),
w AS (SELECT max(t + CASE k WHEN 0 THEN INTERVAL 0 SECOND WHEN 5 THEN INTERVAL 10 SECOND ELSE INTERVAL 20 SECOND END) - INTERVAL 1 MINUTE AS now FROM m)
SELECT session, CASE k WHEN 0 THEN 'pending' WHEN 1 THEN 'done' WHEN 2 THEN 'pending' WHEN 3 THEN 'dlq' WHEN 4 THEN CASE WHEN t + INTERVAL 50 SECOND <= now THEN 'pending' ELSE 'waiting' END ELSE CASE WHEN t + INTERVAL 310 SECOND <= now THEN 'pending' ELSE 'processing' END END AS status,
CASE k WHEN 2 THEN 2 ELSE 1 END AS version, CASE WHEN k IN (3, 4) THEN 1 ELSE 0 END AS attempts, CASE k WHEN 2 THEN payload_key || ',more' ELSE payload_key END AS payload_keys
FROM m, w WHERE k <> 1 OR t + INTERVAL 20 SECOND + INTERVAL 7 DAY > now""")
def queue_end_states(f: Frames) -> DataFrame:
    """The queue after a stream of messages: left alone, done, done too early, dead, tried again and lost."""
    def told(seconds: int, kind: str, of: str, key: str | None = None, version: int | None = None, transient: bool | None = None) -> DataFrame:
        payload = F.col("payload_key") if key == "own" else F.lit(key).cast("string")
        return f.queue.where(of).select(F.concat(F.lit("q"), "queue_id").alias("session"), F.timestamp_micros(F.unix_micros("created_at") + 1_000_000 * seconds).alias("at"), F.lit(kind).alias("kind"), payload.alias("payload_key"), F.lit(version).cast("long").alias("version"), F.lit(transient).cast("boolean").alias("transient"))

    parts = [told(0, "event", "true", "own"), told(10, "lease", "queue_id % 6 > 0", version=1), told(15, "event", "queue_id % 6 = 2", "more"), told(20, "done", "queue_id % 6 IN (1, 2)", version=1)]
    parts += [told(20, "failed", "queue_id % 6 = 3", transient=False), told(20, "failed", "queue_id % 6 = 4", transient=True)]
    folder = f"{shared_folder(f.spark)}/runs/queue-{uuid.uuid4().hex}"
    reduce(DataFrame.unionByName, parts).write.parquet(f"{folder}/messages")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = f.spark.conf.get(provider)
    f.spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        changed = queue_state.queue_stream(f.spark.readStream.schema(queue_state.MESSAGES).parquet(f"{folder}/messages"))
        admission.write_once(changed, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    finally:
        f.spark.conf.set(provider, before)
    return queue_state.last_rows(f.spark.read.schema(queue_state.ROWS).parquet(f"{folder}/rows/*"))


@query("""WITH t AS (SELECT conv_id, turn, upper(role) || ': ' || coalesce(text, '') || chr(10) AS text FROM conversations)
SELECT conv_id, turn, sha256(text) AS text, CAST(coalesce(sum(length(text)) OVER w, 0) AS BIGINT) AS begin, CAST(1 + coalesce(sum(length(text) - length(replace(text, chr(10), ''))) OVER w, 0) AS BIGINT) AS first_line FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def rendered_sessions(f: Frames) -> DataFrame:
    """Every turn's place in its session's transcript."""
    return udfs.rendered(f.sessions).withColumn("text", F.sha2("text", 256))


@query("""WITH l AS (SELECT chunk_id, content, lag(content) OVER (PARTITION BY doc_id ORDER BY chunk_index, chunk_id) AS before FROM chunks WHERE valid_to IS NULL)
SELECT chunk_id, CASE WHEN before IS NULL THEN 0 ELSE coalesce(list_max(list_filter(range(1, least(length(content), length(before)) + 1), lambda i: right(before, i) = left(content, i))), 0) END::INTEGER AS border FROM l""")
def chunk_borders(f: Frames) -> DataFrame:
    """What each live chunk has in common with the one before it in its document."""
    from pyspark.sql import Window

    before = F.lag("content").over(Window.partitionBy("doc_id").orderBy("chunk_index", "chunk_id"))
    return f.chunks.where("valid_to is null").select("chunk_id", udfs.longest_border(before, F.col("content")).alias("border"))


@query("""SELECT event_id, CAST(json(props) AS VARCHAR) AS props FROM events""")
def repaired_answers(f: Frames) -> DataFrame:
    """Properties whose last brace was cut off, whole again."""
    return f.table("events").select("event_id", udfs.repaired_json(F.expr("substr(props, 1, length(props) - 1)")).alias("props"))
