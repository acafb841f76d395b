"""Persisting what was ingested: claims of queue rows, one batch into all tables, and what follows a write."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from siltstone.expr.text import hash_vector, within_bytes
from siltstone.operators import writes

# Rows of a batch, attempts, parked edges that one write drains, and bytes of a usage row's summary.
BATCH_ROWS, MOST_ATTEMPTS, DRAINED, SUMMARY_BYTES = 50, 5, 500, 512


def claimed_batch(queue: DataFrame, inflight: int, most: int = BATCH_ROWS) -> DataFrame:
    """The first `most` pending rows of one (tenant, source): that of the row first in line whose tenant has fewer than `inflight` rows in work."""
    busy = queue.where("status = 'processing'").groupBy("customer_id").agg(F.count(F.lit(1)).alias("busy"))
    order = [F.desc("priority"), F.asc("created_at"), F.asc("queue_id")]
    pending = queue.where("status = 'pending'")
    pick = pending.join(busy, "customer_id", "left").where(F.coalesce("busy", F.lit(0)) < inflight).orderBy(*order).limit(1).select("customer_id", "source_system")
    return pending.join(pick, ["customer_id", "source_system"], "left_semi").orderBy(*order).limit(most)


def claimed_anchors(queue: DataFrame, n: int, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """The n rows of an inferred-edge queue that wait longest, one for each anchor (anchor_doc_id), neither begun nor done nor out of attempts."""
    open_ = queue.where(F.col("started_at").isNull() & F.col("done_at").isNull() & (F.col("attempts") < most_attempts))
    first = open_.groupBy("customer_id", "anchor_doc_id").agg(F.min_by(F.struct("queue_id", "enqueued_at", "attempts"), F.struct("enqueued_at", "queue_id")).alias("q"))
    return first.select("customer_id", "anchor_doc_id", "q.*").orderBy("enqueued_at", "queue_id").limit(n)


def claimed_backfill(states: DataFrame) -> DataFrame:
    """The pending backfill of least tenant and source, or none."""
    return states.where("status = 'pending'").orderBy("customer_id", "source_system").limit(1).select("customer_id", "source_system")


def persisted(tables: dict[str, DataFrame], batch: dict[str, DataFrame], now: str) -> dict[str, DataFrame]:
    """All tables after one batch of one tenant and source: documents and chunks by version, nodes and edges each in one upsert, edges without an end parked.

    tables: documents (doc_id, version, content_hash, valid_from, valid_to, deleted_at), chunks (doc_id,
    content_hash, chunk_index, first_seen_version, last_seen_version, valid_to), nodes (label,
    canonical_id, properties), edges and pending as writes.upsert_edges has them, aliases (label, alias,
    primary). batch: documents (doc_id, seq, content_hash), chunks (doc_id, content_hash, chunk_index),
    nodes (label, canonical_id, properties, seq), edges (upsert_edges' columns). However many results a
    batch has, each table is joined once. Edges of a batch see the nodes of the same batch.
    """
    documents = writes.upsert_documents(tables["documents"], batch["documents"], now)
    versions = documents.where("valid_to is null").join(batch["documents"].select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "version")
    live = tables["chunks"].where("valid_to is null").join(versions.select("doc_id"), "doc_id", "left_semi").select("doc_id", "content_hash", "chunk_index")
    plan = writes.plan_chunks(live, batch["chunks"])
    chunks = writes.apply_chunks(tables["chunks"], plan, versions, now)
    nodes = writes.upsert_nodes(tables["nodes"], batch["nodes"], tables["aliases"])
    edges, parked = writes.upsert_edges(tables["edges"], batch["edges"], tables["aliases"].select("alias", "primary"), nodes.select("canonical_id"))
    return {"documents": documents, "chunks": chunks, "nodes": nodes, "edges": edges, "pending": tables["pending"].unionByName(parked, allowMissingColumns=True)}


def valid_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, failed) of a batch's rows (queue_id, error): a row that failed to normalise leaves the batch with its reason and doesn't stop the others."""
    return results.where("error is null"), results.where("error is not null").select("queue_id", "error")


def committed(tables: dict[str, DataFrame], folder: str, number: int) -> None:
    """Writes all tables of a batch under its number, the marker last: a reader takes the last number that has one, so it sees all of a batch or nothing. A replay writes the same number again."""
    spark = next(iter(tables.values())).sparkSession
    for name, table in sorted(tables.items()):
        table.write.mode("overwrite").parquet(f"{folder}/batch={number}/{name}")
    spark.range(1).select(F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{folder}/committed/{number:012d}")


def last_committed(spark, folder: str, name: str) -> DataFrame:
    """A table as of the last whole batch."""
    number = spark.read.parquet(f"{folder}/committed/*").agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{folder}/batch={number}/{name}")


def after_write(changed: DataFrame, nodes: DataFrame, pending: DataFrame, dimensions: int = 64, most: int = DRAINED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors, edges, pending) after some nodes (canonical_id) changed: vectors of those without one, the parked edges that they were waited for, and those still parked.

    Of each changed node the `most` edges parked first are drained; the others wait for its next turn.
    pending: edge_type, from_id, to_id, parked_at.
    """
    vectors = nodes.join(changed, "canonical_id", "left_semi").where("embedding is null").select("canonical_id", hash_vector(F.concat_ws(" ", "label", "name"), dimensions).alias("embedding"))
    ready, _ = writes.drain_pending(pending, nodes)
    ends = ready.withColumn("canonical_id", F.explode(F.array_distinct(F.array("from_id", "to_id")))).join(changed, "canonical_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("canonical_id").orderBy("parked_at", "edge_type", "from_id", "to_id"))
    lanes = ["edge_type", "from_id", "to_id"]
    drained = ends.withColumn("place", place).where(F.col("place") <= most).select(*lanes).distinct()
    return vectors, pending.join(drained, lanes, "left_semi"), pending.join(drained, lanes, "left_anti")


def usage_rows(calls: DataFrame) -> DataFrame:
    """One usage row for each call, its summary cut to whole characters within SUMMARY_BYTES; missing metadata and counters are empty objects."""
    columns = ["customer_id", "occurred_at", "caller_kind", "event_type", "request_id", "endpoint", "status", "error_class", "latency_ms", "result_count"]
    return calls.select(*columns, within_bytes(F.col("summary"), SUMMARY_BYTES).alias("summary"), *(F.coalesce(c, F.lit("{}")).alias(c) for c in ("metadata", "counters")))


def trace_rows(calls: DataFrame, most: int = 1 << 18) -> DataFrame:
    """(customer_id, request_id, occurred_at, request, response, truncated): payloads cut to `most` bytes, with a mark where one was."""
    cut = [within_bytes(F.col(c), most).alias(c) for c in ("request", "response")]
    long = (F.coalesce(F.octet_length("request"), F.lit(0)) > most) | (F.coalesce(F.octet_length("response"), F.lit(0)) > most)
    return calls.select("customer_id", "request_id", "occurred_at", *cut, long.alias("truncated"))


def append(rows: DataFrame, path: str) -> None:
    """Appends rows by day, for sinks that only grow."""
    rows.withColumn("day", F.to_date("occurred_at")).write.mode("append").partitionBy("day").parquet(path)
