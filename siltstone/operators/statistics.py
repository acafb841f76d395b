"""Usage and ingestion statistics, clause serving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The windows of usage statistics.
WINDOWS = {"24h": 1, "7d": 7, "30d": 30, "90d": 90, "all": None}


def usage_statistics(usage: DataFrame, window: str, now: str) -> DataFrame:
    """Calls, errors and latency percentiles of good calls: overall, by caller and by event type, in one scan."""
    if window not in WINDOWS:
        raise ValueError(f"unknown window: {window}")
    days = WINDOWS[window]
    if days is not None:
        usage = usage.where(F.col("occurred_at") >= F.expr(f"timestamp'{now}' - INTERVAL {days} DAY"))
    ok = F.when(F.col("status") == "ok", F.col("latency_ms"))
    sets = usage.groupingSets([["caller_kind"], ["event_type"], []], "caller_kind", "event_type")
    out = sets.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") == "error").alias("errors"), F.percentile(ok, F.lit(0.5)).alias("p50"), F.percentile(ok, F.lit(0.95)).alias("p95"))
    level = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "caller_kind").otherwise("event_type")
    return out.select(level.alias("level"), F.coalesce("caller_kind", "event_type", F.lit("*")).alias("name"), "calls", "errors", F.col("p50").cast("long").alias("p50"), F.col("p95").cast("long").alias("p95"))


def usage_feed(usage: DataFrame, words: list[str], kind: str | None, limit: int) -> DataFrame:
    """The newest calls whose summary has all the words."""
    from siltstone.expr.text import tokens

    found = usage.where(F.col("caller_kind") == kind) if kind else usage
    for word in words:
        found = found.where(F.array_contains(tokens(F.col("summary"), 1), word.lower()))
    return found.orderBy(F.desc("occurred_at"), "event_id").limit(limit).select("event_id", "caller_kind", "event_type")


def ingestion_statistics(documents: DataFrame, chunks: DataFrame, queue: DataFrame) -> DataFrame:
    """Documents, last ingestion, chunks and queue depth of each source that has any, zeros filled in.

    Each table is summed by source first; what is joined has a row for each source.
    """
    alive = documents.where("valid_to is null and deleted_at is null")
    docs = alive.groupBy("source_system").agg(F.count(F.lit(1)).alias("documents"), F.max("ingested_at").alias("last_ingested"))
    live = chunks.where("valid_to is null").select("customer_id", "doc_id").join(alive.select("customer_id", "doc_id", "source_system"), ["customer_id", "doc_id"])
    pieces = live.groupBy("source_system").agg(F.count(F.lit(1)).alias("chunks"))
    depth = queue.groupBy("source_system").pivot("status", ["pending", "processing", "dlq"]).count()
    out = docs.join(pieces, "source_system", "full").join(depth, "source_system", "full").na.fill(0)
    return out.orderBy(F.desc("documents"), "source_system")


def queue_depth(queue: DataFrame) -> DataFrame:
    return queue.groupBy("source_system", "status").agg(F.count(F.lit(1)).alias("n"))


def claimable(queue: DataFrame, cap: int, limit: int) -> DataFrame:
    """Pending rows in order of priority, then age, of tenants below their cap of rows in work; a claim takes of a tenant no more than its cap has left."""
    busy = queue.where("status = 'processing'").groupBy("customer_id").agg(F.count(F.lit(1)).alias("busy"))
    free = queue.where("status = 'pending'").join(busy, "customer_id", "left").withColumn("room", F.lit(cap) - F.coalesce("busy", F.lit(0))).where("room > 0")
    place = F.row_number().over(Window.partitionBy("customer_id").orderBy(F.desc("priority"), "created_at", "queue_id"))
    free = free.withColumn("place", place).where(F.col("place") <= F.least("room", F.lit(limit)))  # no tenant sends more than the limit on
    return free.orderBy(F.desc("priority"), "created_at", "queue_id").limit(limit).select("queue_id", "customer_id", "priority")


def idle_sessions(rows: DataFrame, now: str, minutes: int) -> DataFrame:
    """Sessions whose last event is older than some minutes."""
    last = rows.groupBy("user_id").agg(F.max("occurred_at").alias("last"), F.count(F.lit(1)).alias("n"))
    return last.where(F.col("last") < F.expr(f"timestamp'{now}' - INTERVAL {minutes} MINUTE")).select("user_id", "n")


def visible_clauses(clauses: DataFrame, backers: DataFrame, viewer: str) -> DataFrame:
    """Clauses with two distinct untainted human backers, or by the viewer, or published."""
    support = backers.where("not tainted and kind = 'human'").groupBy("clause_id").agg(F.countDistinct("author").alias("backers"))
    joined = clauses.join(support, "clause_id", "left").withColumn("backers", F.coalesce("backers", F.lit(0)))
    return joined.where((F.col("backers") >= 2) | (F.col("author") == viewer) | F.col("published"))


def serve_clauses(visible: DataFrame, limit: int) -> DataFrame:
    """By how specific the scope is (its number of keys), status, the newest, id."""
    keys = F.coalesce(F.size(F.json_object_keys("scope")), F.lit(0))
    status = F.when(F.col("status") == "active", 0).when(F.col("status") == "proposed", 1).otherwise(2)
    return visible.withColumns({"specificity": keys, "status_rank": status}).orderBy(F.desc("specificity"), "status_rank", F.desc("updated_at"), "clause_id").limit(limit)


def document_bytes(chunks: DataFrame) -> DataFrame:
    """Size of each document's live chunks joined by blank lines."""
    size = F.sum(F.octet_length("content")) + F.greatest(F.count(F.lit(1)) - 1, F.lit(0)) * 2
    return chunks.where("valid_to is null").groupBy("doc_id").agg(size.cast("long").alias("bytes"))
