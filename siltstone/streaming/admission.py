"""Streaming admission: idempotent events, coalesced sessions, late edges, idle sessions, retries.

State is keyed and bounded by watermarks or time to live; sinks write by batch id, so a replayed batch
changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Attempts before a row is set aside, seconds after which work counts as lost.
MOST_ATTEMPTS, STALE_SECONDS = 5, 300
#: How long a session without events is remembered.
SESSION_MILLISECONDS = 7 * 24 * 3600 * 1000


def admitted(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The first of each (tenant, source, event); replays within the watermark are dropped."""
    return events.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["customer_id", "source_system", "source_event_id"])


def admitted_batch(events: DataFrame) -> DataFrame:
    """The first of each (tenant, source, event) of a table, by queue_id: what `admitted` lets through of a stream in that order."""
    first = events.groupBy("customer_id", "source_system", "source_event_id").agg(F.min_by(F.struct(*events.columns), "queue_id").alias("row"))
    return first.select("row.*")


def coalesced(events: DataFrame) -> DataFrame:
    """Batch form of session coalescing: keys in arrival order, and a version for each event."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("received_at", "payload_key"))), lambda x: x["payload_key"])
    return events.groupBy("customer_id", "source_system", "source_event_id").agg(ordered.alias("payload_keys"), F.count(F.lit(1)).alias("version"))


class SessionCoalescer(StatefulProcessor):
    """Appends an event's keys to its session and raises the version; emits the session after each batch.

    A consumer that took version v completes only if the state is still at v: a higher version means
    that events came meanwhile and the session is to be processed again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", "version long, keys array<string>", SESSION_MILLISECONDS)  # keys and version expire together

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        version, keys = self.session.get() if self.session.exists() else (0, [])
        keys = dict.fromkeys(keys)
        for payload_key in pd.concat(list(rows)).sort_values("received_at", kind="stable")["payload_key"]:
            if payload_key not in keys:  # a replayed event is there already
                keys[payload_key] = None
                version += 1
        self.session.update((version, list(keys)))
        yield pd.DataFrame({"session": [key[0]], "payload_keys": [",".join(keys)], "version": [version]})

    def close(self) -> None:
        pass


def coalesced_stream(events: DataFrame) -> DataFrame:
    keyed = events.select(F.concat_ws("|", "customer_id", "source_system", "source_event_id").alias("session"), "received_at", "payload_key")
    return keyed.groupBy("session").transformWithStateInPandas(SessionCoalescer(), outputStructType="session string, payload_keys string, version long", outputMode="Update", timeMode="ProcessingTime")


def idle(events: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """Sessions as they close after some minutes without an event, by event time."""
    gap = F.session_window("received_at", f"{minutes} minutes")
    closed = events.withWatermark("received_at", late).groupBy(gap.alias("w"), "customer_id", "source_event_id").agg(F.count(F.lit(1)).alias("events"))
    return closed.select("customer_id", "source_event_id", F.col("w.start").alias("begun"), F.col("w.end").alias("ended"), "events")


def late_edges(edges: DataFrame, nodes: DataFrame, wait: str = "14 days") -> DataFrame:
    """Edges as soon as the node at their far end arrives, either first; what waits longer than a parked edge lives is dropped. Both sides have a time."""
    e = edges.withWatermark("seen_at", wait)
    n = nodes.select(F.col("canonical_id").alias("to_id"), F.col("seen_at").alias("node_seen_at")).withWatermark("node_seen_at", wait)
    near = F.expr(f"node_seen_at BETWEEN seen_at - INTERVAL {wait} AND seen_at + INTERVAL {wait}")
    return e.join(n, "to_id").where(near)


def completed(queue: DataFrame, done: DataFrame) -> DataFrame:
    """Marks rows done whose version is still the one that was taken; the others stay pending for another round."""
    taken = done.select("queue_id", F.col("version").alias("taken"))
    joined = queue.join(taken, "queue_id", "left")
    status = F.when(F.col("taken") == F.col("version"), "done").when(F.col("taken").isNotNull(), "pending").otherwise(F.col("status"))
    return joined.withColumn("status", status).drop("taken")


def after_errors(queue: DataFrame, errors: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """Failed rows: a passing error is tried again until its attempts are used up; any other goes to the dead-letter state."""
    joined = queue.join(errors.select("queue_id", "transient"), "queue_id", "left")
    failed = F.col("transient").isNotNull()
    attempts = F.col("attempts") + F.when(failed, 1).otherwise(0)
    status = F.when(failed & F.col("transient") & (attempts < most), "pending").when(failed, "dlq").otherwise(F.col("status"))
    return joined.withColumns({"status": status, "attempts": attempts}).drop("transient")


def reclaimed(queue: DataFrame, now: str, seconds: int = STALE_SECONDS) -> DataFrame:
    """Rows in work without a heartbeat for some time become pending."""
    stale = (F.col("status") == "processing") & (F.col("heartbeat_at") < F.expr(f"timestamp'{now}' - INTERVAL {seconds} SECOND"))
    return queue.withColumn("status", F.when(stale, "pending").otherwise(F.col("status")))


def replayed(queue: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Dead-letter rows (or the chosen ones) become pending with no attempts used."""
    mine = F.col("status") == "dlq"
    if chosen is not None:
        queue = queue.join(chosen.select("queue_id").withColumn("chosen", F.lit(True)), "queue_id", "left")
        mine = mine & F.coalesce("chosen", F.lit(False))
    out = queue.withColumns({"attempts": F.when(mine, 0).otherwise(F.col("attempts")), "status": F.when(mine, "pending").otherwise(F.col("status"))})
    return out.drop("chosen")


def unconsumed(queue: DataFrame) -> DataFrame:
    """payload_keys without those already consumed, in order."""
    return queue.withColumn("payload_keys", F.array_except("payload_keys", "consumed"))


def write_once(df: DataFrame, path: str, checkpoint: str):
    """A streaming sink whose batches overwrite their own folder, so a replay leaves the same rows."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
