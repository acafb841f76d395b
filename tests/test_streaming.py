"""Stateful streams, run to their end on files."""

import pytest
from pyspark.sql import functions as F
from siltstone.streaming import admission


def events(spark, rows):
    df = spark.createDataFrame(rows, "customer_id string, source_system string, source_event_id long, payload_key string, at string")
    return df.select("customer_id", "source_system", "source_event_id", "payload_key", F.col("at").cast("timestamp").alias("received_at"))


def stream(spark, df, path):
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, old)


def test_sessions_coalesce(spark, tmp_path, rocks):
    rows = [("a", "s", 1, "k2", "2025-01-01 00:00:02"), ("a", "s", 1, "k2", "2025-01-01 00:00:09"), ("a", "s", 1, "k1", "2025-01-01 00:00:01"), ("a", "s", 2, "k3", "2025-01-01 00:00:03")]
    out = admission.coalesced_stream(stream(spark, events(spark, rows), str(tmp_path / "in")))
    query = out.writeStream.format("memory").queryName("coalesced").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r["session"]: (r["payload_keys"], r["version"]) for r in spark.table("coalesced").collect()} == {"a|s|1": ("k1,k2", 2), "a|s|2": ("k3", 1)}


def test_idle_sessions_close(spark, tmp_path):
    rows = [("a", "s", 1, "k", "2025-01-01 00:00:00"), ("a", "s", 1, "k", "2025-01-01 00:05:00"), ("a", "s", 2, "k", "2025-01-01 09:00:00")]
    out = admission.idle(stream(spark, events(spark, rows), str(tmp_path / "in")), 30)
    admission.write_once(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["source_event_id"], r["events"]) for r in found] == [(1, 2)]


def test_late_edges_meet_their_nodes(spark, tmp_path):
    edges = spark.createDataFrame([("x", "n1", "2025-01-01 00:00:00"), ("y", "n2", "2025-01-01 00:00:00")], "from_id string, to_id string, t string").select("from_id", "to_id", F.col("t").cast("timestamp").alias("seen_at"))
    nodes = spark.createDataFrame([("n1", "2025-01-01 00:20:00"), ("n2", "2025-01-20 05:00:00")], "canonical_id string, t string").select("canonical_id", F.col("t").cast("timestamp").alias("seen_at"))
    out = admission.late_edges(stream(spark, edges, str(tmp_path / "e")), stream(spark, nodes, str(tmp_path / "n")))
    admission.write_once(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [r["from_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["x"]


def test_queue_states(spark):
    queue = spark.createDataFrame([(1, "processing", "2025-01-01 00:00:00", ["a", "b", "c"], ["b"])], "queue_id long, status string, h string, payload_keys array<string>, consumed array<string>").withColumn("heartbeat_at", F.col("h").cast("timestamp"))
    assert admission.reclaimed(queue, "2025-01-01 00:04:00").first()["status"] == "processing"
    assert admission.reclaimed(queue, "2025-01-01 00:06:00").first()["status"] == "pending"
    assert admission.unconsumed(queue).first()["payload_keys"] == ["a", "c"]


T = 1_735_689_600  # 2025-01-01


def message(session, second, kind, key=None, version=None, transient=None):
    return session, T + second, kind, key, version, transient


#: A session of each state, and what all of its messages come to; timers fire up to the last message's time less a minute.
HISTORIES = {
    "pending": ([(0, "event", "k1")], ("pending", 1, 0, "k1")),
    "replayed": ([(0, "event", "k1"), (1, "event", "k1"), (2, "event", "k2")], ("pending", 2, 0, "k1,k2")),
    "in work": ([(0, "event", "k1"), (9_990, "lease", None, 1)], ("processing", 1, 0, "k1")),
    "alive": ([(0, "event", "k1"), (9_700, "lease", None, 1), (9_900, "beat")], ("processing", 1, 0, "k1")),
    "lost": ([(0, "event", "k1"), (10, "lease", None, 1), (200, "beat")], ("pending", 1, 0, "k1")),
    "too late": ([(0, "event", "k1"), (10, "lease", None, 1), (400, "done", None, 1)], ("pending", 1, 0, "k1")),
    "done": ([(0, "event", "k1"), (10, "lease", None, 1), (20, "done", None, 1)], ("done", 1, 0, "k1")),
    "again": ([(0, "event", "k1"), (10, "lease", None, 1), (15, "event", "k2"), (20, "done", None, 1)], ("pending", 2, 0, "k1,k2")),
    "reopened": ([(0, "event", "k1"), (10, "lease", None, 1), (20, "done", None, 1), (30, "event", "k2")], ("pending", 2, 0, "k1,k2")),
    "stolen": ([(0, "event", "k1"), (1, "event", "k2"), (10, "lease", None, 1)], ("pending", 2, 0, "k1,k2")),
    "retried": ([(0, "event", "k1"), (10, "lease", None, 1), (20, "failed", None, None, True)], ("pending", 1, 1, "k1")),
    "waiting": ([(0, "event", "k1"), (9_960, "lease", None, 1), (9_980, "failed", None, None, True)], ("waiting", 1, 1, "k1")),
    "dead": ([(0, "event", "k1"), (10, "lease", None, 1), (20, "failed", None, None, False)], ("dlq", 1, 1, "k1")),
    "worn out": ([(0, "event", "k1")] + [m for i in range(5) for m in ((1000 * i + 10, "lease", None, 1), (1000 * i + 20, "failed", None, None, True))], ("dlq", 1, 5, "k1")),
    "brought back": ([(0, "event", "k1"), (10, "lease", None, 1), (20, "failed", None, None, False), (30, "replay")], ("pending", 1, 0, "k1")),
    "clock": ([(10_000, "event", "k")], ("pending", 1, 0, "k")),
}


@pytest.mark.parametrize("cuts", [[], [1, 12, 25, 500, 5000]])
def test_queue_rows_over_restarts(spark, tmp_path, rocks, cuts):
    """All messages in one batch, or a batch for each stretch of time with the stream ended and begun again between them: the same end."""
    from siltstone.streaming import queue_state

    rows = [message(session, *m) for session, (history, _) in HISTORIES.items() for m in history]
    df = spark.createDataFrame(rows, "session string, s long, kind string, payload_key string, version long, transient boolean").select("session", F.timestamp_seconds("s").alias("at"), "kind", "payload_key", "version", "transient")
    bounds = [-1, *cuts, 100_000]
    for i, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        df.where(f"unix_seconds(at) - {T} > {low} AND unix_seconds(at) - {T} <= {high}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p={i}"))
        source = spark.readStream.schema(queue_state.MESSAGES).parquet(str(tmp_path / "in" / "*"))
        admission.write_once(queue_state.queue_stream(source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(240)
    found = {r["session"]: tuple(r)[1:] for r in queue_state.last_rows(spark.read.schema(queue_state.ROWS).parquet(str(tmp_path / "out" / "*"))).collect()}
    assert found == {session: end for session, (_, end) in HISTORIES.items()}


def test_a_done_row_is_forgotten_in_time():
    from siltstone.streaming.queue_state import REMEMBERED, QueueRow

    row = QueueRow()
    for m in ((0, "event", "k1", None, None), (1, "lease", None, 1, None), (2, "done", None, 1, None)):
        row.apply(*m)
    row.expire(3)
    assert row.status == "done"
    row.apply(3 + 1000 * REMEMBERED, "event", "k2", None, None)
    assert (row.status, row.version, row.keys) == ("pending", 1, ["k2"])
