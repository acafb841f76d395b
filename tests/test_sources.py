"""Connectors, uploads, pollers, streaming admission."""

import json

import pytest
from pyspark.sql import functions as F
from siltstone.operators import writes
from siltstone.sources import connectors, readers
from siltstone.streaming import admission


def raw(spark, *payloads):
    return spark.createDataFrame([(json.dumps(p),) for p in payloads], "payload string").withColumn("received_at", F.lit("2025-01-01").cast("timestamp"))


def test_chat_edits_and_deletes(spark):
    event = {"team_id": "T", "event": {"channel": "C", "user": "U", "text": "hello\nthere", "ts": "1700000000.000100"}}
    gone = {"team_id": "T", "event": {"subtype": "message_deleted", "channel": "C", "deleted_ts": "1700000000.000100", "previous_message": {"user": "U", "text": "hello", "ts": "1700000000.000100"}}}
    rows = connectors.chat_documents(raw(spark, event, gone)).orderBy("deleted").collect()
    assert [r["doc_id"] for r in rows] == ["slack:T:C:1700000000.000100"] * 2 and [r["deleted"] for r in rows] == [False, True]
    assert rows[0]["title"] == "hello"
    assert connectors.chat_edges(raw(spark, event)).count() == 3


def test_push_fans_out(spark):
    push = {"repository": {"full_name": "o/r"}, "commits": [{"id": "a", "message": "m\nbody", "timestamp": "2025-01-01T00:00:00Z", "author": {"username": "u"}, "modified": ["f"]}, {"id": "b", "message": "n", "author": {"email": "e"}}]}
    assert {r["source_id"]: r["author_id"] for r in connectors.code_documents(raw(spark, push)).collect()} == {"a": "u", "b": "e"}
    assert connectors.code_edges(raw(spark, push)).groupBy("edge_type").count().collect()
    lines = spark.createDataFrame([("r", "*.py @a @b # c"), ("r", "# only a comment"), ("r", "")], "repo string, line string")
    assert connectors.owners(lines).count() == 2


def test_tickets_mention_others(spark):
    issue = {"action": "create", "type": "Issue", "data": {"id": "1", "identifier": "AB-1", "title": "like AB-2", "description": "AB-1 AB-2 CD-3", "creator": {"id": "p"}, "assignee": {"id": "q"}}}
    edges = connectors.ticket_edges(raw(spark, issue)).collect()
    assert sorted((e["edge_type"], e["to_id"]) for e in edges) == [("ASSIGNED_TO", "q"), ("AUTHORED", "linear:AB-1"), ("MENTIONS", "linear:AB-2"), ("MENTIONS", "linear:CD-3")]


def test_other_connectors(spark):
    error = {"data": {"issue": {"id": "9", "title": "T", "project": {"slug": "p"}, "assignedTo": {"id": "u"}}}}
    assert connectors.error_documents(raw(spark, error)).first()["doc_id"] == "sentry:issue:9"
    assert connectors.error_edges(raw(spark, error)).count() == 2
    incident = {"event": {"event_type": "incident.triggered", "data": {"id": "I", "title": "t", "service": {"id": "S"}}}}
    assert connectors.incident_edges(raw(spark, incident)).first()["edge_type"] == "FIRES_IN"
    page = {"entity": {"id": "P", "type": "page"}, "data": {"last_edited_by": {"id": "u"}}, "blocks": [{"plain_text": "one"}, {"x": {"plain_text": "two"}}]}
    assert connectors.page_documents(raw(spark, page)).first()["body"] == "one\ntwo"
    declared = {"source_key": "k", "documents": [{"id": "d", "title": "t", "author": "a", "entities": [{"label": "Service", "id": "s"}], "edges": [{"type": "FIXES", "to_label": "Document", "to_id": "x"}]}]}
    assert sorted(r["edge_type"] for r in connectors.declared_edges(raw(spark, declared)).collect()) == ["AUTHORED", "FIXES", "TOUCHES"]
    bad = spark.createDataFrame([("{",), ("{}",), (json.dumps(declared),)], "payload string")
    assert sorted(r["reason"] for r in connectors.rejected(bad).collect()) == ["no documents", "not JSON"]
    assert connectors.meeting_documents(raw(spark, {"id": "m", "owner": {"email": "e"}})).first()["author_id"] == "e"
    with pytest.raises(ValueError, match="another profile"):
        connectors.register(connectors.Profile("slack", "other."), None, None)


def test_uploads():
    assert readers.parse_upload("a.txt", b"x  \r\n\r\n\r\n\r\ny") == ("x\n\ny", None)
    assert readers.parse_upload("a.bin", b"\0\1")[1] == "binary"


def test_poller_batch_and_stream(spark, tmp_path):
    spark.dataSource.register(readers.PollerSource)
    assert spark.read.format("poller").option("poller", "counting").load().count() == 10


def test_poller_stream_goes_on_where_it_stopped(spark, tmp_path):
    spark.dataSource.register(readers.PollerSource)

    def run():
        stream = spark.readStream.format("poller").option("poller", "counting").load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["payload"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    whole = sorted(f'{{"n": {i}}}' for i in range(10))
    assert run() == whole and run() == whole
    pulling = readers._Stream("counting")
    assert [(s.begin, s.end) for s in pulling.partitions({"cursor": 3}, {"cursor": 10})] == [(3, 7), (7, 10)]
    assert [r for s in pulling.partitions({"cursor": 3}, {"cursor": 10}) for (r,) in pulling.read(s)] == [f'{{"n": {i}}}' for i in range(3, 10)]


def test_a_round_of_polling_survives_a_failure(spark):
    cursors = spark.createDataFrame([("r1", "counting", 2, "2025-01-01 00:00:00"), ("r2", "missing", 5, "2025-01-01 00:00:00"), ("r3", "counting", 0, "2025-01-02 00:00:00")], "resource_id string, poller string, cursor long, t string").withColumn("polled_at", F.col("t").cast("timestamp"))
    got = {r["resource_id"]: (r["payloads"], r["cursor"], r["error"]) for r in readers.polled(cursors, "2025-01-02 00:00:30", 60, 10).collect()}
    assert got == {"r1": ([f'{{"n": {i}}}' for i in range(2, 6)], 6, None), "r2": ([], 5, "KeyError: 'missing'")}


def test_page_bodies_are_unescaped(spark):
    payload = '{"entity": {"id": "p1", "type": "page"}, "blocks": [{"plain_text": "caf\\u00e9 \\"x\\""}, {"children": [{"plain_text": "line\\nbreak"}]}]}'
    row = connectors.page_documents(spark.createDataFrame([(payload,)], "payload string")).first()
    assert row["body"] == 'café "x"\nline\nbreak'


def test_raw_archive_prunes(spark, tmp_path):
    rows = spark.createDataFrame([("a", "s1", "{}"), ("a", "s2", "{}")], "customer_id string, source_system string, payload string").withColumn("received_at", F.current_timestamp())
    readers.write_raw(rows, str(tmp_path / "raw"))
    assert readers.read_raw(spark, str(tmp_path / "raw"), "s1").count() == 1


def test_stream_admits_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "s", i % 3, f"k{i}") for i in range(9)], "customer_id string, source_system string, source_event_id long, payload_key string").withColumn("received_at", F.lit("2025-01-01").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    admission.write_once(admission.admitted(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_merge_then_unmerge(spark):
    nodes = spark.createDataFrame([("S", x, x) for x in "pabz"], "label string, canonical_id string, name string")
    edges = spark.createDataFrame([("T", "z", "a", "INFERRED"), ("T", "z", "b", "INFERRED"), ("T", "a", "p", "INFERRED")], "edge_type string, from_id string, to_id string, confidence string")
    merged = writes.merge_cluster(nodes, edges, "S", "p", ["a"])
    assert sorted((r["from_id"], r["to_id"]) for r in merged["edges"].collect()) == [("z", "b"), ("z", "p")]
    assert [r["fate"] for r in merged["snapshots"].collect()] == ["self_loop"]
    back = writes.unmerge_alias(merged, "a")
    assert sorted((r["from_id"], r["to_id"]) for r in back["edges"].collect()) == [("a", "a"), ("z", "a"), ("z", "b")]
    assert back["nodes"].count() == 4


def test_conflicts(spark):
    row = spark.createDataFrame([("a@x", "b@x", None)], "l string, r string, n string")
    assert row.select(writes.conflicting({"email": F.col("l")}, {"email": F.col("r")}).alias("v")).first()["v"]
    assert not row.select(writes.conflicting({"email": F.col("l")}, {"email": F.col("n")}).alias("v")).first()["v"]
