"""A file-backed source that fails and limits, polled over restarts: nothing is lost and nothing comes twice."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F
from siltstone.sources import polling
from siltstone.sources.polling import Page, Puller, RateLimited, add_resources, backfill, poll_round, polling_tables


def files_puller(folder):
    """Made here, so that tasks get the class itself: they can't import the tests."""

    class Files(Puller):
        """A resource is a file of lines. Its cursors are hashes that only it can read; some pages fail or are limited the first time."""

        def __init__(self, folder):
            self.folder = folder

        def cursor(self, resource, n):
            return None if n == 0 else hashlib.md5(f"{resource} {n}".encode()).hexdigest()

        def pull(self, resource, cursor, most):
            lines = open(f"{self.folder}/{resource}").read().splitlines()
            at = next(n for n in range(len(lines) + 1) if self.cursor(resource, n) == cursor)
            mark = f"{self.folder}/.{resource}-{at}"
            if (at // 100 + len(resource)) % 3 and not os.path.exists(mark):
                open(mark, "w").close()
                if at % 200:
                    raise RateLimited(60)
                raise OSError("no answer")
            end = min(at + most, len(lines))
            return Page(lines[at:end], self.cursor(resource, end), end < len(lines))

    return Files(folder)


@pytest.fixture
def source(tmp_path, monkeypatch):
    os.makedirs(tmp_path / "files")
    sizes = {"a": 250, "bb": 0, "ccc": 100, "dddd": 431, "e": 1}
    for name, n in sizes.items():
        (tmp_path / "files" / name).write_text("".join(f"{name} {i}\n" for i in range(n)))
    monkeypatch.setitem(polling.PULLERS, "files", files_puller(str(tmp_path / "files")))
    return sizes


def test_a_backfill_over_restarts(spark, source, tmp_path):
    path, minute = str(tmp_path / "state"), iter(range(1000))

    def clock():
        return f"2025-01-01 {(m := next(minute)) // 60:02}:{m % 60:02}:00"

    resources = spark.createDataFrame([(r, "files") for r in source], "resource_id string, puller string")
    add_resources(polling_tables(spark, path), "start", resources)
    assert not backfill(polling_tables(spark, path), "fill", clock, 3, 2)
    assert not backfill(polling_tables(spark, path), "fill", clock, 3, 3)  # stopped and begun again
    add_resources(polling_tables(spark, path), "again", resources)
    tables = polling_tables(spark, path)
    assert backfill(tables, "fill", clock, 5, 25)
    got = sorted(r["payload"] for r in tables.read("payloads").collect())
    assert got == sorted(f"{r} {i}" for r, n in source.items() for i in range(n))
    assert tables.read("cursors").where("error is not null or failures > 0 or not ended").count() == 0
    assert max(r["n"] for r in tables.read("payloads").groupBy("resource_id", "round").agg(F.count("*").alias("n")).collect()) <= polling.PAGE
    assert backfill(tables, "fill", clock, 5, 1)  # there is nothing left


def test_a_round_counts_once_and_waits(spark, source, tmp_path):
    tables = polling_tables(spark, str(tmp_path / "state"))
    add_resources(tables, "start", spark.createDataFrame([("a", "files"), ("zz", "files"), ("q", "unknown")], "resource_id string, puller string"))
    version = poll_round(tables, "r1", "2025-01-01 00:00:00", 10)
    assert poll_round(tables, "r1", "2025-01-01 00:00:00", 10) == version
    state = {r["resource_id"]: r for r in tables.read("cursors").collect()}
    assert state["zz"]["failures"] == 1 and "FileNotFoundError" in state["zz"]["error"] and "KeyError" in state["q"]["error"]
    assert state["zz"]["due_at"].second == 30 and state["zz"]["cursor"] is None
    poll_round(tables, "r2", "2025-01-01 00:00:10", 10)  # none of the failed ones is due
    assert {r["resource_id"]: r["rounds"] for r in tables.read("cursors").collect()}["zz"] == 1
    poll_round(tables, "r3", "2025-01-01 00:01:00", 10)
    again = {r["resource_id"]: r for r in tables.read("cursors").collect()}
    assert again["zz"]["failures"] == 2 and (again["zz"]["due_at"] - state["zz"]["due_at"]).seconds == 90
