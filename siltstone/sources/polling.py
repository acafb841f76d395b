"""Polling of resources whose cursors only the source understands, with state that survives failures.

A round pulls a page of each due resource, each in a task of its own, and writes the payloads and where
each resource goes on as one version of a set of tables. So a round that fails halfway, or is run again
under its name, loses nothing and doubles nothing. A resource that is limited by its source waits as long
as that asks; one that fails keeps its cursor and its error, and waits longer each time. A backfill is
rounds until every resource has come to its end; begun again, it goes on from the cursors it had.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from siltstone.store import written
from siltstone.tables import Change, Snapshot, Spec, TableSet

#: Payloads of a page; seconds to wait after a first failure, doubled for each further one, and at most.
PAGE, FIRST_WAIT, MOST_WAIT = 100, 30, 3600
TABLES = {
    "cursors": Spec("resource_id string, puller string, cursor string, ended boolean, failures int, error string, due_at timestamp, rounds long", ("resource_id",), 16),
    "payloads": Spec("resource_id string, round string, place int, payload string", ("resource_id",), 16),
}


@dataclass(frozen=True)
class Page:
    """payloads, the cursor that goes on behind them, and whether there is more now."""

    payloads: list[str]
    cursor: str | None
    more: bool


class RateLimited(Exception):
    """The source asks to wait for some seconds."""

    def __init__(self, seconds: int) -> None:
        super().__init__(f"limited for {seconds} seconds")
        self.seconds = seconds


class Puller:
    """Pulls pages of a source's resources. The same cursor gives the same page again."""

    def pull(self, resource: str, cursor: str | None, most: int) -> Page:
        raise NotImplementedError


PULLERS: dict[str, Puller] = {}


def register_puller(name: str, puller: Puller) -> None:
    PULLERS[name] = puller


def polling_tables(spark: SparkSession, path: str) -> TableSet:
    return TableSet(spark, path, TABLES)


def add_resources(tables: TableSet, name: str, resources: DataFrame) -> int:
    """Begins with some resources (resource_id, puller); those that are known keep their state."""
    none = F.lit(None)

    def step(s: Snapshot) -> dict[str, Change]:
        def rows(old: DataFrame) -> DataFrame:
            fresh = resources.select("resource_id", "puller").distinct().join(old.select("resource_id"), "resource_id", "left_anti")
            return old.unionByName(fresh.select("resource_id", "puller", none.cast("string").alias("cursor"), F.lit(False).alias("ended"), F.lit(0).alias("failures"), none.cast("string").alias("error"), none.cast("timestamp").alias("due_at"), F.lit(0).cast("long").alias("rounds")))

        return {"cursors": s.upsert("cursors", resources, rows)}

    return tables.write(name, step)


def poll_round(tables: TableSet, name: str, now: str, limit: int, seconds: int = 0, ended_too: bool = True) -> int:
    """One round of the `limit` resources that are due longest. Resources at their end are due again after `seconds`, unless they are left out."""
    pullers, t = dict(PULLERS), F.lit(now).cast("timestamp")

    def pulled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for resource, puller, cursor, failures in zip(batch["resource_id"], batch["puller"], batch["cursor"], batch["failures"], strict=True):
                try:
                    page = pullers[puller].pull(resource, cursor, PAGE)
                    rows.append((resource, page.payloads, page.cursor, not page.more, 0, None, seconds if not page.more else 0))
                except RateLimited as error:
                    rows.append((resource, [], cursor, False, int(failures), str(error), error.seconds))
                except Exception as error:  # one resource's trouble isn't another's
                    rows.append((resource, [], cursor, False, int(failures) + 1, f"{type(error).__name__}: {error}", min(MOST_WAIT, FIRST_WAIT * 2 ** int(failures))))
            yield pd.DataFrame(rows, columns=["resource_id", "payloads", "cursor", "ended", "failures", "error", "wait"])

    def step(s: Snapshot) -> dict[str, Change]:
        due = s.read("cursors").where(F.col("due_at").isNull() | (F.col("due_at") <= t))
        due = due if ended_too else due.where("not ended")
        first = due.orderBy(F.asc_nulls_first("due_at"), "rounds", "resource_id").limit(limit)
        number = F.row_number().over(Window.orderBy("resource_id")) - 1  # of `limit` rows at most
        dealt = first.withColumn("task", number).repartitionById(limit, "task").select("resource_id", "puller", "cursor", "failures")
        got = written(dealt.mapInPandas(pulled, "resource_id string, payloads array<string>, cursor string, ended boolean, failures int, error string, wait long"), "pulled")
        payloads = got.select("resource_id", F.lit(name).alias("round"), F.posexplode("payloads").alias("place", "payload"))
        fresh = got.withColumn("new_due", F.timestamp_micros(F.unix_micros(t) + F.col("wait") * 1_000_000)).select("resource_id", *(F.col(c).alias(f"new_{c}") for c in ("cursor", "ended", "failures", "error")), "new_due", F.lit(True).alias("polled"))

        def moved(old: DataFrame) -> DataFrame:
            joined = old.join(fresh, "resource_id", "left")
            new = {c: F.when(F.col("polled"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in ("cursor", "ended", "failures", "error")}
            return joined.select("resource_id", "puller", *(v.alias(c) for c, v in new.items()), F.when(F.col("polled"), F.col("new_due")).otherwise(F.col("due_at")).alias("due_at"), (F.col("rounds") + F.coalesce("polled", F.lit(False)).cast("long")).alias("rounds"))

        return {"cursors": s.upsert("cursors", got, moved), "payloads": s.append("payloads", payloads)}

    return tables.write(name, step)


def backfill(tables: TableSet, name: str, clock, limit: int, most_rounds: int) -> bool:
    """Rounds until every resource is at its end; whether they are. clock() gives each round's time. What is limited or failing isn't due before its time, so a backfill that is out of rounds, or was stopped, is called again later and goes on."""
    for _ in range(most_rounds):
        left = tables.read("cursors").where("not ended")
        if not left.limit(1).count():
            return True
        poll_round(tables, f"{name}-{tables.manifest()['version']}", clock(), limit, ended_too=False)
    return not tables.read("cursors").where("not ended").limit(1).count()
