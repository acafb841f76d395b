"""Versioned tables in hash buckets, of which a write rewrites only those that it touches.

A set of tables has one list of versions. A version is a manifest: for each table and bucket the folders
that hold its rows. A write puts new folders for its buckets beside the old ones and then the next
manifest, by a rename that fails if another writer was first; so readers see all tables as of one version,
or as of an older one that they pin, and never a part of a write. A write that is repeated under its
name (a replayed batch) finds that name in a manifest and does nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Times that a write is tried anew after another writer was first.
TRIES = 10


@dataclass(frozen=True)
class Spec:
    """A table's columns (DDL), the key columns whose hash is the bucket, and how many buckets it has. A bucket should fit a task."""

    ddl: str
    keys: tuple[str, ...]
    buckets: int = 64


def bucket_of(spec: Spec) -> Column:
    return F.pmod(F.xxhash64(*spec.keys), F.lit(spec.buckets)).cast("int")


@dataclass(frozen=True)
class Change:
    """A table's new rows of the buckets that some keys are in: rows is whole for those buckets, or, with append, comes beside what is there. segments: rows stay in the tasks that made them, a sorted file for each task and bucket."""

    rows: DataFrame
    buckets: tuple[int, ...]
    append: bool = False
    segments: bool = False


class TableSet:
    def __init__(self, spark: SparkSession, path: str, specs: dict[str, Spec]) -> None:
        self.spark, self.path, self.specs = spark, path.rstrip("/"), specs
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # --- manifests

    def _at(self, path: str):
        target = self._hadoop.Path(path)
        return target.getFileSystem(self._conf), target

    def versions(self) -> list[int]:
        files, target = self._at(f"{self.path}/manifests")
        if not files.exists(target):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in files.listStatus(target) if s.getPath().getName().endswith(".json") and s.getPath().getName()[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The version's folders by table and bucket, and the name of the write that made it; without a version the last, before any write nothing."""
        known = self.versions()
        if not known and version is None:
            return {"version": 0, "write": None, "writes": [], "parts": {name: {} for name in self.specs}}
        number = known[-1] if version is None else version
        if number not in known:
            raise ValueError(f"no version {number}; there are {known[:1]} to {known[-1:]}")
        files, target = self._at(f"{self.path}/manifests/{number:012d}.json")
        stream = files.open(target)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, manifest: dict) -> bool:
        """Whether this manifest became the next version: no other had."""
        name = f"{manifest['version']:012d}.json"
        files, made = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = files.create(made, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        _, target = self._at(f"{self.path}/manifests/{name}")
        context = self._hadoop.FileContext.getFileContext(made.toUri(), self._conf) if ":" in self.path.split("/")[0] else self._hadoop.FileContext.getFileContext(self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(made, target, none)  # fails if the target is there
        except Py4JJavaError as error:
            files.delete(made, False)
            if "FileAlreadyExistsException" in str(error.java_exception):
                return False
            raise
        return True

    # --- reading

    def read(self, name: str, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """A table as of a version, or only some of its buckets."""
        return self._rows(name, self.manifest(version), buckets)

    def _rows(self, name: str, manifest: dict, buckets: set[int] | None = None) -> DataFrame:
        parts = manifest["parts"].get(name, {})
        paths = [f"{self.path}/{p}" for b, folders in sorted(parts.items()) if buckets is None or int(b) in buckets for p in folders]
        schema = StructType.fromDDL(self.specs[name].ddl)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def touched(self, name: str, keys: DataFrame) -> set[int]:
        """The buckets of some keys: as many numbers as the table has buckets at most."""
        return {r[0] for r in keys.select(bucket_of(self.specs[name]).alias("b")).distinct().collect()}

    # --- writing

    def write(self, name: str, step: Callable[[Snapshot], dict[str, Change]]) -> int:
        """One write: step gets the tables as they are and gives new rows for buckets. The version that holds it.

        If another writer was first, a write whose buckets that one didn't touch is put on top of it; else
        step runs again on the tables as they are then.
        """
        for _ in range(TRIES):
            base = self.manifest()
            if name in base["writes"]:
                return base["version"]
            changes = step(Snapshot(self, base))
            made = {table: self._put(table, change) for table, change in changes.items()}
            beside = {table for table, change in changes.items() if change.append}
            while True:
                now = self.manifest()
                if name in now["writes"]:
                    return now["version"]
                moved = [(t, b) for t, parts in made.items() if t not in beside for b in parts if now["parts"].get(t, {}).get(b) != base["parts"].get(t, {}).get(b)]
                if moved:
                    break
                fresh = {t: {b: now["parts"].get(t, {}).get(b, []) + f if t in beside else f for b, f in parts.items()} for t, parts in made.items()}
                parts = {t: {b: f for b, f in (now["parts"].get(t, {}) | fresh.get(t, {})).items() if f} for t in self.specs}
                if self._publish({"version": now["version"] + 1, "write": name, "writes": [*now["writes"][-999:], name], "parts": parts}):
                    return now["version"] + 1
        raise RuntimeError(f"other writers were first {TRIES} times")

    def _put(self, name: str, change: Change) -> dict[str, list[str]]:
        """Writes rows as a folder for each bucket; a bucket without rows has none."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        spec = self.specs[name]
        columns = StructType.fromDDL(spec.ddl).fieldNames()
        rows = change.rows.select(*columns).withColumn("bucket", bucket_of(spec))
        if len(change.buckets) < spec.buckets:
            rows = rows.where(F.col("bucket").isin(*change.buckets)) if change.buckets else rows.limit(0)
        rows = rows if change.segments else rows.repartition("bucket")
        rows.sortWithinPartitions("bucket", *spec.keys).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        files, target = self._at(f"{self.path}/{folder}")
        there = {s.getPath().getName() for s in files.listStatus(target)}
        return {str(b): [f"{folder}/bucket={b}"] if f"bucket={b}" in there else [] for b in change.buckets}

    # --- what changed

    def changes(self, name: str, since: int, until: int | None = None) -> DataFrame:
        """(change, and the columns): rows that came (insert) and went (delete) between two versions; an updated row is one of each. Reads the buckets that differ."""
        before, after = self.manifest(since) if since else {"parts": {}}, self.manifest(until)
        old, new = before["parts"].get(name, {}), after["parts"].get(name, {})
        differ = {int(b) for b in old.keys() | new.keys() if old.get(b) != new.get(b)}
        was, now = (self._rows(name, m, differ) for m in (before, after))
        return now.exceptAll(was).withColumn("change", F.lit("insert")).unionByName(was.exceptAll(now).withColumn("change", F.lit("delete")))

    def vacuum(self, keep: int) -> int:
        """Deletes manifests but for the last `keep`, and buckets' folders that none of those names. How many folders went. Not while others write."""
        kept = self.versions()[-keep:]
        used = {folder for v in kept for parts in self.manifest(v)["parts"].values() for folders in parts.values() for folder in folders}
        gone = 0
        files, target = self._at(f"{self.path}/data")
        for folder in files.listStatus(target) if files.exists(target) else []:
            buckets = [s.getPath() for s in files.listStatus(folder.getPath()) if s.isDirectory()]
            stale = [p for p in buckets if f"data/{folder.getPath().getName()}/{p.getName()}" not in used]
            for path in [folder.getPath()] if len(stale) == len(buckets) else stale:
                files.delete(path, True)
            gone += len(stale)
        for v in self.versions():
            if v not in kept:
                files.delete(self._at(f"{self.path}/manifests/{v:012d}.json")[1], False)
        return gone


@dataclass
class Snapshot:
    """The tables as of one version, for a write."""

    tables: TableSet
    base: dict

    def read(self, name: str, keys: DataFrame | None = None) -> DataFrame:
        """A table, or the buckets of some keys."""
        return self.tables._rows(name, self.base, None if keys is None else self.tables.touched(name, keys))

    def append(self, name: str, rows: DataFrame, segments: bool = False) -> Change:
        """New rows beside those that are there, which aren't read; segments: and without a shuffle. Many small appends make many files; rewrite such buckets at times."""
        return Change(rows, tuple(range(self.tables.specs[name].buckets)), True, segments)

    def upsert(self, name: str, keys: DataFrame, rows: Callable[[DataFrame], DataFrame]) -> Change:
        """New rows for the buckets of some keys, made from the old ones."""
        buckets = self.tables.touched(name, keys)
        return Change(rows(self.tables._rows(name, self.base, buckets)), tuple(sorted(buckets)))
