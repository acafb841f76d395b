"""Derived tables that are written once and read many times, as an ingest would keep them.

A table's folder is named by what it derives from: the source files with their sizes and times, the
scope and the code that defines it. So a changed source gives a new table and never a stale one,
and a reader needs no lock: a table is written beside its place and moved there when it is whole.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Modules that define the tables: with another version of them a table is another one.
DEFINED_IN = ("store.py", "model/frames.py", "model/vocabulary.py", "expr/text.py", "operators/text_index.py", "operators/vector_index.py", "operators/source_view.py")
#: Bytes of an Arrow batch between an executor and its Python worker; either holds several at a time (Spark's own limit is 64 MB).
BATCH_BYTES = 4 << 20
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Where it is unset, a local session gets a temporary folder and a cluster an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if found is None:
        option = sc._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else _own.get(sc.applicationId)
    if found is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Names, sizes and times of all files under the paths."""
    seen = []
    for path in paths:
        files, target = _file_system(spark, path)
        listing = files.listFiles(target, True)
        while listing.hasNext():
            status = listing.next()
            seen.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]


@cache
def definitions() -> str:
    own = Path(__file__).parent
    return hashlib.sha256(b"".join((own / name).read_bytes() for name in DEFINED_IN)).hexdigest()


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold BATCH_BYTES at most, or one row; a lower limit of its own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < own <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def stored(spark: SparkSession, name: str, sources: list[str], scope: str, build: Callable[[], DataFrame], by: str | list[str], folders: list[str] | None = None) -> DataFrame:
    """The table of that name over those sources, and within that scope, built if it isn't there.

    Its files are what the build's tasks made, each sorted by `by`, so that a filter on the first of these
    columns reads a few pages of each file, as of the segments of a search index. Rows aren't dealt into ranges
    over all files: that would run the build twice, for a sample, and shuffle tables that are larger than
    their sources. folders: columns that are folders, which filters and joins prune.
    """
    key = hashlib.sha256(f"{definitions()} {scope} {fingerprint(spark, sources)}".encode()).hexdigest()[:24]
    by = [*(folders or []), *([by] if isinstance(by, str) else by)]
    path = f"{shared_folder(spark)}/tables/{name}-{key}"
    files, target = _file_system(spark, path)
    if not files.exists(target):
        bound_batches(spark)
        made = f"{path}.{uuid.uuid4().hex}"
        build().sortWithinPartitions(*by).write.options(**{"parquet.block.size": 8 << 20, "compression": "zstd"}).partitionBy(*(folders or [])).parquet(made)
        _, unfinished = _file_system(spark, made)
        if files.exists(target):
            files.delete(unfinished, True)  # another session was first; its table is the same
        elif not files.rename(unfinished, target):
            raise RuntimeError(f"could not move {made} to {path}")
    return spark.read.parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """A table of this run alone, written to the shared folder and read again: it cuts the plan and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/runs/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A short list as part of the plan, whose size the optimiser then knows: joins with it broadcast it and leave the other side where it is."""
    fields = StructType.fromDDL(schema)
    if not rows:
        return spark.createDataFrame([], fields)
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields, strict=True)]) for row in rows])))
