"""What the operators of this subpackage share: tables, shared scratch space, Arrow helpers."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from siltstone.store import BATCH_BYTES, bound_batches, shared_folder

#: Text bytes that one vectorised step handles at most (a single longer text is one step).
STEP_BYTES = BATCH_BYTES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Intermediate tables in the shared folder. A written table cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        bound_batches(spark)
        self.base = f"{shared_folder(spark)}/siltstone/{label}-{uuid.uuid4().hex[:12]}"
        self._count = 0
        self._paths: dict[int, str] = {}

    def write(self, df: DataFrame, partition_by: list[str] | None = None, codec: str = "zstd") -> DataFrame:
        self._count += 1
        path = f"{self.base}/{self._count}"
        writer = df.write.option("compression", codec)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        self._keep = getattr(self, "_keep", [])
        self._keep.append(out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Frees tables that nothing reads any more, and the shuffle files of the plans that made them."""
        for frame in frames:
            path = self._paths.pop(id(frame), None)
            if path:
                _delete(self.spark, path)
        self._keep = [f for f in getattr(self, "_keep", []) if id(f) in self._paths]
        self.release()

    def release(self) -> None:
        """Lets Spark's cleaner drop shuffle files of finished plans."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets into them; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    buffers = column.buffers()
    if n == 0 or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about `limit` bytes together."""
    n, begin = len(offsets) - 1, 0
    while begin < n:
        end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
        end = min(n, max(begin + 1, end))
        yield begin, end
        begin = end


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """doc_id as long and text as string, whatever other columns the table has."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


def held_out(df: DataFrame) -> DataFrame:
    """Adds held_out: crc32 of doc_id as text leaves 0 when divided by 5."""
    return df.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))


def carried_along(docs: DataFrame, keep: list[str]) -> dict[str, Column]:
    """The columns to carry along, under names that clash with nothing; a text that is a string isn't among them, as it is there already."""
    return {f"kept_{i}": F.col(f"`{c}`") for i, c in enumerate(keep) if c != "text" or not isinstance(docs.schema[c].dataType, StringType)}


def beside(docs: DataFrame, keep: list[str], taken: str) -> tuple[DataFrame, str]:
    """doc_id, held_out, text and the columns to carry along; and the schema of taken and those columns, with which `together` puts a batch out."""
    bound_batches(docs.sparkSession)
    carried = carried_along(docs, keep)
    frame = held_out(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c.alias(name) for name, c in carried.items())))
    schema = ", ".join([taken, *(f"kept_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))])
    return frame.select("doc_id", "held_out", "text", *carried), schema


def together(batch: pa.RecordBatch, own: dict[str, pa.Array], keep: list[str]) -> pa.RecordBatch:
    """An operator's own columns and those that it carries along for keep."""
    there = set(batch.schema.names)
    kept = {name: batch.column(name if name in there else "text") for name in (f"kept_{i}" for i in range(len(keep)))}
    return pa.RecordBatch.from_arrays([*own.values(), *kept.values()], names=[*own, *kept])


def restored(df: DataFrame, keep: list[str], own: bool = True) -> DataFrame:
    """Gives the carried columns their names back, after the operator's own or without those."""
    taken = [c for c in df.columns if not c.startswith("kept_")] if own else []
    return df.select(*taken, *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)))


def hashed_sample(rows: DataFrame, n: int, total: int, *by: str) -> DataFrame:
    """The n rows of least hash: rows beyond a bound that keeps about 2 n are left out before they are sorted, so one task gets no more."""
    hashed = rows.withColumn("sample_hash", F.xxhash64(*by).bitwiseAND(F.lit((1 << 62) - 1)))
    if total > 4 * n:
        hashed = hashed.where(F.col("sample_hash") < int((1 << 62) * (2 * n + 200) / total))
    return hashed.orderBy("sample_hash", *by).limit(n).drop("sample_hash")


def prefix_sums(scratch: Scratch, df: DataFrame, group: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """Adds <name>_before for each of the sums: the sum over the group's rows that come before in the order, which should tell rows apart (those it doesn't come in any order).

    Rows are dealt into ranges of group and order, so that a large group is spread over many tasks; only
    a row for each group and range is summed over the ranges before it. Nulls come first.
    """
    ranged = scratch.write(df.repartitionByRange(*group, *order).withColumn("range_part", F.spark_partition_id()))
    inner = Window.partitionBy("range_part", *group)
    earlier = inner.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range_part", *group).agg(*(F.sum(c).alias(f"{c}_sum") for c in sums))
    ranges = Window.partitionBy(*(group or [F.lit(0)])).orderBy("range_part").rowsBetween(Window.unboundedPreceding, -1)
    based = totals.select("range_part", *group, *(F.coalesce(F.sum(f"{c}_sum").over(ranges), F.lit(0)).alias(f"{c}_base") for c in sums))
    summed = ranged.select("*", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in sums))
    joined = summed.join(based, ["range_part", *group])
    return joined.select(*df.columns, *((F.col(f"{c}_before") + F.col(f"{c}_base")).alias(f"{c}_before") for c in sums))
