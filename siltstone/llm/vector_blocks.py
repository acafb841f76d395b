"""Blocks of rows against blocks of queries, for searches of a stated query set over a whole table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch

#: Rows, and queries, that one task holds at a time at most (hashing keeps blocks near their mean).
ROWS = 2048
QUERIES = 1024


def valid_vectors(df: DataFrame) -> DataFrame:
    """(vec_id, d, h, embedding) of the vectors that take part: d is the length and h a hash of the vector.

    Left out: null ids, null or empty vectors, and such with null or non-finite components. Floats stay
    floats, as they are what is shuffled; tasks compute in double precision.
    """
    kind = df.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0").where(finite)
    return rows.select("vec_id", F.size("embedding").alias("d"), F.xxhash64("embedding").alias("h"), "embedding")


def lengths_of(rows: DataFrame, every: int) -> list[tuple[int, int, int]]:
    """(length, rows, queries) of each length of vectors; only vectors of one length are compared."""
    asked = F.sum((F.col("vec_id") % every == 0).cast("long"))
    return sorted(tuple(r) for r in rows.groupBy("d").agg(F.count(F.lit(1)), asked).collect())


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column of one length, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def block_search(rows: DataFrame, every: int, lengths: list[tuple[int, int, int]], search: Callable, k: int, score: str, extra: list[str], raised: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): runs `search` in each cell of a grid of row blocks and query blocks, and merges.

    rows: vec_id, d, h, embedding and `extra`; queries are those whose vec_id is divisible by `every`.
    search(queries, floors, ids, vectors, *extra) returns (place of the query, place of the row, score)
    arrays, the best `k + 1` of a query by score and then by id; floors are scores that a row must reach.
    Every row is a candidate, the query's own too: it is among the best k + 1 or tied with what is, and
    leaves there. So rows that share an id or a vector are candidates of each other. Blocks come from a
    hash of the row and its place, so nothing common makes a block larger; a cell is one group of ROWS +
    QUERIES rows about. The merge keeps k + 1 of (k + 1) * blocks rows of a query, by partial top-k in each
    task first. raised: the first block is searched ahead, and its k + 1 best set the other blocks' floors.
    """
    spark = rows.sparkSession
    number = {d: (max(1, -(-n // ROWS)), max(1, -(-m // QUERIES))) for d, n, m in lengths} or {0: (1, 1)}

    def blocks_of(i: int) -> Column:
        return F.create_map(*[F.lit(v) for d, n in number.items() for v in (d, n[i])])[F.col("d")]

    scratch = Scratch(spark, "search")
    block = F.pmod(F.xxhash64("vec_id", "h", F.monotonically_increasing_id()), F.col("nr")).cast("int")
    placed = scratch.write(rows.withColumns({"nr": blocks_of(0), "nq": blocks_of(1)}).withColumn("rb", block))  # written, so that a row is in one block whatever reads it
    kind, null = (pa.float64(), "double") if score == "double" else (pa.int64(), "long")
    asked = placed.where(F.col("vec_id") % every == 0).groupBy("vec_id", "d", "h", "nr", "nq").agg(F.any_value("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies"))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id", "h"), F.col("nq")).cast("int"))
    right = placed.withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    right = right.select("d", "rb", "qb", "vec_id", "h", "embedding", *extra)
    names = ["query_id", "query_h", "vec_id", "h", "score"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), kind)], names=names)
        ids, hashes = b["vec_id"].to_numpy(), b["h"].to_numpy()
        q, r, found = search(matrix(a["embedding"]), a["floor"].to_pylist(), ids, matrix(b["embedding"]), *[b[c].combine_chunks() for c in extra])
        return pa.table([pa.array(x) for x in (a["vec_id"].to_numpy()[q], a["h"].to_numpy()[q], ids[r], hashes[r])] + [pa.array(found, kind)], names=names)

    def cells(some_rows: DataFrame, queries: DataFrame, blocks) -> DataFrame:
        left = queries.withColumn("rb", F.explode(blocks))
        left = left.select(*(F.col(c).alias(c) for c in ("d", "rb", "qb", "vec_id", "h", "embedding", "floor")))  # both sides come from the same rows
        return left.groupBy("d", "rb", "qb").cogroup(some_rows.groupBy("d", "rb", "qb")).applyInArrow(run, f"query_id long, query_h long, vec_id long, h long, score {null}")

    order = Window.partitionBy("query_id", "query_h").orderBy(F.desc("score"), F.asc("vec_id"), F.asc("h"))
    no_floor = asked.withColumn("floor", F.lit(None).cast(null))
    if raised and any(n > ROWS for _, n, _ in lengths):
        ahead = scratch.write(cells(right.where("rb = 0"), no_floor, F.array(F.lit(0))))
        floors = ahead.withColumn("at", F.row_number().over(order)).where(F.col("at") == k + 1).select(F.col("query_id").alias("vec_id"), F.col("query_h").alias("h"), F.col("score").alias("floor"))
        later = asked.join(floors, ["vec_id", "h"], "left").where("nr > 1")
        found = ahead.unionByName(cells(right.where("rb > 0"), later, F.sequence(F.lit(1), F.col("nr") - 1)))
    else:
        found = cells(right, no_floor, F.sequence(F.lit(0), F.col("nr") - 1))
    best = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("h") == F.col("query_h"))
    # the query's own row: the first of its id and vector, or one beyond the last place
    best = best.withColumn("own_at", F.min(F.when(own, F.col("at"))).over(Window.partitionBy("query_id", "query_h")))
    best = best.where(F.col("at") != F.coalesce("own_at", F.lit(k + 1)))
    rank = (F.col("at") - F.when(F.col("own_at") < F.col("at"), 1).otherwise(0)).cast("int")
    copies = asked.select(F.col("vec_id").alias("query_id"), F.col("h").alias("query_h"), "copies")
    each = best.withColumn("rank", rank).join(copies, ["query_id", "query_h"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select("query_id", "rank", "vec_id", "score")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= edge)
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], -scores[among]))[:k]]
