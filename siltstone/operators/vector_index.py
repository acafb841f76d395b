"""Nearest vectors from an inverted file: a folder for each cell of a coarse partition, of which a query reads few.

Centroids are fitted by k-means on a bounded sample; every vector is placed in the cell of its nearest
centroid. A cell's row says how far its vectors reach from the centroid, which bounds the cosine that any
of them can have with a query. So a search has two forms: the nearest cells only, whose recall is
measured, or, with `exact`, those cells first and then all cells whose bound reaches the k-th score found.
Filters come before each limit, and both forms prune folders by the join with the chosen cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from siltstone.expr.scoring import cosine

#: Vectors of the sample for each cell, cells at most, and numbers of all centroids at most (32 MB).
SAMPLED, MOST_CELLS, MOST_NUMBERS = 64, 4096, 1 << 22
#: The cell of vectors that no centroid applies to: null, zero, or of another length. It is always read.
UNPLACED = -1


@dataclass
class VectorIndex:
    """rows: (customer_id, vec_id, source_system, updated_at, embedding, closeness), in folders by cell; cells: (cell, centroid, least)."""

    rows: DataFrame
    cells: DataFrame


def _norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def centroids(vectors: DataFrame, seed: int = 1) -> DataFrame:
    """(cell, centroid): unit vectors; about half the square root of the number of vectors of the commonest length."""
    spark = vectors.sparkSession
    usable = vectors.select("vec_id", "embedding").where("embedding is not null and not exists(embedding, x -> x is null or isnan(x))").withColumn("norm", _norm(F.col("embedding"))).where("norm > 0 and norm < double('infinity')")
    sizes = usable.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    schema = "cell int, centroid array<double>"
    if sizes is None:
        return spark.createDataFrame([], schema)
    size, n = sizes
    most = max(1, min(MOST_CELLS, MOST_NUMBERS // size, round(n**0.5 / 2)))
    wanted = SAMPLED * most
    own = usable.where(F.size("embedding") == size).withColumn("hash", F.xxhash64("vec_id", F.lit(seed)).bitwiseAND(F.lit((1 << 62) - 1)))
    if n > 4 * wanted:  # so that no more than about twice the sample is sorted
        own = own.where(F.col("hash") < int((1 << 62) * 2 * wanted / n))
    sample = own.orderBy("hash", "vec_id").limit(wanted).select(array_to_vector("embedding").alias("features"))
    if most == 1:
        means = [np.mean([r[0].toArray() for r in sample.collect()], axis=0)]
    else:
        means = KMeans(k=most, distanceMeasure="cosine", maxIter=10, seed=seed).fit(sample).clusterCenters()
    unit = [m / norm for m in means if (norm := float(np.sqrt(m @ m))) > 0]
    return spark.createDataFrame([(i, [float(x) for x in m]) for i, m in enumerate(unit)], schema)


def placed(vectors: DataFrame, cells: DataFrame) -> DataFrame:
    """Every vector with its cell and its cosine with the cell's centroid."""
    means = np.array([r["centroid"] for r in cells.orderBy("cell").collect()], float)  # MOST_NUMBERS at most
    known = vectors.sparkSession.sparkContext.broadcast(means)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means = known.value
        size = means.shape[1] if means.size else -1
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("embedding"))
            cell, close = np.full(batch.num_rows, UNPLACED, np.int32), np.full(batch.num_rows, np.nan)
            for begin in range(0, batch.num_rows, 1024):
                part = column.slice(begin, 1024)
                fit = [i for i, v in enumerate(part) if v.is_valid and len(v) == size and v.values.null_count == 0]
                if not fit:
                    continue
                x = np.stack([part[i].values.to_numpy(zero_copy_only=False) for i in fit]).astype(float)
                norms = np.sqrt((x * x).sum(axis=1))
                good = np.isfinite(norms) & (norms > 0)
                at = np.array(fit)[good] + begin
                scores = (x[good] / norms[good, None]) @ means.T
                cell[at] = scores.argmax(axis=1)
                close[at] = scores.max(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(close, from_pandas=True)], names=[*batch.schema.names, "cell", "closeness"])

    return vectors.mapInArrow(run, StructType([*vectors.schema, StructField("cell", IntegerType()), StructField("closeness", DoubleType())]))


def cells(rows: DataFrame, means: DataFrame) -> DataFrame:
    """(cell, centroid, least) of the cells that hold vectors; least: the smallest cosine of its vectors with the centroid."""
    held = rows.groupBy("cell").agg(F.min("closeness").alias("least"))
    return held.join(means, "cell", "left").select("cell", "centroid", "least")


def bounded_cells(index: VectorIndex, query: Column) -> DataFrame:
    """(cell, place, bound): the cells' order by nearness to the query, and the largest cosine with it that a vector of the cell can have."""
    near = F.when(F.col("cell") == UNPLACED, 2.0).otherwise(cosine(F.col("centroid"), query))
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("near")))) - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("least"))))
    bound = F.when(F.col("cell") == UNPLACED, 1.0).otherwise(F.cos(F.greatest(F.lit(0.0), apart)))
    scored = index.cells.withColumn("near", near).withColumn("bound", bound)
    return scored.select("cell", "bound", F.row_number().over(Window.orderBy(F.desc("near"), "cell")).alias("place"))  # of MOST_CELLS rows at most


def indexed_search(index: VectorIndex, query: list[float], k: int, probes: int = 8, exact: bool = False, within: DataFrame | None = None, sources: tuple[str, ...] = ()) -> DataFrame:
    """(vec_id, source_system, updated_at, score): the k nearest by cosine, ties by id, of the `probes` nearest cells, or of all with `exact`.

    within: (vec_id) of the rows that may be found; sources: those that may be. What is filtered out takes
    no place among the k. Scores are rounded to six digits, which the exact form allows for.
    """
    asked = F.array(*[F.lit(float(v)) for v in query])
    chosen = bounded_cells(index, asked)

    def nearest(some: DataFrame) -> DataFrame:
        rows = index.rows.join(F.broadcast(some.select("cell")), "cell")  # MOST_CELLS numbers at most
        if sources:
            rows = rows.where(F.col("source_system").isin(*sources))
        if within is not None:
            rows = rows.join(within.select("vec_id"), "vec_id", "left_semi")
        scored = rows.select("vec_id", "source_system", "updated_at", F.round(cosine(F.col("embedding"), asked), 6).alias("score"))
        return scored.orderBy(F.desc("score"), "vec_id").limit(k)

    first = nearest(chosen.where(F.col("place") <= probes))
    if not exact:
        return first
    floor = first.agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(-2.0).alias("floor"))
    return nearest(chosen.crossJoin(F.broadcast(floor)).where(F.col("bound") >= F.col("floor") - 2e-6))  # one row
