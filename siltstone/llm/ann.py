"""Approximate nearest neighbours: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

Vectors are brought to unit length, so that cosine is an inner product. They are cut into subspaces of
two dimensions, each with sixteen centroids: four bits. The loss of a code weighs the residual's part
that is parallel to the vector `eta` times the rest, as only that part moves the largest inner
products; codes come from coordinate descent under that loss and centroids from its normal equations.
A query turns into one table of sixteen partial products for each subspace, a scan adds table entries
by code, and the best of each block are scored again on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import hashed_sample
from siltstone.llm.vector_blocks import best, block_search, lengths_of, matrix, valid_vectors

CENTROIDS = 16
#: Dimensions of a subspace.
WIDTH = 2
#: Rows that codebooks are fitted on at most, chosen by a hash of vec_id; every row is indexed.
SAMPLE = 8192
#: Candidates that are reranked for each query in each block of rows.
RERANK = 64


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(top > 0, top, 1)  # no overflow in the squares of large components
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Codebook:
    centroids: np.ndarray  # subspace, centroid, width
    eta: float

    @property
    def size(self) -> int:
        return len(self.centroids)

    def cut(self, x: np.ndarray) -> np.ndarray:
        """Rows as (row, subspace, width), padded with zeros."""
        padded = np.zeros((len(x), self.size * WIDTH))
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), self.size, WIDTH)

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes (row, subspace) of unit rows, by coordinate descent on the anisotropic loss."""
        parts = self.cut(x)
        gaps = parts[:, :, None, :] - self.centroids[None]
        square = (gaps**2).sum(axis=3)
        along = (gaps * parts[:, :, None, :]).sum(axis=3)
        codes = (square + (self.eta - 1) * along**2).argmin(axis=2)
        each = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
        for _ in range(rounds):
            for m in range(self.size):
                rest = total - along[each, m, codes[:, m]]
                codes[:, m] = (square[:, m] + (self.eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(axis=1)
                total = rest + along[each, m, codes[:, m]]
        return codes.astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Partial inner products (query, subspace, centroid)."""
        return np.einsum("qmw,mcw->qmc", self.cut(queries), self.centroids).astype(np.float32)


def fit(x: np.ndarray, threshold: float = 0.2, rounds: int = 4, seed: int = 0) -> Codebook:
    """Codebooks of unit rows; threshold is the inner product above which accuracy matters."""
    d = x.shape[1]
    subspaces = -(-d // WIDTH)
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    random = np.random.default_rng(seed)
    book = Codebook(np.zeros((subspaces, CENTROIDS, WIDTH)), eta)
    parts = book.cut(x)
    book.centroids = parts[random.integers(0, len(x), CENTROIDS)].transpose(1, 0, 2) + random.normal(0, 1e-4, (subspaces, CENTROIDS, WIDTH))
    for _ in range(8):  # a plain start: each subspace's own means
        codes = ((parts[:, :, None, :] - book.centroids[None]) ** 2).sum(axis=3).argmin(axis=2)
        for m in range(subspaces):
            count = np.bincount(codes[:, m], minlength=CENTROIDS)
            for w in range(WIDTH):
                mean = np.bincount(codes[:, m], parts[:, m, w], CENTROIDS) / np.maximum(count, 1)
                book.centroids[m, :, w] = np.where(count > 0, mean, book.centroids[m, :, w])
    unknowns = subspaces * CENTROIDS * WIDTH
    for _ in range(rounds):
        codes = book.encode(x)
        column = (np.arange(subspaces) * CENTROIDS + codes)[:, :, None] * WIDTH + np.arange(WIDTH)
        lhs, rhs = np.zeros((unknowns, unknowns)), np.zeros(unknowns)
        for i in range(0, len(x), 1024):
            dense = np.zeros((min(1024, len(x) - i), unknowns))
            np.put_along_axis(dense, column[i : i + 1024].reshape(len(dense), -1), parts[i : i + 1024].reshape(len(dense), -1), 1)
            lhs += (eta - 1) * dense.T @ dense
            rhs += eta * dense.sum(axis=0)
        lhs[np.diag_indices(unknowns)] += np.bincount(column.ravel(), minlength=unknowns) + 1e-6
        book.centroids = np.linalg.solve(lhs, rhs + 1e-6 * book.centroids.ravel()).reshape(book.centroids.shape)
    return book


def index(rows: DataFrame, lengths: list[tuple[int, int, int]], sample: int = SAMPLE) -> tuple[DataFrame, dict[int, Codebook]]:
    """Adds `codes` (two four-bit codes a byte) to every row; a codebook for each length of vectors is fitted on `sample` rows.

    Lengths with no more rows than are reranked anyway need no codes.
    """
    books = {}
    for d, n, _ in lengths:
        if n > RERANK:
            chosen = hashed_sample(rows.where(F.col("d") == d), sample, n, "vec_id", "h").select("embedding").toArrow()
            books[d] = fit(unit(matrix(chosen["embedding"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(1).to_numpy()
            packed = np.full(batch.num_rows, b"", object)
            for d in np.unique(size).tolist():
                book, own = books.get(d), np.flatnonzero(size == d)
                for i in range(0, len(own) if book else 0, 1024):
                    some = own[i : i + 1024]
                    codes = book.encode(unit(matrix(batch.column(3).take(pa.array(some)))))
                    codes = np.concatenate([codes, np.zeros((len(codes), codes.shape[1] % 2), np.uint8)], axis=1)
                    packed[some] = [row.tobytes() for row in codes[:, ::2] | codes[:, 1::2] << 4]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary())], names=["vec_id", "d", "h", "embedding", "codes"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.select("vec_id", "d", "h", "embedding").mapInArrow(run, f"vec_id long, d int, h long, embedding {kind}, codes binary"), books


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, the k others of largest cosine found.

    score is the cosine in double precision on the original vectors; ties go to the smaller vec_id. Null
    and zero vectors, and such with null or non-finite components, take no part. Vectors are compared
    with those of their own length. Candidates are all rows but the query's own row: rows that share its
    id or its vector count, repeated rows each by itself, and a query that repeats is answered as often.
    Fewer than k candidates: all of them. No valid vector: no rows. Other columns are ignored. A scan in
    each block of rows keeps `rerank` candidates, and all that tie with the last of them, for exact
    scoring, so recall can only rise as there are more blocks.
    """
    valid = valid_vectors(vectors).where(F.exists("embedding", lambda x: x != 0))
    lengths = lengths_of(valid, every)
    rows, books = index(valid, lengths, sample)

    def search(q: np.ndarray, floors: list, ids: np.ndarray, x: np.ndarray, packed: pa.Array) -> tuple:
        book = books.get(x.shape[1])
        norms = np.sqrt((x * x).sum(axis=1))
        if book:
            raw = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(ids), -1)
            codes = np.empty((raw.shape[1] * 2, len(ids)), np.uint8)
            codes[::2], codes[1::2] = (raw & 15).T, (raw >> 4).T
            tables = book.tables(unit(q))
        out: tuple[list, list, list] = ([], [], [])
        for i, vector in enumerate(q):
            near = np.arange(len(ids))
            if book and len(ids) > rerank:
                approximate = np.zeros(len(ids), np.float32)
                for m in range(book.size):
                    approximate += tables[i, m][codes[m]]
                near = np.flatnonzero(approximate >= np.partition(approximate, len(ids) - rerank)[len(ids) - rerank])
            exact = (x[near] * vector).sum(axis=1) / (norms[near] * np.sqrt((vector * vector).sum()))
            top = best(exact, ids[near], k + 1)
            out[0].append(np.full(len(top), i))
            out[1].append(near[top])
            out[2].append(exact[top])
        return tuple(map(np.concatenate, out))

    return block_search(rows, every, lengths, search, k, "double", ["codes"])
