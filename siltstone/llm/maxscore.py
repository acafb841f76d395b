"""Exact top-k by inner product: MaxScore over shards.

A term is a dimension with a sign: its postings are the rows whose component has that sign. For a
query, the terms whose sign agrees with its own add to a score and the opposite ones only lower it, so
the largest component of an agreeing term's postings bounds what the term can add. Terms are ordered
by bound; as long as the bounds of the smallest ones together stay below the k-th best score so far,
they are non-essential: rows that only they contain can't enter. Postings of the essential terms are
traversed a range of rows at a time, each range FACTOR times as long as the one before; what they found
is probed in the other terms while its partial score and the bounds still to come reach the threshold,
and scored whole at the end. After each range the threshold rises with the best so far, and fewer terms
are essential. Shards are searched apart; a first shard's best are the threshold that the others begin
with, so those are one range each. Their k best are merged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from siltstone.llm.vector_blocks import best, block_search, lengths_of, valid_vectors

#: Rows of the first range where no threshold is known yet, and how much longer the next one is.
RANGE, FACTOR = 256, 4
#: Terms that are probed between two looks at what is still competitive.
PROBES = 16


class Shard:
    """Postings of one block of integer rows, in order of their ids.

    Half of all rows are in a term's postings, so these are columns: what a row has of the term, 0 if it isn't in them.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.order = np.argsort(ids, kind="stable")
        self.ids, self.columns = ids[self.order], np.ascontiguousarray(rows[self.order].T)
        self.postings = np.stack([np.maximum(self.columns, 0), np.maximum(-self.columns, 0)])  # sign, dimension, row
        self.largest = self.postings.max(axis=2)
        self.doubles = self.postings.astype(np.float64)
        self.cuts = [0]
        while self.cuts[-1] < len(ids):
            self.cuts.append(min(len(ids), self.cuts[-1] + RANGE * FACTOR ** (len(self.cuts) - 1)))
        self.traversed = self.probed = 0  # entries of postings

    def search(self, q: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places (in the order given at first) and exact scores of the k best rows, ties to the smaller id; none below floor."""
        sign, weight = (q < 0).astype(np.int64), np.abs(q)
        bounds = weight * self.largest[sign, np.arange(len(q))]
        terms = np.argsort(-bounds, kind="stable")
        terms = terms[bounds[terms] > 0]
        sign, weight = sign[terms], weight[terms]
        left = np.concatenate([np.cumsum(bounds[terms][::-1])[::-1], [0]])  # left[i]: what terms from i on can add
        postings = self.doubles if left[0] < 1 << 53 else self.postings  # either way sums are exact
        row = (sign * len(q) + terms) * len(self.ids)  # where a term's column begins
        places, scores, threshold = np.zeros(0, np.int64), np.zeros(0, np.int64), floor
        last = len(self.cuts) - 1
        for first, end in [(0, last)] if floor is not None else zip(range(last), range(1, last + 1), strict=True):
            begin, stop = self.cuts[first], self.cuts[end]
            every = threshold is None or threshold <= 0  # rows that no agreeing term holds may be among the best
            essential = len(terms) if every else int(np.argmax(left < threshold))
            weights = np.zeros(postings.shape[:2], postings.dtype)
            weights[sign[:essential], terms[:essential]] = weight[:essential]
            partial = weights.ravel() @ postings.reshape(-1, postings.shape[2])[:, begin:stop]
            self.traversed += essential * (stop - begin)
            active = np.arange(begin, stop) if every else begin + np.flatnonzero(partial > 0)
            partial = partial[active - begin]
            for i in range(essential, len(terms) + PROBES, PROBES):
                if threshold is not None:
                    keep = partial + left[min(i, len(terms))] >= threshold
                    active, partial = active[keep], partial[keep]
                some = slice(i, i + PROBES)
                if i < len(terms) and len(active):
                    partial = partial + weight[some].astype(postings.dtype) @ np.take(postings, row[some, None] + active)
                    self.probed += len(terms[some]) * len(active)
            exact = q @ np.take(self.columns, active, axis=1)  # opposite components, which only lower a score, included
            if threshold is not None:
                active, exact = active[exact >= threshold], exact[exact >= threshold]
            places, scores = np.concatenate([places, active]), np.concatenate([scores, exact])
            top = best(scores, self.ids[places], k)
            places, scores = places[top], scores[top]
            if len(scores) == k:
                threshold = int(scores[-1]) if threshold is None else max(threshold, int(scores[-1]))
        return self.order[places], scores


def top_inner_products(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, the k others of largest score.

    Components become floor(scale * x), x as double; the score is their integer inner product, exact as
    long as it stays below 2**63. Ties go to the smaller vec_id. Null vectors and such with null or
    non-finite components take no part; zero vectors do. Vectors are compared with those of their own
    length. Candidates are all rows but the query's own row: rows that share its id or its vector count,
    repeated rows each by itself, and a query that repeats is answered as often. Fewer than k candidates:
    all. No valid vector: no rows. Other columns are ignored.
    """
    rows = valid_vectors(vectors)

    def search(q: np.ndarray, floors: list, ids: np.ndarray, x: np.ndarray) -> tuple:
        shard = Shard(ids, np.floor(scale * x).astype(np.int64))
        found = [shard.search(v, k + 1, floor) for v, floor in zip(np.floor(scale * q).astype(np.int64), floors, strict=True)]
        return np.repeat(np.arange(len(found)), [len(r) for r, _ in found]), np.concatenate([r for r, _ in found]), np.concatenate([s for _, s in found])

    return block_search(rows, every, lengths_of(rows, every), search, k, "long", [], raised=True)
