"""SimHash near-duplicates: byte-position inverted index with count filtering.

A fingerprint of 64 bits is eight positional bytes. Two fingerprints that differ in at most d bits
differ in at most d bytes, so they share at least 8 - d of the positional bytes: the guaranteed
minimum of matches. A posting of one positional byte alone would hold a 256th of all fingerprints, and
tallying its pairs would be work of the square of their number; so the index is keyed by sets of
positions together with the bytes there, chosen so that any pair with the minimum shares a key, and
postings stay short for any number of documents. In a posting the shared positional bytes of each pair
are tallied over all eight positions, pairs that reach the minimum are retained, and those are verified
on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, documents, text_buffers
from siltstone.llm.components import connected_components

#: Shingle hashes whose bits are counted in one step.
_HASHES = 1 << 16
#: Fingerprints of one posting that one row of work holds from each side.
BLOCK = 2048


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """Of one text: the bits that are set in over half of the XXH64 of its shingles; 0 without a word."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(parts) - words + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _HASHES):
        raw = hashes[i : i + _HASHES].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    chosen = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(chosen, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) with the fingerprint's 64 bits as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            raw = data.tobytes() if len(data) < (64 << 20) else memoryview(data)
            bounds = offsets.tolist()
            out = np.fromiter((fingerprint(bytes(raw[a:b]), words, seed) for a, b in zip(bounds, bounds[1:], strict=False)), np.uint64, len(bounds) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return documents(docs).mapInArrow(run, "doc_id long, fp long")


def position_sets(need: int, size: int) -> list[tuple[int, ...]]:
    """Sets of `size` byte positions such that any `need` of the eight hold one of them.

    For sets of three in any four there is a system of twenty (eight points in three parts: the triples
    inside a part, and those with two points in one part and one in the next); else all sets.
    """
    if (need, size) != (4, 3):
        return list(combinations(range(8), size))
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    inside = [t for p in parts for t in combinations(p, 3)]
    return sorted(inside + [(*two, one) for i, p in enumerate(parts) for two in combinations(p, 2) for one in parts[(i + 1) % 3]])


def shared_bytes(a: str, b: str) -> Column:
    """The tally of a pair: in how many of the eight positions two fingerprints hold the same byte."""
    differ = F.col(a).bitwiseXOR(F.col(b))
    same = [F.when(differ.bitwiseAND(F.lit(_signed(0xFF << 8 * i))) == 0, 1).otherwise(0) for i in range(8)]
    return reduce(Column.__add__, same)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _forest(left: np.ndarray, right: np.ndarray, bits: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span what the pairs between two lists link; fewer than their members."""
    nodes = np.unique(np.concatenate([left, right]))
    label = np.arange(len(nodes))
    li, ri = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
    ends: tuple[list[int], list[int]] = ([], [])
    for begin in range(0, len(left), 128):
        differ = left[begin : begin + 128, None] ^ right[None, :]
        shared = np.count_nonzero(differ.view(np.uint8).reshape(*differ.shape, 8) == 0, axis=2)
        near = (shared >= need) & (np.bitwise_count(differ) <= bits) & (differ != 0)
        for x in np.flatnonzero(near.any(axis=1)).tolist():
            own = label[li[begin + x]]
            far = ri[near[x]]
            other = far[label[far] != own]
            if not len(other):
                continue
            labels, first = np.unique(label[other], return_index=True)
            ends[0].extend([int(li[begin + x])] * len(labels))
            ends[1].extend(other[first].tolist())
            label[np.isin(label, labels)] = own
    return nodes[ends[0]].view(np.int64), nodes[ends[1]].view(np.int64)


def links(unique: DataFrame, scratch: Scratch, bits: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs of fingerprints that hold together every group which fingerprints `bits` apart form.

    unique: fp, one row per fingerprint. Postings are keyed by sets of byte positions and the bytes
    there: of three bytes while there are fewer than 2**26 fingerprints, of four beyond, so that chance
    meetings stay few; either finds every pair. A posting of two is a pair and is tallied and verified in
    the plan; longer ones are cut into blocks of `block`, each pair of blocks is a row of work of its own, so that
    no posting, however hot, meets in one task. Only edges that span a block pair leave it, never all
    of its pairs.
    """
    need = 8 - bits
    size = min(need, 3 if unique.count() < 1 << 26 else 4)
    masks = [sum(0xFF << 8 * i for i in chosen) for chosen in position_sets(need, size)]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])
    postings = unique.select("fp", F.explode(keys).alias("key"))
    counted = scratch.write(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    retained = counted.where("n = 2").where(shared_bytes("a", "b") >= need)
    pairs = retained.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select("a", "b")

    long = counted.where("n > 2").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    members = postings.join(long, "key").withColumn("own", own)
    cells = members.select("key", "own", "fp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    cells = cells.agg(F.collect_list(F.when(F.col("own") <= F.col("other"), F.col("fp"))).alias("left"), F.collect_list(F.when(F.col("own") >= F.col("other"), F.col("fp"))).alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            bounds = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
            return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), bounds

        for batch in batches:
            if not batch.num_rows:
                continue
            (left, lb), (right, rb) = side(batch.column(0)), side(batch.column(1))
            found, size = [], 0
            for k in range(batch.num_rows):
                found.append(_forest(left[lb[k] : lb[k + 1]], right[rb[k] : rb[k + 1]], bits, need))
                size += len(found[-1][0])
                if found and (size > 50_000 or k == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([e[i] for e in found])) for i in (0, 1)], names=["a", "b"])
                    found, size = [], 0

    return pairs.unionAll(cells.select("left", "right").mapInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame, bits: int = 4, words: int = 4, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the least doc_id reachable over links of `bits` or fewer.

    Lower-cases A-Z, takes words of anything but ASCII white space, shingles of `words` words with
    repeats; a shorter text is one shingle. Null, empty and blank texts have fingerprint zero and are
    linked like any other. Rows that repeat a doc_id are kept and each judged. A row without a doc_id links
    others like any other row and gets their component, but never names one: where none of those that it
    reaches has a doc_id, component_id is null. Other columns are ignored. Empty table: no rows.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    table = scratch.write(fingerprints(docs, words, seed))
    unique = scratch.write(table.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    groups = connected_components(links(unique.select("fp"), scratch, bits, block), scratch)
    rooted = unique.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "component_id")
    out = table.join(named, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
