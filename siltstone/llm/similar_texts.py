"""Near-duplicates by similarity: SimHash fingerprints from the byte-position index with count filtering, then the exact similarity of shingle sets.

A text is the set of its shingles; two texts are linked if their sets' Jaccard similarity reaches
LEAST_SIMILARITY. Candidates are texts whose fingerprints the index links (see near_duplicates.py). That
finds copies and slight edits; pairs of a similarity near LEAST_SIMILARITY are some ten bits apart, which
no index with a guaranteed minimum of matches finds, so MinHash bands add candidates to it:
each distinct set has a signature of BANDS * ROWS minimums. Texts that agree in a whole
band meet; those whose signatures agree in LEAST_EQUAL places are candidates. Every group that candidates
form is then verified on the sets themselves, so no link is ever below the similarity. A pair of exactly
LEAST_SIMILARITY fails to share a band with probability (1 - 0.8 ** 5) ** 25 = 5e-5, or has fewer equal
places with about 1e-5 (binomial); more alike ones far less often.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, text_buffers
from siltstone.llm.components import connected_components
from siltstone.llm.near_duplicates import fingerprint, links

WORDS = 5
LEAST_SIMILARITY = 0.8
BANDS, ROWS = 25, 5
#: Equal places of two signatures from which the sets are compared: 4.5 deviations below the mean at LEAST_SIMILARITY.
LEAST_EQUAL = 80
#: Signatures of one band's posting, and bytes of shingle hashes of one group, that a row of work holds from each side.
BLOCK = 2048
BLOCK_BYTES = 2 << 20
_random = np.random.default_rng(42)
_FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
#: Shingles that are multiplied out in one step.
_STEP = 4096


def shingle_set(text: bytes, words: int = WORDS, seed: int = 42) -> np.ndarray:
    """Sorted distinct XXH64 of a text's shingles, lower-cased A-Z; a shorter text is one shingle."""
    parts = text.lower().split()
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - words + 1].tolist()
    return np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Sixteen bits of each of the BANDS * ROWS minimums."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), _STEP):
        least = np.minimum(least, (shingles[None, i : i + _STEP] * _FACTORS[:, None] + _SHIFTS[:, None]).min(axis=1))
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype("<u2")


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, offsets = text_buffers(column)
    for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        yield data[a:b].tobytes()


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    return map(shingle_set, _texts(column))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text("text").alias("text")).withColumn("text_hash", F.xxhash64("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, key, size, sig, fp): key names the text's set of shingles, fp is its fingerprint. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, sigs, fps = [], [], [], []
            for text in _texts(batch.column(1)):
                own = shingle_set(text)
                fps.append(fingerprint(text))
                keys.append(xxhash.xxh64_intdigest(own.tobytes()))
                sizes.append(len(own))
                sigs.append(signature(own).tobytes())
            named, printed = (pa.array(np.array(v, np.uint64).view(np.int64)) for v in (keys, fps))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), named, pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), printed], names=["doc_id", "text_hash", "key", "size", "sig", "fp"])

    return _hashed(docs).select("doc_id", "text", "text_hash").mapInArrow(run, "doc_id long, text_hash long, key long, size long, sig binary, fp long")


def _spanning(left: np.ndarray, right: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """Edges that span what the near pairs between two lists link; near judges one of left against some of right."""
    nodes = np.unique(np.concatenate([left, right]))
    label = np.arange(len(nodes))
    li, ri = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
    ends: tuple[list[int], list[int]] = ([], [])

    def link(x: int, others: np.ndarray) -> None:
        others = others[label[ri[others]] != label[li[x]]]
        if not len(others):
            return
        others = others[near(x, others)]
        labels, first = np.unique(label[ri[others]], return_index=True)
        ends[0].extend([int(left[x])] * len(labels))
        ends[1].extend(right[others[first]].tolist())
        label[np.isin(label, labels)] = label[li[x]]

    every = np.arange(len(right))
    for x in range(len(left)):
        if len(right) > 8:
            link(x, np.unique(label[ri], return_index=True)[1])  # one of each group first, so that a group of copies is passed over
        link(x, every)
    return ends


def _paired(members: DataFrame, group: str, value: str, judge: Callable[[list, list], Callable[[int, np.ndarray], np.ndarray]]) -> DataFrame:
    """(a, b): edges that span the near pairs of each group. members: group, key, value (binary), blocks.

    A group is dealt to its number of blocks and each pair of blocks is a row of work, so that no group,
    however large, meets in one task. Never all pairs leave it.
    """
    own = F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks")).cast("int")
    cells = members.withColumn("own", own).select(group, "own", F.struct("key", value).alias("it"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.groupBy(group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    cells = cells.agg(F.collect_list(F.when(F.col("own") <= F.col("other"), F.col("it"))).alias("left"), F.collect_list(F.when(F.col("own") >= F.col("other"), F.col("it"))).alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(cell: pa.ListScalar) -> tuple[np.ndarray, list]:
            items = cell.values
            return items.field(0).to_numpy(zero_copy_only=False), items.field(1).to_pylist()

        for batch in batches:
            found: tuple[list[int], list[int]] = ([], [])
            for k in range(batch.num_rows):
                (left, lv), (right, rv) = side(batch.column(0)[k]), side(batch.column(1)[k])
                for out, part in zip(found, _spanning(left, right, judge(lv, rv)), strict=True):
                    out.extend(part)
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in found], names=["a", "b"])

    return cells.select("left", "right").mapInArrow(run, "a long, b long")


def _by_signature(left: list, right: list) -> Callable[[int, np.ndarray], np.ndarray]:
    x, y = (np.frombuffer(b"".join(v), "<u2").reshape(len(v), -1) for v in (left, right))
    return lambda i, others: np.count_nonzero(y[others] == x[i], axis=1) >= LEAST_EQUAL


def _by_similarity(left: list, right: list) -> Callable[[int, np.ndarray], np.ndarray]:
    x, y = ([np.frombuffer(v, "<u8") for v in side] for side in (left, right))
    sizes = np.array([len(v) for v in y])

    def near(i: int, others: np.ndarray) -> np.ndarray:
        n, out = len(x[i]), np.zeros(len(others), bool)
        fit = np.flatnonzero(np.minimum(n, sizes[others]) >= LEAST_SIMILARITY * np.maximum(n, sizes[others]))
        if len(fit):
            many = np.concatenate([y[o] for o in others[fit].tolist()])
            same = x[i][np.minimum(np.searchsorted(x[i], many), n - 1)] == many
            lengths = sizes[others[fit]]
            shared = np.add.reduceat(same, np.cumsum(lengths) - lengths, dtype=np.int64)
            out[fit] = shared >= LEAST_SIMILARITY * (n + lengths - shared)
        return out

    return near


def _band_keys() -> Column:
    width = 2 * ROWS
    return F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 1 + i * width, width)) for i in range(BANDS)])


def _by_fingerprint(table: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): keys of texts whose fingerprints are equal or that the index links; edges that span the groups, not all pairs. table: key, fp."""
    held = scratch.write(table.select("fp", "key").distinct())
    first = scratch.write(held.groupBy("fp").agg(F.min("key").alias("first")))
    equal = held.join(first, "fp").where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    near = links(first.select("fp"), scratch)
    for end in ("a", "b"):
        near = near.join(first.withColumnsRenamed({"fp": end, "first": f"{end}_key"}), end)
    return equal.unionAll(near.select(F.col("a_key").alias("a"), F.col("b_key").alias("b")))


def _with_sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(root, key, shingles) of chosen (rep, key, root, blocks): the set of each one's text; rep: doc_id and text_hash of a row that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [own.tobytes() for own in _sets(batch.column(3))]
            keys = [xxhash.xxh64_intdigest(own) for own in sets]
            fits = pa.array(np.array(keys, np.uint64).view(np.int64) == batch.column(1).to_numpy())  # another text can have the same hash
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sets, pa.binary())], names=["root", "key", "blocks", "shingles"]).filter(fits)

    same = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("text_hash") == F.col("rep.text_hash"))
    joined = _hashed(docs).join(chosen, same).select("root", "key", "blocks", "text")
    return joined.mapInArrow(run, "root long, key long, blocks int, shingles binary").dropDuplicates(["key"])


def groups_of_similar_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, root) of every row: rows whose texts hang together have the same root.

    Words are anything but ASCII white space. Null, empty and blank texts are equal. Rows that repeat a
    doc_id are kept and each judged by its own text, and so are those without one. text_hash is xxhash64
    of the text, by which a row finds its text again. Empty table: no rows.
    """
    scratch = Scratch(docs.sparkSession, "similar-texts")
    table = scratch.write(signatures(docs))
    unique = scratch.write(table.groupBy("key").agg(F.max(F.struct("doc_id", "text_hash")).alias("rep"), F.min("size").alias("size"), F.min("sig").alias("sig")))
    postings = unique.select("key", F.explode(_band_keys()).alias("band"))
    shared = scratch.write(postings.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # keys alone meet by their bands; signatures come to those that met
    met = postings.join(shared.select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "band").join(unique.select("key", "sig"), "key")
    candidates = connected_components(_by_fingerprint(table, scratch).unionAll(_paired(met, "band", "sig", _by_signature)), scratch)

    roots = scratch.write(candidates.unionAll(candidates.select(F.col("root").alias("node"), "root")).distinct())
    placed = scratch.write(unique.join(roots, F.col("key") == F.col("node")).select("rep", "key", "root", "size"))
    blocks = placed.groupBy("root").agg(F.ceil(F.sum("size") * 8 / BLOCK_BYTES).cast("int").alias("blocks"))
    sets = scratch.write(_with_sets(docs, placed.join(blocks, "root").select("rep", "key", "root", "blocks")))
    groups = connected_components(_paired(sets, "root", "shingles", _by_similarity), scratch)
    named = unique.join(groups, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("root"))
    return table.select("doc_id", "text_hash", "key").join(named, "key").select("doc_id", "text_hash", "root")


def similar_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every row: component_id is the least doc_id reachable over pairs of LEAST_SIMILARITY or more, null where none has one."""
    found = groups_of_similar_texts(docs)
    return found.join(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each group the row of least doc_id (those without one last), then of least text_hash, once if it repeats."""
    found = groups_of_similar_texts(docs).withColumn("place", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash"))
    chosen = found.groupBy("root").agg(F.min("place").alias("kept")).select("kept.doc_id", "kept.text_hash").distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = own.withColumns({"doc_id": F.col("row.doc_id").cast("long"), "text_hash": F.xxhash64(_text("row.text"))})
    same = F.col("own.doc_id").eqNullSafe(F.col("chosen.doc_id")) & (F.col("own.text_hash") == F.col("chosen.text_hash"))
    return own.alias("own").join(chosen.alias("chosen"), same, "left_semi").dropDuplicates(["doc_id", "text_hash"]).select("row.*")
