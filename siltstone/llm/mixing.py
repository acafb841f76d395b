"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source, its documents in order of doc_id, are one stream, cut into blocks of
`block_words`. Its target says how many words the mix takes: whole epochs of all blocks, then blocks of
one more epoch in permuted order, the last one cut so that the words come out even. These draws are
split among output shards: the node of a range of shards divides its count of each source between its
two halves by a multivariate-hypergeometric draw whose seed is the range, so that any task finds the
exact quotas of its own shards by walking down from the root, and all quotas of a source add up. The
quotas are disjoint stretches of the source's permuted draws; a last permutation shuffles each shard.

All permutations are keyed Feistel networks on exactly the values below a bound, so a block's place
in an epoch, a draw's shard and its place there are computed and never sorted for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import lcm

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from siltstone.llm.common import Scratch, prefix_sums, text_buffers

#: Weights by rank of the source, repeating, and how often a source is taken at most.
WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 1024
SHARD_WORDS = 1 << 23
#: Draws in all, beyond which blocks get longer (numpy's hypergeometric draws are bounded by 10**9).
MOST_DRAWS = 1 << 28
#: Strata of the tree: a source each, or sources whose ranks are alike modulo this.
STRATA = 1 << 16
#: Draws of a stratum that are looked up together.
CELL = 64
_M32 = np.uint64(0xFFFFFFFF)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Mixture:
    """rows: (row, doc_id, source, size); plan: a row for each source; pieces: (row, shard, place, epoch, first_word, words); words of a row count from 0."""

    rows: DataFrame
    plan: DataFrame
    pieces: DataFrame
    texts: DataFrame | None


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Runs without ASCII white space in each text."""
    if not len(data):
        return np.zeros(len(offsets) - 1, np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    before = np.concatenate([[0], np.cumsum(begins)])
    return before[offsets[1:]] - before[offsets[:-1]]


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.empty(batch.num_rows, np.int64)
        text = batch.column(batch.num_columns - 1)
        for i in range(0, batch.num_rows, 256):
            part = text.slice(i, 256)
            sizes[i : i + len(part)] = word_counts(*text_buffers(part))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes)], names=[*batch.schema.names[:-1], "size"])


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of 0..n-1 for each key: four Feistel rounds on the next power of four, again until the value is below n."""
    x, n, key = (np.asarray(a).astype(np.uint64) for a in np.broadcast_arrays(x, n, key))
    half = (np.searchsorted(np.array([1 << 2 * i for i in range(1, 32)], np.uint64), n) + 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, left = x.copy(), np.arange(len(x))
    base = ((key & _M32) * np.uint64(0xC2B2AE3D)) & _M32
    while len(left):
        h, m, b, v = half[left], mask[left], base[left], out[left]
        a, c = v >> h, v & m
        for i in range(4):
            t = ((c + b + np.uint64(i * 0x27D4EB2F)) & _M32) * np.uint64(0x9E3779B1) & _M32
            t = (t ^ (t >> np.uint64(15))) * np.uint64(0x85EBCA77) & _M32
            a, c = c, a ^ ((t ^ (t >> np.uint64(13))) & m)
        out[left] = (a << h) | c
        left = left[out[left] >= n[left]]
    return out.astype(np.int64)


@F.pandas_udf(LongType())
def _permuted(x: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    known = (x.notna() & n.notna() & key.notna()).to_numpy()
    out = pd.Series(pd.NA, index=x.index, dtype="Int64")
    out[known] = permuted(*(a[known].to_numpy(np.int64) for a in (x, n, key)))
    return out


class Tree:
    """Quotas of strata in shards. Each node's draw depends on the seed and its range of shards alone."""

    def __init__(self, draws: list[int], shards: int, seed: int) -> None:
        self.draws, self.shards, self.seed, self.total = np.array(draws, np.int64), shards, seed, sum(draws)

    def end(self, shard: int) -> int:
        """Draws of all shards before this one; shards differ by one draw at most."""
        return self.total * shard // self.shards

    def leaves(self, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, counts, counts in all shards before it) of the shards from first up to last."""
        stack = [(0, self.shards, self.draws, np.zeros_like(self.draws))]
        while stack:
            lo, hi, counts, before = stack.pop()
            if hi <= first or lo >= last:
                continue
            if hi - lo == 1:
                yield lo, counts, before
                continue
            middle = (lo + hi) // 2
            random = np.random.Generator(np.random.Philox(np.random.SeedSequence([self.seed, lo, hi])))
            left = random.multivariate_hypergeometric(counts, self.end(middle) - self.end(lo), method="marginals")
            stack += [(middle, hi, counts - left, before + left), (lo, middle, left, before)]


def shard_quotas(spark: SparkSession, draws: list[int], shards: int, seed: int) -> DataFrame:
    """(stratum, shard, lo, hi, base, capacity): a stratum's draws from lo up to hi go to the shard, at base and on."""
    tree = spark.sparkContext.broadcast(Tree(draws, shards, seed))  # STRATA numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            for shard, counts, before in tree.value.leaves(int(ids[0]), int(ids[-1]) + 1):
                some = np.flatnonzero(counts)
                base = (np.cumsum(counts) - counts)[some]
                n = len(some)
                columns = [some, np.full(n, shard), before[some], before[some] + counts[some], base, np.full(n, counts.sum())]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["stratum", "shard", "lo", "hi", "base", "capacity"])

    return spark.range(0, shards, 1, -(-shards // 256)).mapInArrow(run, "stratum long, shard long, lo long, hi long, base long, capacity long")


def targets(scratch: Scratch, totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(rank, source, source_size, weight, capped, share, of, target) for each (source, source_size).

    Sources get their weights by code point, null last. Together they share the sum of all sizes; a
    source's part stops at `most` times its size, and what is over is shared again by weight. In order
    of size over weight, a source is capped if what is left for it and all after it, by weight, reaches
    its cap; the rest share what the capped leave: target = share * weight / of, in whole numbers.
    """
    if not weights or min(weights) < 1 or most < 1:
        raise ValueError("weights are whole numbers from 1 on, and a source may be taken once at least")
    common = lcm(*weights)
    named = prefix_sums(scratch, totals.withColumns({"one": F.lit(1).cast("long"), "unnamed": F.col("source").isNull().cast("int")}), [], ["unnamed", "source"], ["one"])
    ranked = named.withColumnRenamed("one_before", "rank").drop("one", "unnamed")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumns({"relative": F.expr(f"source_size * {common} div weight"), "cap": F.col("source_size") * most})
    filled = scratch.write(prefix_sums(scratch, ranked, [], ["relative", "rank"], ["cap", "weight"]).drop("relative"))
    total, of_all = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    wide = "decimal(38,0)"
    reached = (F.lit(total) - F.col("cap_before")).cast(wide) * F.col("weight") >= F.col("cap").cast(wide) * (F.lit(of_all) - F.col("weight_before"))
    filled = filled.withColumn("capped", reached)
    taken, of = filled.agg(F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))), F.lit(0))).first()
    share = F.col("weight") * (total - taken)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share.cast("double") / F.lit(max(of, 1)).cast("double"))
    words = F.when(F.col("capped"), F.col("cap")).otherwise(F.expr(f"(2 * weight * {total - taken}L + {of}L) div {2 * max(of, 1)}L"))
    return filled.select("rank", "source", "source_size", "weight", target.alias("target"), words.alias("target_words"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 11, with_text: bool = False) -> Mixture:
    """Mixes the documents' words (runs without ASCII white space).

    A text that is null or has no word has size 0: none of it is taken, and a source of such texts
    alone has target 0. Null is a source of its own; a null doc_id comes first in its source. Rows that
    repeat are each taken by their own place in the stream. Other columns take no part. An empty table
    gives empty frames. The words that the mix takes of a source are its target, rounded; no word is
    taken more than `most` times. The same table gives the same mix, whatever its partitions.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mix")
    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    numbered = taken.withColumn("row", F.monotonically_increasing_id())
    texts = None
    if with_text:
        numbered = texts = scratch.write(numbered)
    sized = numbered.select("row", "doc_id", "source", "text_hash", "text").mapInArrow(_sized, "row long, doc_id long, source string, text_hash long, size long")
    rows = scratch.write(sized)
    plan = scratch.write(targets(scratch, rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    words, parts = plan.agg(F.coalesce(F.sum("target_words"), F.lit(0)), F.count(F.lit(1))).first()
    while words // block_words + (most + 1) * parts > MOST_DRAWS and words > block_words:
        block_words *= 2
    draws = scratch.write(_draws(plan, block_words, most))

    order = F.broadcast if parts <= STRATA else lambda df: df
    streams = rows.join(order(plan.select("source", "rank")), rows["source"].eqNullSafe(plan["source"])).select("row", "doc_id", "text_hash", "size", "rank").where("size > 0")
    placed = prefix_sums(scratch, streams, ["rank"], ["doc_id", "text_hash", "size", "row"], ["size"])
    blocks = placed.withColumn("block", F.explode(F.expr(f"sequence(size_before div {block_words}, (size_before + size - 1) div {block_words})")))
    begin = F.greatest("size_before", F.col("block") * block_words)
    end = F.least(F.col("size_before") + F.col("size"), (F.col("block") + 1) * block_words)
    pieces = blocks.select("row", "rank", "block", (begin - F.col("size_before")).alias("first_word"), (begin - F.col("block") * block_words).alias("at"), (end - begin).alias("words"))
    drawn = pieces.join(order(draws), "rank").withColumn("epoch", F.explode(F.expr("sequence(0, IF(rest > 0, full, full - 1))"))).where("epoch <= full AND NOT (full = 0 AND rest = 0)")
    drawn = drawn.withColumn("in_epoch", _permuted("block", "blocks", F.col("rank") * (most + 1) + F.col("epoch")))
    before = F.expr(f"in_epoch * {block_words} - IF(short_place < in_epoch, {block_words} - short, 0)")
    until = F.when(F.col("epoch") < F.col("full"), F.col("words")).otherwise(F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - before - F.col("at"))))
    drawn = drawn.withColumn("words", until.cast("long")).where("words > 0")
    drawn = drawn.select("row", "epoch", "first_word", "at", "words", "stratum", _permuted(F.expr("offset + epoch * blocks + in_epoch"), "stratum_draws", F.col("stratum") + 0x51ED270B).alias("position"))

    totals = {r["stratum"]: r["n"] for r in draws.groupBy("stratum").agg(F.max("stratum_draws").alias("n")).collect()}  # STRATA rows at most
    counts = [totals.get(i, 0) for i in range(max(totals, default=-1) + 1)]
    shards = max(1, -(-sum(counts) * block_words // shard_words))
    cells = shard_quotas(spark, counts, shards, seed).withColumn("cell", F.explode(F.expr(f"sequence(lo div {CELL}, (hi - 1) div {CELL})")))
    dealt = drawn.withColumn("cell", F.expr(f"position div {CELL}")).join(cells, ["stratum", "cell"]).where("position >= lo AND position < hi")
    shuffled = dealt.withColumn("place", _permuted(F.expr("base + position - lo"), "capacity", F.col("shard") + 0x2545F491))
    return Mixture(rows, plan, shuffled.select("row", "shard", "place", F.col("at").alias("place_at"), "epoch", "first_word", "words"), texts)


def _draws(plan: DataFrame, block_words: int, most: int) -> DataFrame:
    """For each source with words: its blocks, the whole epochs and the words of one more, how many blocks those take, and where its draws begin among its stratum's."""
    from pyspark.sql import Window

    split = plan.where("source_size > 0").selectExpr("rank", "source_size", f"(source_size + {block_words - 1}) div {block_words} AS blocks", "target_words div source_size AS full", "target_words % source_size AS rest", f"rank % {STRATA} AS stratum")
    split = split.withColumn("short", F.col("source_size") - (F.col("blocks") - 1) * block_words)
    split = split.withColumn("short_place", _permuted(F.col("blocks") - 1, "blocks", F.col("rank") * (most + 1) + F.col("full")))
    last = F.expr(f"""CASE WHEN rest <= short_place * {block_words} THEN (rest + {block_words - 1}) div {block_words} WHEN rest <= short_place * {block_words} + short THEN short_place + 1
        ELSE short_place + 1 + (rest - short_place * {block_words} - short + {block_words - 1}) div {block_words} END""")
    counted = split.withColumn("n", F.col("full") * F.col("blocks") + last)
    stratum = Window.partitionBy("stratum")
    offset = F.coalesce(F.sum("n").over(stratum.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.select("rank", "blocks", "full", "rest", "short", "short_place", "stratum", offset.alias("offset"), F.sum("n").over(stratum).alias("stratum_draws"))


def mixed_texts(mixed: Mixture) -> DataFrame:
    """(shard, place, place_at, doc_id, source, epoch, text): the mix itself; a shard in order of place and place_at is its shuffled sequence of blocks. Needs with_text."""
    if mixed.texts is None:
        raise ValueError("the mixture was made without texts")
    words = F.regexp_extract_all("text", F.lit("[^ \\t-\\r]+"), F.lit(0))
    joined = mixed.pieces.join(mixed.texts.select("row", "doc_id", "source", "text"), "row")
    cut = F.concat_ws(" ", F.slice(words, (F.col("first_word") + 1).cast("int"), F.col("words").cast("int")))
    return joined.select("shard", "place", "place_at", "doc_id", "source", "epoch", cut.alias("text"))


def write_shards(mixed: Mixture, path: str) -> None:
    """Writes the mix as a folder for each shard, in its shuffled order."""
    mixed_texts(mixed).repartition("shard").sortWithinPartitions("shard", "place", "place_at").write.partitionBy("shard").parquet(path)


def words_taken(mixed: Mixture) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    taken = mixed.pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    sources = mixed.plan.select(F.col("source").alias("of_source"), "source_size", "target")
    found = mixed.rows.join(sources, F.col("source").eqNullSafe(F.col("of_source"))).join(taken, "row", "left")
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _mixed_number(value: str) -> str:
    """One round's function in SQL, of a value and a key below 2**32."""
    a = f"((({value}) & 4294967295::UBIGINT) * 2654435761::UBIGINT & 4294967295::UBIGINT)"
    b = f"(xor({a}, {a} >> 15) * 2246822519::UBIGINT & 4294967295::UBIGINT)"
    return f"xor({b}, {b} >> 13)"


#: taken depends on the permutation of a source's blocks and not on the split into shards. (Blocks of BLOCK_WORDS: below MOST_DRAWS.)
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT *, {MOST} * source_size AS cap, ([{", ".join(map(str, WEIGHTS))}])[1 + rank % {len(WEIGHTS)}] AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source)
), f AS (
  SELECT *, (t - coalesce(sum(cap) OVER w, 0)) * weight >= cap * (v - coalesce(sum(weight) OVER w, 0)) AS capped
  FROM s, (SELECT sum(source_size) AS t, sum(weight) AS v FROM s)
  WINDOW w AS (ORDER BY source_size * {lcm(*WEIGHTS)} // weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT CAST(any_value(t) - coalesce(sum(cap) FILTER (capped), 0) AS BIGINT) AS share, CAST(coalesce(sum(weight) FILTER (NOT capped), 0) AS BIGINT) AS parts FROM f
), p AS (
  SELECT rank, source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(weight * share AS DOUBLE) / CAST(parts AS DOUBLE) END AS target,
    CASE WHEN capped THEN cap ELSE (2 * weight * share + parts) // (2 * parts) END AS words FROM f, g
), e AS (
  SELECT *, CAST((source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} AS UBIGINT) AS blocks, words // source_size AS full_epochs, words % source_size AS rest FROM p WHERE source_size > 0
), k AS (
  SELECT *, (CAST(rank * {MOST + 1} + full_epochs AS UBIGINT) * 3266489917::UBIGINT) & 4294967295::UBIGINT AS base, (SELECT min(i) FROM range(1, 31) t(i) WHERE (1::HUGEINT << (2 * i)) >= blocks) AS half FROM e
), x AS (
  SELECT rank, b AS block, CAST(b AS UBIGINT) >> half AS l, CAST(b AS UBIGINT) & ((1::UBIGINT << half) - 1) AS r, 0 AS step FROM (SELECT *, unnest(range(0, CAST(blocks AS BIGINT))) AS b FROM k)
  UNION ALL
  SELECT x.rank, block, r, xor(l, {_mixed_number("r + base + CAST(step % 4 AS UBIGINT) * 668265263::UBIGINT")} & ((1::UBIGINT << half) - 1)), step + 1
  FROM x JOIN k ON x.rank = k.rank WHERE NOT (step > 0 AND step % 4 = 0 AND ((l << half) | r) < blocks)
), y AS (
  SELECT k.*, block, CAST((l << half) | r AS BIGINT) AS place, least({BLOCK_WORDS}, source_size - block * {BLOCK_WORDS}) AS length
  FROM x JOIN k ON x.rank = k.rank WHERE step > 0 AND step % 4 = 0 AND ((l << half) | r) < blocks
), z AS (
  SELECT rank, block, full_epochs, greatest(0, least(length, rest - coalesce(sum(length) OVER (PARTITION BY rank ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS more FROM y
), o AS (
  SELECT d.*, p.rank, p.source_size, p.target, coalesce(sum(size) OVER (PARTITION BY p.rank ORDER BY doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun, row_number() OVER () AS n
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), q AS (
  SELECT n, sum(full_epochs * (least(begun + size, (block + 1) * {BLOCK_WORDS}) - greatest(begun, block * {BLOCK_WORDS})) + greatest(0, least(begun + size, block * {BLOCK_WORDS} + more) - greatest(begun, block * {BLOCK_WORDS}))) AS taken
  FROM o JOIN z ON o.rank = z.rank AND z.block BETWEEN begun // {BLOCK_WORDS} AND (begun + size - 1) // {BLOCK_WORDS} WHERE size > 0 GROUP BY n
)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM o LEFT JOIN q ON o.n = q.n
"""
