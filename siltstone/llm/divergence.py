"""An audit of how the sources of a language differ in their words, by sketch-prefiltered counting.

Each task counts its own texts' terms. From those counts a count-min sketch of document frequencies is
made: a task's counters are merged, block by block, into one sketch whose estimates are never too low,
so a term whose estimate is below the least document frequency is discarded before anything is
shuffled by term. The survivors are counted exactly, and those that still fall short go. Smoothed
shares of kept terms are whole numbers (billionths, rounded down, plus one), and sums of differences
over all kept terms come from sparse joins: for two sources, terms that both have are joined; a term
that only one has differs from the other's constant share of absent terms, which the one's histogram of
counts sums without the terms; all other terms differ by one constant.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from siltstone.llm.common import Scratch

#: Documents of the language that a kept term is in at least; smoothing; term ranks that are reported.
LEAST_DOCUMENTS, SMOOTHING, TOP_TERMS = 30, 5, 50
BILLION = 1_000_000_000
#: Counters of a sketch: rows of a power of two each, within these bounds. One is a byte, which holds the least frequency and no more.
DEPTH, LEAST_BITS, MOST_BITS = 3, 16, 23
#: Counters that are merged as one row, and rows of one block that are merged in the first round.
BLOCK, FIRST_MERGE = 1 << 14, 64
#: Distinct terms that a task counts before it hands them on, and bytes of a text that are cut into terms at a time.
COUNTED, STRETCH = 800_000, 1 << 20

_TERM = re.compile(rb"[a-z\x80-\xff]+")


def terms(text: memoryview) -> Iterator[list[bytes]]:
    """Lower-cased runs of ASCII letters and of all characters beyond ASCII, a stretch of the text at a time."""
    begin, n = 0, len(text)
    while begin < n:
        part = bytes(text[begin : begin + STRETCH])
        end = begin + len(part)
        while end < n and (text[end] >= 0x80 or 0x41 <= text[end] & 0xDF <= 0x5A):  # a term isn't cut
            more = bytes(text[end : end + 4096]).lower()
            inside = _TERM.match(more)
            end += inside.end() if inside else 0
        yield _TERM.findall(bytes(text[begin:end]).lower() if end > begin + len(part) else part.lower())
        begin = end


class TermCounts:
    """Counts of (lang, source, term): documents and occurrences."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.size = 0

    def add(self, lang: str, source: str, text: memoryview) -> None:
        documents, occurrences = self.groups.setdefault((lang, source), (Counter(), Counter()))
        before, own = len(documents), set()
        for part in terms(text):
            occurrences.update(part)
            own.update(part)
        documents.update(own)
        self.size += len(documents) - before

    def batches(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), (documents, occurrences) in self.groups.items():
            found = list(occurrences)
            for i in range(0, len(found), 50_000):
                some = found[i : i + 50_000]
                columns = [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(map(documents.__getitem__, some)), pa.int64()), pa.array(list(map(occurrences.__getitem__, some)), pa.int64())], names=["lang", "source", "term", "docs", "n"])
        self.groups.clear()
        self.size = 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = TermCounts()
    for batch in batches:
        text = batch.column(2)
        data = memoryview(text.buffers()[2]).cast("B") if batch.num_rows and text.buffers()[2] is not None else memoryview(b"")
        offsets = np.frombuffer(text.buffers()[1], np.int64 if pa.types.is_large_string(text.type) else np.int32)[text.offset : text.offset + batch.num_rows + 1].tolist() if batch.num_rows else []
        for lang, source, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), offsets, offsets[1:], strict=False):
            counts.add(lang, source, data[a:b])
            if counts.size > COUNTED:
                yield from counts.batches()
    yield from counts.batches()


def _cells(hashed: np.ndarray, bits: int) -> np.ndarray:
    """The counter of each hash in each row of the sketch, numbered through all rows."""
    with np.errstate(over="ignore"):
        h = hashed.astype(np.uint64)
        step = ((h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        rows = [((h + np.uint64(i) * step) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits) for i in range(DEPTH)]
    return np.stack([r.astype(np.int64) + (i << bits) for i, r in enumerate(rows)])


def _sketch_blocks(counters: np.ndarray) -> pa.RecordBatch:
    """Blocks of counters that aren't all zero."""
    blocks = counters.reshape(-1, BLOCK)
    some = np.flatnonzero(blocks.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([blocks[i].tobytes() for i in some], pa.binary())], names=["block", "counters"])


def sketch(spark: SparkSession, scratch: Scratch, partial: DataFrame, bits: int, least: int) -> np.ndarray:
    """One bit for each counter of the merged sketch: whether it reaches the least frequency. At most DEPTH * 2**MOST_BITS bits (3 MB)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(DEPTH << bits, np.int32)
        for batch in batches:
            np.add.at(counters, _cells(batch.column(0).to_numpy(), bits).reshape(-1), np.tile(np.minimum(batch.column(1).to_numpy(), least), DEPTH).astype(np.int32))
        yield _sketch_blocks(np.minimum(counters, least).astype(np.uint8))

    def merged(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        """Rows come sorted, so that one block's counters are held at a time. The last round gives bits."""
        key, total = None, np.zeros(0, np.int64)

        def done() -> pa.RecordBatch:
            out = np.packbits(total >= least) if last else total.astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=["block", "counters"])

        for batch in batches:
            for block, part, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                values = np.frombuffer(raw, np.uint8).astype(np.int64)
                if key == (block, part):
                    total = np.minimum(total + values, least)
                    continue
                if key is not None:
                    yield done()
                key, total = (block, part), values
        if key is not None:
            yield done()

    schema = "block long, counters binary"
    blocks = partial.select(F.xxhash64("lang", "term").alias("hash"), "docs").mapInArrow(made, schema).withColumn("part", F.spark_partition_id() % FIRST_MERGE)
    for last in (False, True):
        ordered = blocks.select("block", "part", "counters").repartition("block", "part").sortWithinPartitions("block", "part")
        blocks = ordered.mapInArrow(lambda batches, last=last: merged(batches, last), schema).withColumn("part", F.lit(0))
    out = np.zeros((DEPTH << bits) // 8, np.uint8)
    for row in blocks.select("block", "counters").collect():
        out[row["block"] * BLOCK // 8 : (row["block"] + 1) * BLOCK // 8] = np.frombuffer(row["counters"], np.uint8)
    return out


def survivors(spark: SparkSession, scratch: Scratch, partial: DataFrame, least: int) -> DataFrame:
    """The partial counts of terms whose estimated document frequency reaches the least one; a counter of the sketch gets 8 to 16 of them on average, within bounds."""
    bits = min(MOST_BITS, max(LEAST_BITS, (int(partial.count()) // 16).bit_length()))
    known = spark.sparkContext.broadcast(sketch(spark, scratch, partial, bits, min(least, 255)))  # what a byte holds; beyond it more terms are counted exactly

    @F.pandas_udf("boolean")
    def reaches(hashed: pd.Series) -> pd.Series:
        cells = _cells(hashed.to_numpy(np.int64), bits)
        return pd.Series((known.value[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).all(axis=0))

    return partial.where(reaches(F.xxhash64("lang", "term")))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(billion * (count + smoothing) / (total + smoothing * kept)), by long division in base 1000, which stays within 64 bits; 1 where no term is kept."""
    of = F.nullif(total + SMOOTHING * kept, F.lit(0).cast("long"))
    rest, out = count + SMOOTHING, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, of)
        rest = (rest * 1000) % of
    return F.coalesce(out + 1, F.lit(1).cast("long"))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how a source's words differ from each other source's of its language, and its most overused terms.

    Null text, lang and source are read as ''. Every (lang, source) that occurs has its pairs, even
    without terms; with no kept term all differences are 0. A language's single source has no pairs.
    Ties in value go by the item's UTF-8. Repeated rows each count as a document; doc_ids and other
    columns take no part; an empty table gives no rows. Texts of any length are counted whole.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "divergence")
    group = ["lang", "source"]
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*group, "text")))
    partial = scratch.write(texts.mapInArrow(_count, "lang string, source string, term string, docs long, n long"))
    alive = survivors(spark, scratch, partial, least)
    counted = scratch.write(alive.groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")))
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("of_lang")).where(F.col("docs") >= least).drop("docs")
    counts = scratch.write(counted.drop("docs").join(kept, ["lang", "term"]))
    totals = counts.groupBy(*group).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    langs = counts.groupBy("lang").agg(F.countDistinct("term").alias("kept"), F.sum("n").alias("lang_total"))
    joined = texts.select(*group).distinct().join(totals, group, "left").join(langs, "lang", "left").fillna(0)
    groups = scratch.write(joined.withColumn("absent", _share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))))
    shares = scratch.write(counts.join(groups, group).select(*group, "term", "absent", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), _share(F.col("of_lang"), F.col("lang_total"), F.col("kept")).alias("q")))

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "item")))

    over = ranked(shares.where("p > q").select(*group, F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))).where(F.col("rank") <= top)
    sums = _pair_sums(groups, shares)
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.select("lang", ways.alias("way"), "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    return ranked(pairs).unionByName(over)


def _pair_sums(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, a, b, value), a before b: the sum over all kept terms of the differences of their shares."""
    this = groups.select("lang", F.col("source").alias("a"), F.col("terms").alias("a_terms"), F.col("absent").alias("a_absent"), "kept")
    that = groups.select("lang", F.col("source").alias("b"), F.col("terms").alias("b_terms"), F.col("absent").alias("b_absent"))
    absent = this.join(that, "lang").where("a < b").selectExpr("lang", "a", "b", "(kept - a_terms - b_terms) * abs(a_absent - b_absent) AS value")
    histogram = shares.groupBy("lang", F.col("source").alias("of"), "p").agg(F.count(F.lit(1)).alias("m"))
    alone = histogram.join(that, "lang").where("of <> b").selectExpr("lang", "least(of, b) AS a", "greatest(of, b) AS b", "m * abs(p - b_absent) AS value")
    left = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("a_p"), F.col("absent").alias("a_absent"))
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("b_p"), F.col("absent").alias("b_absent"))
    more = "abs(a_p - b_p) - abs(a_p - b_absent) - abs(a_absent - b_p) + abs(a_absent - b_absent)"
    both = left.join(right, ["lang", "term"]).where("a < b").selectExpr("lang", "a", "b", f"{more} AS value")
    return absent.unionByName(alone).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


#: The same from all groups and all kept terms, zeros included.
SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), w AS (
  SELECT d, lang, source, unnest(words) AS term FROM t
), k AS (
  SELECT lang, term, count(*) AS of_lang FROM w GROUP BY lang, term HAVING count(DISTINCT d) >= {LEAST_DOCUMENTS}
), l AS (
  SELECT lang, count(*) AS v, sum(of_lang) AS n FROM k GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term
), g AS (
  SELECT DISTINCT lang, source FROM t
), f AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.of_lang FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT f.lang, f.source, term, f.n, 1 + ({BILLION}::HUGEINT * (f.n + {SMOOTHING})) // (sum(f.n) OVER (PARTITION BY f.lang, f.source) + {SMOOTHING} * l.v) AS p, 1 + ({BILLION}::HUGEINT * (of_lang + {SMOOTHING})) // (l.n + {SMOOTHING} * l.v) AS q FROM f JOIN l ON l.lang = f.lang
), x AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
