"""Bounded views of sources from a stored index of their lines: pages with a cursor, tails, searches and greps.

The index has a row for each line of a live document, sorted by document and line, so a view reads its
documents' rows alone. A view is of any number of documents at once; each has its own limits. What is
beyond a limit is told: `truncated`, and `next_cursor`, the line to go on from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from siltstone.expr.text import occurrences, within_bytes

#: A view's limits, whatever is asked for: lines, bytes, lines of context, matches.
MOST_LINES, MOST_BYTES, MOST_CONTEXT, MOST_MATCHES = 2000, 1 << 18, 20, 100


def line_index(documents: DataFrame) -> DataFrame:
    """(customer_id, doc_id, version, line, begin, total, content): lines from 1, their first byte in the body, and how many lines there are."""
    split = documents.where("body is not null").select("customer_id", "doc_id", "version", F.split("body", "\n").alias("lines"))
    placed = split.select("customer_id", "doc_id", "version", F.size("lines").cast("long").alias("total"), F.posexplode("lines").alias("place", "content"))
    before = Window.partitionBy("doc_id", "version").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.octet_length("content") + 1).over(before), F.lit(0)).cast("long")
    return placed.select("customer_id", "doc_id", "version", (F.col("place") + 1).cast("long").alias("line"), begin.alias("begin"), "total", "content")


def _asked(lines: DataFrame, asked: DataFrame | list[str]) -> DataFrame:
    """The rows of some documents: a few by a filter that files are skipped by, a table of them by a join."""
    if isinstance(asked, list):
        return lines.where(F.col("doc_id").isin(*asked) if asked else F.lit(False))
    return lines.join(asked.select("doc_id").distinct(), "doc_id", "left_semi")


def page(lines: DataFrame, asked: DataFrame | list[str], start: int = 1, most_lines: int = 200, most_bytes: int = 1 << 16, tail: bool = False) -> DataFrame:
    """(doc_id, line, content, next_cursor, truncated): lines from `start` on, or the last ones, within so many lines and bytes.

    A line counts with its end. A first line that is too long alone is cut to whole characters. A page
    beyond the end has no rows. A tail has no cursor.
    """
    most_lines, most_bytes = min(most_lines, MOST_LINES), min(most_bytes, MOST_BYTES)
    first = F.greatest(F.lit(1), F.col("total") - most_lines + 1) if tail else F.lit(max(1, start))
    near = _asked(lines, asked).withColumn("first", first.cast("long")).where(F.col("line").between(F.col("first"), F.col("first") + most_lines - 1))
    order = Window.partitionBy("doc_id").orderBy("line")
    running = F.sum(F.octet_length("content") + 1).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = near.withColumn("running", running).where((F.col("running") <= most_bytes) | (F.col("line") == F.col("first")))
    last = F.max("line").over(Window.partitionBy("doc_id"))
    over = F.col("running") > most_bytes
    shown = kept.withColumn("last", last).withColumn("content", F.when(over, within_bytes(F.col("content"), most_bytes)).otherwise(F.col("content")))
    more = F.col("last") < F.col("total")
    cut = F.max(over).over(Window.partitionBy("doc_id"))
    if tail:
        return shown.select("doc_id", "line", "content", F.lit(None).cast("long").alias("next_cursor"), ((F.col("first") > 1) | more | cut).alias("truncated"))
    return shown.select("doc_id", "line", "content", F.when(more, F.col("last") + 1).alias("next_cursor"), (more | cut).alias("truncated"))


def grep(lines: DataFrame, asked: DataFrame | list[str], pattern: str, literal: bool = False, context: int = 3, most_matches: int = 20) -> DataFrame:
    """(doc_id, section, line_start, line_end, line, content, matched): the first matching lines of each document with lines around them; matches whose surroundings meet are one section.

    pattern: a regular expression, or a literal in any case.
    """
    context, most_matches = min(context, MOST_CONTEXT), min(most_matches, MOST_MATCHES)
    own = _asked(lines, asked)
    hit = F.contains(F.lower("content"), F.lit(pattern.lower())) if literal else F.col("content").rlike(pattern)
    order = Window.partitionBy("doc_id").orderBy("line")
    found = own.where(hit).select("doc_id", "line", F.row_number().over(order).alias("rn")).where(F.col("rn") <= most_matches)
    around = found.select("doc_id", F.explode(F.sequence(F.col("line") - context, F.col("line") + context)).alias("line"), (F.col("line")).alias("of"))
    wanted = around.groupBy("doc_id", "line").agg(F.max(F.col("line") == F.col("of")).alias("matched"))
    shown = own.select("doc_id", "line", "content").join(wanted, ["doc_id", "line"])
    opened = shown.withColumn("new", (F.col("line") - F.coalesce(F.lag("line").over(order), F.lit(-1)) > 1).cast("long"))
    numbered = opened.withColumn("section", F.sum("new").over(order))
    within = Window.partitionBy("doc_id", "section")
    return numbered.select("doc_id", "section", F.min("line").over(within).alias("line_start"), F.max("line").over(within).alias("line_end"), "line", "content", "matched")


def term_score(text: Column, query: str) -> Column:
    """Occurrences of the query's terms in any case, all of them."""
    out = F.lit(0).cast("long")
    for term in dict.fromkeys(query.lower().split()):
        out = out + occurrences(F.lower(text), F.lit(term))
    return out


def search(chunks: DataFrame, asked: DataFrame | list[str], query: str, most_matches: int = 20, most_bytes: int = 1 << 16) -> DataFrame:
    """(doc_id, rank, chunk_id, chunk_index, score, content): each document's live chunks by how often they hold the query's terms, within so many bytes; the first alone is cut to whole characters."""
    most_matches, most_bytes = min(most_matches, MOST_MATCHES), min(most_bytes, MOST_BYTES)
    own = _asked(chunks.where("valid_to is null"), asked)
    scored = own.select("doc_id", "chunk_id", "chunk_index", "content", term_score(F.col("content"), query).alias("score")).where("score > 0")
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "chunk_index", "chunk_id")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_matches)
    running = F.sum(F.octet_length("content")).over(Window.partitionBy("doc_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = best.withColumn("running", running).where((F.col("running") <= most_bytes) | (F.col("rank") == 1))
    return kept.select("doc_id", "rank", "chunk_id", "chunk_index", "score", F.when(F.col("running") > most_bytes, within_bytes(F.col("content"), most_bytes)).otherwise(F.col("content")).alias("content"))


def whole(lines: DataFrame, asked: DataFrame | list[str], most_bytes: int) -> DataFrame:
    """(doc_id, version, bytes, too_large, text) of whole documents; one of more than `most_bytes` has no text."""
    own = _asked(lines, asked)
    sized = own.groupBy("doc_id", "version").agg(F.max(F.col("begin") + F.octet_length("content")).alias("bytes"))
    small = own.join(sized.where(F.col("bytes") <= most_bytes).select("doc_id", "version"), ["doc_id", "version"])
    texts = small.groupBy("doc_id", "version").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda r: r["content"]), "\n").alias("text"))
    return sized.join(texts, ["doc_id", "version"], "left").select("doc_id", "version", "bytes", (F.col("bytes") > most_bytes).alias("too_large"), "text")
