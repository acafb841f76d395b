"""Filtered lists, counts and groups of versioned documents."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from siltstone.expr.temporal import Temporal, document_predicate
from siltstone.store import literal_rows

GROUP_KEYS = ("source_system", "doc_type", "author_id")


@dataclass(frozen=True)
class Filters:
    sources: tuple[str, ...] = ()
    doc_types: tuple[str, ...] = ()
    author_ids: tuple[str, ...] = ()
    source_keys: tuple[str, ...] | None = None
    keyless: bool = False
    temporal: Temporal = field(default_factory=Temporal)
    drafts: bool = False


def source_key_predicate(keys: tuple[str, ...] | None, keyless: bool) -> Column:
    """Any key where none are asked for; else one of them, and rows without a key if keyless."""
    if keys is None:
        return F.lit(True)
    chosen = F.col("source_key").isin(*keys)
    return chosen | F.col("source_key").isNull() if keyless else chosen


def filtered(documents: DataFrame, f: Filters) -> DataFrame:
    out = documents.where(document_predicate(f.temporal)).where(source_key_predicate(f.source_keys, f.keyless))
    for column, values in (("source_system", f.sources), ("doc_type", f.doc_types), ("author_id", f.author_ids)):
        if values:
            out = out.where(F.col(column).isin(*values))
    return out if f.drafts else out.where("visibility = 'approved'")


def count_documents(documents: DataFrame, f: Filters) -> DataFrame:
    return filtered(documents, f).agg(F.count(F.lit(1)).alias("n"))


def group_documents(documents: DataFrame, key: str, f: Filters, k: int) -> DataFrame:
    """The k largest groups; a missing author is a group. Ties by key, nulls last."""
    if key not in GROUP_KEYS:
        raise ValueError(f"can't group by {key}")
    return filtered(documents, f).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("key")).limit(k)


def list_documents(documents: DataFrame, chunks: DataFrame, f: Filters, k: int, sort: str = "updated_at", descending: bool = True) -> DataFrame:
    """The first k documents, then the first live chunk of each; documents without one drop out. score is 1 / (1 + place)."""
    order = [F.desc(sort) if descending else F.asc(sort), F.asc("doc_id")]
    top = filtered(documents, f).orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)
    live = chunks.where("valid_to is null").select("doc_id", "chunk_id", "chunk_index", "content", "first_seen_version", "last_seen_version")
    joined = top.join(live, "doc_id").where("version between first_seen_version and last_seen_version")
    first = Window.partitionBy("doc_id", "version").orderBy("chunk_index", "chunk_id")
    return joined.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("doc_id", "version", "chunk_id", (1.0 / (1 + F.col("place"))).alias("score"))


def with_versions(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks joined to the versions that hold them: equal keys, and the version in the chunk's range."""
    c = chunks.select("customer_id", "doc_id", "chunk_id", "chunk_index", "first_seen_version", "last_seen_version")
    return c.join(documents.drop("title", "body"), ["customer_id", "doc_id"]).where("version between first_seen_version and last_seen_version")


def page_of_chunks(chunks: DataFrame, doc_id: str, n: int, offset: int) -> DataFrame:
    return chunks.where(F.col("doc_id") == doc_id).orderBy("chunk_index", "chunk_id").offset(offset).limit(n).select("chunk_id", "chunk_index", "n_tokens")


def chunk_window(chunks: DataFrame, targets: DataFrame, before: int, after: int) -> DataFrame:
    """Chunks around each target chunk: an equi-join on the document with a range beside it."""
    near = targets.select("doc_id", F.col("chunk_index").alias("at"), F.col("chunk_id").alias("target"))
    return chunks.join(near, "doc_id").where(F.col("chunk_index").between(F.col("at") - before, F.col("at") + after)).select("target", "chunk_id", "chunk_index")


def source_page(documents: DataFrame, after: str, n: int) -> DataFrame:
    """Live, undeleted documents beyond a cursor, in order."""
    return documents.where("valid_to is null and deleted_at is null").where(F.col("doc_id") > after).orderBy("doc_id").limit(n).select("doc_id", "version")


def near_in_time(documents: DataFrame, anchors: DataFrame, hours: int, k: int) -> DataFrame:
    """(own, doc_id, version): the k documents of each anchor (doc_id, updated_at) that changed within some hours of it, the newest first.

    An equi-join on spans of that many hours: what is near lies in an anchor's span or in one beside it.
    """
    seconds = hours * 3600

    def span(time: str) -> Column:
        return F.floor(F.unix_seconds(time) / seconds)

    mine = anchors.select(F.col("doc_id").alias("own"), F.col("updated_at").alias("at")).withColumn("span", F.explode(F.array(*[span("at") + i for i in (-1, 0, 1)])))
    theirs = documents.withColumn("span", span("updated_at"))
    apart = F.abs(F.unix_micros("updated_at") - F.unix_micros("at")) <= F.lit(seconds * 1_000_000)
    near = theirs.join(mine, "span").where(apart & (F.col("doc_id") != F.col("own")))
    place = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("updated_at"), "doc_id"))
    return near.withColumn("place", place).where(F.col("place") <= k).drop("span", "at", "place")


def by_exact_id(documents: DataFrame, ids: list[str]) -> DataFrame:
    """Live documents whose source's id, own id or address ends in one of the ids: each with the first that fits, in the order given."""
    asked = literal_rows(documents.sparkSession, list(enumerate(ids)), "place int, asked string")
    keys = F.explode(F.array_distinct(F.array("source_id", "doc_id", F.regexp_extract("source_url", "([^/]+)/?$", 1))))
    named = documents.where("valid_to is null").withColumn("asked", keys).join(asked, "asked")
    return named.groupBy("doc_id", "version", "source_id", "source_url").agg(F.min("place").alias("place"))


def entity_documents(symmetric_edges: DataFrame, nodes: DataFrame, label: str, values: list[str]) -> DataFrame:
    """Documents with a live edge, in either direction, to a node of the label that matches a value.

    A value matches an id or name without regard to case, an id's part after its last slash or colon, or
    either with all but letters and digits left out.
    """
    lower = [v.lower() for v in values]
    plain = ["".join(c for c in v if c.isascii() and c.isalnum()) for v in lower]
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    hit = F.lower("canonical_id").isin(*lower) | F.regexp_replace(F.lower("canonical_id"), "^.*[/:]", "").isin(*lower) | F.lower("name").isin(*lower) | bare("canonical_id").isin(*plain) | bare("name").isin(*plain)
    chosen = nodes.where(F.col("label") == label).where(hit).select(F.col("canonical_id").alias("b"))
    return symmetric_edges.where("live").join(chosen, "b", "left_semi").where(F.col("a").startswith("Document:")).select(F.col("a").alias("document")).distinct()


def version_rows(documents: DataFrame) -> DataFrame:
    """The latest version of each document: one aggregation, no sort."""
    return documents.groupBy("doc_id").agg(F.max_by("source_system", "version").alias("source_system"), F.max("version").alias("version"))
