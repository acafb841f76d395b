"""The model's tables, derived from the star-schema tables of a folder.

Every frame is a DataFrame with fixed columns; nothing is cached or collected. Rows of one tenant are
those of its keys, and an edge is a tenant's if both its ends are. Chunks, postings, nodes, edges and
the search indexes are derived once for all tenants and stored, a folder for each (see siltstone.store);
`Frames.of(tenant)` reads the tenant's folders alone, and counts, degrees and statistics are its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from siltstone.expr.text import tokens
from siltstone.model.vocabulary import CHUNK_OVERLAP, CHUNK_TOKENS, CONFIDENCE
from siltstone.operators import source_view, text_index, vector_index
from siltstone.store import stored

EPOCH = "timestamp'2024-01-01 00:00:00'"
WORDS = "[^ \\t\\n\\r]+"
GRAPH_SOURCES = ["orders", "lineitem", "supplier"]
NODE_SOURCES = [*GRAPH_SOURCES, "customer", "part"]
#: Lines that one task of a build of edges gets, or about so many.
TASK_ROWS = 500_000
#: Tokens that one step of a build of postings counts, or those of one chunk; and rows that it hands on at once.
STEP_TOKENS, MADE_ROWS = 1 << 18, 1 << 14
#: Stands for a tenant on edges between two tenants' nodes.
SHARED = "shared"


@dataclass
class KeywordIndex:
    """Postings; document frequencies and numbers of chunks by visibility and whether they are live; and the chunks, for states of the past."""

    postings: DataFrame
    terms: DataFrame
    sizes: DataFrame
    chunks: DataFrame


@dataclass
class Frames:
    spark: SparkSession
    folder: str
    tenant: str | None = None

    def of(self, tenant: str) -> Frames:
        """The same tables, scoped to one tenant."""
        return Frames(self.spark, self.folder, tenant)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _scoped(self, df: DataFrame, *keys: str) -> DataFrame:
        """The rows all of whose keys are the tenant's."""
        for key in keys if self.tenant is not None else ():
            df = df.where(tenant_of(key) == self.tenant)
        return df

    def _stored(self, name: str, sources: list[str], build: Callable[[Frames], DataFrame], by: list[str], folders: list[str] | None = None) -> DataFrame:
        """A table of all tenants, of which a tenant reads its own folder."""
        every = Frames(self.spark, self.folder)
        kept = stored(self.spark, name, [f"{self.folder}/{s}.parquet" for s in sources], "", lambda: build(every), by, ["customer_id"] if folders is None else folders)
        return kept if self.tenant is None else kept.where(F.col("customer_id") == self.tenant)

    @cached_property
    def documents(self) -> DataFrame:
        """Versioned documents: every fifth has two versions, some are drafts or tombstones, some lack an author or a key."""
        n = "doc_id"
        base = self._scoped(self.table("documents").select(n, "text", "lang", "source"), n)
        versions = base.select("*", F.expr(f"explode(CASE WHEN {n} % 5 = 0 THEN array(1, 2) ELSE array(1) END)").alias("version"))
        begun = f"timestampadd(HOUR, CAST({n} AS INT), {EPOCH})"
        out = versions.select(
            tenant_of(n).alias("customer_id"),
            F.expr(f"concat('doc:', source, ':', {n})").alias("doc_id"),
            F.col("version").cast("long").alias("version"),
            F.col("source").alias("source_system"),
            F.expr(f"CAST({n} AS STRING)").alias("source_id"),
            F.expr(f"concat('https://example.com/', source, '/items/', {n})").alias("source_url"),
            F.expr(f"CASE {n} % 3 WHEN 0 THEN 'message' WHEN 1 THEN 'issue' ELSE 'page' END").alias("doc_type"),
            F.expr("substr(split_part(text, '\\n', 1), 1, 60)").alias("title"),
            F.expr(f"CASE WHEN {n} % 5 = 0 AND version = 1 THEN substr(text, 1, CAST(length(text) / 2 AS INT)) ELSE text END").alias("body"),
            F.expr(f"CASE WHEN {n} % 11 = 0 THEN 'unknown' WHEN {n} % 7 = 0 THEN NULL ELSE concat('p', {n} % 50) END").alias("author_id"),
            F.expr(f"CASE WHEN {n} % 4 = 3 THEN NULL ELSE concat('k', {n} % 3) END").alias("source_key"),
            F.expr(f"CASE WHEN {n} % 13 = 0 THEN 'draft' ELSE 'approved' END").alias("visibility"),
            F.expr(begun).alias("created_at"),
            F.expr(f"timestampadd(DAY, 10 * (version - 1), {begun})").alias("valid_from"),
            F.expr(f"CASE WHEN {n} % 5 = 0 AND version = 1 THEN timestampadd(DAY, 10, {begun}) END").alias("valid_to"),
            F.expr(f"timestampadd(DAY, 10 * (version - 1), {begun})").alias("updated_at"),
            F.expr(f"timestampadd(MINUTE, 5, timestampadd(DAY, 10 * (version - 1), {begun}))").alias("ingested_at"),
            F.expr(f"CASE WHEN {n} % 17 = 0 AND NOT ({n} % 5 = 0 AND version = 1) THEN timestampadd(DAY, 20, {begun}) END").alias("deleted_at"),
            F.col("lang").alias("language"),
        )
        return out

    @cached_property
    def chunks(self) -> DataFrame:
        """Content-addressed chunks: one row for a document and a content, over the versions that hold it; with the lengths that keyword ranking needs."""
        return self._stored("chunks", ["documents"], Frames._chunks, ["doc_id"])

    @cached_property
    def postings(self) -> DataFrame:
        return self._stored("postings", ["documents"], lambda f: postings(f.chunks), ["term"])

    @cached_property
    def keyword_index(self) -> KeywordIndex:
        """Postings that hold all that ranking and filters need, and counts of what may be searched."""
        terms = self._stored("term-counts", ["documents"], lambda f: term_counts(f.postings), ["term"])
        sizes = self._stored("chunk-counts", ["documents"], lambda f: chunk_counts(f.chunks), ["visibility"])
        return KeywordIndex(self.postings, terms, sizes, self.chunks)

    @cached_property
    def name_index(self) -> DataFrame:
        """Grams and words of nodes' names (see siltstone.operators.text_index)."""
        return self._stored("name-index", NODE_SOURCES, lambda f: text_index.entries(f._named_nodes.select("customer_id", F.col("canonical_id").alias("id"), "label", F.col("name").alias("text"), F.col("name").alias("words"), F.col("updated_at").alias("seen"))), ["key"])

    @cached_property
    def names(self) -> DataFrame:
        return self._stored("names", NODE_SOURCES, lambda f: text_index.displays(f._named_nodes.select("customer_id", F.col("canonical_id").alias("id"), F.col("name").alias("display"))), ["id"], ["shelf"])

    @cached_property
    def bare_ids(self) -> DataFrame:
        """Nodes by their id without its label."""
        return self._stored("bare-ids", NODE_SOURCES, lambda f: f._named_nodes.select("customer_id", F.regexp_replace("canonical_id", "^[^:]*:", "").alias("bare"), "label", "canonical_id", "name"), ["bare"])

    @cached_property
    def title_index(self) -> DataFrame:
        """Grams of live documents' titles, words of their titles and beginnings."""
        lead = F.concat_ws(" ", "title", F.substring("body", 1, 200))
        return self._stored("title-index", ["documents"], lambda f: text_index.entries(f.documents.where("valid_to is null").select("customer_id", F.col("doc_id").alias("id"), F.lit("title").alias("label"), F.col("title").alias("text"), lead.alias("words"), F.col("updated_at").alias("seen"))), ["key"])

    @cached_property
    def titles(self) -> DataFrame:
        return self._stored("titles", ["documents"], lambda f: text_index.displays(f.documents.where("valid_to is null").select("customer_id", F.col("doc_id").alias("id"), F.col("title").alias("display"))), ["id"], ["shelf"])

    def _chunks(self) -> DataFrame:
        # one shuffle, of bodies: what is merged lies in one document
        pieces = windows(self.documents.repartition("customer_id", "doc_id"), "body", CHUNK_TOKENS, CHUNK_OVERLAP, "customer_id", "doc_id", "version", "title", "visibility", "valid_from", "valid_to")
        hashed = pieces.withColumn("content_hash", F.sha2("content", 256))
        # content, title and visibility follow from the other keys; as keys they leave only numbers to aggregate
        same = hashed.groupBy("customer_id", "doc_id", "content_hash", "content", "title", "visibility").agg(
            F.max("chunk_index").alias("chunk_index"),
            F.min("version").alias("first_seen_version"),
            F.max("version").alias("last_seen_version"),
            F.min("valid_from").alias("valid_from"),
            F.max(F.coalesce("valid_to", F.expr("timestamp'9999-01-01 00:00:00'"))).alias("until"),
            F.max("n_tokens").alias("n_tokens"),
        )
        open_ended = F.when(F.col("until") < F.expr("timestamp'9999-01-01 00:00:00'"), F.col("until"))
        named = same.withColumn("valid_to", open_ended).drop("until").withColumn("chunk_id", F.concat("doc_id", F.lit(":c_"), F.substring("content_hash", 1, 16)))
        return named.withColumns({f"{c}_length": F.regexp_count(F.lower(c), F.lit("[a-z0-9_]{2,}")) for c in ("title", "content")})

    @cached_property
    def vectors(self) -> DataFrame:
        return self._scoped(self.table("embeddings"), "vec_id").select("vec_id", F.concat(F.lit("src"), "label").alias("source_system"), F.col("embedding").cast("array<double>").alias("embedding"), F.expr(f"timestampadd(HOUR, CAST((vec_id * 37) % 1000 AS INT), {EPOCH})").alias("updated_at"))

    @cached_property
    def source_lines(self) -> DataFrame:
        """Lines of live documents (see siltstone.operators.source_view)."""
        return self._stored("source-lines", ["documents"], lambda f: source_view.line_index(f.documents.where("valid_to is null")), ["doc_id", "line"])

    @cached_property
    def text_tables(self) -> text_index.TextTables:
        return text_index.TextTables(self.name_index, self.names, self.bare_ids, self.title_index, self.titles)

    @cached_property
    def vector_index(self) -> vector_index.VectorIndex:
        """Vectors by cell (see siltstone.operators.vector_index); cells are those of all tenants."""
        if self.tenant is not None:
            every = Frames(self.spark, self.folder).vector_index
            return vector_index.VectorIndex(every.rows.where(F.col("customer_id") == self.tenant), every.cells)
        centroids = self._stored("vector-centroids", ["embeddings"], lambda f: vector_index.centroids(f.vectors), ["cell"], [])
        rows = self._stored("vector-index", ["embeddings"], lambda f: vector_index.placed(f.vectors.withColumn("customer_id", tenant_of("vec_id")), centroids), ["customer_id", "vec_id"], ["cell"])
        return vector_index.VectorIndex(rows, self._stored("vector-cells", ["embeddings"], lambda f: vector_index.cells(rows, centroids), ["cell"], []))

    @cached_property
    def nodes(self) -> DataFrame:
        """Graph nodes with degree (of all edges, of a tenant's own for a tenant), and the time of their last change where they have one."""
        degree = "degree" if self.tenant is None else "own_degree"
        return self._tenant_nodes.select("label", "canonical_id", "name", F.col(degree).alias("degree"), "updated_at")

    @cached_property
    def _tenant_nodes(self) -> DataFrame:
        return self._stored("nodes", NODE_SOURCES, Frames._nodes, ["canonical_id"])

    @property
    def _named_nodes(self) -> DataFrame:
        """(customer_id, label, canonical_id, name, updated_at) of nodes, read from their sources: what needs no degree needs no edges."""
        return _named(self._keyed_nodes)

    @property
    def _keyed_nodes(self) -> DataFrame:
        """(label, key, shown, updated_at) of nodes; key is a number, shown null where the name follows from it."""
        made = [("Person", "customer", "c_custkey", "c_name", None), ("Service", "supplier", "s_suppkey", "s_name", None), ("Repo", "part", "p_partkey", "p_name", None), ("Document", "orders", "o_orderkey", None, "o_orderdate")]
        every = None
        for label, table, key, name, changed in made:
            shown = (F.col(name) if name else F.lit(None)).cast("string")
            time = (F.col(changed) if changed else F.lit(None)).cast("timestamp")
            part = self.table(table).select(F.lit(label).alias("label"), F.col(key).cast("long").alias("key"), shown.alias("shown"), time.alias("updated_at"))
            every = part if every is None else every.unionByName(part)
        return every

    @cached_property
    def named_nodes(self) -> DataFrame:
        """Nodes without degree."""
        return self._scoped_rows(self._named_nodes).drop("customer_id")

    def _scoped_rows(self, df: DataFrame) -> DataFrame:
        return df if self.tenant is None else df.where(F.col("customer_id") == self.tenant)

    def _nodes(self) -> DataFrame:
        """Degrees are counted on numeric keys, from the sources: nodes need no stored edges."""
        ahead, back = (F.struct(F.col(f"{end}_label").alias("label"), F.col(f"{end}_key").alias("key")) for end in ("from", "to"))
        loop = (F.col("from_label") == F.col("to_label")) & (F.col("from_key") == F.col("to_key"))
        ends = self._keyed_edges.select(_edge_tenant().alias("customer_id"), F.explode(F.when(loop, F.array(ahead)).otherwise(F.array(ahead, back))).alias("end"))
        own = F.count_if(F.col("customer_id") != SHARED)
        degree = ends.groupBy("end.label", "end.key").agg(F.count(F.lit(1)).alias("degree"), own.alias("own_degree"))
        counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("degree", "own_degree")]
        named = _named(self._keyed_nodes.join(degree, ["label", "key"], "left"), *counts)
        return named.select("customer_id", "label", "canonical_id", "name", "degree", "own_degree", "updated_at")

    @cached_property
    def edges(self) -> DataFrame:
        """One edge for each type and pair of ends: least valid_from, strongest confidence, live unless every line was closed."""
        return self._tenant_edges.drop("customer_id")

    @cached_property
    def _tenant_edges(self) -> DataFrame:
        return self._stored("edges", GRAPH_SOURCES, Frames._edges, ["from_id", "to_id"])

    def _edges(self) -> DataFrame:
        ids = [F.concat(f"{end}_label", F.lit(":"), F.col(f"{end}_key").cast("string")).alias(f"{end}_id") for end in ("from", "to")]
        confidence = F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.col("tier") + 1).alias("confidence")
        return self._keyed_edges.select(_edge_tenant().alias("customer_id"), "edge_type", *ids, confidence, "tier", "valid_from", (F.col("open") == 1).alias("live"))

    @property
    def _keyed_edges(self) -> DataFrame:
        """(edge_type, from_label, from_key, to_label, to_key, tier, valid_from, open): rows are merged on their numeric keys.

        Lines are dealt once, by their order, to tasks of bounded size; both of their kinds are merged where they lie.
        """
        orders, lines = self.table("orders"), self.table("lineitem")
        tier = F.when(F.col("l_returnflag") == "N", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
        opened = F.when(F.col("l_linestatus") == "O", 1).otherwise(0)
        tasks = max(self.spark.sparkContext.defaultParallelism, lines.count() // TASK_ROWS + 1)
        dealt = lines.select("l_orderkey", "l_partkey", "l_suppkey", tier.alias("rank"), opened.alias("open"), F.col("l_shipdate").alias("time")).repartition(tasks, "l_orderkey")
        both = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.col(key).alias("key")) for kind, label, key in (("TOUCHES", "Repo", "l_partkey"), ("ASSIGNED_TO", "Service", "l_suppkey"))]))
        cited = dealt.select("l_orderkey", both.alias("to"), "rank", "open", "time").groupBy("l_orderkey", "to.kind", "to.label", "to.key").agg(*_merging(F.col("rank"), F.col("open"), "time"))
        every = cited.select(F.col("kind").alias("edge_type"), F.lit("Document").alias("from_label"), F.col("l_orderkey").alias("from_key"), F.col("label").alias("to_label"), F.col("key").alias("to_key"), "tier", "valid_from", "open")
        related = orders.where("o_orderkey % 3 = 0 AND o_orderkey > 0").withColumn("about", F.expr("o_orderkey div 4")).join(orders.select(F.col("o_orderkey").alias("about")), "about", "left_semi")
        services = self.table("supplier").withColumns({"called": F.col("s_suppkey") % 7 + 1, "since": F.expr(EPOCH)}).where("called <> s_suppkey")
        kinds = [
            ("AUTHORED", "Person", "o_custkey", "Document", "o_orderkey", orders, F.lit(2), "o_orderdate"),
            ("DISCUSSES", "Document", "o_orderkey", "Document", "about", related, F.lit(1), "o_orderdate"),
            ("CALLS", "Service", "s_suppkey", "Service", "called", services, F.when(F.col("s_suppkey") % 2 == 0, 1).otherwise(2), "since"),
        ]
        for kind, from_label, from_key, to_label, to_key, rows, rank, time in kinds:
            merged = rows.groupBy(from_key, to_key).agg(*_merging(rank, F.lit(1), time))
            part = merged.select(F.lit(kind).alias("edge_type"), F.lit(from_label).alias("from_label"), F.col(from_key).alias("from_key"), F.lit(to_label).alias("to_label"), F.col(to_key).alias("to_key"), "tier", "valid_from", "open")
            every = every.unionByName(part)
        return every

    @cached_property
    def symmetric_edges(self) -> DataFrame:
        """Each edge from either end (a: the near one), so that neighbours are an equi-join and never an OR; a loop once.

        A view of the edges: a filter on either end reaches their files, and no second and third copy of them is written.
        """
        e, rest = self.edges, ["edge_type", "confidence", "tier", "live", "valid_from"]
        back = e.where("from_id <> to_id").select(F.col("to_id").alias("a"), F.col("from_id").alias("b"), *rest)
        return e.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), *rest).unionAll(back)

    @cached_property
    def sourced_edges(self) -> DataFrame:
        """Edges with the source that asserted them."""
        return self.edges.withColumn("source_system", F.concat(F.lit("src"), (F.split_part("from_id", F.lit(":"), F.lit(2)).cast("long") % 5).cast("string")))

    @cached_property
    def provenance(self) -> DataFrame:
        """(canonical_id, source_system, first_seen, last_seen): when a source first and last asserted a node."""
        ends = self.sourced_edges.select(F.explode(F.array("from_id", "to_id")).alias("canonical_id"), "source_system", "valid_from")
        return ends.groupBy("canonical_id", "source_system").agg(F.min("valid_from").alias("first_seen"), F.max("valid_from").alias("last_seen"))

    @cached_property
    def usage(self) -> DataFrame:
        return self._scoped(self.table("events"), "user_id").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("occurred_at"), F.col("value").alias("latency_ms"), "event_type", F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.expr("CASE WHEN user_id % 3 = 0 THEN 'agent' ELSE 'human' END").alias("caller_kind"), F.concat_ws(" ", "event_type", "props").alias("summary"))

    @cached_property
    def history(self) -> DataFrame:
        """One entity for each user, one version for each event."""
        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return self._scoped(self.table("events"), "user_id").select("event_id", "user_id", "event_type", F.row_number().over(order).cast("long").alias("version"), F.col("ts").cast("timestamp").alias("valid_from"), F.lead(F.col("ts").cast("timestamp")).over(order).alias("valid_to"))

    @cached_property
    def queue(self) -> DataFrame:
        statuses = F.expr("element_at(array('pending', 'processing', 'done', 'dlq'), CAST(event_id % 4 AS INT) + 1)")
        return self._scoped(self.table("events"), "user_id").select(F.col("event_id").alias("queue_id"), tenant_of("user_id").alias("customer_id"), F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("source_system"), F.col("user_id").alias("source_event_id"), F.expr("CASE event_type WHEN 'purchase' THEN 100 WHEN 'error' THEN 75 ELSE 50 END").alias("priority"), statuses.alias("status"), F.col("ts").cast("timestamp").alias("created_at"), F.expr("CAST(event_id % 7 AS INT)").alias("attempts"), F.concat(F.lit("raw/"), F.col("event_id").cast("string")).alias("payload_key"))

    @cached_property
    def sessions(self) -> DataFrame:
        return self._scoped(self.table("conversations"), "conv_id").select("conv_id", "turn", "role", "text")


def tenant_of(key: str) -> Column:
    """The tenant to which a key of the source tables belongs."""
    return F.when(F.col(key) % 10 == 3, "globex").otherwise("acme")


def _merging(rank: Column, open_: Column, time: str) -> list[Column]:
    return [F.max(rank).alias("tier"), F.min(F.col(time).cast("timestamp")).alias("valid_from"), F.max(open_).alias("open")]


def _edge_tenant() -> Column:
    return F.when(tenant_of("from_key") == tenant_of("to_key"), tenant_of("from_key")).otherwise(SHARED)


def _named(keyed: DataFrame, *more: Column) -> DataFrame:
    """Nodes by number with their tenant, id and name."""
    number = F.col("key").cast("string")
    name = F.when(F.col("label") == "Document", F.concat(F.lit("Order "), number)).otherwise(F.col("shown"))
    return keyed.select(tenant_of("key").alias("customer_id"), "label", F.concat("label", F.lit(":"), number).alias("canonical_id"), name.alias("name"), *more, "updated_at")


def two_way(edges: DataFrame, *keep: str) -> DataFrame:
    """Edges from either end, in one pass."""
    ahead, back = F.struct(F.col("from_id").alias("a"), F.col("to_id").alias("b")), F.struct(F.col("to_id").alias("a"), F.col("from_id").alias("b"))
    ends = F.explode(F.when(F.col("from_id") == F.col("to_id"), F.array(ahead)).otherwise(F.array(ahead, back)))
    return edges.select(ends.alias("e"), "edge_type", "confidence", "tier", "live", "valid_from", *keep).select(*keep, "e.a", "e.b", "edge_type", "confidence", "tier", "live", "valid_from")


def postings(chunks: DataFrame) -> DataFrame:
    """(term, field, chunk_id, tf) of the keyword fields of chunks, with what of the chunk ranking and filters need, so that a search reads no chunks.

    A chunk's terms are counted in its own row, so nothing is shuffled.
    """
    about = ["customer_id", "chunk_id", "doc_id", "first_seen_version", "last_seen_version", "visibility", "valid_from", "valid_to"]
    parts = [chunks.select(*about, F.col(f"{c}_length").alias("length"), F.lit(c).alias("field"), tokens(F.col(c)).alias("tokens")) for c in ("title", "content")]
    rows = parts[0].unionByName(parts[1])
    out = rows.drop("tokens").withColumns({"term": F.lit(""), "tf": F.lit(0).cast("long")}).schema
    return rows.where(F.size("tokens") > 0).mapInArrow(_counted, out)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct token of a row, with how often it has it.

    What a row is repeated with for each of its terms makes many times the batch, so it is handed on by MADE_ROWS.
    """
    for batch in batches:
        ends = np.cumsum(batch.column("tokens").value_lengths().to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(ends):
            most = STEP_TOKENS + (ends[begin - 1] if begin else 0)
            end = max(begin + 1, int(np.searchsorted(ends, most, "right")))
            part, begin = batch.slice(begin, end - begin), end
            lists = part.column("tokens")
            coded = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            size = max(1, len(coded.dictionary))
            pairs, n = np.unique(row * size + coded.indices.to_numpy(), return_counts=True)
            about = part.drop_columns(["tokens"])
            for at in range(0, len(pairs), MADE_ROWS):
                some = pairs[at : at + MADE_ROWS]
                kept = about.take(pa.array(some // size))
                yield pa.RecordBatch.from_arrays([*kept.columns, coded.dictionary.take(pa.array(some % size)), pa.array(n[at : at + MADE_ROWS].astype(np.int64))], names=[*kept.schema.names, "term", "tf"])


def term_counts(made: DataFrame) -> DataFrame:
    """(customer_id, term, field, visibility, live, df)."""
    return made.groupBy("customer_id", "term", "field", "visibility", F.col("valid_to").isNull().alias("live")).agg(F.count(F.lit(1)).alias("df"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """(customer_id, visibility, live) with the number of chunks and the sums of their lengths."""
    return chunks.groupBy("customer_id", "visibility", F.col("valid_to").isNull().alias("live")).agg(F.count(F.lit(1)).alias("n"), F.sum("title_length").alias("title_sum"), F.sum("content_length").alias("content_sum"))


def windows(df: DataFrame, text: str, size: int, overlap: int, *keep: str) -> DataFrame:
    """Token windows of `size` with `overlap`; the last window ends the text, blank texts have none. Tokens are runs without white space."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to below the window's size")
    stride = size - overlap
    tokens = df.select(*keep, F.regexp_extract_all(F.col(text), F.lit(WORDS), F.lit(0)).alias("tokens")).where(F.size("tokens") > 0)
    last = F.ceil(F.greatest(F.size("tokens") - size, F.lit(0)) / stride).cast("int")
    placed = tokens.select(*keep, "tokens", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    window = F.slice("tokens", F.col("chunk_index") * stride + 1, F.lit(size))
    return placed.select(*keep, F.col("chunk_index").cast("long").alias("chunk_index"), F.concat_ws(" ", window).alias("content"), F.size(window).cast("long").alias("n_tokens"))
