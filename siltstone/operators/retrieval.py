"""Vector and keyword retrieval, fusion, similar documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from siltstone.expr.scoring import cosine, rank_term, rounded, source_weight
from siltstone.expr.temporal import chunk_predicate
from siltstone.model.frames import KeywordIndex
from siltstone.model.vocabulary import BM25_B, BM25_K1, POOL_MULTIPLIER, TITLE_BOOST, TITLE_ONLY_PER_DOC
from siltstone.operators.listing import Filters, filtered
from siltstone.store import literal_rows


def _array(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def scored_vectors(vectors: DataFrame, query: list[float]) -> DataFrame:
    return vectors.withColumn("score", F.round(cosine(F.col("embedding"), _array(query)), 6)).drop("embedding")


def vector_search(vectors: DataFrame, query: list[float], k: int, per_source: int | None = None, recency: bool = False, within: DataFrame | None = None) -> DataFrame:
    """The k nearest by cosine, ties by id. per_source keeps as many of each source and lets sources take turns by their ranks.

    within: (vec_id) of the rows that may be found; what is filtered out takes no place among the k.
    """
    if within is not None:
        vectors = vectors.join(within.select("vec_id"), "vec_id", "left_semi")
    scored = scored_vectors(vectors, query)
    order = [F.desc("updated_at" if recency else "score"), F.asc("vec_id")]
    if per_source is None:
        return scored.orderBy(*order).limit(k)
    ranked = scored.withColumn("source_rank", F.row_number().over(Window.partitionBy("source_system").orderBy(*order)).cast("long")).where(F.col("source_rank") <= per_source)
    return ranked.orderBy("source_rank", *order).limit(k)


def similar_to(vectors: DataFrame, vec_id: int, k: int, within: DataFrame | None = None, sources_but: str | None = None) -> DataFrame:
    """(vec_id, source_system, score): the k rows nearest to a row's own vector, ties by id. One row is joined to all: no vector comes to the driver.

    within: (vec_id) of rows that may be found. sources_but: a source that is left out, after the nearest 10 k were taken.
    """
    own = vectors.where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("own")).limit(1)
    others = vectors.where(F.col("vec_id") != vec_id)
    if within is not None:
        others = others.join(within.select("vec_id").distinct(), "vec_id", "left_semi")
    scored = others.crossJoin(F.broadcast(own)).withColumn("score", F.round(cosine(F.col("embedding"), F.col("own")), 6)).select("vec_id", "source_system", "score")
    order = [F.desc("score"), F.asc("vec_id")]
    if sources_but is None:
        return scored.orderBy(*order).limit(k)
    return scored.orderBy(*order).limit(10 * k).where(F.col("source_system") != sources_but).orderBy(*order).limit(k)


def keyword_search(index: KeywordIndex, documents: DataFrame, queries: list[str], k: int, filters: Filters | None = None, per_source: int | None = None, recency: bool = False) -> DataFrame:
    """BM25 of title (boosted) and content, any term matching, for each query (sub_query: its number); in stages.

    A pool of ten times k by score; of each document only the best chunk that just its title brought in;
    then the document's filters, which may leave fewer than k; then the k best, or newest. k1 1.2, b
    0.75, idf ln(1 + (N - df + 0.5) / (df + 0.5)), over the chunks that may be searched. Reads the terms of
    all queries from postings, once, and no chunks; only the pools, which are bounded, meet the documents.
    """
    filters = filters or Filters()
    asked = [(i, t) for i, q in enumerate(queries) for t in sorted(set(_terms(q)))]
    terms = sorted({t for _, t in asked})
    may = F.lit(True) if filters.drafts else F.col("visibility") == "approved"
    hits = index.postings.where(F.col("term").isin(*terms) if terms else F.lit(False)).where(chunk_predicate(filters.temporal) & may)
    if filters.temporal.mode == "AS_OF":  # the past has no counts at hand
        seen = hits.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
        sizes = index.chunks.where(chunk_predicate(filters.temporal) & may).select(F.lit(1).alias("n"), F.col("title_length").alias("title_sum"), F.col("content_length").alias("content_sum"))
    else:
        held = may & (F.lit(True) if filters.temporal.mode == "ALL" else F.col("live"))
        seen = index.terms.where(F.col("term").isin(*terms) if terms else F.lit(False)).where(held).groupBy("field", "term").agg(F.sum("df").alias("df"))
        sizes = index.sizes.where(held)
    stats = sizes.agg(F.sum("n").alias("n"), (F.sum("title_sum") / F.sum("n")).alias("title_average"), (F.sum("content_sum") / F.sum("n")).alias("content_average"))
    known = literal_rows(index.postings.sparkSession, asked, "sub_query int, term string")
    weighed = seen.join(F.broadcast(known), "term").crossJoin(F.broadcast(stats))  # a row for each field and term of the queries; one row
    joined = hits.join(F.broadcast(weighed), ["field", "term"])
    title = F.col("field") == "title"
    length = F.col("length") / F.when(title, F.col("title_average")).otherwise(F.col("content_average"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(title, TITLE_BOOST).otherwise(1.0) * idf * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * length))
    named = ["sub_query", "customer_id", "chunk_id", "doc_id", "first_seen_version", "last_seen_version"]
    pool = joined.groupBy(*named).agg(F.bool_or(~title).alias("content_hit"), F.round(F.sum(part), 6).alias("score"))
    first = [F.desc("score"), F.asc("chunk_id")]
    pool = _best(pool, POOL_MULTIPLIER * k, ["sub_query"], first)
    rn = F.row_number().over(Window.partitionBy("sub_query", "doc_id", "content_hit").orderBy(*first))
    capped = pool.withColumn("rn", F.when(F.col("content_hit"), 0).otherwise(rn)).where(F.col("rn") <= TITLE_ONLY_PER_DOC)
    live = filtered(documents, filters).select("customer_id", "doc_id", "version", "source_system", "updated_at")
    found = live.join(F.broadcast(capped), ["customer_id", "doc_id"]).where("version between first_seen_version and last_seen_version")  # the pools: ten times k rows for each query at most
    order = [F.desc("updated_at"), F.asc("chunk_id")] if recency else first
    if per_source is not None:
        found = found.withColumn("source_rank", F.row_number().over(Window.partitionBy("sub_query", "source_system").orderBy(*order))).where(F.col("source_rank") <= per_source)
        order = [F.asc("source_rank"), *order]
    return _best(found, k, ["sub_query"], order).select("sub_query", "chunk_id", "doc_id", "version", "source_system", "updated_at", "content_hit", "score")


def _best(rows: DataFrame, n: int, of: list[str], order: list[Column]) -> DataFrame:
    """The first n rows of each."""
    return rows.withColumn("best", F.row_number().over(Window.partitionBy(*of).orderBy(*order))).where(F.col("best") <= n).drop("best")


def _terms(query: str) -> list[str]:
    import re

    return [t.lower() for t in re.findall("[A-Za-z0-9_]+", query) if len(t) >= 2]


def fuse(channels: DataFrame, now: str, profiles: DataFrame | None = None, ahead: bool = False) -> DataFrame:
    """Reciprocal ranks over all lists: every hit counts, blank content excepted, though its rank is taken.

    channels: sub_query, channel_order, rank (from 0 within a list), doc_id, content, source_system,
    updated_at. The source weight is that of a document's first hit. profiles: source_system, multiplier,
    half_life, a small dimension table. ahead: as in source_weight.
    """
    used = channels.where(F.trim(F.coalesce("content", F.lit(""))) != "")
    first = F.min_by(F.struct("source_system", "updated_at"), F.struct("sub_query", "channel_order", "rank"))
    fused = used.groupBy("doc_id").agg(F.sum(rank_term(F.col("rank"))).alias("base"), first.alias("hit"), F.count(F.lit(1)).alias("hits"))
    fused = fused.select("doc_id", "base", "hits", F.col("hit.source_system").alias("source_system"), F.col("hit.updated_at").alias("updated_at"))
    multiplier = half_life = None
    if profiles is not None:
        fused = fused.join(profiles, "source_system", "left")
        multiplier, half_life = F.col("multiplier"), F.col("half_life")
    score = F.col("base") * source_weight(F.col("source_system"), F.col("updated_at"), now, multiplier, half_life, ahead)
    return fused.select("doc_id", "source_system", "hits", rounded(score).alias("score"))


def recall_floor(gathered: DataFrame, fused: DataFrame, least: int) -> DataFrame:
    """Fills a result up to `least` documents with the best fused ones that it doesn't have."""
    have = gathered.select("doc_id").distinct()
    missing = max(0, least - have.limit(least).count())
    extra = fused.join(have, "doc_id", "left_anti").orderBy(F.desc("score"), "doc_id").limit(missing)
    return have.withColumn("backfilled", F.lit(False)).unionByName(extra.select("doc_id", F.lit(True).alias("backfilled")))


def within_budget(df: DataFrame, size: str, order: list, budget: int) -> DataFrame:
    """Rows in order while their running size stays in a budget. The order is total, over few rows."""
    running = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("running", running).where(F.col("running") <= budget)


def suppress_near_duplicates(hits: DataFrame, threshold: float = 0.95, most: int = 1000) -> DataFrame:
    """In rank order, drops a hit whose cosine with a kept one exceeds the threshold; hits without a vector stay.

    hits: (search, rank, vec_id, embedding) of any number of searches. The rule depends on what was kept
    before, so a search's hits are one group, of which the first `most` are looked at; what a list holds
    beyond those stays.
    """
    import numpy as np
    import pandas as pd

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[np.ndarray] = []
        chosen = []
        for place, vector in enumerate(pdf.sort_values("rank")["embedding"]):
            v = None if vector is None else np.asarray(vector, float)
            norm = 0.0 if v is None else float(np.sqrt(v @ v))
            if norm and any(u @ v / norm > threshold for u in kept):
                continue
            if norm:
                kept.append(v / norm)
            chosen.append(place)
        return pdf.sort_values("rank").iloc[chosen][["search", "rank", "vec_id"]]

    kind = hits.schema["search"].dataType.simpleString()
    placed = hits.withColumn("place", F.row_number().over(Window.partitionBy("search").orderBy("rank")))
    judged = placed.where(F.col("place") <= most).groupBy("search").applyInPandas(greedy, f"search {kind}, rank long, vec_id long")
    return judged.unionByName(placed.where(F.col("place") > most).select("search", "rank", "vec_id"))


def classify(vectors: DataFrame, prototypes: DataFrame, floor: float, margin: float) -> DataFrame:
    """The prototype of largest cosine if it reaches the floor and leads the next by the margin; else none.

    prototypes: (name, embedding), a list that people keep: 10,000 at most, which is checked before they are
    sent to all tasks; more are an error.
    """
    if prototypes.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 prototypes")
    pairs = vectors.crossJoin(F.broadcast(prototypes.select(F.col("name"), F.col("embedding").alias("p"))))
    scored = pairs.select("vec_id", "name", F.round(cosine(F.col("embedding"), F.col("p")), 6).alias("score"))
    top = scored.groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "name"))), 1, 2).alias("top"))
    best, second = F.col("top")[0], F.when(F.size("top") > 1, F.element_at("top", 2))
    score, gap = -best["s"], second["s"] - best["s"]
    return top.select("vec_id", F.when((score >= floor) & (F.coalesce(gap, F.lit(1.0)) >= margin), best["name"]).alias("name"), score.alias("score"))


def clause_neighbours(clauses: DataFrame, vector: list[float], model: str, limit: int, floor: float = 0.72) -> DataFrame:
    """(clause_id, status, similarity): the nearest clauses whose vector came from the same model; the floor comes after the limit, so fewer may return."""
    own = clauses.where((F.col("model") == model) & F.col("embedding").isNotNull())
    scored = own.select("clause_id", "status", F.round(cosine(F.col("embedding"), _array(vector)), 6).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "clause_id").limit(max(0, limit)).where(F.col("similarity") >= floor)
