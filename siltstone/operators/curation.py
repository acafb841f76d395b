"""Clauses, suggestions and model-made edges: what is written after a judgement, which is an input table here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from siltstone.model.vocabulary import EDGE_TYPES


def declare_clauses(clauses: DataFrame, evidence: DataFrame, drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clauses, evidence) after some drafts (draft_id, text, author, relation, related_id).

    relation `same` adds its author to the related clause's evidence; `conflict` makes a clause and marks
    both as in conflict; any other makes a clause. A draft's own author is evidence for it.
    """
    same = (F.col("relation") == "same") & F.col("related_id").isNotNull()
    fresh = drafts.where(~F.coalesce(same, F.lit(False)))
    target = drafts.select(F.when(same, F.col("related_id")).otherwise(F.col("draft_id")).alias("clause_id"), "author")
    made = fresh.select(F.col("draft_id").alias("clause_id"), "text", F.when(F.col("relation") == "conflict", F.col("related_id")).alias("conflicts_with"))
    back = fresh.where("relation = 'conflict'").groupBy(F.col("related_id").alias("clause_id")).agg(F.min("draft_id").alias("rival"))
    old = clauses.join(back, "clause_id", "left").select("clause_id", "text", F.coalesce("conflicts_with", "rival").alias("conflicts_with"))
    return old.unionByName(made), evidence.unionByName(target).distinct()


def record_serves(ledger: DataFrame, served: DataFrame, session: str, actor: str, at: str) -> DataFrame:
    """One exposure row for each clause served; none for an empty serve."""
    return ledger.unionByName(served.select("clause_id", F.lit(session).alias("session_id"), F.lit(actor).alias("actor"), F.lit(at).cast("timestamp").alias("served_at")))


def suggest_merges(existing: DataFrame, verdicts: DataFrame, least: float) -> DataFrame:
    """New pending suggestions: sure verdicts on pairs that have none yet, the surest of each pair."""
    sure = verdicts.where(F.col("confidence") >= least)
    best = sure.withColumn("rn", F.row_number().over(Window.partitionBy("label", "primary", "alias").orderBy(F.desc("confidence"), "rationale"))).where("rn = 1").drop("rn")
    return best.join(existing.select("label", "primary", "alias"), ["label", "primary", "alias"], "left_anti").withColumn("status", F.lit("pending"))


def validated_edges(edges: DataFrame, nodes: DataFrame, least_overlap: int = 2) -> DataFrame:
    """Model-made edges with the reason each is dropped for, null if it stays: type, ends, or a `why` that shares no words with a title.

    edges: edge_type, from_id, to_id, why. nodes: canonical_id, name. Words are of three letters or more;
    runs with digits don't count.
    """

    def words(text: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.lower(text), r"\S*\d\S*", " "), F.lit("[a-z]{3,}"), F.lit(0)))

    named = edges
    for end in ("from", "to"):
        named = named.join(nodes.select(F.col("canonical_id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name")), f"{end}_id", "left")
    shared = F.greatest(*[F.size(F.array_intersect(words(F.col("why")), words(F.coalesce(f"{end}_name", F.lit(""))))) for end in ("from", "to")])
    reason = F.when(~F.col("edge_type").isin(*EDGE_TYPES), "unknown type").when(F.col("from_name").isNull() | F.col("to_name").isNull(), "missing end").when(F.col("from_id") == F.col("to_id"), "loop").when(shared < least_overlap, "off topic")
    return named.select("edge_type", "from_id", "to_id", reason.alias("dropped"))


def kept_pending(pending: DataFrame, now: str, days: int) -> DataFrame:
    """Waiting edges within their time to live."""
    return pending.where(F.col("parked_at") >= F.expr(f"timestamp'{now}' - INTERVAL {days} DAY"))


def remove_edges(edges: DataFrame, degrees: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, degrees) without some lanes (edge_type, from_id, to_id): degrees fall by what is truly there."""
    lanes = ["edge_type", "from_id", "to_id"]
    gone = edges.join(removed.select(*lanes).distinct(), lanes, "left_semi")
    fall = gone.select(F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("canonical_id")).groupBy("canonical_id").agg(F.count(F.lit(1)).alias("fall"))
    left = edges.join(removed.select(*lanes).distinct(), lanes, "left_anti")
    return left, degrees.join(fall, "canonical_id", "left").select("canonical_id", (F.col("degree") - F.coalesce("fall", F.lit(0))).alias("degree"))


def replace_edges(edges: DataFrame, source: str, fresh: DataFrame) -> DataFrame:
    """A repository's edges to others are replaced as a whole."""
    return edges.where(F.col("source_repo") != source).unionByName(fresh.where(F.col("source_repo") == source))


def capabilities(cells: DataFrame, key: str) -> DataFrame:
    """Whether a tenant's JSON cell switches a capability on; a missing cell or key is off."""
    return cells.select("customer_id", F.coalesce(F.get_json_object("cell", f"$.{key}").cast("boolean"), F.lit(False)).alias("enabled"))
