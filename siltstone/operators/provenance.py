"""Which source asserted a node and when, clusters of merged nodes, and removal of a source step by step."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged_provenance(provenance: DataFrame, aliases: DataFrame) -> DataFrame:
    """(canonical_id, source_system, first_seen, last_seen) with each alias's rows under its primary: the first and the last time of every source.

    aliases: (alias, primary). One aggregation with partial minima, so a node that a source asserted often stays small.
    """
    named = provenance.join(aliases.select(F.col("alias").alias("canonical_id"), "primary"), "canonical_id", "left")
    own = named.select(F.coalesce("primary", "canonical_id").alias("canonical_id"), "source_system", "first_seen", "last_seen")
    return own.groupBy("canonical_id", "source_system").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def restored_provenance(merged: DataFrame, snapshot: DataFrame, alias: str) -> DataFrame:
    """Provenance after an alias left its cluster: its own rows come back from the snapshot; what its primary gained stays."""
    return merged.where(F.col("canonical_id") != alias).unionByName(snapshot.where(F.col("canonical_id") == alias).select(*merged.columns))


def clusters(aliases: DataFrame, nodes: DataFrame) -> DataFrame:
    """(label, primary, name, aliases, last_added): each primary's aliases as JSON in order of added_at; a primary that is an alias itself is left out.

    aliases: (label, alias, primary, merge_id, added_at).
    """
    top = aliases.join(aliases.select("label", F.col("alias").alias("primary")), ["label", "primary"], "left_anti")
    entry = F.struct("added_at", "alias", "merge_id")
    listed = top.groupBy("label", "primary").agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.max("added_at").alias("last_added"))
    named = listed.join(nodes.select("label", F.col("canonical_id").alias("primary"), "name"), ["label", "primary"], "left")
    shown = F.to_json(F.transform("entries", lambda e: F.struct(e["alias"].alias("alias"), e["merge_id"].alias("merge_id"))))
    return named.select("label", "primary", "name", shown.alias("aliases"), "last_added")


def display_names(names: DataFrame) -> DataFrame:
    """(canonical_id, name): of each id the last name that isn't empty, in a tie the least."""
    there = names.where("name is not null and name <> ''")
    last = there.groupBy("canonical_id").agg(F.max("updated_at").alias("updated_at"))
    return there.join(last, ["canonical_id", "updated_at"]).groupBy("canonical_id").agg(F.min("name").alias("name"))


@dataclass(frozen=True)
class PurgeStep:
    """A table and which of its rows a source's removal takes: those that the function keeps stay. `rows` may read the other tables as they were before."""

    table: str
    kept: Callable[[dict[str, DataFrame], str], DataFrame]


def by_source(table: str) -> PurgeStep:
    return PurgeStep(table, lambda tables, source: tables[table].where(~F.col("source_system").eqNullSafe(source)))


def by_document(table: str) -> PurgeStep:
    """Rows that hang on a document of the source, whatever its version."""
    return PurgeStep(table, lambda tables, source: tables[table].join(tables["documents"].where(F.col("source_system") == source).select("doc_id").distinct(), "doc_id", "left_anti"))


def _orphans(tables: dict[str, DataFrame], source: str) -> DataFrame:
    """Nodes that only this source asserts."""
    rows = tables["provenance"]
    return rows.where(F.col("source_system") == source).select("canonical_id").distinct().join(rows.where(F.col("source_system") != source).select("canonical_id"), "canonical_id", "left_anti")


def _kept_edges(tables: dict[str, DataFrame], source: str) -> DataFrame:
    out, gone = tables["edges"].where(F.col("source_system") != source), _orphans(tables, source)
    for end in ("from_id", "to_id"):
        out = out.join(gone.withColumnRenamed("canonical_id", end), end, "left_anti")
    return out


STEPS = [
    by_document("chunks"),
    by_source("documents"),
    PurgeStep("edges", _kept_edges),
    PurgeStep("nodes", lambda tables, source: tables["nodes"].join(_orphans(tables, source), "canonical_id", "left_anti")),
    by_source("provenance"),
]


def purged(tables: dict[str, DataFrame], source: str, steps: list[PurgeStep] = STEPS) -> dict[str, DataFrame]:
    """The tables without a source. Every step reads the tables as they were, so their order doesn't matter."""
    return tables | {step.table: step.kept(tables, source) for step in steps}


def removed_counts(tables: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(name, before, removed): what a purge took from each table."""
    out = None
    for name in sorted(after):
        count = tables[name].agg(F.count(F.lit(1)).alias("before")).crossJoin(after[name].agg(F.count(F.lit(1)).alias("left_over")))  # one row each
        row = count.select(F.lit(name).alias("name"), "before", (F.col("before") - F.col("left_over")).alias("removed"))
        out = row if out is None else out.unionByName(row)
    return out
