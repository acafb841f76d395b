"""Versioned writes and graph upserts, as rewrites of snapshots: each takes tables and returns the tables after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from siltstone.expr.scoring import confidence_rank
from siltstone.model.vocabulary import CONFIDENCE


def upsert_documents(table: DataFrame, incoming: DataFrame, now: str) -> DataFrame:
    """Slowly changing documents. An unchanged, undeleted live row stays; else it is closed at `now` and the next version inserted.

    table: doc_id, version, content_hash, valid_from, valid_to, deleted_at. incoming: doc_id, seq,
    content_hash; only the last of a document counts. One full join on doc_id.
    """
    last = incoming.groupBy("doc_id").agg(F.max_by("content_hash", "seq").alias("new_hash"))
    top = table.groupBy("doc_id").agg(F.max("version").alias("top"))
    t = F.lit(now).cast("timestamp")
    joined = table.join(last, "doc_id", "left")
    live = F.col("valid_to").isNull()
    changed = live & F.col("new_hash").isNotNull() & ((F.col("new_hash") != F.col("content_hash")) | F.col("deleted_at").isNotNull())
    kept = joined.withColumn("valid_to", F.when(changed, t).otherwise(F.col("valid_to"))).drop("new_hash")
    same = table.where("valid_to is null and deleted_at is null").select("doc_id", F.col("content_hash").alias("new_hash"))
    fresh = last.join(same, ["doc_id", "new_hash"], "left_anti").join(top, "doc_id", "left")
    none = F.lit(None).cast("timestamp")
    inserted = fresh.select("doc_id", (F.coalesce("top", F.lit(0)) + 1).cast("long").alias("version"), F.col("new_hash").alias("content_hash"), t.alias("valid_from"), none.alias("valid_to"), none.alias("deleted_at"))
    return kept.select(*inserted.columns).unionByName(inserted)


def plan_chunks(live: DataFrame, incoming: DataFrame) -> DataFrame:
    """What happens to each (doc_id, content_hash): reused, added or removed. Repeated contents count once, at the last place."""
    old = live.select("doc_id", "content_hash").distinct().withColumn("old", F.lit(True))
    new = incoming.groupBy("doc_id", "content_hash").agg(F.max("chunk_index").alias("chunk_index"))
    joined = new.withColumn("new", F.lit(True)).join(old, ["doc_id", "content_hash"], "full")
    action = F.when(F.col("old") & F.col("new"), "reused").when(F.col("new"), "added").otherwise("removed")
    return joined.select("doc_id", "content_hash", "chunk_index", action.alias("action"))


def apply_chunks(table: DataFrame, plan: DataFrame, versions: DataFrame, now: str) -> DataFrame:
    """Reused chunks reach the new version but keep their old place; a content that comes back is revived; removed ones are closed.

    table: doc_id, content_hash, chunk_index, first_seen_version, last_seen_version, valid_to.
    """
    t, none = F.lit(now).cast("timestamp"), F.lit(None).cast("timestamp")
    todo = plan.select("doc_id", "content_hash", F.col("chunk_index").alias("new_index"), "action").join(versions.select("doc_id", F.col("version").alias("new_version")), "doc_id")
    joined = table.withColumn("there", F.lit(True)).join(todo, ["doc_id", "content_hash"], "full")
    there, action = F.coalesce("there", F.lit(False)), F.col("action")
    present = action.isin("reused", "added")
    return joined.select(
        "doc_id",
        "content_hash",
        F.when(there, F.col("chunk_index")).otherwise(F.col("new_index")).alias("chunk_index"),
        F.when(there, F.col("first_seen_version")).otherwise(F.col("new_version")).alias("first_seen_version"),
        F.when(present, F.col("new_version")).otherwise(F.col("last_seen_version")).alias("last_seen_version"),
        F.when(present, none).when((action == "removed") & F.col("valid_to").isNull(), t).otherwise(F.col("valid_to")).alias("valid_to"),
    )


def retire_children(children: DataFrame, parents: DataFrame, emitted: DataFrame, now: str) -> DataFrame:
    """Closes live children of re-emitted parents that weren't emitted again."""
    gone = children.where("valid_to is null").join(parents.select(F.col("doc_id").alias("parent_id")), "parent_id", "left_semi").join(emitted.select("doc_id"), "doc_id", "left_anti")
    marked = children.join(gone.select("doc_id").withColumn("gone", F.lit(True)), "doc_id", "left")
    return marked.withColumn("valid_to", F.when(F.col("gone"), F.lit(now).cast("timestamp")).otherwise(F.col("valid_to"))).drop("gone")


def admit_in_order(queue: DataFrame, applied: DataFrame) -> DataFrame:
    """Of each document the newest queue row, if it is newer than what was applied."""
    newest = queue.groupBy("doc_id").agg(F.max("queue_id").alias("queue_id"))
    return newest.join(applied.select("doc_id", "applied_id"), "doc_id", "left").where(F.col("queue_id") > F.coalesce("applied_id", F.lit(-1))).select("doc_id", "queue_id")


def merge_properties(rows: DataFrame, *keys: str) -> DataFrame:
    """Shallow merge of JSON objects in order of seq, the last value of a key winning: explode, keep the last, gather."""
    pairs = rows.select(*keys, "seq", F.explode(F.from_json("properties", "map<string,string>")).alias("key", "value"))
    last = pairs.groupBy(*keys, "key").agg(F.max_by("value", "seq").alias("value"))
    gathered = last.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))).alias("properties"))
    return rows.select(*keys).distinct().join(gathered, list(keys), "left").withColumn("properties", F.coalesce("properties", F.lit("{}")))


def resolve_aliases(refs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(label, id) -> its primary; what has no alias row is its own."""
    a = aliases.select("label", F.col("alias").alias("id"), "primary")
    return refs.join(a, ["label", "id"], "left").withColumn("resolved", F.coalesce("primary", "id")).drop("primary")


def cluster_members(refs: DataFrame, aliases: DataFrame) -> DataFrame:
    """All ids of each reference's cluster, the primary first; an unmerged id is alone."""
    named = resolve_aliases(refs, aliases)
    groups = aliases.groupBy("label", F.col("primary").alias("resolved")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    joined = named.join(groups, ["label", "resolved"], "left")
    return joined.select("label", "id", F.concat_ws(",", F.array("resolved"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("members"))


def upsert_nodes(nodes: DataFrame, incoming: DataFrame, aliases: DataFrame) -> DataFrame:
    """Ids are rewritten to their primaries, properties merged in order, old ones first."""
    renamed = resolve_aliases(incoming.withColumnRenamed("canonical_id", "id"), aliases).select("label", F.col("resolved").alias("canonical_id"), "properties", "seq")
    return merge_properties(nodes.select("label", "canonical_id", "properties", F.lit(-1).cast("long").alias("seq")).unionByName(renamed), "label", "canonical_id")


def upsert_edges(edges: DataFrame, incoming: DataFrame, aliases: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, pending). Ends become primaries; a loop that this makes goes; edges without a node at an end are parked.

    A lane (type and ends, with the aliases they came by) keeps its least valid_from, the last valid_to,
    the strongest confidence and the first source. Columns: edge_type, from_id, to_id, confidence,
    valid_from, valid_to, source_system, seq, which orders the input; what is there comes first.
    """
    a = aliases.select("alias", "primary")
    ends = incoming
    for end in ("from", "to"):
        ends = ends.join(a.withColumnRenamed("alias", f"{end}_id").withColumnRenamed("primary", f"{end}_primary"), f"{end}_id", "left")
        ends = ends.withColumn(f"alias_{end}", F.when(F.col(f"{end}_primary").isNotNull(), F.col(f"{end}_id"))).withColumn(f"{end}_new", F.coalesce(f"{end}_primary", f"{end}_id"))
    renamed = ends.where(~((F.col("from_new") == F.col("to_new")) & (F.col("from_id") != F.col("to_id"))))
    renamed = renamed.select("edge_type", F.col("from_new").alias("from_id"), F.col("to_new").alias("to_id"), F.coalesce("alias_from", F.lit("")).alias("alias_from"), F.coalesce("alias_to", F.lit("")).alias("alias_to"), "confidence", "valid_from", "valid_to", "source_system", "seq")
    known = nodes.select("canonical_id")
    present = renamed.join(known.withColumnRenamed("canonical_id", "from_id"), "from_id", "left_semi").join(known.withColumnRenamed("canonical_id", "to_id"), "to_id", "left_semi")
    lanes = ["edge_type", "from_id", "to_id", "alias_from", "alias_to"]
    parked = renamed.join(present.select(*lanes, "seq"), [*lanes, "seq"], "left_anti")
    every = edges.withColumn("seq", F.lit(-1).cast("long")).unionByName(present)
    merged = every.groupBy(*lanes).agg(F.max(confidence_rank(F.col("confidence"))).alias("rank"), F.min("valid_from").alias("valid_from"), F.max_by(F.struct("valid_to"), "seq").alias("last"), F.min_by("source_system", "seq").alias("source_system"))
    confidence = F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.col("rank") + 1)
    return merged.select(*lanes, confidence.alias("confidence"), "valid_from", F.col("last.valid_to").alias("valid_to"), "source_system"), parked


def drain_pending(pending: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges whose ends are both there now, those still waiting)."""
    known = nodes.select("canonical_id").distinct()
    ready = pending.join(known.withColumnRenamed("canonical_id", "from_id"), "from_id", "left_semi").join(known.withColumnRenamed("canonical_id", "to_id"), "to_id", "left_semi")
    return ready, pending.join(ready.select("edge_type", "from_id", "to_id"), ["edge_type", "from_id", "to_id"], "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """Incident edges of each node, a loop once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("canonical_id"))
    return ends.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("degree"))


def merge_cluster(nodes: DataFrame, edges: DataFrame, label: str, primary: str, merged: list[str]) -> dict[str, DataFrame]:
    """Merges aliases into a primary: nodes and edges after, alias rows, and snapshots that an unmerge needs.

    Edges of an alias move to the primary and remember it. Those that become loops, and those whose lane
    the primary already had, are snapshots only. Properties of aliases aren't merged.
    """
    own = (F.col("label") == label) & F.col("canonical_id").isin(*merged)
    is_from, is_to = F.col("from_id").isin(*merged), F.col("to_id").isin(*merged)
    moved = edges.withColumns({"old_from": F.col("from_id"), "old_to": F.col("to_id"), "touched": is_from | is_to})
    moved = moved.withColumns({"from_id": F.when(is_from, primary).otherwise(F.col("from_id")), "to_id": F.when(is_to, primary).otherwise(F.col("to_id"))})
    loop = F.col("touched") & (F.col("from_id") == F.col("to_id"))
    lane = Window.partitionBy("edge_type", "from_id", "to_id").orderBy(F.asc("touched"), "old_from", "old_to")
    placed = moved.withColumn("fate", F.when(loop, "self_loop").when(F.col("touched") & (F.row_number().over(lane) > 1), "duplicate_lane").otherwise("kept"))
    kept = placed.where("fate = 'kept'").select("edge_type", "from_id", "to_id", "confidence", F.when(F.col("old_from") != F.col("from_id"), F.col("old_from")).alias("alias_from"), F.when(F.col("old_to") != F.col("to_id"), F.col("old_to")).alias("alias_to"))
    snapshots = placed.where("fate <> 'kept'").select("fate", "edge_type", F.col("old_from").alias("from_id"), F.col("old_to").alias("to_id"), "confidence")
    aliases = nodes.where(own).select("label", F.col("canonical_id").alias("alias"), F.lit(primary).alias("primary"))
    return {"nodes": nodes.where(~own), "edges": kept, "aliases": aliases, "snapshots": snapshots, "removed_nodes": nodes.where(own)}


def unmerge_alias(merged: dict[str, DataFrame], alias: str) -> dict[str, DataFrame]:
    """Brings an alias back with its own edges and its loops; lanes that had collided stay lost."""
    back = merged["removed_nodes"].where(F.col("canonical_id") == alias)
    edges = merged["edges"].withColumns({"from_id": F.when(F.col("alias_from") == alias, F.lit(alias)).otherwise(F.col("from_id")), "to_id": F.when(F.col("alias_to") == alias, F.lit(alias)).otherwise(F.col("to_id"))})
    edges = edges.withColumns({"alias_from": F.when(F.col("alias_from") != alias, F.col("alias_from")), "alias_to": F.when(F.col("alias_to") != alias, F.col("alias_to"))})
    loops = merged["snapshots"].where((F.col("fate") == "self_loop") & ((F.col("from_id") == alias) | (F.col("to_id") == alias)))
    none = F.lit(None).cast("string")
    loops = loops.select("edge_type", F.lit(alias).alias("from_id"), F.lit(alias).alias("to_id"), "confidence", none.alias("alias_from"), none.alias("alias_to"))
    return {"nodes": merged["nodes"].unionByName(back), "edges": edges.unionByName(loops), "aliases": merged["aliases"].where(F.col("alias") != alias)}


def conflicting(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """Both sides have a stable key (email; repo and number; owner and name; team_id) and it differs."""
    out = F.lit(False)
    for keys in (("email",), ("repo", "number"), ("owner", "name"), ("team_id",)):
        if all(k in left and k in right for k in keys):
            there = F.lit(True)
            equal = F.lit(True)
            for k in keys:
                there = there & left[k].isNotNull() & right[k].isNotNull()
                equal = equal & (left[k] == right[k])
            out = out | F.coalesce(there & ~equal, F.lit(False))
    return out


def advance_cursors(cursors: DataFrame, advanced: DataFrame) -> DataFrame:
    """Insert or update; a missing new value keeps the old one."""
    keys = ["customer_id", "source", "resource_id"]
    return cursors.join(advanced.withColumnRenamed("cursor", "new_cursor"), keys, "full").select(*keys, F.coalesce("new_cursor", "cursor").alias("cursor"))


def promote_single_matches(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """An ambiguous edge is settled if exactly one symbol has its target's last name."""
    tail = lambda c: F.regexp_replace(c, r"^.*\.", "")
    by_tail = symbols.groupBy(tail(F.col("qualified_name")).alias("tail")).agg(F.count(F.lit(1)).alias("n"), F.min("qualified_name").alias("only"))
    joined = edges.withColumn("tail", tail(F.col("to_name"))).join(by_tail, "tail", "left")
    settle = F.col("ambiguous") & (F.col("n") == 1)
    return joined.select("from_name", F.when(settle, F.col("only")).otherwise(F.col("to_name")).alias("to_name"), F.when(settle, False).otherwise(F.col("ambiguous")).alias("ambiguous"))


def drop_evidence(edges: DataFrame, removed: list[str]) -> DataFrame:
    """Evidence in removed files goes, and edges of which none is left."""
    return edges.withColumn("evidence", F.filter("evidence", lambda e: ~e["file"].isin(*removed))).where(F.size("evidence") > 0)


def aggregate_evidence(matches: DataFrame, most: int = 5, width: int = 160) -> DataFrame:
    """One edge for each pair of repositories, with the first pieces of evidence by seq, cut to a width."""
    ordered = matches.withColumn("rn", F.row_number().over(Window.partitionBy("source_repo", "target_repo").orderBy("seq"))).where(F.col("rn") <= most)
    return ordered.groupBy("source_repo", "target_repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.substring("snippet", 1, width).alias("snippet")))), lambda x: x["snippet"]).alias("evidence"))
