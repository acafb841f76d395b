"""Graph retrieval over node and edge tables. Neighbours are equi-joins on a two-way edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from siltstone.expr.scoring import confidence_rank, passes_confidence, surprise
from siltstone.expr.text import without_namespace
from siltstone.store import written

# Priorities of edge types in ranked neighbourhoods; what isn't named comes last.
PRIORITY = {"AUTHORED": 0, "ASSIGNED_TO": 1, "TOUCHES": 2}
INFERRED_PRIORITY = {"DISCUSSES": 0, "RESOLVES": 1, "DOCUMENTS": 2, "MENTIONS_ENTITY": 3, "RELATES_TO": 4}


#: Neighbours in one row of a graph's lists. Beside a number of votes: the mark of a node's own label, and that it is the node's turn.
LIST_NODES, _NOW, _TURN = 1000, 1 << 60, 1 << 61


def priority(edge_type: Column, order: dict[str, int]) -> Column:
    out = F.lit(len(order))
    for name, place in order.items():
        out = F.when(edge_type == name, place).otherwise(out)
    return out


def edge_filter(edges: DataFrame, types: tuple[str, ...] = (), confidence: tuple[str, ...] = (), since: str | None = None) -> DataFrame:
    if types:
        edges = edges.where(F.col("edge_type").isin(*types))
    if confidence:
        edges = edges.where(F.col("confidence").isin(*confidence))
    return edges.where(F.col("valid_from") >= F.lit(since).cast("timestamp")) if since else edges


def one_hop(two_way: DataFrame, nodes: DataFrame, anchor: str, k: int, types: tuple[str, ...] = ()) -> DataFrame:
    """Neighbours over live edges: hits, distinct types, and hits / ln(1 + degree), degree over all edges."""
    near = edge_filter(two_way, types).where((F.col("a") == anchor) & F.col("live"))
    rolled = near.groupBy(F.col("b").alias("canonical_id")).agg(F.count(F.lit(1)).alias("hits"), F.concat_ws(",", F.array_sort(F.collect_set("edge_type"))).alias("types"))
    scored = rolled.join(nodes, "canonical_id").withColumn("idf", F.round(F.col("hits") / F.log(1.0 + F.greatest(F.lit(1), F.col("degree"))), 6))
    return scored.orderBy(F.desc("idf"), "canonical_id").limit(k).select("canonical_id", "label", "hits", "types", "degree", "idf")


def subgraph(two_way: DataFrame, nodes: DataFrame, anchor: str, depth: int, per_parent: int, types: tuple[str, ...] = ()) -> DataFrame:
    """Breadth-first to `depth` (3 at most): the best `per_parent` neighbours of each parent by hits / ln(1 + degree).

    The first parent in the frontier's order keeps a node; the anchor never comes back. Each hop is a
    join with the frontier, which holds at most per_parent ** hop rows, so its plan grows with depth only.
    """
    if not 1 <= depth <= 3:
        raise ValueError("depth is from 1 to 3")
    live = edge_filter(two_way, types).where("live")
    start = two_way.sparkSession.range(1).select(F.lit(anchor).alias("canonical_id"), F.lit(0).alias("hop"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("parent"))
    found, frontier = start, start
    for hop in range(1, depth + 1):
        parents = frontier.select(F.col("canonical_id").alias("a"), F.col("place").alias("parent_place"))
        near = live.join(parents, "a").groupBy("a", "parent_place", "b").agg(F.count(F.lit(1)).alias("hits"))
        scored = near.join(nodes.select(F.col("canonical_id").alias("b"), "degree"), "b").withColumn("idf", F.col("hits") / F.log(1.0 + F.greatest(F.lit(1), F.col("degree"))))
        fresh = scored.join(found.select(F.col("canonical_id").alias("b")), "b", "left_anti")
        best = fresh.withColumn("rn", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("idf"), "b"))).where(F.col("rn") <= per_parent)
        first = best.withColumn("own", F.row_number().over(Window.partitionBy("b").orderBy("parent_place", "rn"))).where("own = 1")
        place = (F.col("parent_place") * per_parent + F.col("rn")).cast("long")
        frontier = first.select(F.col("b").alias("canonical_id"), F.lit(hop).alias("hop"), place.alias("place"), F.col("a").alias("parent"))
        frontier = frontier.limit(per_parent**hop)  # cuts nothing off, but tells the optimiser how few there are
        found = found.unionByName(frontier)
    return found.where("hop > 0").select("canonical_id", "hop", "parent")


def anchored(two_way: DataFrame, nodes: DataFrame, anchor: str, first_cap: int, second_cap: int) -> DataFrame:
    """Two hops around an anchor, each ranked by best edge type, degree and id, and capped.

    The second starts from the first's capped nodes and leaves those out, so a node that the first cap
    cut can come back.
    """
    live = two_way.where("live")
    by = nodes.select(F.col("canonical_id").alias("b"), "degree")

    def ranked(near: DataFrame, cap: int) -> DataFrame:
        best = near.groupBy("b").agg(F.min(priority(F.col("edge_type"), PRIORITY)).alias("priority"))
        return best.join(by, "b").orderBy("priority", F.desc("degree"), "b").limit(cap).select(F.col("b").alias("canonical_id"), "priority", "degree")

    one = ranked(live.where((F.col("a") == anchor) & (F.col("b") != anchor)), first_cap)
    seeds = one.select(F.col("canonical_id").alias("a"))
    two = ranked(live.join(seeds, "a", "left_semi").where(F.col("b") != anchor).join(one.select(F.col("canonical_id").alias("b")), "b", "left_anti"), second_cap)
    return one.select("canonical_id", F.lit(1).alias("hop"), "priority", "degree").unionByName(two.select("canonical_id", F.lit(2).alias("hop"), "priority", "degree"))


def induced_edges(edges: DataFrame, chosen: DataFrame, cap: int) -> DataFrame:
    """Live edges with both ends chosen, each once: strongest confidence, then type, then ids."""
    ids = chosen.select("canonical_id").distinct()
    kept = edges.where("live").join(ids.withColumnRenamed("canonical_id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("canonical_id", "to_id"), "to_id", "left_semi")
    return kept.orderBy(F.desc("tier"), priority(F.col("edge_type"), PRIORITY), "from_id", "to_id", "edge_type").limit(cap).select("edge_type", "from_id", "to_id", "confidence")


def top_nodes(nodes: DataFrame, k: int) -> DataFrame:
    return nodes.orderBy(F.desc("degree"), "canonical_id").limit(k)


def typeahead(nodes: DataFrame, prefix: str, k: int = 25) -> DataFrame:
    """Ids or names that begin with a prefix, without regard to case; % and _ in it are plain characters."""
    p = prefix.lower()
    hit = F.lower("canonical_id").startswith(p) | F.lower("name").startswith(p)
    return nodes.where(hit).orderBy(F.desc("degree"), "canonical_id").limit(min(k, 25)).select("canonical_id", "label", "degree")


def entity_search(two_way: DataFrame, nodes: DataFrame, anchors: DataFrame, k: int, floor: str | None = "INFERRED", within: DataFrame | None = None) -> DataFrame:
    """Documents next to anchors (label, canonical_id: any of the labels with any of the ids), or anchors themselves.

    Attributes are independent minima over all edges to a document, as text, so a document with an
    AMBIGUOUS edge counts as AMBIGUOUS. The limit, by id, comes before the confidence floor and the
    surprise ranking, so fewer than k can return. Closed edges count. within: (document) of those that
    may be found; what is filtered out takes no place among the k.
    """
    ids = anchors.select("canonical_id")
    chosen = nodes.join(ids, "canonical_id", "left_semi").join(anchors.select("label"), "label", "left_semi")
    chosen = chosen.select(F.col("canonical_id").alias("a"), F.col("label").alias("via_label"), F.col("degree").alias("via_degree"))
    far = nodes.where("label = 'Document'").select(F.col("canonical_id").alias("b"), F.col("degree").alias("far_degree"))
    near = two_way.join(ids.withColumnRenamed("canonical_id", "a"), "a", "left_semi").join(chosen, "a").join(far, "b").select(F.col("b").alias("document"), F.col("a").alias("via"), "via_label", "edge_type", "confidence", "via_degree", F.col("far_degree").alias("degree"))
    none = F.lit(None).cast("string")
    own = chosen.where("via_label = 'Document'").select(F.col("a").alias("document"), F.col("a").alias("via"), "via_label", none.alias("edge_type"), none.alias("confidence"), "via_degree", F.col("via_degree").alias("degree"))
    columns = ["via", "via_label", "edge_type", "confidence", "via_degree", "degree"]
    every = near.unionByName(own)
    if within is not None:
        every = every.join(within.select("document"), "document", "left_semi")
    pool = every.groupBy("document").agg(*[F.min(c).alias(c) for c in columns]).orderBy("document").limit(k)
    score = surprise(F.col("confidence"), none, none, none, none, F.col("via_degree"), F.col("degree"))
    return pool.where(passes_confidence(F.col("confidence"), floor)).select("document", *columns, F.round(score, 6).alias("score"))


def anchor_documents(two_way: DataFrame, nodes: DataFrame, anchors: DataFrame, cap: int) -> DataFrame:
    """(canonical_id, rank from 0): documents one hop from any anchor (label, canonical_id), each once, the last changed first, `cap` at most. Closed edges count."""
    own = nodes.join(anchors, ["label", "canonical_id"], "left_semi").select(F.col("canonical_id").alias("a"))
    around = two_way.join(anchors.select(F.col("canonical_id").alias("a")), "a", "left_semi")  # a short list, before what needs a shuffle
    near = around.join(own, "a", "left_semi").select(F.col("b").alias("canonical_id")).distinct()
    order = [F.desc_nulls_last("updated_at"), F.asc("canonical_id")]
    top = nodes.where("label = 'Document'").join(near, "canonical_id", "left_semi").orderBy(*order).limit(cap)
    return top.select("canonical_id", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("rank"))  # of at most `cap` rows


def inferred_neighbours(two_way: DataFrame, anchors: DataFrame, k: int, dampening: float = 1.0, within: DataFrame | None = None) -> DataFrame:
    """What lies over INFERRED edges of ranked anchors (canonical_id, rank from 0): type priority, then the newest.

    The limit comes before each one keeps its best anchor, so fewer than k can return. within:
    (canonical_id) of those that may be found; what is filtered out takes no place among the k.
    """
    ranked = anchors.select(F.col("canonical_id").alias("a"), "rank")
    near = two_way.where("confidence = 'INFERRED' AND live").join(ranked, "a")
    if within is not None:
        near = near.join(within.select(F.col("canonical_id").alias("b")), "b", "left_semi")
    pool = near.withColumn("priority", priority(F.col("edge_type"), INFERRED_PRIORITY | {"ASSIGNED_TO": 5, "TOUCHES": 6})).orderBy("priority", F.desc("valid_from"), "b", "a", "edge_type").limit(k)
    best = pool.groupBy(F.col("b").alias("canonical_id")).agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("linked_edges"))
    return best.select("canonical_id", "rank", "linked_edges", F.round(F.lit(dampening) / (1 + F.col("rank")), 6).alias("score"))


def related_entities(two_way: DataFrame, nodes: DataFrame, documents: DataFrame, excluded: DataFrame, k: int, floor: str = "INFERRED") -> DataFrame:
    """Entities next to ranked documents (canonical_id, rank): distinct types and documents, strongest confidence, up to three sample documents in rank order.

    score is documents / ln(1 + the entity's documents over all); both counts have the floor. Excluded
    (label, id) are left out by four forms of their id.
    """
    ok = two_way.where("live").where(passes_confidence(F.col("confidence"), floor))
    ranked = documents.select(F.col("canonical_id").alias("b"), "rank")
    near = ok.join(ranked, "b").where(~F.col("a").startswith("Document:"))
    rolled = near.groupBy(F.col("a").alias("canonical_id")).agg(
        F.countDistinct("edge_type").alias("types"),
        F.max(confidence_rank(F.col("confidence"))).alias("strongest"),
        F.countDistinct("b").alias("documents"),
        F.concat_ws(",", F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "b"))), lambda x: x["b"])), 1, 3)).alias("samples"),
    )
    overall = ok.where(F.col("b").startswith("Document:")).join(F.broadcast(rolled.select(F.col("canonical_id").alias("a"))), "a", "left_semi").groupBy(F.col("a").alias("canonical_id")).agg(F.countDistinct("b").alias("overall"))
    lower, bare = F.lower("canonical_id"), without_namespace(F.col("canonical_id"))
    forms = excluded.select("label", F.explode(F.array(F.col("canonical_id"), lower, bare, F.regexp_replace(bare, "[^a-z0-9]", ""))).alias("form")).distinct()
    own = nodes.select("label", "canonical_id", "name", F.explode(F.array_distinct(F.array(F.col("canonical_id"), lower, bare, F.regexp_replace(bare, "[^a-z0-9]", "")))).alias("form"))
    gone = own.join(F.broadcast(forms), ["label", "form"], "left_semi").select("canonical_id").distinct()
    scored = rolled.join(overall, "canonical_id", "left").join(nodes.select("canonical_id", "label"), "canonical_id").join(gone, "canonical_id", "left_anti")
    score = F.round(F.col("documents") / F.log1p(F.coalesce("overall", F.lit(1))), 6)
    return scored.withColumn("score", score).orderBy(F.desc("score"), "canonical_id").limit(k).select("canonical_id", "label", "types", "strongest", "documents", "samples", "score")


def evidence(two_way: DataFrame, anchors: DataFrame, per_anchor: int = 8) -> DataFrame:
    """Edges beside result documents: one of each (anchor, other, type), of the first per_anchor of an anchor, repeats counted."""
    near = two_way.where("live").join(anchors.select(F.col("canonical_id").alias("a")), "a", "left_semi")
    order = [F.desc("tier"), F.asc("edge_type"), F.asc("b")]
    once = F.row_number().over(Window.partitionBy("a", "b", "edge_type").orderBy(*order))
    place = F.row_number().over(Window.partitionBy("a").orderBy(*order))
    return near.withColumns({"dedup_rn": once, "anchor_rn": place}).where((F.col("dedup_rn") == 1) & (F.col("anchor_rn") <= per_anchor)).select("a", "b", "edge_type", "confidence")


def undirected(rows: DataFrame) -> DataFrame:
    """Edges found from both ends, once: no confidence counts as EXTRACTED."""
    ends = rows.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), "edge_type", F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence"))
    return ends.groupBy("low", "high", "edge_type").agg(F.min("confidence").alias("confidence"))


def communities(edges: DataFrame, least_edges: int = 100, most_rounds: int = 100) -> DataFrame:
    """(node, community) by label propagation on the undirected simple graph, until no node has more neighbours of another label than of its own.

    A node moves to the label that most of its neighbours have, ties to the least, and only if it gains
    by that. In a round one half of the nodes, by a hash that changes with the round, may move; so two
    neighbours seldom swap, and the number of edges inside communities grows until all rest. Nothing for
    graphs of fewer than `least_edges` edges; an error if labels don't settle. Nodes are numbered in the
    order of their names, so rounds join numbers. A round judges the nodes whose votes may have changed:
    those beside one that moved, and those that wanted to but whose turn it wasn't; the others rest as
    before. Labels are a written table. Neighbours lie in lists of LIST_NODES at most, so that a round joins
    lists, not edges, and deals out each vote once; a node's own label comes with them, as a vote of no weight.
    """
    spark = edges.sparkSession
    simple = written(edges.where("from_id <> to_id").select(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).distinct(), "pairs")
    if simple.limit(least_edges).count() < least_edges:
        return spark.createDataFrame([], "node string, community string")
    labels = written(numbered(simple).withColumn("community", F.col("node")), "labels")
    names, total = labels.select("node", "name"), labels.count()
    pairs = simple
    for end in ("a", "b"):
        pairs = pairs.join(names.withColumnRenamed("name", end).withColumnRenamed("node", f"{end}_node"), end)
    lists = _neighbour_lists(pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    awake = None
    for i in range(most_rounds):
        turn = F.pmod(F.xxhash64("name", F.lit(i)), F.lit(2)) == 0
        own = labels.select("node", "community", F.when(turn, _NOW + _TURN).otherwise(_NOW).alias("w"))
        if awake is None:  # every node tells its neighbours
            told = lists.join(labels.select("node", "community"), "node").select(F.explode("near").alias("node"), "community")
        else:  # those awake ask theirs
            asking = lists.join(awake, "node", "left_semi").select(F.col("node").alias("asks"), F.explode("near").alias("node"))
            told = asking.join(labels.select("node", "community"), "node").select(F.col("asks").alias("node"), "community")
            own = own.join(awake, "node", "left_semi")
        dealt = told.withColumn("w", F.lit(1).cast("long")).unionAll(own).repartition("node")
        votes = dealt.groupBy("node", "community").agg(F.sum("w").alias("w")).withColumn("n", F.col("w").bitwiseAND(F.lit(_NOW - 1)))
        held = votes.groupBy("node").agg(
            F.min_by(F.struct("community", "n"), F.struct((-F.col("n")).alias("n"), "community")).alias("best"),
            F.max(F.when(F.col("w") >= _NOW, F.col("n"))).alias("own"),
            (F.max("w") >= _TURN).alias("turn"),
        )
        wants = written(held.where(F.col("best.n") > F.col("own")).select("node", F.col("best.community").alias("to"), "turn"), "wants")
        n = wants.count()
        if not n:
            named = names.withColumnsRenamed({"node": "community", "name": "called"})
            return labels.join(named, "community").select(F.col("name").alias("node"), F.col("called").alias("community"))
        movers = wants.where("turn").select("node", "to")
        labels = written(labels.join(movers, "node", "left").select("node", "name", F.coalesce("to", "community").alias("community")), "labels")
        if 20 * n > total:
            awake = None  # too many to look for
        else:
            beside = lists.join(movers, "node", "left_semi").select(F.explode("near").alias("node"))
            awake = written(beside.unionAll(wants.where("not turn").select("node")).distinct(), "awake")
    raise RuntimeError(f"communities did not settle in {most_rounds} rounds")


def _neighbour_lists(pairs: DataFrame) -> DataFrame:
    """(node, near): the neighbours of each node by pairs (a, b), several rows for a node of more than LIST_NODES."""
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    placed = pairs.select(ends).select(F.col("e.a").alias("node"), F.col("e.b").alias("b"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("b"))
    lists = placed.withColumn("list", F.floor(place / LIST_NODES)).groupBy("node", "list").agg(F.collect_list("b").alias("near"))
    return written(lists.select("node", "near"), "neighbours")


def numbered(pairs: DataFrame) -> DataFrame:
    """(node, name) of the ends of pairs (a, b): node is a number that grows with the name. A written table, so that numbers stay what they are."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    return written(ends.orderBy("name").select(F.monotonically_increasing_id().alias("node"), "name"), "numbered")


def node_titles(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(canonical_id, label, title): a document's own title, if it has one, else the node's name."""
    own = documents.select("canonical_id", F.col("title").alias("own"))
    title = F.when(F.col("label") == "Document", F.coalesce(F.nullif("own", F.lit("")), "name")).otherwise(F.col("name"))
    return nodes.join(own, "canonical_id", "left").select("canonical_id", "label", title.alias("title"))


def with_total(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows, each with the number that there are without the limit: two reads of the source, and one row joined to k."""
    return rows.orderBy(*order).limit(k).crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))
