"""Queries over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from siltstone.model.frames import Frames, two_way
from siltstone.operators import graph, leiden, listing, provenance, text_index, writes
from siltstone.plans.registry import query
from siltstone.store import literal_rows

ANCHOR = "Person:7"
IDF = "round(hits / ln(1.0 + greatest(1, degree)), 6)"


@query("SELECT label, count(*) AS n, CAST(sum(degree) AS BIGINT) AS degree FROM nodes GROUP BY label")
def node_degrees(f: Frames) -> DataFrame:
    return f.nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("degree").alias("degree"))


@query("SELECT edge_type, confidence, live, count(*) AS n FROM edges GROUP BY ALL")
def edge_lanes(f: Frames) -> DataFrame:
    return f.edges.groupBy("edge_type", "confidence", "live").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT edge_type, count(*) AS n FROM edges WHERE edge_type IN ('TOUCHES', 'ASSIGNED_TO') AND confidence IN ('INFERRED', 'AMBIGUOUS') AND valid_from >= TIMESTAMP '1995-01-01' GROUP BY 1")
def filtered_edges(f: Frames) -> DataFrame:
    return graph.edge_filter(f.edges, ("TOUCHES", "ASSIGNED_TO"), ("INFERRED", "AMBIGUOUS"), "1995-01-01").groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH r AS (SELECT b AS canonical_id, count(*) AS hits, array_to_string(list_sort(list(DISTINCT edge_type)), ',') AS types FROM sym WHERE a = 'Repo:11' AND live GROUP BY b)
SELECT canonical_id, label, hits, types, degree, {IDF} AS idf FROM r JOIN nodes USING (canonical_id) ORDER BY idf DESC, canonical_id LIMIT 15""")
def one_hop_neighbours(f: Frames) -> DataFrame:
    return graph.one_hop(f.symmetric_edges, f.nodes, "Repo:11", 15)


@query(f"""WITH h1 AS (SELECT *, row_number() OVER (ORDER BY idf DESC, b) AS rn FROM (SELECT s.b, count(*) / ln(1.0 + greatest(1, any_value(n.degree))) AS idf FROM sym s JOIN nodes n ON n.canonical_id = s.b WHERE s.a = '{ANCHOR}' AND s.live AND s.b <> '{ANCHOR}' GROUP BY s.b) QUALIFY rn <= 3),
h2 AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY idf DESC, b) AS rn FROM (SELECT s.a, p.rn AS place, s.b, count(*) / ln(1.0 + greatest(1, any_value(n.degree))) AS idf FROM sym s JOIN h1 p ON p.b = s.a JOIN nodes n ON n.canonical_id = s.b WHERE s.live AND s.b <> '{ANCHOR}' AND s.b NOT IN (SELECT b FROM h1) GROUP BY s.a, p.rn, s.b) QUALIFY rn <= 3),
f2 AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY place, rn) AS own FROM h2 QUALIFY own = 1)
SELECT b AS canonical_id, 1 AS hop, '{ANCHOR}' AS parent FROM h1 UNION ALL SELECT b, 2, a FROM f2""")
def subgraph_two_hops(f: Frames) -> DataFrame:
    return graph.subgraph(f.symmetric_edges, f.nodes, ANCHOR, 2, 3)


def _hops(anchor: str, depth: int, per_parent: int) -> str:
    """SQL of the breadth-first subgraph, a step for each hop; f: the frontier, with the place that orders it."""
    parts = [f"f0 AS (SELECT '{anchor}' AS b, CAST(0 AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS parent)", "s0 AS (SELECT b FROM f0)"]
    for h in range(1, depth + 1):
        parts.append(f"""h{h} AS (SELECT s.a, p.place AS parent_place, s.b, row_number() OVER (PARTITION BY s.a ORDER BY count(*) / ln(1.0 + greatest(1, any_value(n.degree))) DESC, s.b) AS rn FROM sym s JOIN f{h - 1} p ON p.b = s.a JOIN nodes n ON n.canonical_id = s.b WHERE s.live AND s.b NOT IN (SELECT b FROM s{h - 1}) GROUP BY s.a, p.place, s.b QUALIFY rn <= {per_parent})""")
        parts.append(f"f{h} AS (SELECT b, parent_place * {per_parent} + rn AS place, a AS parent FROM h{h} QUALIFY row_number() OVER (PARTITION BY b ORDER BY parent_place, rn) = 1)")
        parts.append(f"s{h} AS (SELECT b FROM s{h - 1} UNION ALL SELECT b FROM f{h})")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT b AS canonical_id, {h} AS hop, parent FROM f{h}" for h in range(1, depth + 1))


@query(_hops(ANCHOR, 3, 4))
def subgraph_three_hops(f: Frames) -> DataFrame:
    return graph.subgraph(f.symmetric_edges, f.nodes, ANCHOR, 3, 4)


_PRIORITY = "min(CASE s.edge_type WHEN 'AUTHORED' THEN 0 WHEN 'ASSIGNED_TO' THEN 1 WHEN 'TOUCHES' THEN 2 ELSE 3 END)"
_ANCHORED = f"""one AS (SELECT s.b AS canonical_id, {_PRIORITY} AS priority, any_value(n.degree) AS degree FROM sym s JOIN nodes n ON n.canonical_id = s.b WHERE s.a = 'Service:3' AND s.b <> 'Service:3' AND s.live GROUP BY s.b ORDER BY priority, degree DESC, s.b LIMIT 20),
two AS (SELECT s.b AS canonical_id, {_PRIORITY} AS priority, any_value(n.degree) AS degree FROM sym s JOIN nodes n ON n.canonical_id = s.b WHERE s.live AND s.a IN (SELECT canonical_id FROM one) AND s.b <> 'Service:3' AND s.b NOT IN (SELECT canonical_id FROM one) GROUP BY s.b ORDER BY priority, degree DESC, s.b LIMIT 60)"""


@query(f"WITH {_ANCHORED} SELECT canonical_id, 1 AS hop, priority, degree FROM one UNION ALL SELECT canonical_id, 2, priority, degree FROM two")
def anchored_explore(f: Frames) -> DataFrame:
    return graph.anchored(f.symmetric_edges, f.nodes, "Service:3", 20, 60)


@query(f"""WITH {_ANCHORED}, ids AS (SELECT canonical_id FROM one UNION SELECT canonical_id FROM two UNION SELECT 'Service:3')
SELECT edge_type, from_id, to_id, confidence FROM edges WHERE live AND from_id IN (SELECT canonical_id FROM ids) AND to_id IN (SELECT canonical_id FROM ids)
ORDER BY tier DESC, CASE edge_type WHEN 'AUTHORED' THEN 0 WHEN 'ASSIGNED_TO' THEN 1 WHEN 'TOUCHES' THEN 2 ELSE 3 END, from_id, to_id, edge_type LIMIT 150""")
def anchored_explore_edges(f: Frames) -> DataFrame:
    found = graph.anchored(f.symmetric_edges, f.nodes, "Service:3", 20, 60).select("canonical_id")
    own = f.spark.range(1).select(F.lit("Service:3").alias("canonical_id"))
    return graph.induced_edges(f.edges, found.unionByName(own), 150)


@query("SELECT canonical_id, label, name, degree FROM nodes ORDER BY degree DESC, canonical_id LIMIT 100")
def default_graph_nodes(f: Frames) -> DataFrame:
    return graph.top_nodes(f.nodes, 100).select("canonical_id", "label", "name", "degree")


@query("""WITH t AS (SELECT canonical_id FROM nodes ORDER BY degree DESC, canonical_id LIMIT 300)
SELECT edge_type, from_id, to_id, confidence FROM edges WHERE live AND from_id IN (SELECT canonical_id FROM t) AND to_id IN (SELECT canonical_id FROM t)
ORDER BY tier DESC, CASE edge_type WHEN 'AUTHORED' THEN 0 WHEN 'ASSIGNED_TO' THEN 1 WHEN 'TOUCHES' THEN 2 ELSE 3 END, from_id, to_id, edge_type LIMIT 500""")
def default_graph_edges(f: Frames) -> DataFrame:
    return graph.induced_edges(f.edges, graph.top_nodes(f.nodes, 300), 500)


@query("SELECT canonical_id, label, degree FROM nodes WHERE starts_with(lower(canonical_id), 'customer#00000001') OR starts_with(lower(name), 'customer#00000001') ORDER BY degree DESC, canonical_id LIMIT 25")
def graph_typeahead(f: Frames) -> DataFrame:
    return graph.typeahead(f.nodes, "Customer#00000001")


@query("""WITH anchors AS (SELECT canonical_id AS a, label AS via_label, degree AS via_degree FROM nodes WHERE label IN ('Person', 'Service', 'Document') AND canonical_id IN ('Person:7', 'Service:2', 'Document:5')),
every AS (SELECT s.b AS document, s.a AS via, a.via_label, s.edge_type, s.confidence, a.via_degree, n.degree FROM sym s JOIN anchors a ON a.a = s.a JOIN nodes n ON n.canonical_id = s.b AND n.label = 'Document'
  UNION ALL SELECT a, a, via_label, NULL, NULL, via_degree, via_degree FROM anchors WHERE via_label = 'Document'),
pool AS (SELECT document, min(via) AS via, min(via_label) AS via_label, min(edge_type) AS edge_type, min(confidence) AS confidence, min(via_degree) AS via_degree, min(degree) AS degree FROM every GROUP BY document ORDER BY document LIMIT 40)
SELECT *, round(least(8.0, CASE confidence WHEN 'AMBIGUOUS' THEN 1.5 WHEN 'INFERRED' THEN 1.25 ELSE 1.0 END * CASE WHEN least(via_degree, degree) <= 2 AND greatest(via_degree, degree) >= 5 THEN 1.3 ELSE 1.0 END * CASE WHEN least(via_degree, degree) >= 3 THEN greatest(1.0 - 0.15 * log2(least(via_degree, degree) / 2.0), 0.5) ELSE 1.0 END), 6) AS score
FROM pool WHERE confidence IS NULL OR confidence <> 'AMBIGUOUS'""")
def entity_graph_search(f: Frames) -> DataFrame:
    anchors = literal_rows(f.spark, [("Person", "Person:7"), ("Service", "Service:2"), ("Document", "Document:5")], "label string, canonical_id string")
    return graph.entity_search(f.symmetric_edges, f.nodes, anchors, 40)


_RANKED = "docs_ranked AS (SELECT canonical_id, row_number() OVER (ORDER BY degree DESC, canonical_id) - 1 AS rank FROM nodes WHERE label = 'Document' ORDER BY rank LIMIT 12)"


def _ranked_documents(f: Frames) -> DataFrame:
    from pyspark.sql import Window

    top = f.nodes.where("label = 'Document'").orderBy(F.desc("degree"), "canonical_id").limit(12)
    return top.select("canonical_id", (F.row_number().over(Window.orderBy(F.desc("degree"), "canonical_id")) - 1).cast("long").alias("rank"))


@query(f"""WITH {_RANKED}, pool AS (SELECT s.b, r.rank FROM sym s JOIN docs_ranked r ON r.canonical_id = s.a WHERE s.confidence = 'INFERRED' AND s.live ORDER BY CASE s.edge_type WHEN 'DISCUSSES' THEN 0 WHEN 'ASSIGNED_TO' THEN 5 WHEN 'TOUCHES' THEN 6 ELSE 7 END, s.valid_from DESC, s.b, s.a, s.edge_type LIMIT 20)
SELECT b AS canonical_id, min(rank) AS rank, count(*) AS linked_edges, round(1.0 / (1 + min(rank)), 6) AS score FROM pool GROUP BY b""")
def inferred_edge_neighbours(f: Frames) -> DataFrame:
    return graph.inferred_neighbours(f.symmetric_edges, _ranked_documents(f), 20)


@query("""WITH own AS (SELECT canonical_id FROM nodes WHERE (label, canonical_id) IN (('Person', 'Person:7'), ('Service', 'Service:2'), ('Repo', 'Repo:999999'))),
near AS (SELECT DISTINCT s.b FROM sym s JOIN own o ON o.canonical_id = s.a)
SELECT canonical_id, row_number() OVER (ORDER BY updated_at DESC NULLS LAST, canonical_id) - 1 AS rank FROM nodes WHERE label = 'Document' AND canonical_id IN (SELECT b FROM near) ORDER BY rank LIMIT 25""")
def entity_anchor_documents(f: Frames) -> DataFrame:
    anchors = literal_rows(f.spark, [("Person", "Person:7"), ("Service", "Service:2"), ("Repo", "Repo:999999")], "label string, canonical_id string")
    return graph.anchor_documents(f.symmetric_edges, f.nodes, anchors, 25)


@query(f"""WITH {_RANKED}, ok AS (SELECT * FROM sym WHERE live AND tier >= 1),
rolled AS (SELECT o.a AS canonical_id, count(DISTINCT edge_type) AS types, CAST(max(tier) AS INTEGER) AS strongest, count(DISTINCT o.b) AS documents FROM ok o JOIN docs_ranked r ON r.canonical_id = o.b WHERE NOT starts_with(o.a, 'Document:') GROUP BY o.a),
samples AS (SELECT canonical_id, array_to_string(list(b ORDER BY rank)[1:3], ',') AS samples FROM (SELECT DISTINCT o.a AS canonical_id, o.b, r.rank FROM ok o JOIN docs_ranked r ON r.canonical_id = o.b) GROUP BY canonical_id),
overall AS (SELECT a AS canonical_id, count(DISTINCT b) AS overall FROM ok WHERE starts_with(b, 'Document:') GROUP BY a)
SELECT canonical_id, label, types, strongest, documents, samples, round(documents / ln(1 + coalesce(overall, 1)), 6) AS score
FROM rolled JOIN samples USING (canonical_id) LEFT JOIN overall USING (canonical_id) JOIN nodes USING (canonical_id) WHERE canonical_id NOT IN ('Service:1', 'Repo:2') ORDER BY score DESC, canonical_id LIMIT 20""")
def related_entities(f: Frames) -> DataFrame:
    excluded = literal_rows(f.spark, [("Service", "service:1"), ("Repo", "Repo:2")], "label string, canonical_id string")
    return graph.related_entities(f.symmetric_edges, f.nodes, _ranked_documents(f), excluded, 20)


@query(f"""WITH {_RANKED}, near AS (SELECT s.* FROM sym s WHERE s.live AND s.a IN (SELECT canonical_id FROM docs_ranked)),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b, edge_type ORDER BY tier DESC, edge_type, b) AS d, row_number() OVER (PARTITION BY a ORDER BY tier DESC, edge_type, b) AS p FROM near)
SELECT a, b, edge_type, confidence FROM r WHERE d = 1 AND p <= 8""")
def graph_evidence(f: Frames) -> DataFrame:
    return graph.evidence(f.symmetric_edges, _ranked_documents(f))


@query("SELECT edge_type, confidence, count(*) AS n FROM (SELECT least(a, b) AS low, greatest(a, b) AS high, edge_type, min(coalesce(confidence, 'EXTRACTED')) AS confidence FROM sym GROUP BY ALL) GROUP BY ALL")
def undirected_edges(f: Frames) -> DataFrame:
    return graph.undirected(two_way(f.edges)).groupBy("edge_type", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT s.a AS document FROM sym s JOIN nodes n ON n.canonical_id = s.b WHERE s.live AND n.label = 'Person' AND starts_with(s.a, 'Document:') AND (lower(n.canonical_id) IN ('customer#000000012', 'person:9') OR regexp_replace(lower(n.canonical_id), '^.*[/:]', '') IN ('customer#000000012', 'person:9') OR lower(n.name) IN ('customer#000000012', 'person:9') OR regexp_replace(lower(n.canonical_id), '[^a-z0-9]', '', 'g') IN ('customer000000012', 'person9') OR regexp_replace(lower(n.name), '[^a-z0-9]', '', 'g') IN ('customer000000012', 'person9'))""")
def entity_filter_semi_join(f: Frames) -> DataFrame:
    return listing.entity_documents(f.symmetric_edges, f.nodes, "Person", ["Customer#000000012", "person:9"])


@query("""WITH g AS (SELECT label, canonical_id, name, updated_at, list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM nodes),
q AS (SELECT list_distinct(flatten(list_transform(['customer', '000000012'], lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS q),
s AS (SELECT label, canonical_id, name, updated_at, round(coalesce(len(list_intersect(g, q)) / nullif(len(list_distinct(list_concat(g, q))), 0), 0), 6) AS similarity FROM g, q)
SELECT label, canonical_id, name, similarity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, updated_at DESC NULLS LAST, canonical_id) AS rn FROM s WHERE similarity >= 0.3) WHERE rn <= 5 ORDER BY similarity DESC, updated_at DESC NULLS LAST, canonical_id LIMIT 20""")
def fuzzy_entity_probe(f: Frames) -> DataFrame:
    return text_index.probe_names(f.name_index, f.names, ["Customer 000000012"], 0.3, 5, 20).select("label", "canonical_id", "name", "similarity")


@query()
def community_detection(f: Frames) -> DataFrame:
    """Every node's community over all edges."""
    return graph.communities(f.edges)


@query("SELECT canonical_id, count(*) AS degree FROM (SELECT from_id AS canonical_id FROM edges UNION ALL SELECT to_id FROM edges WHERE from_id <> to_id) GROUP BY 1")
def recomputed_degrees(f: Frames) -> DataFrame:
    return writes.degrees(f.edges)


@query("SELECT 'Service:1' AS id, 'Service:1' AS resolved UNION ALL SELECT 'Service:2', 'Service:1' UNION ALL SELECT 'Service:9', 'Service:9'")
def alias_resolution(f: Frames) -> DataFrame:
    aliases = literal_rows(f.spark, [("Service", "Service:2", "Service:1"), ("Service", "Service:3", "Service:1")], "label string, alias string, primary string")
    refs = literal_rows(f.spark, [("Service", "Service:1"), ("Service", "Service:2"), ("Service", "Service:9")], "label string, id string")
    return writes.resolve_aliases(refs, aliases).select("id", "resolved")


_MOVED = """moved AS (SELECT edge_type, confidence, from_id AS old_from, to_id AS old_to, from_id IN ('Service:2', 'Service:3') OR to_id IN ('Service:2', 'Service:3') AS touched,
  CASE WHEN from_id IN ('Service:2', 'Service:3') THEN 'Service:1' ELSE from_id END AS from_id, CASE WHEN to_id IN ('Service:2', 'Service:3') THEN 'Service:1' ELSE to_id END AS to_id FROM edges WHERE edge_type = 'ASSIGNED_TO'),
placed AS (SELECT *, CASE WHEN touched AND from_id = to_id THEN 'self_loop' WHEN touched AND row_number() OVER (PARTITION BY edge_type, from_id, to_id ORDER BY touched, old_from, old_to) > 1 THEN 'duplicate_lane' ELSE 'kept' END AS fate FROM moved)"""


def _merged(f: Frames) -> dict[str, DataFrame]:
    edges = f.edges.where("edge_type = 'ASSIGNED_TO'").select("edge_type", "from_id", "to_id", "confidence")
    return writes.merge_cluster(f.named_nodes.where("label = 'Service'"), edges, "Service", "Service:1", ["Service:2", "Service:3"])


@query(f"WITH {_MOVED} SELECT to_id, CASE WHEN old_to <> to_id THEN old_to END AS alias_to, count(*) AS n FROM placed WHERE fate = 'kept' GROUP BY ALL")
def entity_merge(f: Frames) -> DataFrame:
    return _merged(f)["edges"].groupBy("to_id", "alias_to").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_MOVED} SELECT fate, count(*) AS n FROM placed WHERE fate <> 'kept' GROUP BY 1")
def entity_merge_snapshots(f: Frames) -> DataFrame:
    return _merged(f)["snapshots"].groupBy("fate").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_MOVED} SELECT CASE WHEN old_to = 'Service:2' THEN 'Service:2' ELSE to_id END AS to_id, count(*) AS n FROM placed WHERE fate = 'kept' GROUP BY 1")
def entity_unmerge(f: Frames) -> DataFrame:
    return writes.unmerge_alias(_merged(f), "Service:2")["edges"].groupBy("to_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n.canonical_id, n.label, CASE WHEN n.label = 'Document' THEN coalesce(nullif(d.title, ''), n.name) ELSE n.name END AS title FROM nodes n LEFT JOIN (SELECT 'Document:' || source_id AS canonical_id, title FROM docs WHERE valid_to IS NULL) d USING (canonical_id)")
def node_titles(f: Frames) -> DataFrame:
    live = f.documents.where("valid_to is null").select(F.concat(F.lit("Document:"), "source_id").alias("canonical_id"), "title")
    return graph.node_titles(f.named_nodes, live)


@query("SELECT canonical_id, degree, (SELECT count(*) FROM nodes WHERE label = 'Repo') AS total FROM nodes WHERE label = 'Repo' ORDER BY degree DESC, canonical_id LIMIT 40")
def nodes_with_total(f: Frames) -> DataFrame:
    return graph.with_total(f.nodes.where("label = 'Repo'").select("canonical_id", "degree"), 40, F.desc("degree"), F.asc("canonical_id"))


_MERGED = "a AS (SELECT 'Service:' || s_suppkey AS alias, 'Service:' || (s_suppkey - s_suppkey % 3) AS p FROM supplier WHERE s_suppkey % 3 <> 0)"


def _service_aliases(f: Frames) -> DataFrame:
    n = F.col("s_suppkey")
    made = f.table("supplier").where("s_suppkey % 3 <> 0 OR s_suppkey % 9 = 3")
    primary = F.when(n % 3 != 0, n - n % 3).otherwise(n - 3)
    return made.select(F.lit("Service").alias("label"), F.concat(F.lit("Service:"), n.cast("string")).alias("alias"), F.concat(F.lit("Service:"), primary.cast("string")).alias("primary"), F.concat(F.lit("m"), (n % 4).cast("string")).alias("merge_id"), F.expr("timestampadd(HOUR, CAST(s_suppkey * 7 % 50 AS INT), timestamp'2024-01-01 00:00:00')").alias("added_at"))


@query(f"WITH {_MERGED} SELECT coalesce(a.p, canonical_id) AS canonical_id, source_system, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM provenance LEFT JOIN a ON a.alias = canonical_id GROUP BY ALL")
def provenance_merge(f: Frames) -> DataFrame:
    aliases = _service_aliases(f).where("cast(split_part(alias, ':', 2) as long) % 3 <> 0")
    return provenance.merged_provenance(f.provenance, aliases)


@query(f"WITH {_MERGED}, m AS (SELECT coalesce(a.p, canonical_id) AS canonical_id, source_system, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM provenance LEFT JOIN a ON a.alias = canonical_id GROUP BY ALL) SELECT * FROM m WHERE starts_with(canonical_id, 'Service:') UNION ALL SELECT canonical_id, source_system, first_seen, last_seen FROM provenance WHERE canonical_id = 'Service:2'")
def provenance_after_unmerge(f: Frames) -> DataFrame:
    aliases = _service_aliases(f).where("cast(split_part(alias, ':', 2) as long) % 3 <> 0")
    services = f.provenance.where(F.col("canonical_id").startswith("Service:"))
    return provenance.restored_provenance(provenance.merged_provenance(services, aliases), services, "Service:2")


@query("""WITH a AS (SELECT 'Service:' || s_suppkey AS alias, 'Service:' || CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey - s_suppkey % 3 ELSE s_suppkey - 3 END AS p, 'm' || (s_suppkey % 4) AS merge_id, TIMESTAMP '2024-01-01 00:00:00' + (s_suppkey * 7 % 50) * INTERVAL 1 HOUR AS added_at FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 9 = 3)
SELECT 'Service' AS label, p AS primary_id, any_value(n.name) AS name, '[' || string_agg('{"alias":"' || alias || '","merge_id":"' || merge_id || '"}', ',' ORDER BY added_at, alias) || ']' AS aliases, max(added_at) AS last_added
FROM a LEFT JOIN nodes n ON n.canonical_id = p WHERE p NOT IN (SELECT alias FROM a) GROUP BY p""")
def cluster_listing(f: Frames) -> DataFrame:
    return provenance.clusters(_service_aliases(f), f.named_nodes).withColumnRenamed("primary", "primary_id")


@query("SELECT canonical_id, name FROM (SELECT 'Person:' || (user_id % 100) AS canonical_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type || ' ' || (event_id % 50) END AS name, ts AS updated_at FROM events) WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY updated_at DESC, name) = 1")
def latest_display_names(f: Frames) -> DataFrame:
    named = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat("event_type", F.lit(" "), (F.col("event_id") % 50).cast("string")))
    return provenance.display_names(f.table("events").select(F.concat(F.lit("Person:"), (F.col("user_id") % 100).cast("string")).alias("canonical_id"), named.alias("name"), F.col("ts").cast("timestamp").alias("updated_at")))


@query()
def leiden_communities(f: Frames) -> DataFrame:
    """Every node's community of large modularity."""
    return leiden.leiden(f.edges)


@query("""WITH pairs AS (SELECT DISTINCT least(from_id, to_id) AS a, greatest(from_id, to_id) AS b FROM edges WHERE from_id <> to_id), both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
named AS (SELECT a, split_part(a, ':', 1) || CAST(split_part(a, ':', 2) AS BIGINT) % 3 AS x, split_part(b, ':', 1) || CAST(split_part(b, ':', 2) AS BIGINT) % 3 AS y FROM both_ways)
SELECT x AS community, count(*) FILTER (x = y) AS inside, count(*) AS k, round(count(*) FILTER (x = y) / (SELECT count(*) FROM both_ways) - pow(count(*) / (SELECT count(*) FROM both_ways), 2), 9) AS share FROM named GROUP BY x""")
def partition_modularity(f: Frames) -> DataFrame:
    """The modularity of a partition by label and id, community by community."""
    ends = f.edges.select(F.explode(F.array("from_id", "to_id")).alias("node")).distinct()
    labels = ends.select("node", F.concat(F.split_part("node", F.lit(":"), F.lit(1)), (F.split_part("node", F.lit(":"), F.lit(2)).cast("long") % 3).cast("string")).alias("community"))
    return leiden.partition_modularity(f.edges, labels)
