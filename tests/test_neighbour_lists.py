"""Rounds of label propagation join lists of neighbours and deal each vote once."""

from siltstone.operators import graph


def test_lists_hold_every_neighbour_in_rows_of_bounded_length(spark, monkeypatch):
    monkeypatch.setattr(graph, "LIST_NODES", 4)
    pairs = [(0, b) for b in range(1, 30)] + [(5, 9), (7, 8)]
    rows = graph._neighbour_lists(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert max(len(r["near"]) for r in rows) <= 4
    assert sorted((r["node"], b) for r in rows for b in r["near"]) == sorted([*pairs, *((b, a) for a, b in pairs)])


def test_a_round_deals_votes_once(spark, monkeypatch):
    plans, whole = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or whole(df, name))
    monkeypatch.setattr(graph, "LIST_NODES", 5)
    edges = spark.createDataFrame([(f"{g}{i}", f"{g}{j}") for g in "abc" for i in range(8) for j in range(i)] + [("a0", "b0"), ("b1", "c1")], "from_id string, to_id string")
    found = {r["node"]: r["community"] for r in graph.communities(edges, 10).collect()}
    assert found == {f"{g}{i}": f"{g}0" for g in "abc" for i in range(8)}
    rounds = [[line for line in plan.splitlines() if "Exchange hashpartitioning" in line] for name, plan in plans if name == "wants"]
    assert rounds and not any("community" in line.split("[plan_id")[0] for lines in rounds for line in lines)  # all by node
