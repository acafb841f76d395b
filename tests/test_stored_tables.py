"""What the stored tables cost: no sample run of a build, no shuffle of postings, no edges for what needs none."""

from collections import Counter

from conftest import SF
from pyspark.sql import functions as F
from siltstone.model.frames import Frames, postings
from siltstone.store import stored


def test_a_build_runs_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def build():
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return spark.range(1000).mapInArrow(run, "id long")

    spark.range(1).write.parquet(str(tmp_path / "source"))
    assert stored(spark, "once", [str(tmp_path / "source")], str(tmp_path), build, "id").count() == 1000
    assert seen.value == 1000


def test_postings_are_counted_where_chunks_are(spark):
    chunks = Frames(spark, SF).chunks
    made = postings(chunks)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    few = chunks.limit(50).localCheckpoint()
    got = Counter({(r["chunk_id"], r["field"], r["term"]): r["tf"] for r in postings(few).collect()})
    plain = Counter((r["chunk_id"], c, w) for r in few.collect() for c in ("title", "content") for w in __import__("re").findall("[a-z0-9_]+", r[c].lower()) if len(w) > 1)
    assert got == plain


def test_names_need_no_edges(spark, monkeypatch):
    monkeypatch.setattr(Frames, "_edges", lambda f: (_ for _ in ()).throw(AssertionError("edges were built")))
    monkeypatch.setattr(Frames, "_nodes", lambda f: (_ for _ in ()).throw(AssertionError("degrees were counted")))
    frames = Frames(spark, SF)
    assert frames.named_nodes.count() == frames.named_nodes.select("canonical_id").distinct().count() > 0
    for table in (frames.name_index, frames.names, frames.bare_ids):
        assert table.where(F.col("customer_id").isNotNull()).limit(1).count() == 1


def test_degrees_are_counted_without_stored_edges(spark, monkeypatch):
    edges = [(r["from_id"], r["to_id"], r["customer_id"]) for r in Frames(spark, SF)._edges().collect()]
    degree, own = Counter(), Counter()
    for a, b, tenant in edges:
        for end in {a, b}:
            degree[end] += 1
            own[end] += tenant != "shared"
    monkeypatch.setattr(Frames, "_tenant_edges", property(lambda f: (_ for _ in ()).throw(AssertionError("edges were stored"))))
    for r in Frames(spark, SF)._nodes().collect():
        assert (r["degree"], r["own_degree"]) == (degree[r["canonical_id"]], own[r["canonical_id"]])


def test_lines_are_dealt_once(spark):
    plan = Frames(spark, SF)._edges()._jdf.queryExecution().executedPlan().toString()
    assert len(__import__("re").findall(r"Exchange hashpartitioning\(l_orderkey", plan)) == 1
