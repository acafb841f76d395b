"""Vector and text indexes: recall, exactness, filters, and that plans read only what they need."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from siltstone.expr.text import bare_ids, grounding_tokens, tokens, trigrams
from siltstone.model.frames import Frames, postings
from siltstone.operators import retrieval, text_index, vector_index
from siltstone.operators.vector_index import VectorIndex, indexed_search
from siltstone.store import stored


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue().split("===== Subqueries")[0]  # those repeat a broadcast that is reused when the plan runs


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """2,000 vectors around 40 centres, one of which holds a third of them; and null, zero, short and non-finite ones."""
    random = np.random.default_rng(5)
    centres = random.normal(size=(40, 24))
    x = centres[np.where(np.arange(2000) % 3 == 0, 0, random.integers(0, 40, 2000))] + 0.5 * random.normal(size=(2000, 24))
    rows = [(i, f"src{i % 5}", [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(5000, "src0", None), (5001, "src0", [0.0] * 24), (5002, "src1", [1.0, 2.0]), (5003, "src1", [None] * 24), (5004, "src1", [])]
    df = spark.createDataFrame(rows, "vec_id long, source_system string, embedding array<double>").withColumns({"updated_at": F.lit("2024-01-01").cast("timestamp"), "customer_id": F.lit("acme")})
    folder = str(tmp_path_factory.mktemp("vectors"))
    df.write.parquet(f"{folder}/v")
    df = spark.read.parquet(f"{folder}/v")
    means = vector_index.centroids(df)
    stored_rows = stored(spark, "test-vectors", [f"{folder}/v"], "", lambda: vector_index.placed(df, means), ["vec_id"], ["cell"])
    return df, VectorIndex(stored_rows, vector_index.cells(stored_rows, means)), x


def test_recall_of_the_nearest_cells(spark, clustered):
    df, index, x = clustered
    assert index.cells.count() >= 20 and index.rows.count() == df.count()
    found = total = 0
    for q in range(0, 2000, 100):
        scores = np.round(x @ x[q] / np.sqrt((x * x).sum(axis=1) * (x[q] @ x[q])), 6)
        best = set(np.lexsort((np.arange(2000), -scores))[:10].tolist())
        got = {r["vec_id"] for r in indexed_search(index, x[q].tolist(), 10).collect()}
        found, total = found + len(best & got), total + 10
    assert found / total >= 0.9


@pytest.mark.parametrize("options", [{}, {"sources": ("src2",)}, {"k": 300}, {"k": 3000}])
def test_the_exact_form_equals_a_scan(spark, clustered, options):
    df, index, x = clustered
    k, sources = options.get("k", 10), options.get("sources", ())
    for query in (x[3].tolist(), (-x[7]).tolist(), [0.0] * 24, [1.0, 2.0]):
        kept = df.where(F.col("source_system").isin(*sources)) if sources else df
        expected = [(r["vec_id"], r["score"]) for r in retrieval.vector_search(kept, query, k).collect()]
        assert [(r["vec_id"], r["score"]) for r in indexed_search(index, query, k, exact=True, sources=sources).collect()] == expected
    within = df.where("vec_id % 97 = 0")
    expected = [r["vec_id"] for r in retrieval.vector_search(df, x[3].tolist(), 10, within=within).collect()]
    assert [r["vec_id"] for r in indexed_search(index, x[3].tolist(), 10, exact=True, within=within).collect()] == expected


def test_recall_on_the_given_vectors(spark):
    f = Frames(spark, "/root/testdata/sf0.1")
    random, found = np.random.default_rng(3), 0
    for _ in range(8):
        query = random.normal(size=64).tolist()
        best = {r["vec_id"] for r in retrieval.vector_search(f.vectors, query, 10).collect()}
        found += len(best & {r["vec_id"] for r in indexed_search(f.vector_index, query, 10, probes=16).collect()})
    assert found >= 0.9 * 80


def test_only_chosen_cells_are_read(spark, clustered):
    _, index, x = clustered
    for exact in (False, True):
        plan = plan_of(indexed_search(index, x[3].tolist(), 10, exact=exact))
        assert "PartitionFilters: [isnotnull(cell" in plan and "dynamicpruningexpression" in plan


def test_vectors_that_none_can_use(spark):
    empty = spark.createDataFrame([(1, "s", None), (2, "s", [0.0])], "vec_id long, source_system string, embedding array<double>").withColumns({"updated_at": F.lit(None).cast("timestamp"), "customer_id": F.lit("a")})
    means = vector_index.centroids(empty)
    rows = vector_index.placed(empty, means)
    assert means.count() == 0
    assert [(r["vec_id"], r["score"]) for r in indexed_search(VectorIndex(rows, vector_index.cells(rows, means)), [1.0], 5, exact=True).collect()] == [(1, 0.0), (2, 0.0)]


TEXTS = ["Ünïcode names: a_b c-d", "The THE the", "x", "", "  ", "PR #77 of ABC-12, deadbeef12 and 1234567", "don't stop 3.14 Ⅷ ½", "show me what (is) \"this\"...", "日本語 テキスト"]


def test_python_forms_of_a_query_agree_with_columns(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    ids = F.transform(bare_ids(F.col("t")), lambda b: b["id"])
    for r in df.select("t", trigrams(F.col("t")).alias("g"), tokens(F.col("t")).alias("w"), ids.alias("i"), grounding_tokens(F.col("t")).alias("c")).collect():
        assert text_index.query_grams(r["t"]) == r["g"]
        assert text_index.query_words(r["t"]) == list(dict.fromkeys(r["w"]))
        assert text_index.named_ids(r["t"]) == list(dict.fromkeys(r["i"]))
        assert text_index.content_words(r["t"]) == r["c"]


def test_probes_read_keys_and_not_names(spark):
    f = Frames(spark, SF)
    plan = plan_of(text_index.probe_names(f.name_index, f.names, ["Customer 000000012", "supplier"]))
    assert "In(key, " in plan and plan.count("/name-index-") == 1 and "nodes-" not in plan and "shelf" in plan
    assert "documents.parquet" not in plan_of(text_index.probe_titles(f.title_index, f.titles, ["The the erntre"]))
    found = text_index.probe_names(f.name_index, f.names, ["Customer 000000012", "nothing like it qqq"])
    assert {r["probe"] for r in found.collect()} == {0}
    assert text_index.probe_names(f.name_index, f.names, ["", "#"]).count() == 0


def test_keyword_search_reads_postings_alone(spark):
    f = Frames(spark, SF)
    plan = plan_of(retrieval.keyword_search(f.keyword_index, f.documents, ["die the Oneaan", "und"], 20))
    assert not [x for x in plan.splitlines() if "/chunks-" in x]
    assert plan.count("/postings-") == 1 and "In(term, " in plan
    both = retrieval.keyword_search(f.keyword_index, f.documents, ["die the Oneaan", "", "und"], 5).collect()
    alone = [retrieval.keyword_search(f.keyword_index, f.documents, [q], 5).drop("sub_query").collect() for q in ("die the Oneaan", "und")]
    for number, rows in zip((0, 2), alone, strict=True):
        assert {tuple(r)[1:] for r in both if r["sub_query"] == number} == {tuple(r) for r in rows}
    assert not [r for r in both if r["sub_query"] == 1]


def test_a_hot_term_is_spread_over_files(spark, tmp_path):
    chunks = spark.range(4000).selectExpr("'acme' AS customer_id", "concat('c', id) AS chunk_id", "'d' AS doc_id", "1L AS first_seen_version", "1L AS last_seen_version", "'approved' AS visibility", "timestamp'2024-01-01' AS valid_from", "CAST(NULL AS TIMESTAMP) AS valid_to", "'the' AS title", "'the the' AS content", "1 AS title_length", "2 AS content_length")
    chunks.write.parquet(str(tmp_path / "c"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join ranges this small
    made = stored(spark, "test-postings", [str(tmp_path / "c")], "", lambda: postings(spark.read.parquet(str(tmp_path / "c"))), ["term", "chunk_id"], ["customer_id"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert made.where("term = 'the'").select(F.input_file_name()).distinct().count() > 1


def test_a_tenant_reads_its_own_folder(spark):
    f = Frames(spark, SF).of("globex")
    for df in (f.chunks, f.edges, f.symmetric_edges, f.nodes, f.postings, f.name_index):
        assert "PartitionFilters: [isnotnull(customer_id" in plan_of(df)
    every = Frames(spark, SF)
    assert f.nodes.join(every.nodes, "canonical_id", "left_semi").count() == f.nodes.count() < every.nodes.count()
    degrees = f.symmetric_edges.groupBy(F.col("a").alias("canonical_id")).count()
    assert f.nodes.join(degrees, "canonical_id", "left").where("degree <> coalesce(count, 0)").count() == 0
    assert f.edges.where("NOT (split_part(from_id, ':', 2) % 10 = 3 AND split_part(to_id, ':', 2) % 10 = 3)").count() == 0
    assert f.vector_index.rows.where("vec_id % 10 <> 3").count() == 0
