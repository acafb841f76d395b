"""Views of sources on small documents, and the functions over whole columns."""

import pytest
from pyspark.sql import functions as F
from siltstone.functions import udfs
from siltstone.operators import source_view


@pytest.fixture(scope="module")
def lines(spark):
    bodies = {"a": "one\ntwo 123\nthree\nfour 456\nfive\nsix\nseven\neight\nnine 789\n", "b": "é" * 50, "c": "", "d": None}
    df = spark.createDataFrame([("acme", d, 1, b) for d, b in bodies.items()], "customer_id string, doc_id string, version long, body string")
    return source_view.line_index(df)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy("doc_id", "line").collect()]


def test_lines_and_their_places(lines):
    got = rows(lines.where("doc_id = 'a'"), "doc_id", "line", "begin", "content")
    assert got[:3] == [("a", 1, 0, "one"), ("a", 2, 4, "two 123"), ("a", 3, 12, "three")] and got[-1][3] == "" and len(got) == 10
    assert lines.where("doc_id = 'c'").count() == 1 and lines.where("doc_id = 'd'").count() == 0


def test_pages(lines):
    columns = ("doc_id", "line", "content", "next_cursor", "truncated")
    assert rows(source_view.page(lines, ["a"], 2, 2), *columns) == [("a", 2, "two 123", 4, True), ("a", 3, "three", 4, True)]
    assert rows(source_view.page(lines, ["a"], 9, 20), *columns) == [("a", 9, "nine 789", None, False), ("a", 10, "", None, False)]
    assert rows(source_view.page(lines, ["a"], 1, 20, 13), *columns) == [("a", 1, "one", 3, True), ("a", 2, "two 123", 3, True)]
    assert rows(source_view.page(lines, ["b"], 1, 5, 7), *columns) == [("b", 1, "é" * 3, None, True)]
    assert rows(source_view.page(lines, ["a"], 11), *columns) == [] == rows(source_view.page(lines, []), *columns)
    tail = source_view.page(lines, ["a", "c"], most_lines=2, tail=True)
    assert rows(tail, *columns) == [("a", 9, "nine 789", None, True), ("a", 10, "", None, True), ("c", 1, "", None, False)]


def test_grep(lines):
    columns = ("doc_id", "section", "line_start", "line_end", "line", "matched")
    found = rows(source_view.grep(lines, ["a"], "[0-9]+", context=1), *columns)
    assert found == [("a", 1, 1, 5, n, n in (2, 4)) for n in range(1, 6)] + [("a", 2, 8, 10, n, n == 9) for n in range(8, 11)]
    assert [r[4] for r in rows(source_view.grep(lines, ["a"], "[0-9]+", context=0, most_matches=2), *columns)] == [2, 4]
    assert [r[4] for r in rows(source_view.grep(lines, ["a"], "TWO 1", literal=True, context=0), *columns)] == [2]
    assert rows(source_view.grep(lines, ["a"], "nothing"), *columns) == []


def test_whole_documents(spark, lines):
    got = {r["doc_id"]: (r["bytes"], r["too_large"], r["text"]) for r in source_view.whole(lines, ["a", "b", "c"], 60).collect()}
    assert got["a"] == (57, False, "one\ntwo 123\nthree\nfour 456\nfive\nsix\nseven\neight\nnine 789\n") and got["b"] == (100, True, None) and got["c"] == (0, False, "")


def test_search_of_chunks(spark):
    chunks = spark.createDataFrame([("d", f"c{i}", i, t) for i, t in enumerate(["the The", "no", "the end of the", "END"])], "doc_id string, chunk_id string, chunk_index long, content string").withColumn("valid_to", F.lit(None).cast("timestamp"))
    got = [(r["chunk_id"], r["score"], r["content"]) for r in source_view.search(chunks, ["d"], "the end THE", most_bytes=20).orderBy("rank").collect()]
    assert got == [("c2", 3, "the end of the")]
    assert [(r["chunk_id"], r["content"]) for r in source_view.search(chunks, ["d"], "the", 1, 3).collect()] == [("c0", "the")]


def test_embedding_goes_on_after_failures(spark):
    def embed(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no vector")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(i, "bad" if i in (3, 11) else None if i == 5 else "x" * i) for i in range(20)], "id long, text string").coalesce(2)
    got = {r["id"]: (r["embedding"], r["failed"]) for r in udfs.embedded(df, embed, 8).collect()}
    assert got == {i: (None, True) if i in (3, 5, 11) else ([float(i)], False) for i in range(20)}


def test_budgets_symbols_and_json(spark):
    hits = spark.createDataFrame([("r", i, "y" * 1000) for i in range(4)] + [("s", 0, "short")], "response string, rank long, content string")
    got = {(r["response"], r["rank"]): len(r["content"]) for r in udfs.budgeted(hits, 2000, 1500).collect()}
    assert got[("s", 0)] == 5 and sum(n for (r, _), n in got.items() if r == "r") <= 2000 and ("r", 0) in got
    cut = udfs.split_symbols(spark.createDataFrame([("f", "a b c\n\nd e f\n\ng"), ("g", None)], "symbol string, body string"), 6).orderBy("symbol", "piece").collect()
    assert [(r["symbol"], r["piece"]) for r in cut][:2] == [("f", 0), ("f", 1)] and cut[0]["text"].startswith("# f\n") and cut[1]["text"].startswith("# f (more)\n")
    fixed = spark.createDataFrame([('{"a": [1, {"b": "c',), ("[1, 2",), ("nope",), (None,)], "t string").select(udfs.repaired_json("t").alias("j")).collect()
    assert [r["j"] for r in fixed] == ['{"a":[1,{"b":"c"}]}', "[1,2]", None, None]
