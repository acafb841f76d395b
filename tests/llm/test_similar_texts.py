"""The pipeline's near-duplicates stage against brute-force similarity."""

import corpus_pipeline as pipeline
import numpy as np
import pandas as pd
from siltstone.llm import similar_texts
from siltstone.llm.similar_texts import _by_similarity, _spanning


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept_by_brute_force(rows):
    """The least doc_id of each group of texts 0.8 or more alike."""
    sets = [(i, shingles(t or "")) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            low, high = sorted((len(x), len(y)))
            if low >= 0.8 * high and len(x & y) >= 0.8 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for i, (doc, _) in enumerate(sets):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return set(least.values())


def edited(random, copies, share):
    """Copies of one text of 300 words, each with about `share` of its words changed."""
    base = [f"w{random.integers(5000)}" for _ in range(300)]
    return [" ".join(w if random.random() > share else f"x{random.integers(10**9)}" for w in base) for _ in range(copies)]


def test_stage_links_all_that_is_similar(spark, monkeypatch):
    random = np.random.default_rng(3)
    texts = [t for share in (0.005, 0.01, 0.015, 0.02, 0.03) for _ in range(12) for t in edited(random, 4, share)]
    texts += edited(random, 60, 0.01) + [None, "", "  ", "One two", "one  TWO", "one two three"]
    rows = list(enumerate(texts))
    expected = kept_by_brute_force(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block, size in ((similar_texts.BLOCK, similar_texts.BLOCK_BYTES), (16, 8 * 3000)):
        monkeypatch.setattr(similar_texts, "BLOCK", block)
        monkeypatch.setattr(similar_texts, "BLOCK_BYTES", size)
        assert {r["doc_id"] for r in pipeline.keep_one_of_near_duplicates(spark, df, "").collect()} == expected


def test_stage_keeps_unrelated_texts_of_one_id(spark):
    random = np.random.default_rng(5)
    one, other, third = (edited(random, 1, 0)[0] for _ in range(3))
    rows = [(7, one, "x"), (7, other, "x"), (8, one, "x"), (9, other + " more", "x"), (None, third, "x"), (None, third, "x"), (None, one, "x"), (7, one, "x"), (3, None, "x"), (4, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string")
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in pipeline.keep_one_of_near_duplicates(spark, df, "").collect())
    assert got == sorted([("7", one), ("7", other), ("None", third), ("3", "")])
    assert pipeline.keep_one_of_near_duplicates(spark, df.limit(0), "").count() == 0


def test_stage_on_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = pd.read_parquet(f"{folder}/documents.parquet")[["doc_id", "text"]].values.tolist()
    kept = pipeline.keep_one_of_near_duplicates(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert {r["doc_id"] for r in kept.collect()} == kept_by_brute_force(rows)


def test_similarity_is_exact_at_the_edge():
    x, y, z = (np.arange(a, b, dtype="<u8").tobytes() for a, b in ((0, 90), (10, 100), (11, 101)))
    near = _by_similarity([x], [y, z])
    assert near(0, np.array([0, 1])).tolist() == [True, False]  # 80 of 100, 79 of 101
    assert _spanning(np.array([5]), np.array([6, 7]), near) == ([5], [6])


def test_fingerprints_give_candidates_of_their_own(spark, monkeypatch):
    """Copies and slight edits are linked by the fingerprints' index when no band is shared; what it links is judged by similarity as well."""
    random = np.random.default_rng(9)
    base = edited(random, 1, 0)[0].split()
    slight = [" ".join([*base, f"end{i}"]) for i in range(6)]
    rows = list(enumerate([*slight, *edited(random, 3, 0), "One two", "one  TWO"]))
    monkeypatch.setattr(similar_texts, "_by_signature", lambda left, right: lambda i, others: np.zeros(len(others), bool))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in pipeline.keep_one_of_near_duplicates(spark, df, "").collect()} == kept_by_brute_force(rows)
    monkeypatch.setattr(similar_texts, "_by_similarity", lambda left, right: lambda i, others: np.zeros(len(others), bool))
    assert pipeline.keep_one_of_near_duplicates(spark, df, "").count() == len(rows) - 3  # equal sets alone: two of three copies, and one of two cases
