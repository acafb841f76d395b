"""The audit against a plain count over all groups and all terms."""

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from siltstone.llm import divergence as module
from siltstone.llm.common import Scratch
from siltstone.llm.divergence import TermCounts, divergence, sketch, terms

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(LOWER))


def plain(rows, least, top):
    """rows: (lang, source, text)."""
    documents, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        groups[lang].add(source)
        documents[lang].update(set(words(text)))
        counts[lang, source].update(words(text))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in documents[lang].items() if n >= least)
        share = {}
        for s in [*sources, None]:
            own = {t: sum(counts[lang, x][t] for x in (sources if s is None else [s])) for t in kept}
            share[s] = {t: 1 + 10**9 * (own[t] + 5) // (sum(own.values()) + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = sorted((-sum(abs(share[s][t] - share[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            over = sorted((share[None][t] - share[s][t], t.encode()) for t in kept if counts[lang, s][t] and share[s][t] > share[None][t])[:top]
            for part, found in (("pair", pairs), ("term", over)):
                out |= {(lang, s, part, item.decode(), -v, rank + 1) for rank, (v, item) in enumerate(found)}
    return out


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "lang string, source string, text string, term string, n int, docs int")


@pytest.mark.parametrize("seed", range(3))
def test_against_a_plain_count(spark, seed):
    random = np.random.default_rng(seed)
    vocabulary = ["The", "the", "ÉTÉ", "été", "日本", "a", "zz", "x1y", "don't", "Ω", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(random.choice(["en", "", "fr"]), random.choice(["s", "t", "é", "", "long"]), " ".join(random.choice(vocabulary, int(random.integers(0, 15))))) for _ in range(120)]
    rows += [(None, None, None), ("en", None, ""), ("xx", "only", "\x00 7 _"), ("en", "empty", None), rows[0], rows[0]]
    for least in (1, 4, 30, 10_000):
        assert {tuple(r) for r in divergence(made(spark, rows), least, 3).collect()} == plain(rows, least, 3)


def test_more_documents_than_a_counter_holds(spark):
    rows = [("en", f"s{i % 2}", "often") for i in range(700)]
    assert {tuple(r) for r in divergence(made(spark, rows), 600, 3).collect()} == plain(rows, 600, 3)
    assert {tuple(r) for r in divergence(made(spark, rows), 701, 3).collect()} == plain(rows, 701, 3)


def test_the_smallest_table_and_nothing(spark):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    rows = list(docs[["lang", "source", "text"]].itertuples(index=False, name=None))
    got = [tuple(r) for r in divergence(made(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, 30, 50)
    assert divergence(made(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("stretch", [1, 3, 7, 1 << 20])
def test_a_long_text_is_cut_between_terms(monkeypatch, stretch):
    monkeypatch.setattr(module, "STRETCH", stretch)
    text = "One two,, THREE été日本 " * 20 + "q" * 9000 + " end"
    assert [t.decode() for part in terms(memoryview(text.encode())) for t in part] == words(text)


def test_tasks_hand_on_before_they_hold_too_much(spark, monkeypatch):
    counts = TermCounts()
    for text in ("a b a", "b c"):
        counts.add("en", "s", memoryview(text.encode()))
    assert counts.size == 3
    got = {r["term"]: (r["docs"], r["n"]) for b in counts.batches() for r in b.to_pylist()}
    assert got == {"a": (1, 2), "b": (2, 2), "c": (1, 1)} and counts.size == 0


def test_estimates_are_never_too_low(spark):
    """On a sketch of far fewer counters than terms, too; a wide one discards nearly all that is rare."""
    rows = [("en", f"t{i}", 1 + i % 40 // 35 * 9) for i in range(30_000)]
    partial = spark.createDataFrame(rows, "lang string, term string, docs long").repartition(3)
    hashed = {r["term"]: r["h"] for r in partial.selectExpr("term", "xxhash64(lang, term) AS h").collect()}
    passed = {}
    for bits in (14, 20):
        bitmap = sketch(spark, Scratch(spark, "s"), partial, bits, 10)
        cells = module._cells(np.array([hashed[f"t{i}"] for i in range(30_000)]), bits)
        passed[bits] = (bitmap[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).all(axis=0)
        assert all(passed[bits][i] for i in range(30_000) if rows[i][2] >= 10)
    assert passed[20].sum() < 1.01 * sum(n >= 10 for _, _, n in rows) and passed[14].sum() >= passed[20].sum()
