"""Hand-checked cases of scores, time frames, text functions and chunking."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F
from siltstone.expr import scoring, temporal, text
from siltstone.functions import chunking
from siltstone.model.frames import windows


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("confidence", "sources", "communities", "degrees", "expected"),
    [
        (None, (None, None), (None, None), (0, 0), 1.0),
        ("INFERRED", ("a", "b"), (1, 2), (1, 5), 3.4125),
        ("AMBIGUOUS", ("a", "b"), (1, 2), (0, 0), 1.5),
        ("EXTRACTED", ("a", "a"), (None, None), (50, 50), 0.5),
    ],
)
def test_surprise(spark, confidence, sources, communities, degrees, expected):
    lit = lambda v, t: F.lit(v).cast(t)
    got = value(spark, scoring.surprise(lit(confidence, "string"), *(lit(s, "string") for s in sources), *(lit(c, "int") for c in communities), *(lit(d, "int") for d in degrees)))
    assert got == pytest.approx(expected)


def test_decay_halves_after_a_half_life(spark):
    got = value(spark, scoring.source_weight(F.lit("s"), F.lit("2025-01-01").cast("timestamp"), "2025-01-08", F.lit(0.5), F.lit(7.0)))
    assert got == pytest.approx(0.25)
    assert value(spark, scoring.source_weight(F.lit(None).cast("string"), F.lit("2025-01-01").cast("timestamp"), "2025-01-08")) == 1.0
    assert value(spark, scoring.source_weight(F.lit("s"), F.lit("2026-01-01").cast("timestamp"), "2025-01-08", F.lit(0.5))) == 0.5


def test_cosine_of_zero_and_unequal(spark):
    arrays = [([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], 0.0), ([3.0, 4.0], [3.0, 4.0], 1.0)]
    for a, b, expected in arrays:
        assert value(spark, scoring.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))) == pytest.approx(expected)


def test_confidence_floor(spark):
    assert value(spark, scoring.passes_confidence(F.lit(None).cast("string"), "EXTRACTED"))
    assert not value(spark, scoring.passes_confidence(F.lit("AMBIGUOUS"), "INFERRED"))
    assert value(spark, scoring.passes_confidence(F.lit("AMBIGUOUS"), None))


def test_as_of_is_half_open(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01' AS valid_from, timestamp'2024-02-01' AS valid_to")
    assert rows.where(temporal.document_predicate(temporal.Temporal("AS_OF", at="2024-02-01"))).count() == 0
    assert rows.where(temporal.document_predicate(temporal.Temporal("AS_OF", at="2024-01-01"))).count() == 1


def test_resolve_time_frames():
    now = datetime(2025, 6, 1, tzinfo=UTC)
    assert temporal.resolve(None, now) == (None, None)
    spec, error = temporal.resolve({"since": {"rel": -7}}, now)
    assert error is None and spec.mode == "CHANGED_BETWEEN" and spec.since.startswith("2025-05-25") and spec.until.startswith("2025-06-01")
    assert temporal.resolve({"since": {"abs": "2025-06-02"}}, now)[1]
    assert temporal.resolve({"unresolvable_anchor": "the outage"}, now)[0] is None


@pytest.mark.parametrize(("tokens", "sizes"), [(0, []), (1, [1]), (512, [512]), (513, [512, 65]), (960, [512, 512]), (961, [512, 512, 65])])
def test_chunk_windows(spark, tokens, sizes):
    df = spark.createDataFrame([("d", " ".join(["w"] * tokens))], "doc_id string, body string")
    assert [r["n_tokens"] for r in windows(df, "body", 512, 64, "doc_id").orderBy("chunk_index").collect()] == sizes


def test_text_functions(spark):
    got = value(spark, text.bare_ids(F.lit("see ABC-12 and PR #77 at 0a1b2c3d4e")))
    assert [(r["kind"], r["id"]) for r in got] == [("ticket", "ABC-12"), ("pr", "77"), ("commit_sha", "0a1b2c3d4e")]
    assert value(spark, text.grounding_tokens(F.lit("Where is the (auth.py) file, please?"))) == ["auth.py", "file"]
    assert value(spark, text.residual(F.lit("ticket ABC-17"), F.array(F.lit("ABC-17")))) is None
    assert value(spark, text.residual(F.lit("ABC-17 auth refactor"), F.array(F.lit("ABC-17")))) == "auth refactor"
    assert value(spark, text.similarity(text.trigrams(F.lit("word")), text.trigrams(F.lit("two words")))) == pytest.approx(4 / 11)
    assert value(spark, text.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2


def test_reconstruction_joins_whole_overlaps_only(spark):
    from siltstone.functions.udfs import reconstructed

    rows = [("d", "the cat sat on a", 0), ("d", "apple pie is good", 1), ("e", "one two three", 0), ("e", "two three four", 1), ("e", "three", 2), ("f", "a b", 0), ("f", "a b", 1)]
    chunks = spark.createDataFrame([(d, f"c{i}", i, c, None) for d, c, i in rows], "doc_id string, chunk_id string, chunk_index long, content string, valid_to timestamp")
    got = {r["doc_id"]: r["text"] for r in reconstructed(chunks, overlap=2, separator=" | ").collect()}
    assert got == {"d": "the cat sat on a | apple pie is good", "e": "one two three four | three", "f": "a b"}
    assert chunking.border_lengths("ab\0ab", "ab\0x") == [2] and chunking.border_lengths("xaa", "aab") == [2, 1] and chunking.border_lengths("a", "") == []


def test_native_text_functions(spark):
    for raw in ("añb", "日本語x", "😀😀", "ab", "", "\ufffdé"):
        for most in range(9):
            expected = raw.encode()[:most].decode("utf-8", "ignore") if len(raw.encode()) > most else raw
            assert value(spark, text.within_bytes(F.lit(raw), most)) == expected, (raw, most)
    assert value(spark, text.clean_citations(F.lit("x [1, 2] [ 2 ] [3 ,4,5] [a, 1]"))) == "x [1][2] [3][4][5] [a, 1]"
    vector = value(spark, text.hash_vector(F.lit("a"), 8))
    assert len(vector) == 8 and sum(v * v for v in vector) == pytest.approx(1) and vector != value(spark, text.hash_vector(F.lit("b"), 8))
    assert value(spark, text.grounding_tokens(F.lit("but how about my list"))) == ["how", "about", "my"]


def test_large_blocks_are_cut():
    pieces = chunking.split_symbol("one two\n\n" + " ".join(["w"] * 50) + "\n\n" + "\n".join(["x y z"] * 9), "H", "C", 20)
    assert all(len(p.split()) <= 20 for p in pieces) and " ".join(pieces).split().count("w") == 50 and " ".join(pieces).split().count("x") == 9
    assert pieces[0].startswith("H\n") and all(p.startswith("C\n") for p in pieces[1:])


def test_budgets_and_repairs():
    assert chunking.repair_json('{"a": [1, 2, {"b": "c') == {"a": [1, 2, {"b": "c"}]}
    assert chunking.repair_json("[1, 2, tru" + "x" * 300) is None
    turns = [("user", "x" * 60, False), ("assistant", "y" * 60, False), ("user", "z" * 60, False)]
    assert chunking.segment_session(turns, 100) == ([[0, 1], [2]], False)
    done, failed = chunking.bisect_batches([1, 2, 0, 4], lambda xs: [8 // x for x in xs])
    assert done == {0: 8, 1: 4, 3: 2} and failed == [2]
    assert chunking.fit_response([{"content": "x" * 1000}], 400, 10_000)[0]["content"] != "x" * 1000
