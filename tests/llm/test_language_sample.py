"""What the language model is fitted on, on tables where rows aren't spread evenly."""

import numpy as np
from siltstone.llm.language_id import SAMPLE_ROWS, _spans, training_sample


def test_rare_languages_and_copies(spark):
    """A language of 12 rows in 20,000 is learned on, and a third of all rows being one text counts as one text."""
    rows = [(i, "the same text again" if i % 3 == 0 else f"text number {i}", "en") for i in range(20_000)] + [(20_000 + i, f"harvinainen teksti {i}", "fi") for i in range(12)]
    texts, labels = training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(set(texts)) == len(texts)
    assert labels.count("en") == SAMPLE_ROWS and labels.count("fi") >= 6


def test_spans_go_over_all_words():
    for total in (1, 31, 500, 400_000):
        at = _spans(total, 32, np.random.default_rng(0))
        assert set(at.ravel().tolist()) == set(range(total)) and len(at) >= 64
    switched = (np.diff(at, axis=1) != 1).any(axis=1).mean()
    assert 0.4 < switched < 0.6
