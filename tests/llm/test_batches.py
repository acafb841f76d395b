"""What goes between executors and their Python workers: no text twice, and batches of bounded size."""

import re

import numpy as np
import pyarrow as pa
from siltstone.llm import language_id, toxicity
from siltstone.llm.common import BATCH_BYTES, Scratch
from siltstone.llm.passage_dedup import without_repeats

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def stages(docs):
    texts = [f"good plain words {i}" for i in range(20)] + [f"bad vile words {i}" for i in range(20)]
    net = toxicity.fit(texts, np.repeat([0, 1], 20), epochs=1)
    field = language_id.fit(["good plain words", "hyvin selkeitä sanoja"] * 20, ["en", "fi"] * 20, epochs=1)
    return {"toxicity": toxicity.clean(docs, net), "language_id": language_id.known_languages(docs, field, 0.0), "repeated_passages": without_repeats(docs)}


def test_a_text_is_carried_once(spark):
    """The worker's input has one column of texts, and each row comes out whole."""
    rows = [(i, f"good plain words about number {i} and no more", "en", "a b", i) for i in range(30)] + [(30, None, None, "c", 1), (None, "good words", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `the source` string, n_chars long")
    for name, made in stages(docs).items():
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        given = re.search(r"MapInArrow.*\n[\s:+-]*Project \[(.*)\]", plan)[1]
        assert len(re.findall(r"\btext#\d+|cast\(text", given)) == 1, (name, given)
        assert made.columns == docs.columns and made.dtypes == docs.dtypes
        own = {r["doc_id"]: r for r in docs.collect()}
        found = made.collect()
        assert len(found) >= 25, name
        assert all(r == own[r["doc_id"]] for r in found), name
    assert None in {r["text"] for r in stages(docs)["toxicity"].collect()}


def test_a_text_of_another_type_keeps_it(spark):
    docs = spark.createDataFrame([(1, b"good plain words"), (2, b"more good words")], "doc_id long, text binary")
    made = stages(docs)["toxicity"]
    assert made.dtypes == docs.dtypes and {bytes(r["text"]) for r in made.collect()} <= {b"good plain words", b"more good words"}


def test_batches_are_bounded(spark):
    """Rows of 64 KB come in batches of BATCH_BYTES, not in one; a lower limit of the session's own stays."""
    before = spark.conf.get(KEY)
    try:
        spark.conf.set(KEY, "64m")
        docs = spark.range(400).selectExpr("id as doc_id", "repeat('word ', 13000) as text").coalesce(1)
        Scratch(spark, "batches")

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

        found = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
        assert sum(found) > 5 * BATCH_BYTES and max(found) <= BATCH_BYTES + (1 << 17)
        spark.conf.set(KEY, "1m")
        Scratch(spark, "batches")
        assert spark.conf.get(KEY) == "1m"
    finally:
        spark.conf.set(KEY, before)
