"""Builds hand on rows in batches of bounded size, and a search moves no chunks that it hasn't found."""

from collections import Counter

import pyarrow as pa
from conftest import SF
from siltstone.engine import Engine
from siltstone.model import frames


def test_postings_are_handed_on_in_bounded_batches():
    """A chunk's columns are repeated for each of its terms, so a batch of chunks makes many times its size."""
    texts = [[f"w{i % 7}", *(f"w{i}x{j}" for j in range(500)), f"w{i % 7}"] for i in range(1000)] + [[f"z{j}" for j in range(frames.STEP_TOKENS + 5)], ["a"]]
    batch = pa.RecordBatch.from_pydict({"chunk_id": [f"c{i}" for i in range(len(texts))], "length": [len(t) for t in texts], "tokens": texts})
    got = list(frames._counted(iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in got) <= frames.MADE_ROWS
    rows = [tuple(r.values()) for b in got for r in b.to_pylist()]
    want = [(f"c{i}", len(t), w, n) for i, t in enumerate(texts) for w, n in Counter(t).items()]
    assert len(rows) == len(want) and set(rows) == set(want)


def test_a_search_leaves_chunks_where_they_are(spark):
    found = Engine(spark, SF).search(["die the oneaan"], entities=[("Person", "Person:1")])
    plan = found._jdf.queryExecution().executedPlan().toString()
    moved = plan.split("LeftSemi, BuildRight")
    assert len(moved) == 2 and "Exchange hashpartitioning" not in moved[1].split("BroadcastExchange")[0]
