"""The mix against plain targets, and that all of it adds up."""

from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from siltstone.llm.common import Scratch, prefix_sums
from siltstone.llm.mixing import Tree, mixed_texts, mixture, permuted, targets, word_counts, words_taken, write_shards


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """By resharing what is over until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = Fraction(sum(sizes.values())), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        target = {s: Fraction(most * sizes[s]) if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in names}
        above = {s for s in free if target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    random = np.random.default_rng(seed)
    sizes = {f"s{i}": int(random.integers(0, 10 ** random.integers(1, 6))) for i in range(int(random.integers(1, 15)))} | ({None: 7} if seed % 2 else {"é": 0, "Z": 3})
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: (r["target"], r["target_words"]) for r in targets(Scratch(spark, "t"), df).collect()}
    for source, expected in plain_targets(sizes).items():
        assert got[source][0] == pytest.approx(float(expected)) and abs(got[source][1] - expected) <= Fraction(1, 2)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 64, 65, 1000])
def test_permutations(n):
    for key in (0, 1, 99):
        assert sorted(permuted(np.arange(n), np.full(n, n), np.full(n, key)).tolist()) == list(range(n))
    assert n < 17 or (permuted(np.arange(n), np.full(n, n), np.zeros(n)) != permuted(np.arange(n), np.full(n, n), np.ones(n))).any()


def test_quotas_add_up_and_any_task_finds_its_own():
    tree = Tree([1000, 0, 37, 5], 13, 7)
    leaves = {k: (c.tolist(), b.tolist()) for k, c, b in tree.leaves(0, 13)}
    assert np.sum([c for c, _ in leaves.values()], axis=0).tolist() == [1000, 0, 37, 5]
    for k, (counts, before) in leaves.items():
        assert sum(counts) == tree.end(k + 1) - tree.end(k)
        assert before == np.sum([leaves[i][0] for i in range(k)] or [[0] * 4], axis=0).tolist()
    assert {k: (c.tolist(), b.tolist()) for k, c, b in tree.leaves(4, 9)} == {k: leaves[k] for k in range(4, 9)}


def test_splits_are_hypergeometric():
    """The first of two shards gets half of each source on average, with the variance of draws without replacement."""
    first = np.array([next(Tree([60, 40], 2, seed).leaves(0, 1))[1][0] for seed in range(2000)])
    assert abs(first.mean() - 30) < 0.3 and abs(first.var() - 50 * 0.6 * 0.4 * 50 / 99) < 0.6


def test_word_counts():
    texts = ["", " a  b\tc\n", "a", "\x0b", "x\x1cy é z", "a"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    assert word_counts(np.frombuffer(data, np.uint8), offsets).tolist() == [0, 3, 1, 0, 2, 1]


def test_prefix_sums(spark):
    rows = [(g, i % 7, i, i * i) for i in range(200) for g in ("a", "b") if g == "a" or i < 3]
    df = spark.createDataFrame(rows, "g string, o long, i long, v long").repartition(5)
    for group in ([], ["g"]):
        got = {(r["g"], r["i"]): r["v_before"] for r in prefix_sums(Scratch(spark, "p"), df, group, ["o", "g", "i"], ["v"]).collect()}
        for g, o, i, _ in rows:
            assert got[g, i] == sum(v for h, p, j, v in rows if (p, h, j) < (o, g, i) and (not group or h == g))


def awkward(spark):
    texts = ["w%d " % i * (i * 37 % 90) for i in range(60)] + [None, "", " \n", "long " * 5000, "é\tà", "same text here", "same text here"]
    rows = [(i if i % 9 else None, t, None if i % 11 == 0 else f"s{i % 4}", "r", 1, 2.0) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1], (5, "one word of its own", "tiny", "r", 1, 2.0), (6, None, "none", "r", 1, 2.0)], "doc_id long, text string, source string, row string, rank int, target double")


@pytest.mark.parametrize(("block", "shard"), [(16, 300), (1024, 1 << 23), (1, 5000)])
def test_the_mix_adds_up(spark, block, shard):
    docs = awkward(spark)
    mixed = mixture(docs, block_words=block, shard_words=shard, with_text=True)
    rows = words_taken(mixed).collect()
    assert len(rows) == docs.count()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r["source"]] += len((r["text"] or "").split())
    target = plain_targets(sizes)
    assert Counter((r["source_size"], round(r["target"], 6)) for r in rows) == Counter((sizes[r["source"]], round(float(target[r["source"]]), 6)) for r in docs.collect())
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    taken = {r["source"]: r["n"] for r in mixed.pieces.join(mixed.rows, "row").groupBy("source").agg({"words": "sum"}).toDF("source", "n").collect()}
    assert all(abs(taken.get(s, 0) - t) <= Fraction(1, 2) for s, t in target.items())
    pieces = mixed.pieces.collect()
    once = Counter((p["row"], p["epoch"], w) for p in pieces for w in range(p["first_word"], p["first_word"] + p["words"]))
    assert max(once.values()) == 1  # an epoch takes no word twice
    texts = mixed_texts(mixed).collect()
    assert sum(len(r["text"].split()) for r in texts) == sum(p["words"] for p in pieces)
    places = defaultdict(set)
    for p in pieces:
        places[p["shard"]].add(p["place"])
    assert all(sorted(s) == list(range(len(s))) for s in places.values())  # the shuffled draws fill each shard
    assert max(map(len, places.values())) - min(map(len, places.values())) <= 1


def test_the_same_mix_from_other_partitions(spark, tmp_path):
    docs = awkward(spark)

    def digest(df):
        return Counter(map(tuple, words_taken(mixture(df, block_words=16)).collect()))

    assert digest(docs.repartition(7)) == digest(docs.coalesce(1))
    write_shards(mixture(docs, block_words=16, shard_words=500, with_text=True), str(tmp_path / "mix"))
    assert spark.read.parquet(str(tmp_path / "mix")).where("shard = 0").count() > 0


def test_a_mix_of_nothing(spark):
    docs = awkward(spark)
    assert words_taken(mixture(docs.limit(0))).count() == 0
    assert [tuple(r) for r in words_taken(mixture(docs.where("source = 'none'"))).collect()] == [(6, 0, 0, 0.0, 0)]
    with pytest.raises(ValueError):
        mixture(docs, weights=(1, 0))
