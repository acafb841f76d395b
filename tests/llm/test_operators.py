"""Each operator of the subpackage against a plain version, and on awkward tables."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers as public
import pytest
import xxhash
from siltstone.llm import queries
from siltstone.llm.ann import fit, nearest, unit
from siltstone.llm.language_id import forward_backward, language_id
from siltstone.llm.maxscore import Shard, top_inner_products
from siltstone.llm.near_duplicates import _forest, near_duplicates, position_sets
from siltstone.llm.packing import best_fit, pack
from siltstone.llm.passage_dedup import repeated_passages
from siltstone.llm.pieces import Decoder, Encoder, StreamingViterbi, Vocabulary, encode_long, encode_pieces, read_model
from siltstone.llm.token_counts import Counting, load, token_counts, whole_tokens
from siltstone.llm.token_files import Encoding, decode_segment, encode_segment, token_files
from siltstone.llm.toxicity import Network, fit as fit_network, toxicity

SF = "/root/testdata/sf0.001"
WORD = public.path("word_bpe_49k.json")
PIECES = public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and blank texts, repeated rows, a long text, special strings, other scripts, and columns whose names clash."""
    long = "alpha beta gamma delta " * 3000
    texts = [None, "", "  \n\t ", "One word", "one two three four five six", "one two three four five six", "a<|endoftext|>b <|startoftext|> c", "日本語 テキスト ΑΣ", "É à la crème", long, long + "x", "x" * 450, "tail " + "q" * 210 + "é" * 150, "q" * 210 + "é" * 150]
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, "src0", 1, "s", 2.0) for i, t in enumerate(texts)]
    rows.append(rows[5])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, score double")


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


def texts_of(awkward):
    return [(r["doc_id"], r["text"] or "") for r in awkward.collect()]


# --- searches ------------------------------------------------------------------------------------


def vectors(spark):
    random = np.random.default_rng(0)
    x = random.normal(size=(300, 16)).astype(np.float32)
    x[7] = x[50]
    x[9] = 0
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(400, None), (401, [1.0, None] + [0.0] * 14), (402, [float("nan")] * 16), (403, [1.0, 2.0]), (404, []), (None, [1.0] * 16), (450, [float("inf")] * 16)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), x


def plain_search(rows, k, every, score):
    """(query_id, rank, vec_id, score) with repeats, from all pairs of rows; score gives None for vectors that take no part."""
    out = Counter()
    for i, (q, x) in enumerate(rows):
        if q is None or q % every or score(x, x) is None:
            continue
        found = [(-score(x, y), v) for j, (v, y) in enumerate(rows) if j != i and v is not None and score(x, y) is not None]
        for rank, (s, v) in enumerate(sorted(found)[:k]):
            out[q, rank + 1, v, -s] += 1
    return out


def usable(x):
    return x is not None and len(x) > 0 and all(v is not None and np.isfinite(v) for v in x)


def cosine(x, y):
    if not (usable(x) and usable(y) and len(x) == len(y) and any(x) and any(y)):
        return None
    a, b = np.array(x, float), np.array(y, float)
    return round(float((a * b).sum() / (np.sqrt((b * b).sum()) * np.sqrt((a * a).sum()))), 9)


def integer_product(x, y):
    if not (usable(x) and usable(y) and len(x) == len(y)):
        return None
    return int(np.floor(256 * np.array(x, np.float32).astype(float)).astype(np.int64) @ np.floor(256 * np.array(y, np.float32).astype(float)).astype(np.int64))


def found_by(df):
    return Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9) if isinstance(r["score"], float) else r["score"]) for r in df.collect())


def test_ann_against_brute_force(spark):
    df, x = vectors(spark)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    expected, got = plain_search(rows, 5, 50, cosine), found_by(nearest(df))
    assert {(q, r) for q, r, _, _ in got} == {(q, r) for q, r, _, _ in expected}
    assert sum((got & expected).values()) >= 0.9 * sum(expected.values())
    scores = {}
    for q, _, v, s in got:
        scores[q, v] = s
    assert all(s == pytest.approx(cosine(dict(rows)[q], dict(rows)[v]), abs=1e-9) for (q, v), s in scores.items())


@pytest.mark.parametrize("size", [2048, 7])
def test_searches_of_repeated_ids_lengths_and_ties(spark, monkeypatch, size):
    """Ids with several vectors, repeated rows, minority lengths, mass ties, and columns whose names clash."""
    from siltstone.llm import vector_blocks

    monkeypatch.setattr(vector_blocks, "ROWS", size)
    monkeypatch.setattr(vector_blocks, "QUERIES", size)
    random = np.random.default_rng(8)
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0, 0.0]), (3, [0.5, 0.5, 0.0]), (4, [-1.0, 0.0, 0.0]), (100, [0.0, 0.0]), (150, [2.0, 2.0, 2.0, 2.0])]
    rows += [(i, [1.0, 0.0]) for i in range(20)] + [(i, [0.25, 0.75]) for i in range(0, 60, 2)]
    rows += [(int(random.integers(0, 40)) * 10, random.choice([-1.0, 0.0, 0.5], 2).tolist()) for _ in range(20)]
    rows += [(None, [1.0, 1.0]), (0, None), (50, [None, 1.0]), (50, [])]
    df = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "vec_id long, embedding array<float>, codes string, d int, score double")
    assert found_by(top_inner_products(df)) == plain_search(rows, 5, 50, integer_product)
    got = found_by(nearest(df))
    assert got == plain_search(rows, 5, 50, cosine) and (50, 1) in {(q, r) for q, r, _, _ in got}
    wide = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found_by(nearest(wide)) == got


def recall(vectors, spark):
    x = np.array([v for _, v in vectors], np.float64)
    u, ids = x / np.sqrt((x * x).sum(axis=1, keepdims=True)), np.array([i for i, _ in vectors])
    found = {}
    for r in nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<float>")).collect():
        found.setdefault(r["query_id"], []).append(r["score"])
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = np.sort(np.delete(u @ u[q], q))[::-1][:5]
        hits, total = hits + sum(a >= s[-1] - 1e-6 for a in found[int(ids[q])]), total + 5
    return hits / total


def test_recall_in_full_blocks(spark):
    """2,000 vectors are one block, of which 64 are reranked; then with 500 near copies of each of three vectors, whose codes tie."""
    table = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(int(i), [float(v) for v in x]) for i, x in zip(table.vec_id, table.embedding, strict=True)]
    assert recall(rows, spark) >= 0.95
    random = np.random.default_rng(1)
    x = np.array([v for _, v in rows])
    near = np.concatenate([x[i] + random.normal(0, 1e-3, (500, x.shape[1])) for i in (0, 50, 100)])
    assert recall([*rows, *((10_000 + i, v.tolist()) for i, v in enumerate(near))], spark) >= 0.9


def test_anisotropic_codes_lower_their_loss():
    random = np.random.default_rng(1)
    x = unit(random.normal(size=(1500, 16)))
    book = fit(x, threshold=0.5)

    def loss(codes):
        rest = (book.cut(x) - np.take_along_axis(book.centroids[None], codes[:, :, None, None], 2)[:, :, 0]).reshape(len(x), -1)
        return ((rest**2).sum(axis=1) + (book.eta - 1) * (rest * x).sum(axis=1) ** 2).mean()

    plain = ((book.cut(x)[:, :, None, :] - book.centroids[None]) ** 2).sum(axis=3).argmin(axis=2)
    assert book.eta > 1 and loss(book.encode(x)) <= loss(plain) + 1e-12


def test_maxscore_is_exact(spark):
    df, x = vectors(spark)
    got = {}
    for r in top_inner_products(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = np.floor(256 * x.astype(float)).astype(np.int64)
    for q in range(0, 300, 50):
        s = v @ v[q]
        expected = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5]
        assert sorted(got[q]) == [(k + 1, i, int(s[i])) for k, i in enumerate(expected)]


@pytest.mark.parametrize("seed", range(20))
def test_shard_with_ties_and_few_rows(seed, monkeypatch):
    from siltstone.llm import maxscore

    monkeypatch.setattr(maxscore, "RANGE", int(np.random.default_rng(seed).choice([3, 256])))
    random = np.random.default_rng(seed)
    n = int(random.integers(1, 40))
    rows = random.integers(-2, 3, size=(n, 4))
    q = random.integers(-2, 3, size=4)
    ids = np.arange(n)[::-1] * 3
    expected = sorted(zip(ids.tolist(), (rows @ q).tolist(), strict=True), key=lambda p: (-p[1], p[0]))[:5]
    places, scores = Shard(ids, rows).search(q, 5)
    assert list(zip(ids[places].tolist(), scores.tolist(), strict=True)) == expected
    floor = expected[-1][1]
    places, scores = Shard(ids, rows).search(q, 5, floor)
    assert list(zip(ids[places].tolist(), scores.tolist(), strict=True)) == expected


def test_the_threshold_rises_and_spares_postings():
    random = np.random.default_rng(2)
    rows = np.floor(256 * random.normal(size=(4096, 32)) / 32**0.5).astype(np.int64)
    shard = Shard(np.arange(4096), rows)
    every = 20 * 4096 * 32  # all rows of the agreeing terms
    for q in rows[:20]:
        places, scores = shard.search(q, 6)
        assert scores.tolist() == sorted((rows @ q).tolist(), reverse=True)[:6] and places[0] == np.argmax(rows @ q)
    without, shard.traversed = shard.traversed, 0
    for q in rows[:20]:
        shard.search(q, 6, int(np.sort(rows @ q)[-6]))
    assert shard.traversed < 0.6 * every < without < 0.7 * every


def test_searches_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(df).count() == 0 and top_inner_products(df).count() == 0


# --- token files and counts ----------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 31, 5000, 40_000])
def test_segments_round_trip(n):
    random = np.random.default_rng(n)
    tokens = np.minimum(random.zipf(1.2, n), 50_000).astype(np.uint32)
    lengths = np.array([n - n // 3, 0, n // 3])
    payload = encode_segment(np.array([3, 4, 9]), lengths, tokens, 2)
    ids, sizes, back = decode_segment(payload)
    assert ids.tolist() == [3, 4, 9] and sizes.tolist() == lengths.tolist() and (back == tokens).all()
    if n:
        broken = bytearray(payload)
        broken[-1] ^= 1
        with pytest.raises((ValueError, IndexError)):
            ids, sizes, back = decode_segment(bytes(broken))
            if (back == tokens).all():
                raise ValueError("the changed byte was beyond what is read")


def test_token_files(spark, awkward, empty):
    encoding = queries.byte_bpe_encoding()
    library = load(encoding[0])
    rows = sorted(texts_of(awkward), key=lambda r: (r[0] is not None, r[0] or 0))
    expected, start = Counter(), 0
    for i, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        expected[(i, start if i != 5 else None, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        start += len(ids)
    got = Counter((r["doc_id"], r["start"] if r["doc_id"] != 5 else None, r["n_tokens"], r["ids_crc32"]) for r in token_files(awkward, encoding).collect())
    assert got == expected
    assert token_files(empty, encoding).count() == 0


def test_token_files_without_ids(spark):
    """The least long is an id like any other; rows without one come first, in any order, in shards of their own."""
    encoding = queries.byte_bpe_encoding()
    rows = [(None, f"text {i} " * i) for i in range(40)] + [(-(1 << 63), "least"), ((1 << 63) - 1, "most"), (0, None)]
    got = token_files(spark.createDataFrame(rows, "doc_id long, text string"), encoding).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 40 + [-(1 << 63), 0, (1 << 63) - 1]
    library = load(encoding[0])
    expected = Counter((i, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in rows)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == expected
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)]).tolist()[:-1]
    alone = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    assert token_files(alone, encoding).where("doc_id is null").count() == 3


def test_fast_encoding_equals_the_library(docs):
    encoding = queries.byte_bpe_encoding()
    fast, library = Encoding(*encoding), load(encoding[0])
    for text in [*docs.text, "a\x1cb", "<|endoftext|><|endoftext|> x", "ſtraße Ǆ", "'S 'll 'LL"]:
        assert fast(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_counts(spark, awkward, empty, docs):
    library = load(WORD)
    expected = Counter((i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts_of(awkward))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts(awkward, WORD).collect()) == expected
    assert token_counts(empty, WORD).count() == 0
    own = spark.createDataFrame(docs[["doc_id", "text"]])
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts(own, WORD).collect()}
    assert counts == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in zip(docs.doc_id, docs.text, strict=True)}


ODD = ["the cat\u2019s \u201cquoted\u201d \u2014 dash", "emoji 😀 and text<|endoftext|>日本<|endoftext|> x", "\u3000 a \u2003b", "ΑΣ Σας ﬁne Ǆ ǆ", "e\u0301 caf\u0065\u0301 \u0301x", "a\x1cb 日 \x1c c", "x \u2019s y", "日  two spaces", "a \u00a0 日 b", " 日", "日 ", "mix日ed words'll 日're"]


def test_only_odd_words_leave_the_shortcut(docs):
    library, counting = load(WORD), Counting(WORD, whole_tokens(WORD))
    random = np.random.default_rng(3)
    parts = [*ODD, *(t[:200] for t in docs.text[:20])]
    texts = ODD + [" ".join(random.choice(parts, 4)) for _ in range(200)] + ["".join(random.choice(list("a '\u2019s日é\n\u0301Σ5<|"), 30)) for _ in range(2000)]
    for text in texts:
        assert counting.count(text) == len(library.encode(text, add_special_tokens=False).ids), text
    assert counting.shortcut > 1000
    encoding = queries.byte_bpe_encoding()
    fast, library = Encoding(*encoding), load(encoding[0])
    for text in texts:
        assert fast(text).tolist() == library.encode(text, add_special_tokens=False).ids, text
    fast.by_library = 0
    fast("a long plain text with one \u2014 dash " + "and many plain words " * 200)
    assert fast.by_library < 20


def test_wide_ids_are_kept(spark):
    encoding = queries.byte_bpe_encoding()
    texts = [(1, "one"), (2, None), (3, "three")]
    found = {r["doc_id"]: r for r in token_files(spark.createDataFrame(texts, "doc_id long, text string"), encoding, end_id=70_000).collect()}
    library = load(encoding[0])
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 70_000]
        assert found[i]["n_tokens"] == len(ids) and found[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_many_shards(spark, docs, monkeypatch):
    from siltstone.llm import token_files as module

    encoding = queries.byte_bpe_encoding()
    own = spark.createDataFrame(docs[["doc_id", "text"]])
    whole = {tuple(r) for r in token_files(own, encoding).collect()}
    monkeypatch.setattr(module, "SHARD_BYTES", 20_000)
    assert {tuple(r) for r in token_files(own, encoding).collect()} == whole and len(whole) == len(docs)


def test_whole_tokens_are_proven():
    library = load(WORD)
    whole = whole_tokens(WORD)
    assert len(whole) > 10_000
    assert all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in whole[::97])


# --- passages ------------------------------------------------------------------------------------


def plain_passages(texts, width):
    raw = [t.encode() for t in texts]
    seen = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        marks = np.zeros(len(b) + 1, int)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                marks[i] += 1
                marks[i + width] -= 1
        gone = np.cumsum(marks)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("width", [20, 200])
def test_passages(spark, awkward, empty, docs, width):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    own = texts_of(awkward)
    expected = Counter((i, *r) for (i, _), r in zip(own, plain_passages([t for _, t in own], width), strict=True))
    assert Counter(tuple(r[n] for n in names) for r in repeated_passages(awkward, width).collect()) == expected
    assert repeated_passages(empty, width).count() == 0
    some = docs.head(60)
    expected = {i: r for i, r in zip(some.doc_id, plain_passages(some.text.tolist(), width), strict=True)}
    assert {r["doc_id"]: tuple(r[n] for n in names[1:]) for r in repeated_passages(spark.createDataFrame(some[["doc_id", "text"]]), width, with_text=False).collect()} == expected


def test_frequent_anchors_are_cut_finer(spark, monkeypatch):
    from siltstone.llm import passage_dedup

    monkeypatch.setattr(passage_dedup, "FREQUENT", 2)
    random = np.random.default_rng(3)
    passage = "".join(random.choice(list("abcdefgh "), 400))
    texts = ["".join(random.choice(list("abcdefgh "), 150)) + passage[int(a) :] + "".join(random.choice(list("abcdefgh "), 150)) for a in random.integers(0, 150, 12)]
    got = {r["doc_id"]: r["kept_sha256"] for r in repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: r[3] for i, r in enumerate(plain_passages(texts, 200))}


@pytest.mark.parametrize(("hot", "shard"), [(1, 12 << 20), (400, 12 << 20), (1 << 30, 2000)])
def test_hot_routes_and_many_shards(spark, monkeypatch, hot, shard):
    """A passage in most texts, whose last strings run on into each of them; all, some or no routes are hot."""
    from siltstone.llm import passage_dedup

    monkeypatch.setattr(passage_dedup, "FREQUENT", 2)
    monkeypatch.setattr(passage_dedup, "HOT_BYTES", hot)
    monkeypatch.setattr(passage_dedup, "SHARD_BYTES", shard)
    random = np.random.default_rng(4)
    passage = "".join(random.choice(list("abcdefgh "), 500))
    ends = ["".join(random.choice(list("ab"), 60)) for _ in range(6)]
    texts = [passage + ends[i % 6] + str(i) * 40 for i in range(30)] + [None, "", passage[:199], passage[100:330], "é" * 300]
    rows = [*enumerate(texts), (None, texts[0]), (None, texts[0]), (3, texts[3])]
    found = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found.collect())
    assert got == Counter((i, *r) for (i, _), r in zip(rows, plain_passages([t or "" for _, t in rows], 200), strict=True))


def test_a_shard_far_larger_than_memory(tmp_path):
    """Its stars are ten times what the sort may hold at once; it never holds more, and finds the same."""
    from siltstone.llm import induced_sort

    random = np.random.default_rng(0)
    block = random.integers(1, 5, 3000).astype(np.uint8).tobytes()
    text = b"".join(random.integers(1, 5, 2000).astype(np.uint8).tobytes() + block[: int(random.integers(300, 3000))] for _ in range(20)) + b"\1\2" * 4000 + b"\0"
    path = tmp_path / "t"
    path.write_bytes(text + b"\xff" * 216)

    def run(budget):
        folder = tmp_path / str(budget)
        folder.mkdir()
        got = list(induced_sort.sorted_suffixes(str(path), len(text), 200, str(folder), budget))
        return np.concatenate([s for s, _ in got]), np.concatenate([p for _, p in got])

    stars = sum(map(len, induced_sort.star_suffixes(np.frombuffer(text, np.uint8), len(text))))
    held, take = [], induced_sort._in_order

    def counted(words, starts, at, cap):
        held.append(len(starts))
        return take(words, starts, at, cap)

    induced_sort._in_order = counted
    try:
        small = run(stars // 10)
    finally:
        induced_sort._in_order = take
    whole = run(1 << 22)
    assert max(held) <= stars // 10 and len(held) > 10
    assert (small[1] == whole[1]).all() and all(text[a : a + 200] == text[b : b + 200] for a, b in zip(*(x[0].tolist() for x in (small, whole)), strict=True) if a != b)


@pytest.mark.parametrize("seed", range(60))
def test_induced_sort(tmp_path, seed, monkeypatch):
    from siltstone.llm import induced_sort

    random = np.random.default_rng(seed)
    monkeypatch.setattr(induced_sort, "BATCH", int(random.choice([4, 1 << 18])))
    n, letters, cap = int(random.integers(1, 80)), int(random.choice([2, 3, 90])), int(random.choice([8, 200]))
    body = bytes(random.integers(1, letters + 1, n).astype(np.uint8)) * int(random.integers(1, 4)) + b"\1" * int(random.integers(0, 20))
    text = body + b"\0" + body[::-1] + b"\0"
    path = tmp_path / "t"
    path.write_bytes(text + b"\xff" * (cap + 16))
    got = [(int(s), int(p)) for a, b in induced_sort.sorted_suffixes(str(path), len(text), cap, str(tmp_path), int(random.choice([5, 1 << 20]))) for s, p in zip(a, b, strict=True)]
    padded = [text[s:] + b"\xff" * 400 for s, _ in got]
    assert sorted(s for s, _ in got) == list(range(len(text) - 1))
    for (a, b), (_, p) in zip(zip(padded, padded[1:], strict=False), got[1:], strict=True):
        assert a[:cap] >= b[:cap]
        assert p == min(cap, next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), cap))


# --- pieces --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    """The sentencepiece library's own Viterbi over the same pieces; sentinel scores of -1e9 are brought into the range that its floats add exactly."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(PIECES, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        if piece.score < -1e8:
            piece.score = -3_000_000
    out = sentencepiece.SentencePieceProcessor()
    out.LoadFromSerializedProto(model.SerializeToString())
    return out


def test_pieces_against_the_library(library, docs):
    vocabulary = Vocabulary(read_model(PIECES))
    texts = [t[i : i + 60] for t in docs.text[:80] for i in range(0, len(t), 60)] + ["", " ", "  a", "\n\t", "日本語", "é\x00z", "a" * 60, "😀 x", "a  b   c"]
    encode = Encoder(vocabulary)
    for text in texts:
        ids = encode(text)
        assert ids.tolist() == library.encode(text) == encode(text).tolist()
        assert Decoder(vocabulary)(ids.tolist()) == text
        if text:
            assert encode_long(vocabulary, "▁" + text.replace(" ", "▁")) == ids.tolist()


def test_streaming_commits_early():
    vocabulary = Vocabulary(read_model(PIECES))
    decoder = StreamingViterbi(vocabulary)
    text = ("▁the▁quick▁brown▁fox" * 500)
    ids = [*decoder.feed(text), *decoder.close()]
    assert decoder.most < 200 and ids == encode_long(vocabulary, text)


def test_the_decoder_does_the_work(docs):
    vocabulary = Vocabulary(read_model(PIECES))
    encode = Encoder(vocabulary)
    for text in docs.text[:60]:
        ready = "▁" + text.replace(" ", "▁")
        before = set(encode.remembered)
        ids = encode(text)
        assert ids.tolist() == encode_long(vocabulary, ready)
        assert encode.decoded >= sum(map(len, set(encode.remembered) - before))
    # every stretch that is remembered has been through the decoder once
    assert encode.decoded >= sum(map(len, encode.remembered)) > 0
    ends = set("".join(p for p in vocabulary.ids))
    codes = np.array([ord(c) for c in "▁the▁日é\U0001F600x"], np.uint32)
    apart = vocabulary.apart(codes)
    held = {p[i : i + 2] for p in vocabulary.ids for i in range(len(p) - 1)}
    assert ends and [bool(a) for a in apart] == [chr(x) + chr(y) not in held and max(x, y) < 1 << 16 for x, y in zip(codes.tolist(), codes[1:].tolist(), strict=False)]


def test_pieces_operator(spark, awkward, empty):
    rows = encode_pieces(awkward, PIECES).collect()
    assert len(rows) == awkward.count() and all(r["restored"] for r in rows)
    assert all(r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    assert encode_pieces(empty, PIECES).count() == 0


# --- classifiers ---------------------------------------------------------------------------------


def test_forward_backward_against_enumeration():
    from itertools import product

    random = np.random.default_rng(0)
    scores, move, start = random.normal(size=(1, 4, 3)), random.normal(size=(3, 3)), random.normal(size=3)
    total, marginals, expected = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in product(range(3), repeat=4):
        w = np.exp(start[path[0]] + sum(scores[0, t, path[t]] for t in range(4)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        for t in range(4):
            marginals[t, path[t]] += w
        for a, b in zip(path, path[1:], strict=False):
            expected[a, b] += w
    got, counts = forward_backward(scores, move, start, np.array([4]))
    assert np.allclose(got[0], marginals / total) and np.allclose(counts, expected / total)


@pytest.mark.parametrize("stretch", [1, 5, 64])
def test_whole_texts_are_one_chain(monkeypatch, stretch):
    from siltstone.llm import language_id as module

    monkeypatch.setattr(module, "STRETCH", stretch)
    random = np.random.default_rng(stretch)
    counts = np.array([0, 3, 5, 1, 130, 0, 300, 10, 64, 65])
    scores, move, start = random.normal(size=(counts.sum(), 4)) * 4, random.normal(size=(4, 4)) * 2, random.normal(size=4)
    got = module.text_marginals(scores, counts, move, start)
    ends = np.cumsum(counts)
    for a, b in zip(ends - counts, ends, strict=True):
        if a < b:
            assert np.allclose(got[a:b], forward_backward(scores[None, a:b], move, start, np.array([b - a]))[0][0])


def test_language_id_held_out(spark, docs):
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id(own).join(own.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_classifiers_on_awkward_tables(spark, awkward, empty):
    rows = language_id(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (0, 1, 2)} == {"und"} and all(0 <= r["score"] <= 1 for r in rows)
    assert language_id(empty).count() == 0
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (7, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity(empty, labels.limit(0)).count() == 0


def test_network_gradient():
    random = np.random.default_rng(0)
    net = Network(np.zeros(0, np.uint64))
    x, length = random.normal(size=(5, 3, 16)).astype(np.float32), np.array([5, 3, 1])
    slope = np.array([0.3, -1.0, 0.7], np.float32)
    keep = {}
    net.read(x, length, keep)
    got = net.gradient(x, keep, slope)
    for name in ("fx", "bh", "a", "v", "o", "f0"):
        for at in list(np.ndindex(net.p[name].shape))[::7]:
            old = net.p[name][at]
            values = []
            for d in (0.01, -0.01):
                net.p[name][at] = old + d
                values.append(float(net.read(x, length) @ slope))
            net.p[name][at] = old
            assert got[name][at] == pytest.approx((values[0] - values[1]) / 0.02, rel=0.05, abs=2e-3)


def plain_toxicity(net, text):
    """The largest window's probability, one word and one window after another."""
    import math

    import pyarrow as pa
    from siltstone.llm.common import text_buffers
    from siltstone.llm.toxicity import HIDDEN, STRIDE, WINDOW
    from siltstone.llm.word_features import words_of

    words = words_of(*text_buffers(pa.array([text], pa.string())))
    p, h = {k: v.astype(np.float64) for k, v in net.p.items()}, HIDDEN
    vectors = [net.inputs(words)[i].astype(np.float64) for i in words.lexeme]

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    def states(x, side):
        now, out = np.zeros(h), []
        for v in x:
            given, sent = v @ p[side + "x"] + p[side + "0"], now @ p[side + "h"]
            r, z = sigmoid(given[:h] + sent[:h]), sigmoid(given[h : 2 * h] + sent[h : 2 * h])
            now = z * now + (1 - z) * np.tanh(given[2 * h :] + r * sent[2 * h :])
            out.append(now)
        return out

    best, begin = -math.inf, 0
    while True:
        part = vectors[begin : begin + WINDOW]
        both = [np.concatenate(pair) for pair in zip(states(part, "f"), states(part[::-1], "b")[::-1], strict=True)]
        weights = [math.exp(np.tanh(s @ p["a"]) @ p["v"]) for s in both]
        pool = sum((w / sum(weights) * s for w, s in zip(weights, both, strict=True)), np.zeros(2 * h))
        best = max(best, float(pool @ p["o"] + p["b"][0]))
        begin += STRIDE
        if begin + WINDOW - STRIDE >= len(vectors):
            return sigmoid(best)


def test_scores_against_a_plain_network(docs):
    import pyarrow as pa
    from siltstone.llm.common import text_buffers
    from siltstone.llm.word_features import words_of

    texts = [*sorted(docs.text, key=len)[:40], "", "one", " ".join(f"word{i}" for i in range(24)), " ".join(f"w{i}x" for i in range(200)), "é ß 日本"]
    texts = [" ".join(t.split()[:120]) for t in texts]
    data, offsets = text_buffers(pa.array(texts))
    net = Network(np.unique(words_of(data, offsets).hashes)[::2], seed=4)
    net.p = {k: v * np.float32(3) for k, v in net.p.items()}
    assert np.allclose(net.scores(data, offsets), [plain_toxicity(net, t) for t in texts], atol=1e-4)


def test_toxic_words_anywhere_are_found(spark):
    random = np.random.default_rng(0)
    plain = ["the", "of", "and", "ringen", "tion", "ander", "with", "heath"]
    texts, labels = [], []
    for i in range(300):
        words = list(random.choice(plain, 120))
        if i % 3 == 0:
            words[int(random.integers(0, 120))] = "scum"
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    net = fit_network(texts, np.array(labels), odds=0.5)
    from siltstone.llm.common import text_buffers
    import pyarrow as pa

    data, offsets = text_buffers(pa.array([" ".join(plain * 40), " ".join(plain * 40) + " scum " + " ".join(plain * 9), ""]))
    scores = net.scores(data, offsets)
    assert scores[0] < 0.5 < scores[1] and scores[2] < 0.5


# --- packing -------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(8))
def test_best_fit(seed):
    random = np.random.default_rng(seed)
    lengths = np.minimum(random.lognormal(5, 1.2, 500).astype(int) + 1, 4096)
    bins, offsets, final = best_fit(lengths)
    used = np.bincount(bins, lengths, len(final)).astype(int)
    assert (used <= final).all() and set(final) <= {512, 1024, 2048, 4096}
    assert all(final[b] == min(c for c in (512, 1024, 2048, 4096) if c >= used[b]) for b in range(len(final)))
    for b in range(len(final)):  # contents stand side by side
        own = sorted(zip(offsets[bins == b].tolist(), lengths[bins == b].tolist(), strict=True))
        assert own[0][0] == 0 and all(a + n == c for (a, n), (c, _) in zip(own, own[1:], strict=False))


def plain_best_fit(lengths, capacities=(512, 1024, 2048, 4096)):
    """Each piece, the longest first, into the open bin that it fills best, the one changed last in a tie; else into a new bin of least cost for a token."""
    from siltstone.llm.packing import cost

    rooms, changed, used, out = [], [], [], {}
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    for n, i in enumerate(order):
        size = int(lengths[i])
        fitting = [b for b in range(len(rooms)) if rooms[b] >= size]
        if fitting:
            b = min(fitting, key=lambda b: (rooms[b], -changed[b]))
        else:

            def expected(c):
                room = c - size
                for j in order[n + 1 :]:
                    room -= int(lengths[j]) if lengths[j] <= room else 0
                return c - room

            c = min((c for c in capacities if c >= size), key=lambda c: (cost(c) / expected(c), c))
            b = len(rooms)
            rooms.append(c)
            changed.append(n)
            used.append(0)
        out[i] = (b, used[b])
        rooms[b] -= size
        used[b] += size
        changed[b] = n
    return [out[i] for i in range(len(lengths))], [min(c for c in capacities if c >= u) for u in used]


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_against_a_plain_version(seed):
    random = np.random.default_rng(seed)
    lengths = np.minimum(random.lognormal(5 + seed % 3, 1.2, 150).astype(int) + 1, 4096)
    if seed == 5:
        lengths = random.choice([100, 200, 512, 700], 150)
    bins, offsets, final = best_fit(lengths)
    placed, sizes = plain_best_fit(lengths)
    assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == placed and final.tolist() == sizes


def test_packing_awkward_tables(spark, awkward, empty):
    from siltstone.llm.packing import pack_documents

    encoding = queries.byte_bpe_encoding()
    library = load(encoding[0])
    expected = Counter((i, len(library.encode(t, add_special_tokens=False).ids) + 1) for i, t in texts_of(awkward))
    rows = pack_documents(awkward, encoding).collect()
    whole = Counter()
    for i, n in expected:
        whole[i] += n * expected[(i, n)]
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["n_tokens"]
    assert got == whole and pack_documents(empty, encoding).count() == 0


def test_pack_cuts_long_documents(spark):
    rows = [(1, 10_000), (2, 4096), (None, 5), (3, 0), (4, None), (5, 1), (5, 1)]
    got = pack(spark.createDataFrame(rows, "doc_id long, n_tokens long")).collect()
    assert sorted((r["begin"], r["n_tokens"]) for r in got if r["doc_id"] == 1) == [(0, 4096), (4096, 4096), (8192, 1808)]
    assert sum(r["n_tokens"] for r in got) == 10_000 + 4096 + 5 + 2
    used = Counter()
    for r in got:
        used[(r["shard"], r["bin"], r["capacity"])] += r["n_tokens"]
    assert all(n <= c for (_, _, c), n in used.items())
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


# --- near duplicates -----------------------------------------------------------------------------


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, bits=4):
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= bits and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [least.get(g) for g in group]


def test_near_duplicates(spark, awkward, empty, docs):
    for rows, df in ((texts_of(awkward), awkward), (list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)), spark.createDataFrame(docs[["doc_id", "text"]]))):
        prints = [(i, plain_fingerprint(t)) for i, t in rows]
        expected = Counter((i, f"{f:016x}", c) for (i, f), c in zip(prints, plain_components(prints), strict=True))
        assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in near_duplicates(df).collect()) == expected
    assert near_duplicates(empty).count() == 0


def test_a_row_without_an_id_links_others(spark, monkeypatch):
    from siltstone.llm import near_duplicates as module

    prints = {"a": 0, "b": 0b1111, "c": 0b11111111, "d": 0b111 << 40 | (1 << 60) - (1 << 50), "e": 1 << 63 | 0x0F0F0F << 20}
    monkeypatch.setattr(module, "fingerprints", lambda docs, words, seed: spark.createDataFrame([(i, (f if f < 1 << 63 else f - (1 << 64))) for i, f in [(1, prints["a"]), (None, prints["b"]), (2, prints["c"]), (None, prints["d"]), (None, prints["d"]), (7, prints["e"])]], "doc_id long, fp long"))
    got = Counter((r["doc_id"], r["component_id"]) for r in module.near_duplicates(spark.range(1)).collect())
    assert got == Counter({(1, 1): 1, (None, 1): 1, (2, 1): 1, (None, None): 2, (7, 7): 1})


def test_tally_counts_equal_positions(spark):
    from siltstone.llm.near_duplicates import shared_bytes

    pairs = [(0, 0, 8), (0, 1, 7), (-1, 0, 0), (0x0102030405060708, 0x0102030405060700, 7), (-(1 << 63), 0, 7), (0x00FF00FF00FF00FF, 0x00FF000000FF0000, 6)]
    rows = spark.createDataFrame(pairs, "a long, b long, n int").select("n", shared_bytes("a", "b").alias("found")).collect()
    assert all(r["n"] == r["found"] for r in rows)


def test_links_lose_nothing_in_hot_postings(spark, tmp_path):
    from pyspark.sql import functions as F
    from siltstone.llm.common import Scratch
    from siltstone.llm.components import connected_components
    from siltstone.llm.near_duplicates import links

    random = np.random.default_rng(5)
    base = int(random.integers(0, 1 << 62))
    prints = {base}
    for _ in range(300):
        flipped = base
        for b in random.choice(64, int(random.integers(1, 9)), replace=False):
            flipped ^= 1 << int(b)
        prints.add(flipped)
    prints |= {int(v) for v in random.integers(0, 1 << 62, 200)}
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in sorted(prints)]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    scratch = Scratch(spark, "test")
    found = {r["node"]: r["root"] for r in connected_components(links(df, scratch, block=16), scratch).collect()}
    groups = {}
    for p, c in zip(signed, plain_components([(i, p & ((1 << 64) - 1)) for i, p in enumerate(signed)]), strict=True):
        groups.setdefault(c, set()).add(found.get(p, p))
    assert all(len(roots) == 1 for roots in groups.values()) and len({next(iter(r)) for r in groups.values()}) == len(groups)
    assert df.where(F.col("fp").isNull()).count() == 0


def test_position_sets_meet_every_pair():
    from itertools import combinations

    for size in (3, 4):
        chosen = [set(s) for s in position_sets(4, size)]
        assert all(any(s <= set(four) for s in chosen) for four in combinations(range(8), 4))
    assert len(position_sets(4, 3)) == 20


def test_forest_spans():
    values = np.array([0, 1, 3, 1 << 40, (1 << 40) | 7, (1 << 60) - 1], np.uint64)
    a, b = _forest(values, values, 4, 4)
    assert len(a) == 4  # five of them hang together


# --- the pipeline --------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs):
    """Each stage against a plain version of it, on all that the stage before kept."""
    import corpus_pipeline as pipeline
    import pyarrow as pa
    from siltstone.llm import language_id, toxicity
    from siltstone.llm.common import Scratch, text_buffers
    from siltstone.llm.word_features import words_of
    from test_similar_texts import kept_by_brute_force

    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "language_id", "near_duplicates", "repeated_passages", "packing"]
    table, scratch = spark.read.parquet(f"{SF}/documents.parquet"), Scratch(spark, "test")

    def texts(df):
        return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}

    after = []
    for _, stage in pipeline.STAGES[:-1]:
        after.append(scratch.write(stage(spark, after[-1] if after else table, SF)))
        assert after[-1].columns == table.columns
    before, harmless, known, single, cut = texts(table), *map(texts, after)

    net = toxicity.fitted(table, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {i: plain_toxicity(net, t) for i, t in before.items()}
    assert {i for i, s in scores.items() if s < 0.499} <= set(harmless) <= {i for i, s in scores.items() if s < 0.501}
    assert 0 < len(harmless) <= len(before) and all(harmless[i] == before[i] for i in harmless)

    field = language_id.fit(*language_id.training_sample(after[0]))
    certain = {}
    for i, t in harmless.items():
        words = words_of(*text_buffers(pa.array([t], pa.string())))
        if len(words.text):
            scores_ = field.emissions(words)[words.lexeme].astype(np.float64)
            certain[i] = forward_backward(scores_[None], field.transitions, field.start, np.array([len(scores_)]))[0][0].max(axis=1).mean()
    least = pipeline.LEAST_CERTAINTY
    assert {i for i, c in certain.items() if c >= least + 1e-6} <= set(known) <= {i for i, c in certain.items() if c >= least - 1e-6}

    assert set(single) == kept_by_brute_force(list(known.items()))

    whole = list(single.items())
    expected = {}
    for (i, t), spans in zip(whole, plain_passages([t for _, t in whole], 200), strict=True):
        expected[i] = spans
    for i, t in single.items():
        n_bytes, removed, _, digest = expected[i]
        if not removed:
            assert cut[i] == t
        elif i in cut:  # but for halves of characters, what the digest was made of
            assert n_bytes - removed - 6 * expected[i][2] <= len(cut[i].encode()) <= n_bytes - removed
            assert len(cut[i].encode()) < n_bytes - removed or hashlib.sha256(cut[i].encode()).hexdigest() == digest
    assert set(cut) <= set(single) and all(expected[i][1] > 0 for i in set(single) - set(cut))

    library = load(queries.byte_bpe_encoding()[0])
    lengths = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in cut.items()}
    pieces = [(i, a, min(4096, n - a)) for i, n in sorted(lengths.items()) for a in range(0, n, 4096)]
    placed, sizes = plain_best_fit([n for _, _, n in pieces if n < 4096])
    short = iter(placed)
    wanted = {(i, a, n, *((next(short)) if n < 4096 else (None, 0))) for i, a, n in pieces}
    rows = pipeline.STAGES[-1][1](spark, after[-1], SF).collect()
    assert {(r["doc_id"], r["begin"], r["n_tokens"], r["bin"] if r["n_tokens"] < 4096 else None, r["bin_offset"]) for r in rows} == wanted
    assert all(r["capacity"] == (sizes[r["bin"]] if r["n_tokens"] < 4096 else 4096) for r in rows)


def test_pipeline_on_awkward_tables(spark, awkward, empty, tmp_path):
    import corpus_pipeline as pipeline

    for name, table in (("awkward", awkward), ("empty", empty)):
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(4, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        rows = pipeline.run(spark, folder).count()
        assert rows == 0 if name == "empty" else rows > 0
