"""Language identification by a linear-chain conditional random field over words.

Each word has affix, n-gram and lexicon features, hashed into one weight table; learned transitions tie
neighbours. Forward-backward gives each word's distribution over languages, so code-switched texts get
labels by word; a text's language is the one with the largest share of its words' marginals. It is fitted
on sequences of spans of labelled texts, half of them spliced from several, so that switches occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import beside, documents, held_out, restored, steps, text_buffers, together
from siltstone.llm.word_features import crf_features, words_of

BITS = 17
#: Distinct labelled texts of each language that are fitted on at most, the first by a hash; each is read whole.
SAMPLE_ROWS = 400
#: Longer texts aren't learned from; they are labelled like any other.
SAMPLE_BYTES = 1 << 20
#: Words that are worked on one after another, and stretches of so many side by side; neither changes a result.
STRETCH = 64
WIDE = 8192
UNKNOWN = "und"
#: Bytes that one step handles.
_STEP = 2 << 20
_has_letter = regex.compile(r"\p{L}").search


@dataclass
class Field:
    labels: list[str]
    weights: np.ndarray  # feature, label
    transitions: np.ndarray
    start: np.ndarray

    def emissions(self, words) -> np.ndarray:
        """Scores of each distinct word."""
        return crf_features(words, BITS).sums(self.weights)


def forward_backward(scores: np.ndarray, transitions: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (chain, word, label) and the transitions' expected counts. scores: (chain, word, label); words beyond a length are padding."""
    n, steps_, k = scores.shape
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(transitions - transitions.max())
    ahead, back = np.empty_like(local), np.ones_like(local)
    ahead[:, 0] = local[:, 0] * np.exp(start - start.max())
    ahead[:, 0] /= ahead[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, steps_):
        now = (ahead[:, t - 1] @ move) * local[:, t]
        ahead[:, t] = now / now.sum(axis=1, keepdims=True)
    for t in range(steps_ - 2, -1, -1):
        now = (back[:, t + 1] * local[:, t + 1]) @ move.T
        now /= now.sum(axis=1, keepdims=True)
        back[:, t] = np.where((t + 1 < lengths)[:, None], now, 1)
    marginals = ahead * back
    marginals /= marginals.sum(axis=2, keepdims=True)
    expected = np.zeros((k, k))
    for t in range(1, steps_):
        pair = ahead[:, t - 1, :, None] * move * (local[:, t] * back[:, t])[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        expected += pair[t < lengths].sum(axis=0)
    return marginals, expected


def _spans(total: int, width: int, random: np.random.Generator) -> np.ndarray:
    """Sequences of `width` words that go over all words: half are consecutive, the others spliced from shuffled pieces of 4 to 15 words."""
    blocks = np.resize(np.arange(total), (-(-total // width), width))
    spliced = random.random(len(blocks)) < 0.5
    words = blocks[spliced].ravel()
    cuts = np.cumsum(random.integers(4, 16, len(words) // 4 + 1))
    pieces = np.split(words, cuts[cuts < len(words)])
    mixed = np.concatenate([pieces[i] for i in random.permutation(len(pieces))]).reshape(-1, width)
    out = np.concatenate([blocks[~spliced], mixed])
    return out if len(out) >= 64 else np.resize(out, (64, width))


def fit(texts: list[str], labels: list[str], epochs: int = 6, batch: int = 128, seed: int = 0) -> Field:
    names = sorted(set(labels))
    k = len(names)
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    words = words_of(data, offsets)
    features = crf_features(words, BITS)
    label_of = np.searchsorted(names, labels)[words.text] if len(words.text) else np.zeros(0, np.int64)
    field = Field(names, np.zeros((1 << BITS, k), np.float32), np.zeros((k, k)), np.zeros(k))
    if not len(words.text) or k == 1:
        return field
    random = np.random.default_rng(seed)
    at = _spans(len(words.text), 32, random)
    count, width = at.shape
    lengths = np.full(batch, width)
    moments = [np.zeros_like(field.weights), np.zeros_like(field.transitions), np.zeros_like(field.start)]
    for epoch in range(epochs):
        order = random.permutation(count)
        rate = 0.3 / (1 + epoch)
        for i in range(0, count, batch):
            rows = at[order[i : i + batch]]
            lexemes, truth = words.lexeme[rows], label_of[rows]
            used, inverse = np.unique(lexemes, return_inverse=True)
            part = features.of(used)
            scores = part.sums(field.weights)[inverse.reshape(rows.shape)]
            marginals, expected = forward_backward(scores.astype(np.float64), field.transitions, field.start, lengths[: len(rows)])
            gap = marginals.copy()
            np.put_along_axis(gap, truth[:, :, None], np.take_along_axis(gap, truth[:, :, None], 2) - 1, 2)
            by_word = np.stack([np.bincount(inverse.ravel(), gap[:, :, c].ravel(), len(used)) for c in range(k)], axis=1)
            seen = np.zeros((k, k))
            np.add.at(seen, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
            grads = [part.scatter(by_word, 1 << BITS) / len(rows), (expected - seen) / len(rows), gap[:, 0].sum(axis=0) / len(rows)]
            for value, grad, moment in zip((field.weights, field.transitions, field.start), grads, moments, strict=True):
                moment += grad * grad
                value -= (rate * grad / (np.sqrt(moment) + 1e-6)).astype(value.dtype)
    return field


def predict(field: Field, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, label) sums of the words' marginals, each text's sum of its words' largest marginals, and its number of words."""
    words = words_of(data, offsets)
    n, k = words.texts, len(field.labels)
    counts = np.bincount(words.text, minlength=n)
    if not len(words.text) or not k:
        return np.zeros((n, max(k, 1))), np.zeros(n), counts
    marginals = text_marginals(field.emissions(words)[words.lexeme], counts, field.transitions, field.start)
    sums = np.stack([np.bincount(words.text, marginals[:, c], n) for c in range(k)], axis=1)
    return sums, np.bincount(words.text, marginals.max(axis=1), n), counts


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row (over all but the first axis) to the sum one: scales cancel in marginals."""
    return x / np.maximum(x.sum(axis=tuple(range(1, x.ndim)), keepdims=True), 1e-30)


def text_marginals(scores: np.ndarray, counts: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Forward-backward over whole texts: marginals (word, label). scores: (word, label) of all texts' words in order.

    A text is one chain however long. It is cut into stretches only to be worked on side by side: a
    stretch is a product of matrices, the messages at all borders follow from those products one after
    another, and with them each stretch is passed through either way.
    """
    k = scores.shape[1]
    place = np.arange(len(scores)) - np.repeat(np.cumsum(counts) - counts, counts)
    head = np.flatnonzero(place % STRETCH == 0)  # first word of each stretch
    lengths = np.diff(np.append(head, len(scores)))
    number = -(-counts // STRETCH)  # stretches of each text
    first = np.cumsum(number) - number
    move = np.exp(transitions - transitions.max())
    begin = np.exp(start - start.max())
    local = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    products = np.empty((len(head), k, k))
    for a in range(0, len(head), WIDE):
        own = slice(a, a + WIDE)
        product = np.eye(k) * local[head[own]][:, None, :]
        for t in range(1, int(lengths[own].max())):
            on = np.flatnonzero(lengths[own] > t)
            product[on] = _scaled((product[on] @ move) * local[head[own][on] + t][:, None, :])
        products[own] = product
    # messages at the borders: what comes into each stretch's first word, and what comes back behind its last
    entry, back = np.empty((len(head), k)), np.ones((len(head), k))
    texts = np.flatnonzero(number > 0)
    entry[first[texts]] = begin
    for j in range(1, int(number.max(initial=1))):
        at = first[np.flatnonzero(number > j)] + j
        entry[at] = _scaled(np.einsum("ni,nij->nj", entry[at - 1], products[at - 1]) @ move)
    for j in range(int(number.max(initial=1)) - 2, -1, -1):
        at = first[np.flatnonzero(number > j + 1)] + j
        back[at] = _scaled(np.einsum("nij,nj->ni", products[at + 1], back[at + 1]) @ move.T)
    out = np.empty_like(local)
    for a in range(0, len(head), WIDE):
        own = slice(a, a + WIDE)
        heads, sizes = head[own], lengths[own]
        now = _scaled(entry[own] * local[heads])
        out[heads] = now
        for t in range(1, int(sizes.max())):
            on = np.flatnonzero(sizes > t)
            now[on] = _scaled((now[on] @ move) * local[heads[on] + t])
            out[heads[on] + t] = now[on]
        now = back[own].copy()
        for t in range(int(sizes.max()) - 1, -1, -1):
            on = np.flatnonzero(sizes > t)
            at = heads[on] + t
            out[at] *= now[on]
            if t:
                now[on] = _scaled((now[on] * local[at]) @ move.T)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-30)


def training_sample(docs: DataFrame) -> tuple[list[str], list[str]]:
    """Text and lang of rows that aren't held out: SAMPLE_ROWS distinct whole texts of each language at most, by a hash of the text.

    Copies count once, so a large group of them is one text; a language has its own share however rare it is.
    """
    rows = held_out(documents(docs, "lang")).where(f"not held_out and lang is not null and octet_length(text) <= {SAMPLE_BYTES}")
    hashed = rows.select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("sample_hash"))
    number = hashed.select("lang", "sample_hash").distinct().groupBy("lang").count().collect()
    # rows beyond a bound that keeps about 2 SAMPLE_ROWS of a language are left out before they are ranked, so one task gets no more
    top = (1 << 63) - 1
    bounds = [(r["lang"], top if r["count"] <= 4 * SAMPLE_ROWS else int((1 << 64) * (2 * SAMPLE_ROWS + 200) / r["count"]) - (1 << 63)) for r in number]
    known = docs.sparkSession.createDataFrame(bounds, "lang string, bound long")
    near = hashed.join(F.broadcast(known) if len(bounds) <= 10_000 else known, "lang").where("sample_hash <= bound")
    once = near.select("lang", "sample_hash", "text").groupBy("lang", "sample_hash").agg(F.min("text").alias("text"))
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("sample_hash")))
    chosen = ranked.where(F.col("place") <= SAMPLE_ROWS).orderBy("sample_hash", "lang").select("text", "lang").toArrow()
    return chosen["text"].to_pylist(), chosen["lang"].to_pylist()


def _identified(docs: DataFrame, field: Field, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ascii_letter = np.zeros(256, bool)
        ascii_letter[0x41:0x5B] = ascii_letter[0x61:0x7B] = True
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            names, scores, sureness = [], [], []
            for a, b in steps(offsets, _STEP):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                sums, certain, counts = predict(field, part, own)
                found = np.concatenate([[0], np.cumsum(ascii_letter[part])])
                sure = found[own[1:]] > found[own[:-1]]
                best = sums.argmax(axis=1)
                share = sums[np.arange(len(sums)), best] / np.maximum(counts, 1)
                for i in range(b - a):
                    known = field.labels and (sure[i] or (counts[i] and _has_letter(part[own[i] : own[i + 1]].tobytes().decode("utf-8", "ignore"))))
                    names.append(field.labels[best[i]] if known else UNKNOWN)
                    scores.append(float(min(1.0, share[i])) if known else 0.0)
                    sureness.append(float(min(1.0, certain[i] / max(counts[i], 1))) if known else 0.0)
            own = {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64()), "certainty": pa.array(sureness, pa.float64())}
            yield together(batch, own, keep)

    frame, schema = beside(docs, keep, "doc_id long, held_out boolean, lang_pred string, score double, certainty double")
    return frame.mapInArrow(run, schema)


def identify(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, certainty) of every row.

    score is the language's share of the words' marginals, certainty the mean of each word's largest
    marginal. `und` with both 0 where the text is null or has no letter, or no language was learned. Ties go to
    the label that sorts first. Rows that repeat a doc_id are each judged; other columns are ignored; an
    empty table gives no rows. No shuffle; the model has a fixed size.
    """
    return _identified(docs, field, [])


def known_languages(docs: DataFrame, field: Field, least_certainty: float) -> DataFrame:
    """The rows of docs, with all their columns, that have a language and whose words are labelled with that certainty at least.

    A clean text in several languages has certain words, though none of its languages has a large share.
    """
    found = _identified(docs, field, docs.columns).where((F.col("lang_pred") != UNKNOWN) & (F.col("certainty") >= least_certainty))
    return restored(found, docs.columns, own=False)


def language_id(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Fits on the labelled rows (docs' own by default) and identifies every row of docs, as identify says.

    Labelled are rows with a text and a lang that aren't held out; a null doc_id isn't. An empty table
    gives no rows, and one without labelled rows `und` throughout.
    """
    return identify(docs, fit(*training_sample(docs if labelled is None else labelled)))
