"""Words of UTF-8 buffers and their hashed features, without a Python object for any word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of letters: A-Z, a-z and all of a multi-byte character; the rest separates words.
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes whose words are hashed together.
_STRETCH = 1 << 19
#: Distinct words whose grams are made together.
_SOME = 1 << 14
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass
class Words:
    """The words of some texts: `text` and `lexeme` of each word, in order; spans of the distinct ones in `low`."""

    low: np.ndarray
    text: np.ndarray
    lexeme: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    texts: int


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Cuts texts into words, lower-cased (ASCII and Latin-1); separators become spaces, with spaces around each text's ends."""
    n = len(offsets) - 1
    low = np.full(len(data) + n + 4, 0x20, np.uint8)
    if len(data):
        letters = _LETTER[data]
        put = np.where(letters, _LOWER[data], 0x20).astype(np.uint8)
        latin = np.zeros(len(data), bool)
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        put[latin] += 0x20
        bounds = offsets.tolist()
        for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):  # no index as long as the texts
            low[a + i + 2 : b + i + 2] = put[a:b]
    inside = low != 0x20
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    text = np.searchsorted(offsets + np.arange(n + 1) + 2, begin, side="right") - 1
    hashes = _hashes(low, begin, end)
    distinct, first, lexeme = np.unique(hashes, return_index=True, return_inverse=True)
    return Words(low, text, lexeme.reshape(-1), begin[first], end[first], distinct, n)


def _hashes(low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial hash of each word, from prefix sums (the odd base has an inverse modulo 2**64), a stretch of the buffer at a time."""
    out = np.empty(len(begin), np.uint64)
    cuts = [0]
    while cuts[-1] < len(begin):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(begin, begin[cuts[-1]] + _STRETCH))))
    longest = max((int(end[b - 1] - begin[a]) for a, b in zip(cuts, cuts[1:], strict=False)), default=0)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest, _MIX, np.uint64)]))
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest, _INVERSE, np.uint64)]))
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = low[begin[a] : end[b - 1]]
            sums = np.concatenate([[np.uint64(0)], np.cumsum(part * power[: len(part)])])
            at, to = begin[a:b] - begin[a], end[a:b] - begin[a]
            out[a:b] = mixed((sums[to] - sums[at]) * back[at] + (to - at).astype(np.uint64))
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


@dataclass
class Ragged:
    """Features of each distinct word: `ids[bounds[i]:bounds[i + 1]]`."""

    ids: np.ndarray
    bounds: np.ndarray

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Sum of the table's rows over each word's features."""
        if len(self.bounds) == 1:
            return np.zeros((0, table.shape[1]), np.float32)
        out = np.empty((len(self.bounds) - 1, table.shape[1]), np.float32)
        for c in range(table.shape[1]):
            out[:, c] = np.add.reduceat(table[:, c][self.ids], self.bounds[:-1])
        return out

    def of(self, chosen: np.ndarray) -> Ragged:
        """The features of some of the words."""
        count = np.diff(self.bounds)[chosen]
        bounds = np.concatenate([[0], np.cumsum(count)])
        return Ragged(self.ids[np.arange(bounds[-1]) + np.repeat(self.bounds[chosen] - bounds[:-1], count)], bounds)

    def scatter(self, grad: np.ndarray, size: int) -> np.ndarray:
        """The sums' gradient with respect to the table."""
        owner = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        return np.stack([np.bincount(self.ids, grad[owner, c], size) for c in range(grad.shape[1])], axis=1)


def _grams(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each distinct word with one space before and behind, and how many each has."""
    count = words.end - words.begin + 3 - size
    bounds = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(bounds[-1], np.uint64)
    for a in range(0, len(count), _SOME):  # some words at a time, so that only the hashes themselves are as many as the grams
        b = min(a + _SOME, len(count))
        at = np.arange(bounds[a], bounds[b]) + np.repeat(words.begin[a:b] - 1 - bounds[a:b], count[a:b])
        code = np.zeros(len(at), np.uint64)
        for i in range(size):
            code = code * np.uint64(257) + words.low[at + i]
        out[bounds[a] : bounds[b]] = mixed(code * _MIX + np.uint64(size))
    return out, count


def ngrams(words: Words, bits: int) -> Ragged:
    """Hashed trigrams."""
    code, count = _grams(words, 3)
    return Ragged((code >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([[0], np.cumsum(count)]))


def crf_features(words: Words, bits: int) -> Ragged:
    """Hashed bigrams and trigrams, affixes of up to four bytes, and the whole word."""
    length = words.end - words.begin
    parts = [_grams(words, 2), _grams(words, 3)]
    for size in (2, 3, 4):
        prefix, suffix = np.full(len(length), size, np.uint64), np.full(len(length), size + 8, np.uint64)
        for i in range(size):
            inside = i < length
            prefix = prefix * np.uint64(257) + np.where(inside, words.low[words.begin + np.minimum(i, length - 1)], 0)
            suffix = suffix * np.uint64(257) + np.where(inside, words.low[words.end - 1 - np.minimum(i, length - 1)], 0)
        parts += [(mixed(prefix * _MIX), np.ones(len(length), np.int64)), (mixed(suffix * _MIX), np.ones(len(length), np.int64))]
    parts.append((mixed(words.hashes + np.uint64(77)), np.ones(len(length), np.int64)))
    counts = np.stack([c for _, c in parts])
    bounds = np.concatenate([[0], np.cumsum(counts.sum(axis=0))])
    ids = np.empty(bounds[-1], np.int64)
    before = bounds[:-1].copy()
    for code, count in parts:
        own = np.concatenate([[0], np.cumsum(count)])
        ids[np.arange(own[-1]) + np.repeat(before - own[:-1], count)] = (code >> np.uint64(64 - bits)).astype(np.int64)
        before += count
    return Ragged(ids, bounds)
