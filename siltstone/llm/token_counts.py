"""Token counts with a whole-token shortcut.

Offline, each vocabulary string is encoded alone; those that come back as the one token they name are
proven whole tokens. A text is normalised and cut into pre-tokens; a pre-token that is a proven whole
token counts as one without any merging, and only the other distinct pre-tokens go through the
library's merges. Pre-tokenisation is reproduced here for characters below U+0250, where it is plain.
A text with others is cut at ASCII white space, which no pre-token and no normalisation spans: each word
that holds another character is counted by the library itself, so that counts never depend on a
difference between Unicode tables, and the rest of the text takes the shortcut.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import documents

#: The vocabulary file's pre-tokenizer pattern and its special strings: fixed values of that file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
END_OF_WORD = "</w>"

#: Distinct merged pre-tokens that a worker remembers at most; then it starts afresh.
REMEMBERED = 300_000

_FIND = regex.compile(PATTERN.replace(r"\s", r"\t-\r \x85\xa0")).findall
_PLAIN = regex.compile("[^\x00-\u024F]").search
_WORDS = regex.compile(r"[^\t-\r ]+").findall
_SPLIT = regex.compile("|".join(map(regex.escape, SPECIAL)))


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_padding()
    out.no_truncation()
    return out


def whole_tokens(path: str) -> list[str]:
    """The pre-tokens that the library encodes alone as the one token of their vocabulary entry, sorted."""
    tokenizer = load(path)
    byte_of = _bytes_of_characters()
    candidates = []
    for entry, i in tokenizer.get_vocab(with_added_tokens=False).items():
        if not entry.endswith(END_OF_WORD):
            continue
        try:
            text = bytes(byte_of[c] for c in entry[: -len(END_OF_WORD)]).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text and not _PLAIN(text) and text == text.lower() and _FIND(text) == [text]:
            candidates.append((text, i))
    encoded = tokenizer.encode_batch_fast([t for t, _ in candidates], add_special_tokens=False)
    return sorted(t for (t, i), e in zip(candidates, encoded, strict=True) if e.ids == [i])


def _bytes_of_characters() -> dict[str, int]:
    """Byte-level vocabularies print a byte as itself where that is a visible Latin-1 character, the rest from U+0100 on in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in visible)
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Counting:
    """Counts the tokens of whole texts, in one worker."""

    def __init__(self, path: str, whole: list[str]) -> None:
        self.tokenizer = load(path)
        self.whole = dict.fromkeys(whole, 1)
        self.merged: dict[str, int] = {}
        self.shortcut = 0  # plain words of texts that also hold other characters

    def _by_library(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        if len(self.merged) + len(words) > REMEMBERED:
            self.merged.clear()
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            self.merged.update(zip(part, self._by_library(part), strict=True))

    def plain(self, text: str) -> int:
        """Of a text of characters below U+0250 without special strings."""
        seen = Counter(_FIND(text.lower()))
        whole, merged = self.whole, self.merged
        rest = {w: n for w, n in seen.items() if w not in whole}
        total = sum(seen.values()) - sum(rest.values())
        unknown = [w for w in rest if w not in merged]
        if unknown:
            self._learn(unknown)
            merged = self.merged
            if len(unknown) < len(rest) and any(w not in merged for w in rest):
                self._learn([w for w in rest if w not in merged])
        return total + sum(n * merged[w] for w, n in rest.items())

    def by_words(self, text: str) -> int:
        """Of a text without special strings: the words with other characters by the library, once for each, the rest by the shortcut."""
        plain, odd = [], []
        for word in _WORDS(text):
            (odd if not word.isascii() and _PLAIN(word) else plain).append(word)
        seen = Counter(odd)
        unknown = [w for w in seen if w not in self.merged]
        if unknown:
            self._learn(unknown)
            again = [w for w in seen if w not in self.merged]
            if again:
                self._learn(again)
        self.shortcut += len(plain)
        return self.plain(" ".join(plain)) + sum(n * self.merged[w] for w, n in seen.items())

    def _part(self, text: str) -> int:
        return self.by_words(text) if not text.isascii() and _PLAIN(text) else self.plain(text)

    def count(self, text: str) -> int:
        if "<|" not in text:
            return self._part(text)
        return len(_SPLIT.findall(text)) + sum(map(self._part, _SPLIT.split(text)))


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    A null or empty text has no bytes and no tokens. Rows that repeat a doc_id are each counted; a
    null doc_id stays null; other columns are ignored; an empty table gives no rows. Texts of any
    length are counted whole. The only thing sent to executors is the list of proven whole tokens,
    which is bounded by the vocabulary. No shuffle.
    """
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(path, whole.value)
        for batch in batches:
            counts = np.fromiter((counting.count(t) if t else 0 for t in (s.as_py() for s in batch.column(2))), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"])

    sized = documents(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
