"""How two tokenizers cut the same text: groups of tokens between common ends, and which tokens end together.

A text with one space before it is the text of both. It is cut before a single space between two
characters of which neither is white space: there both tokenizers begin a new token (the one's pattern
takes a space along with what follows, the other has no piece with its space mark after another
character), so such units are encoded once for each distinct one that a worker remembers, unknown ones
side by side. (Those of ASCII alone by tiktoken's engine on the same entries as ranks; its ids are the
tokenizers library's there, as a test holds.) Two pointers go over the units' cumulative ends and emit groups and links. Each task hands on its texts'
pairs of ids as numbers of a dictionary of its stretch of the table, with the dictionary; Spark counts the
dictionaries' pairs, takes the maximum for each id, joins both back to the dictionaries, and brings
each stretch's dictionary and texts together again.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from siltstone.llm.common import Scratch, documents

#: Bytes of text whose pairs share a dictionary; bytes of distinct units that a worker remembers.
STRETCH_BYTES, REMEMBERED = 8 << 20, 300 << 20
#: No white space of any table, no control character, no mark of the piece vocabulary: what may stand beside a cut.
_INNER = "[^\\x00-\\x20\\x7F-\\xA0\\xAD\\u0300-\\u036F\\u1680\\u180E\\u2000-\\u206F\\u2581\\u3000\\uFE00-\\uFE0F\\uFEFF]"
_CUT = re.compile(f"(?<={_INNER}) (?={_INNER})")
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")
_WHOLE = re.compile(_INNER)
#: Tokens of either side, number of groups, the groups as text, links as a << 32 | b.
Unit = tuple[int, int, int, str, tuple[int, ...]]
#: Of a unit whose bytes one of the tokenizers doesn't give back.
NO_UNIT: Unit = (-1, -1, -1, "", ())


def ends_together(a: list[int], b: list[int], a_lengths: list[int], b_lengths: list[int], ends: list[int]) -> Iterator[tuple[int, int, list[str], list[tuple[int, int]]]]:
    """For each of some stretches, by their ends in bytes: its tokens of either side, its groups between common ends as text, and pairs of ids that end together.

    Two pointers go over two token lists of the same bytes; lengths are by id. Each stretch's end is a
    common one. Tokens without bytes belong to the end before them.
    """
    i = j = first_a = first_b = begun_a = begun_b = a_end = b_end = 0
    n_a, n_b = len(a), len(b)
    for end in ends:
        groups, links = [], []
        while b_end < end:
            a_end += a_lengths[a[i]]
            i += 1
            b_end += b_lengths[b[j]]
            j += 1
            while a_end != b_end:
                if a_end < b_end:
                    a_end += a_lengths[a[i]]
                    i += 1
                else:
                    b_end += b_lengths[b[j]]
                    j += 1
            last_a, last_b = i - 1, j - 1
            while i < n_a and not a_lengths[a[i]]:
                i += 1
            while j < n_b and not b_lengths[b[j]]:
                j += 1
            if i - first_a == 1 and j - first_b == 1:
                groups.append(f"{a[first_a]}|{b[first_b]}")
                links.append((a[first_a], b[first_b]))
            else:
                groups.append(f"{','.join(map(str, a[first_a:i]))}|{','.join(map(str, b[first_b:j]))}")
                links += [(x, y) for x in a[last_a:i] for y in b[last_b:j]]
            first_a, first_b = i, j
        yield i - begun_a, j - begun_b, groups, links
        begun_a, begun_b = i, j


class Aligner:
    """Units of texts under both tokenizers, in one worker."""

    def __init__(self, byte_vocabulary: str, pattern: str, piece_model: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_vocabulary)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        byte_of = _bytes_of_characters()
        entries = self.a.get_vocab(with_added_tokens=True)
        own = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        ranks = {self.a_bytes[i]: i for entry, i in own.items() if all(c in byte_of for c in entry)}
        self.ascii = tiktoken.Encoding("ascii", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.lengths = [list(map(len, side)) for side in (self.a_bytes, self.b_bytes)]
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.units: dict[str, Unit] = {}
        self.codes: dict[int, int] = {}  # one object for each pair
        self.held = 0

    def _aligned(self, units: list[str]) -> list[Unit]:
        """Units side by side in one text, whose joints are such that texts are cut there; one by one where one side's bytes aren't those of the text."""
        text = " ".join(units)
        a = self.ascii.encode_ordinary(f" {text}") if text.isascii() else self.a.encode(f" {text}", add_special_tokens=False).ids
        b, whole = self.b.encode(text), f" {text}".encode()
        if any(b"".join([table[i] for i in ids]) != whole for table, ids in ((self.a_bytes, a), (self.b_bytes, b))):
            return [NO_UNIT] if len(units) == 1 else [u for unit in units for u in self._aligned([unit])]
        ends = list(accumulate([len(u) + 1 for u in units] if text.isascii() else [len(u.encode()) + 1 for u in units]))
        code = self.codes
        return [
            (n_a, n_b, len(groups), ";".join(groups), tuple([code.setdefault(c, c) for c in [x << 32 | y for x, y in links]]))
            for n_a, n_b, groups, links in ends_together(a, b, *self.lengths, ends)
        ]

    def learn(self, new: list[str]) -> None:
        """Encodes units; forgets all others first if they have grown too many."""
        if self.held > REMEMBERED:
            self.forget()
        kinds: tuple[list[str], list[str], list[str]] = [], [], []
        for t in new:
            whole = self.cuts and bool(t) and (t[0].isalnum() or _WHOLE.match(t[0])) and (t[-1].isalnum() or _WHOLE.match(t[-1]))
            kinds[0 if whole and t.isascii() else 1 if whole else 2].append(t)
        groups = [kind[i : i + 512] for kind in kinds[:2] for i in range(0, len(kind), 512)]
        for some in [*groups, *([t] for t in kinds[2])]:
            self.units.update(zip(some, self._aligned(some), strict=True))
            self.held += 400 * len(some) + 12 * sum(map(len, some))

    def cut(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cuts else [text]

    def _units(self, cut: list[str]) -> list[Unit]:
        found = list(map(self.units.get, cut))
        if None in found:
            self.learn([t for t in dict.fromkeys(cut) if t not in self.units])
            found = list(map(self.units.get, cut))
            if None in found:  # others were forgotten
                self.learn([t for t in dict.fromkeys(cut) if t not in self.units])
                found = list(map(self.units.get, cut))
        return found

    def text(self, text: str) -> tuple[int, int, int, str, np.ndarray, np.ndarray] | None:
        """Tokens of either side, the number of groups, the groups' hash, distinct links (a << 32 | b) and how often each occurs; None for a text without tokens."""
        cut = self.cut(text)
        n_a = n_b = n_groups = 0
        sha, links = hashlib.sha256(), Counter()
        for begin in range(0, len(cut), 50_000):
            found = self._units(cut[begin : begin + 50_000])
            if NO_UNIT in found:
                return None
            of_a, of_b, of_groups, shown, pairs = zip(*found, strict=True)
            n_a, n_b, n_groups = n_a + sum(of_a), n_b + sum(of_b), n_groups + sum(of_groups)
            sha.update(((";" if begin else "") + ";".join(shown)).encode())
            own = Counter(chain.from_iterable(pairs))
            links = links + own if begin else own
        return n_a, n_b, n_groups, sha.hexdigest(), np.fromiter(links.keys(), np.int64, len(links)), np.fromiter(links.values(), np.int64, len(links))


@lru_cache(1)
def aligner_of(*files: str) -> Aligner:
    """A worker's own, which it keeps from task to task."""
    return Aligner(*files)


def _bytes_of_characters() -> dict[str, int]:
    from siltstone.llm.token_counts import _bytes_of_characters as table

    return table()


#: A row is a text (places and times: its pairs' places in the dictionary, and how often it has them) or a stretch's dictionary (pairs and times).
ALIGNED = "stretch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places array<int>, pairs array<long>, times array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Stretch:
    """Texts that share a dictionary of pairs, until they are handed on as rows."""

    def __init__(self, number: int) -> None:
        self.number, self.size, self.texts = number, 0, []

    def rows(self) -> pd.DataFrame:
        pairs, place = np.unique(np.concatenate([t[-2] for t in self.texts] or [np.zeros(0, np.int64)]), return_inverse=True)
        place, all_times = place.reshape(-1).astype(np.int32), np.concatenate([t[-1] for t in self.texts] or [np.zeros(0, np.int64)])
        out, at = [], 0
        for doc_id, n_a, n_b, n_groups, sha, own, times in self.texts:
            out.append((self.number, doc_id, n_a, n_b, n_groups, int(times.sum()), sha, place[at : at + len(own)], None, times))
            at += len(own)
        out.append((self.number, None, None, None, None, None, None, None, pairs, np.bincount(place, all_times, len(pairs)).astype(np.int64)))
        columns = [c.split()[0] for c in ALIGNED.split(", ")]
        frame = pd.DataFrame(out, columns=columns)
        return frame.astype({c: "Int64" for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")})


def aligned(docs: DataFrame, byte_vocabulary: str, pattern: str, piece_model: str) -> DataFrame:
    """Rows as in ALIGNED, of texts and of dictionaries."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = aligner_of(byte_vocabulary, pattern, piece_model)
        first = TaskContext.get().partitionId() << 32
        stretch = Stretch(first)
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                found = aligner.text(text) if text else None
                none = np.zeros(0, np.int64)
                stretch.texts.append((None if pd.isna(doc_id) else int(doc_id), *(found or (0, 0, 0, "", none, none))))
                stretch.size += len(text or "") + 64
                if stretch.size >= STRETCH_BYTES:
                    yield stretch.rows()
                    stretch = Stretch(stretch.number + 1)
        if stretch.texts:
            yield stretch.rows()

    kept = documents(docs).select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # a long with nulls would come as floats
    return kept.mapInPandas(run, ALIGNED)


def alignment(docs: DataFrame, byte_vocabulary: str, pattern: str, piece_model: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A text that is null or empty, or that one of the tokenizers doesn't give back byte for byte, has no
    tokens: zeros and ''. Rows that repeat a doc_id are each a row and each count; a null doc_id stays
    null; other columns take no part; an empty table gives no rows. Texts are encoded whole, whatever
    their length. A pair's count is of all links of all texts, its best of all pairs with the same second id.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    rows = scratch.write(aligned(docs, byte_vocabulary, pattern, piece_model))
    listed = rows.where("pairs IS NOT NULL").select("stretch", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "z"))
    listed = listed.select("stretch", "place", F.col("z.pairs").alias("pair"), F.col("z.times").alias("times"))
    counts = scratch.write(listed.groupBy("pair").agg(F.sum("times").alias("count")))
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    most = counts.groupBy(second.alias("second")).agg(F.max("count").alias("most"))
    scored = counts.withColumn("second", second).join(most, "second").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    back = listed.join(scored, "pair").select(F.col("stretch").alias("of_stretch"), "place", "count", "best")
    texts = rows.where("pairs IS NULL").drop("pairs")

    def together(texts: pd.DataFrame, scores: pd.DataFrame) -> pd.DataFrame:
        count, best = np.zeros(len(scores), np.int64), np.zeros(len(scores), np.int64)
        count[scores["place"].to_numpy()] = scores["count"]
        best[scores["place"].to_numpy()] = scores["best"].astype(np.int64)
        out = texts.drop(columns=["stretch", "places", "times"])
        pairs = list(zip(texts["places"], texts["times"], strict=True))
        out.insert(5, "n_best", [int(best[p] @ t) for p, t in pairs])
        out.insert(6, "count_sum", [int(count[p] @ t) for p, t in pairs])
        return out

    return texts.groupBy("stretch").cogroup(back.groupBy("of_stretch")).applyInPandas(together, RESULT)
