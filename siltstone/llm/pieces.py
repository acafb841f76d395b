"""SentencePiece encoding and decoding by streaming Viterbi.

A segmentation is the one of largest total piece score; ties go to the longer last piece, as the
sentencepiece library decides for unigram models. The decoder takes characters as they come and keeps
the boundaries of the last `longest` characters only, the longest piece's length: no piece reaches
further back. Whenever all their backpointer paths meet in one boundary, ids up to it are final and
leave, and the decoder is in its first state again.

Where two neighbouring characters stand side by side in no piece, all paths meet whatever comes next.
So a text is fed to its decoder a stretch between two such places at a time; what the decoder commits
for a stretch depends on nothing else, and it remembers that for stretches that it has met before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.common import documents, text_buffers

SPACE = "▁"
#: Characters of the longest stretch that is remembered, and stretches of each of the two generations remembered.
REMEMBERED_LENGTH, REMEMBERED = 48, 400_000
#: Piece types of the model file's format: fixed values.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an unknown character costs below the least piece score: a fixed value of unigram models.
UNKNOWN_PENALTY = 10.0
#: Characters that the table of neighbours tells apart; any other one counts as standing beside all.
_PLANE = 1 << 16


def read_model(path: str) -> list[tuple[str, float, int]]:
    """Piece, score and type of each id."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    return [(p.piece, p.score, p.type) for p in model.pieces]


class Vocabulary:
    def __init__(self, pieces: list[tuple[str, float, int]]) -> None:
        self.pieces = pieces
        own = [(p, s, i) for i, (p, s, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED) and p]
        self.ids = {p: i for p, _, i in own}
        self.found = {p: (i, float(s)) for p, s, i in own}
        self.longest = max((len(p) for p in self.ids), default=1)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown_id = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        self.unknown_score = min((s for _, s, _ in own), default=0.0) - UNKNOWN_PENALTY
        self.reach: dict[str, int] = {}  # length of the longest piece that ends in a character
        for piece in self.ids:
            self.reach[piece[-1]] = max(len(piece), self.reach.get(piece[-1], 1))
        known = sorted({ord(c) for p in self.ids for c in p if ord(c) < _PLANE})
        self.place = np.zeros(_PLANE, np.int32)  # 0: in no piece
        self.place[known] = np.arange(1, len(known) + 1)
        self.width = len(known) + 1
        self.together = np.zeros(self.width**2, bool)
        for a, b in {pair for p in self.ids for pair in zip(map(ord, p), map(ord, p[1:]), strict=False) if max(pair) < _PLANE}:
            self.together[int(self.place[a]) * self.width + int(self.place[b])] = True

    def apart(self, codes: np.ndarray) -> np.ndarray:
        """For each neighbouring pair of characters, whether no piece holds it: exactly, but pairs with a character beyond _PLANE never are."""
        plain = codes < _PLANE
        place = self.place[codes if plain.all() else np.where(plain, codes, 0)]
        together = self.together[place[:-1].astype(np.int64) * self.width + place[1:]]
        return ~together & plain[:-1] & plain[1:]

    def emit(self, piece_id: int, text: str) -> list[int]:
        """Ids of one boundary-to-boundary step; an unknown character falls back on its bytes."""
        if piece_id >= 0:
            return [piece_id]
        raw = text.encode("utf-8", "replace")
        return [self.byte_ids[b] for b in raw] if all(b in self.byte_ids for b in raw) else [self.unknown_id]


class StreamingViterbi:
    """Feeds on characters of one text; ids leave as soon as they are final."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.text = ""  # from the first boundary that isn't committed on
        self.best, self.back = [0.0], [(-1, -1)]  # by boundary: score; previous boundary and piece
        self.most = 0  # characters held at once so far

    def feed(self, text: str) -> Iterator[int]:
        for begin in range(0, len(text), self.v.longest):
            part = text[begin : begin + self.v.longest]
            self.text += part
            self._extend(len(part))
            self.most = max(self.most, len(self.text))
            if len(self.text) >= self.v.longest:
                yield from self._commit(self._meeting())

    def close(self) -> Iterator[int]:
        yield from self._commit(len(self.best) - 1)

    def _extend(self, count: int) -> None:
        """Takes the last `count` characters in."""
        text, scores, paths = self.text, self.best, self.back
        find, reach, unknown = self.v.found.get, self.v.reach.get, self.v.unknown_score
        for end in range(len(scores), len(scores) + count):
            best, back = scores[end - 1] + unknown, (end - 1, -1)
            if (single := find(text[end - 1])) is not None:
                best, back = scores[end - 1] + single[1], (end - 1, single[0])
            for begin in range(end - 2, max(-1, end - 1 - reach(text[end - 1], 1)), -1):  # in a tie the longer piece
                piece = find(text[begin:end])
                if piece is not None and scores[begin] + piece[1] >= best:
                    best, back = scores[begin] + piece[1], (begin, piece[0])
            scores.append(best)
            paths.append(back)

    def _meeting(self) -> int:
        """Latest boundary that is on the paths of all boundaries from which a piece can still start."""
        end = len(self.best) - 1
        alive = set(range(max(0, end - self.v.longest + 1), end + 1))
        while len(alive) > 1:
            last = max(alive)
            alive.discard(last)
            alive.add(self.back[last][0])
        return alive.pop()

    def _commit(self, to: int) -> Iterator[int]:
        steps_, at = [], to
        while at > 0:
            begin, i = self.back[at]
            steps_.append((i, self.text[begin:at]))
            at = begin
        for i, piece in reversed(steps_):
            yield from self.v.emit(i, piece)
        if to > 0:
            self.text = self.text[to:]
            base = self.best[to]
            self.best = [b - base for b in self.best[to:]]
            self.back = [(begin - to, i) for begin, i in self.back[to:]]


def encode_long(vocabulary: Vocabulary, text: str) -> list[int]:
    """Ids of a text with the model's spaces, character by character."""
    decoder = StreamingViterbi(vocabulary)
    return [*decoder.feed(text), *decoder.close()]


class Encoder:
    """Encodes whole texts, in one worker: each is fed to a decoder stretch by stretch."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.remembered: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}  # what was remembered before; what is met again moves over
        self.decoded = 0  # characters that went through the decoder, not through what it remembers

    def _decode(self, stretch: str) -> tuple[int, ...]:
        ids = self.older.get(stretch)
        if ids is None:
            self.decoded += len(stretch)
            ids = tuple(encode_long(self.v, stretch))
        if len(stretch) <= REMEMBERED_LENGTH:
            if len(self.remembered) >= REMEMBERED:
                self.older, self.remembered = self.remembered, {}
            self.remembered[stretch] = ids
        return ids

    def __call__(self, text: str) -> np.ndarray:
        """Ids of a text, with the model's space before it; none for an empty text."""
        if not text:
            return np.zeros(0, np.int32)
        ready = SPACE + text.replace(" ", SPACE)
        codes = np.frombuffer(ready.encode("utf-32-le", "surrogatepass"), np.uint32)
        cuts = np.concatenate([[0], np.flatnonzero(self.v.apart(codes)) + 1, [len(ready)]]).tolist()
        get, decode = self.remembered.get, self._decode
        parts = [get(ready[a:b]) or decode(ready[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        return np.fromiter(chain.from_iterable(parts), np.int32)


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder, which its later tasks go on with."""
    return Encoder(Vocabulary(read_model(path)))


class Decoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        pieces = vocabulary.pieces
        self.raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(SPACE, " ").encode() for p, _, kind in pieces]

    def __call__(self, ids: Iterable[int]) -> str:
        """The text, without the space that encoding put first."""
        out = b"".join(map(self.raw.__getitem__, ids))
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


def encode_pieces(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, ids_crc32, restored), and with with_ids: ids.

    ids_crc32 is the crc32 of the ids as little-endian unsigned 32-bit integers; restored says whether
    decoding the ids gives the text back (with the model's space character as a space). A null or empty
    text has no ids. Rows that repeat a doc_id are each encoded; other columns are ignored; an empty
    table gives no rows. Texts of any length are encoded whole. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(path)
        decode = Decoder(encode.v)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            rows = []
            for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
                text = data[a:b].tobytes().decode()
                ids = encode(text)
                rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), decode(ids.tolist()) == text.replace(SPACE, " "), *([ids.tolist()] if with_ids else [])))
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())][: 3 + with_ids]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            sizes = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_tokens", "ids_crc32", "restored", "ids"][: 5 + with_ids])

    return documents(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, ids_crc32 long, restored boolean" + ", ids array<int>" * with_ids)
