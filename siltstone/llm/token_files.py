"""Token-ID files: static range asymmetric numeral systems over shared frequency tables.

A file is a Parquet table whose rows are segments; a segment's payload is this format's own bytes:

  header   magic, version, a reserved field, id of end of document, documents, tokens, distinct ids, block size
  table    the distinct ids and their frequencies, which sum to 2**20: shared by all blocks
  index    each document's id and number of tokens
  blocks   each block: its crc32 (of the ids), its checkpoints, its words

A block holds BLOCK tokens (the last of a segment fewer), dealt round-robin over LANES interleaved
64-bit states that share one stream of 32-bit words. Checkpoints keep all states and the place in the
stream at every CHECKPOINT-th step, so a reader starts anywhere there: the decoder below advances all
lanes of all checkpoints of all blocks of a segment at once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, documents

MAGIC = b"SANS"
SCALE_BITS = 20
LANES = 32
BLOCK = 16_384
CHECKPOINT = 128
#: Tokens of a segment; it ends with the document that reaches them.
SEGMENT = 1 << 20
#: Bytes of text of a shard, about: the ids of one document, however long, stay together.
SHARD_BYTES = 32 << 20
_LOW = np.uint64(1 << 32)
_32 = np.uint64(32)
_HEAD = struct.Struct("<4sHHIIQII")


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to 2**SCALE_BITS, none below 1."""
    total = 1 << SCALE_BITS
    out = np.maximum(1, np.floor(counts * (total / counts.sum())).astype(np.int64))
    gap = total - int(out.sum())
    if gap > 0:
        out[int(np.argmax(counts))] += gap
    while gap < 0:  # what rounding up to 1 took, from the largest
        big = np.flatnonzero(out > 1)
        big = big[np.argsort(-out[big], kind="stable")]
        take = np.minimum(out[big] // 2, -(-(-gap) // len(big)) + np.zeros(len(big), np.int64))
        take = np.maximum(take, 1)
        over = np.cumsum(take) - take
        take = np.clip(-gap - over, 0, take)
        out[big] -= take
        gap += int(take.sum())
    return out


def encode_segment(doc_ids: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, end_id: int) -> bytes:
    """One segment's payload. tokens: ids of all documents in order, end ids included."""
    n = len(tokens)
    ids, place, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    freq = frequencies(counts) if n else counts
    cum = np.cumsum(freq) - freq
    blocks = -(-n // BLOCK) if n else 0
    head = _HEAD.pack(MAGIC, 2, 0, end_id, len(doc_ids), n, len(ids), BLOCK)
    parts = [head, ids.astype("<u4").tobytes(), freq.astype("<u4").tobytes(), doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes()]
    if not n:
        return b"".join(parts)
    n_steps = -(-BLOCK // LANES)
    padded = np.zeros(blocks * n_steps * LANES, np.int64)
    padded[:n] = place
    padded = padded.reshape(blocks, n_steps, LANES).transpose(1, 0, 2)
    there = (np.arange(blocks * n_steps * LANES) < n).reshape(blocks, n_steps, LANES).transpose(1, 0, 2)
    f64, c64 = freq.astype(np.uint64), cum.astype(np.uint64)
    state = np.full((blocks, LANES), _LOW, np.uint64)
    words = np.zeros((n_steps, blocks, LANES), np.uint32)
    sent = np.zeros((n_steps, blocks, LANES), bool)
    marks = n_steps // CHECKPOINT
    kept = np.zeros((blocks, marks, LANES), np.uint64)
    shift, room = np.uint64(SCALE_BITS), np.uint64(64 - SCALE_BITS)
    for s in range(n_steps - 1, -1, -1):
        f, c, on = f64[padded[s]], c64[padded[s]], there[s]
        out = on & (state >= (f << room)) & (f < np.uint64(1 << SCALE_BITS))
        words[s], sent[s] = state.astype(np.uint32), out
        moved = np.where(out, state >> _32, state)
        whole = moved // f
        state = np.where(on, (whole << shift) + (moved - whole * f) + c, state)
        if s % CHECKPOINT == 0:
            kept[:, s // CHECKPOINT] = state
    per_step = sent.sum(axis=2)
    before = (np.cumsum(per_step, axis=0) - per_step)[::CHECKPOINT]
    for b in range(blocks):
        stream = words[:, b][sent[:, b]].astype("<u4")
        own = tokens[b * BLOCK : (b + 1) * BLOCK].astype("<u4")
        parts += [struct.pack("<II", zlib.crc32(own.tobytes()), len(stream)), before[:, b].astype("<u4").tobytes(), kept[b].astype("<u8").tobytes(), stream.tobytes()]
    return b"".join(parts)


def decode_segment(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, lengths and tokens (uint32); raises ValueError where a checksum fails."""
    magic, version, _, _, docs, n, distinct, block = _HEAD.unpack_from(payload)
    if magic != MAGIC or version != 2:
        raise ValueError("not a segment of token ids")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, count, at)
        at += out.nbytes
        return out

    ids, freq, doc_ids, lengths = take("<u4", distinct), take("<u4", distinct).astype(np.uint64), take("<i8", docs), take("<u4", docs)
    if not n:
        return doc_ids, lengths, np.zeros(0, np.uint32)
    cum = np.cumsum(freq) - freq
    symbol = np.repeat(np.arange(distinct, dtype=np.uint32), freq.astype(np.int64))
    blocks, n_steps = -(-n // block), -(-block // LANES)
    marks = n_steps // CHECKPOINT
    sums, streams, places, states, base = [], [], [], [], 0
    for _ in range(blocks):
        crc, size = take("<u4", 2).tolist()
        places.append(take("<u4", marks).astype(np.int64) + base)
        states.append(take("<u8", marks * LANES).reshape(marks, LANES))
        streams.append(take("<u4", size))
        sums.append(crc)
        base += size
    stream = np.concatenate([*streams, np.zeros(1, np.uint32)]).astype(np.uint64)
    place, state = np.concatenate(places), np.concatenate(states)
    first = (np.arange(blocks * marks) * CHECKPOINT * LANES)[:, None] + np.arange(LANES)
    mask, shift = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
    out = np.zeros((CHECKPOINT, blocks * marks, LANES), np.uint32)
    for s in range(CHECKPOINT):
        on = first + s * LANES < n
        slot = state & mask
        k = symbol[slot]
        out[s] = k
        moved = freq[k] * (state >> shift) + slot - cum[k]
        low = on & (moved < _LOW)
        at_word = place[:, None] + np.cumsum(low, axis=1) - 1
        moved = np.where(low, (moved << _32) | stream[np.where(low, at_word, len(stream) - 1)], moved)
        place = place + low.sum(axis=1)
        state = np.where(on, moved, state)
    tokens = ids[out.transpose(1, 0, 2).reshape(-1)[:n]]
    for b, crc in enumerate(sums):
        if zlib.crc32(tokens[b * block : (b + 1) * block].astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {b}: checksum differs")
    return doc_ids, lengths, tokens


class Encoding:
    """Token ids as the tokenizers library gives them.

    Stretches of characters below U+0250 go through tiktoken's engine on the same ranks (held equal to
    the library in the tests, and several times as fast); stretches with others go through the library,
    whose Unicode tables then decide. Stretches begin at a single space between two visible ASCII
    characters, where a pre-token always begins.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str, special: dict[str, int]) -> None:
        import base64

        import regex
        import tiktoken

        from siltstone.llm.token_counts import load

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.library = load(json_path)
        self.odd = regex.compile("[^\x00-\u024F]|[\x1c-\x1f]").search
        self.cut = regex.compile("(?<=[!-~])(?= [!-~])").split
        self.largest = max(max(ranks.values(), default=0), max(special.values(), default=0))
        self.by_library = 0  # characters that the library encoded

    def __call__(self, text: str) -> np.ndarray:
        if not self.odd(text):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        out = []
        for odd, stretch in groupby(self.cut(text), lambda part: self.odd(part) is not None):
            joined = "".join(stretch)
            if odd:
                self.by_library += len(joined)
                out.append(np.array(self.library.encode(joined, add_special_tokens=False).ids, np.uint32))
            else:
                out.append(self.fast.encode_to_numpy(joined, allowed_special="all"))
        return np.concatenate(out)


def id_kind(encoding: Encoding, end_id: int) -> str:
    """Two bytes where every id fits them, else four."""
    return "<u2" if max(encoding.largest, end_id) < 1 << 16 else "<u4"


def tokenise(docs: DataFrame, encoding: tuple, end_id: int) -> DataFrame:
    """(doc_id, ids, width): each document's ids, the end id last, as little-endian unsigned integers of `width` bytes, which the vocabulary decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoding(*encoding)
        kind = id_kind(encode, end_id)
        tail = np.array([end_id], kind).tobytes()
        for batch in batches:
            out = [encode(text.as_py()).astype(kind).tobytes() + tail if text.is_valid else tail for text in batch.column(1)]
            width = pa.array(np.full(len(out), np.dtype(kind).itemsize, np.int8))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), width], names=["doc_id", "ids", "width"])

    return documents(docs).mapInArrow(run, "doc_id long, ids binary, width byte")


def write_token_files(docs: DataFrame, path: str, encoding: tuple, end_id: int = 2, segment: int = SEGMENT) -> None:
    """Writes `path`: segments (shard, seq, first_token, n_tokens, payload) in ascending doc_id order.

    Shards are ranges of doc_id between quantiles of that column alone, as many as SHARD_BYTES of text
    make, so texts are encoded once and only ids are shuffled, each shard to a task of its own. Null texts
    are empty, so they hold the end id. Rows without a doc_id come first, in any order: they have shards of
    their own, by the hash of their ids, with negative numbers. Repeated doc_ids keep all their rows.
    """
    number = F.col("doc_id").cast("long")
    size, rows, missing = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))), F.count(F.lit(1)), F.count_if(number.isNull())).first()
    shards = max(1, -(-(size or 0) // SHARD_BYTES))
    without = -(-shards * missing // rows) if missing else 0
    cuts = [i / shards for i in range(1, shards)]
    bounds = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), cuts or [0.5], max(10_000, 20 * shards))).first()[0] or []
    bounds = sorted(set(bounds))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(bounds, np.int64)
        for batch in batches:
            ids, none = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            shard = np.searchsorted(edges, ids).astype(np.int32)
            for i in np.flatnonzero(none).tolist():
                shard[i] = -1 - zlib.crc32(batch.column(1)[i].as_buffer()) % without
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(ids), batch.column(1), batch.column(2)], names=["shard", "doc_id", "ids", "width"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ["shard", "seq", "first_token", "n_tokens", "payload"], []
        shard, seq, begun, size, width = None, 0, 0, 0, 2

        def flush() -> pa.RecordBatch:
            nonlocal seq, begun, size, held
            lengths = np.array([len(x) // width for _, x in held], np.int64)
            tokens = np.frombuffer(b"".join(x for _, x in held), f"<u{width}").astype(np.uint32)
            payload = encode_segment(np.array([i for i, _ in held], np.int64), lengths, tokens, end_id)
            row = [pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([begun], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([payload], pa.binary())]
            seq, begun, size, held = seq + 1, begun + len(tokens), 0, []
            return pa.RecordBatch.from_arrays(row, names=names)

        for batch in batches:
            for s, i, x, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                width = own
                if s != shard:
                    if held:
                        yield flush()
                    shard, seq, begun, size = s, 0, 0, 0
                held.append((i, x.as_py()))
                size += len(held[-1][1]) // width
                if size >= segment:
                    yield flush()
        if held:
            yield flush()

    dealt = tokenise(docs, encoding, end_id).mapInArrow(deal, "shard int, doc_id long, ids binary, width byte")
    sorted_ = dealt.withColumn("place", F.col("shard") + without).repartitionById(shards + without, "place").drop("place").sortWithinPartitions("shard", "doc_id")
    sorted_.mapInArrow(encode, "shard int, seq int, first_token long, n_tokens long, payload binary").write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), each segment decoded on its own.

    start needs the tokens of the shards before: one row for each shard comes to the driver, one for
    SHARD_BYTES of text.
    """
    files = spark.read.parquet(path)
    totals = sorted((r["shard"], r["n"]) for r in files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    before = dict(zip((s for s, _ in totals), np.cumsum([0, *(n for _, n in totals)]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                doc_ids, lengths, tokens = decode_segment(payload.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(tokens.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()) if shard >= 0 else pa.nulls(len(doc_ids), pa.int64()), pa.array(before[shard] + first + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("shard", "first_token", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, encoding: tuple, end_id: int = 2) -> DataFrame:
    """Writes the files to shared scratch space and reads them back."""
    scratch = Scratch(docs.sparkSession, "token-files")
    write_token_files(docs, f"{scratch.base}/files", encoding, end_id)
    scratch.release()
    return read_token_files(docs.sparkSession, f"{scratch.base}/files")
