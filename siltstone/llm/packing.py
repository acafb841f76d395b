"""Best-fit packing into bins of several permitted capacities.

Pieces go in descending length each into the open bin that it fills best. Where none has room, a bin is
opened in the capacity of least cost for each token that it is expected to hold: its own piece, and
what fits of the pieces still to come, the longest first. In the end each bin shrinks to the smallest
capacity that holds its contents. A bin costs its capacity and a share that grows with its square.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from siltstone.llm.common import Scratch

CAPACITIES = (512, 1024, 2048, 4096)
#: Capacity at which the quadratic share of a bin's cost equals the linear one.
EVEN = 16_384
#: Rows that one task packs together, about.
SHARD_ROWS = 20_000


def cost(capacity: int) -> float:
    return capacity * (1 + capacity / EVEN)


class _Left:
    """How many pieces of each length are still to come."""

    def __init__(self, lengths: np.ndarray) -> None:
        values, counts = np.unique(lengths, return_counts=True)
        self.values, self.counts = values.tolist(), dict(zip(values.tolist(), counts.tolist(), strict=True))

    def take(self, length: int) -> None:
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length]
            self.values.pop(bisect_left(self.values, length))

    def fill(self, room: int) -> int:
        """Tokens that the longest fitting pieces, one after another, would put into the room."""
        whole, at = room, len(self.values)
        while room > 0:
            at = bisect_right(self.values, room, 0, at) - 1
            if at < 0:
                break
            length = self.values[at]
            room -= length * min(self.counts[length], room // length)
        return whole - room


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, in the order given, and the final capacity of each bin. Lengths are from 1 to the largest capacity."""
    capacities = tuple(sorted(capacities))
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    used: list[int] = []
    opened: list[int] = []
    rooms: list[int] = []  # distinct room of open bins, ascending
    by_room: dict[int, list[int]] = {}
    left = _Left(lengths)
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        left.take(length)
        at = bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
        else:
            b = len(used)
            best = min((c for c in capacities if c >= length), key=lambda c: (cost(c) / (length + left.fill(c - length)), c))
            used.append(0)
            opened.append(best)
            room = best
        bins[i], offsets[i] = b, used[b]
        used[b] += length
        room -= length
        if room > 0:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(b)
    final = np.array(capacities)[np.searchsorted(capacities, used)] if used else np.zeros(0, np.int64)
    return bins, offsets, final


def pack(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, shard_rows: int = SHARD_ROWS, rows: int | None = None) -> DataFrame:
    """(doc_id, piece, begin, n_tokens, shard, bin, bin_offset, capacity) of every piece of (doc_id, n_tokens).

    A document longer than the largest capacity becomes full pieces and a rest; full pieces are bins of
    their own. Every token is in exactly one piece and every piece in one bin. Lengths that are null or
    below 1 give no piece. Repeated and null doc_ids are packed like any other. Shards are dealt by a
    hash of the row and its place, so no key makes one larger; each is packed on its own, in ties by doc_id. rows: how
    many there are, where that is known more cheaply. Empty table: no rows.
    """
    largest = max(capacities)
    sized = lengths.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens")).where("n_tokens > 0")
    sized = Scratch(lengths.sparkSession, "packing").write(sized)  # rows are told apart by their place in it, which a task that runs again finds unchanged
    shards = max(1, -(-(sized.count() if rows is None else rows) // shard_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "piece", "begin", "n_tokens", "shard", "bin", "bin_offset", "capacity"]
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        shard = -1

        def flush() -> Iterator[pa.RecordBatch]:
            doc, size, missing = (np.concatenate([h[k] for h in held]) for k in range(3))
            full = size // largest
            pieces = full + (size % largest > 0)
            row = np.repeat(np.arange(len(doc)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = number * largest
            length = np.minimum(size[row] - begin, largest)
            whole = length == largest
            bins, offsets, final = best_fit(length[~whole], capacities)
            all_bins, all_offsets, all_sizes = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.full(len(row), largest)
            all_bins[~whole], all_offsets[~whole] = bins, offsets
            all_sizes[~whole] = final[bins] if len(bins) else 0
            all_bins[whole] = len(final) + np.arange(int(whole.sum()))
            for a in range(0, len(row), 50_000):
                part = slice(a, a + 50_000)
                ids = pa.array(doc[row[part]], mask=missing[row[part]])
                numbers = [number, begin, length, np.full(len(row), shard), all_bins, all_offsets, all_sizes]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x[part].astype(np.int64)) for x in numbers)], names=names)

        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
            ids, missing = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False), batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a == b:
                    continue
                if own[a] != shard and held:
                    yield from flush()
                    held = []
                shard = int(own[a])
                held.append((ids[a:b], batch.column(2).to_numpy(zero_copy_only=False)[a:b], missing[a:b]))
        if held:
            yield from flush()

    dealt = sized.select(F.pmod(F.xxhash64("doc_id", "n_tokens", F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"), "doc_id", "n_tokens")
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "n_tokens")
    schema = "doc_id long, piece long, begin long, n_tokens long, shard long, bin long, bin_offset long, capacity long"
    return dealt.mapInArrow(run, schema)


def token_lengths(docs: DataFrame, encoding: tuple, end_id: int = 2) -> DataFrame:
    """(doc_id, n_tokens) with the end id, by the byte-level vocabulary of the token files."""
    from siltstone.llm.token_files import tokenise

    return tokenise(docs, encoding, end_id).select("doc_id", (F.octet_length("ids") / F.col("width")).cast("long").alias("n_tokens"))


def pack_documents(docs: DataFrame, encoding: tuple, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """Packs whole documents by their token lengths, as pack says; a null or empty text is its end id alone.

    Rows that repeat or lack a doc_id are each packed; other columns are ignored; an empty table gives no rows.
    """
    return pack(token_lengths(docs, encoding), capacities, rows=docs.count())
