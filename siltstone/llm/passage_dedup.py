"""Suffix-array removal of repeated passages.

Every byte covered by a `width`-byte string that also starts anywhere else is removed. A string and
its copy share the least hash among their `k`-byte substrings, the anchor. So

1. anchors of all strings are counted; only those that occur twice or more can carry a repeat;
2. the stretches of starts under such an anchor become pieces, and equal pieces are counted once
   with their number, in each task before the shuffle and again after it, so that a passage that a
   third of all documents hold is one piece;
3. pieces are dealt to shards by their anchor, so equal strings meet; pieces under a very frequent
   anchor are first cut by the place of their strings and dealt by the bytes that those have in common.
   Where pieces with such bytes in common still are too many for a shard, as at the end of a passage that
   very many texts hold, each of their strings is dealt by all its bytes, and equal ones are counted;
4. each shard is sorted by external induced sorting, in files: neighbours in suffix order whose common
   prefix reaches `width` are repeats, and a piece that stands for several is one by itself;
5. the repeats' places go back to the documents, where they are united, cut out and hashed.

Anchors only choose where strings meet: strings of a shard are compared on all their bytes, in the
suffix order. Equal pieces, and strings that are dealt one by one, are told by 128 bits of hashes.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, beside, carried_along, restored, steps, text_buffers, together
from siltstone.llm.induced_sort import PAD, sorted_suffixes

#: Bytes of distinct pieces for each shard; a shard may be any larger, as its sort works in files.
SHARD_BYTES = 12 << 20
#: Occurrences of an anchor from which its pieces are cut finer: fewer fit a shard even if all differ.
FREQUENT = 1 << 15
#: Bytes of pieces under one route from which it is no shard's any more: a passage's last strings run on into each text that holds it.
HOT_BYTES = 4 << 20
#: Starts of one finer piece.
FINE = 25
#: Starts whose anchors one step finds.
STEP = 1 << 20
#: Distinct pieces that a task counts together before it passes them on.
COMBINED = 100_000

_MULTIPLIER = 0x9E3779B97F4A7C15


def _powers(length: int) -> np.uint64:
    return np.uint64(pow(_MULTIPLIER, length, 1 << 64))


def substring_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-byte substring, built up by doubling."""
    current, size, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    n = len(data)
    while k:
        if k & 1:
            if out is None:
                out, done = current, size
            else:
                m = n - done - size + 1
                out = out[:m] * _powers(size) + current[done : done + m]
                done += size
        k >>= 1
        if k:
            m = n - 2 * size + 1
            current = current[:m] * _powers(size) + current[size : size + m]
            size *= 2
    out = out ^ (out >> np.uint64(29))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _sliding_minimum(values: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    rest = w - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, offsets: np.ndarray, width: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text's place, first start in the text, number of starts, anchor) of each stretch of starts under one occurrence of an anchor."""
    total = int(offsets[-1])
    for begin in range(0, max(0, total - width + 1), STEP):
        end = min(begin + STEP, total - width + 1)
        hashes = substring_hashes(data[begin : end + width - 1], k)
        least = _sliding_minimum(hashes, width - k + 1)
        at = np.arange(begin, end)
        first, last = np.searchsorted(offsets, [begin, end - 1], side="right") - 1
        each = np.diff(np.clip(offsets[first : last + 2], begin, end))
        text = np.repeat(np.arange(first, last + 1), each)
        final = np.repeat(offsets[first + 1 : last + 2] - width, each)  # the text's last start
        inside = at <= final
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (least[1:] != least[:-1]) | (hashes[: len(at) - 1] == least[:-1])  # the last: the anchor stays behind
        starts = np.flatnonzero(new)
        if not len(starts):
            continue
        stops = np.minimum(final[starts] + 1 - begin, np.append(starts[1:], len(at)))
        yield text[starts], at[starts] - offsets[text[starts]], stops - starts, least[starts].view(np.int64)


def _keyed(docs: DataFrame, *carried: Column) -> DataFrame:
    """k1, k2 name a text of a document; rows that repeat both are the same text and share what is found."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    return rows.withColumns({"k1": F.xxhash64("text", F.col("doc_id").isNull()), "k2": F.coalesce("doc_id", F.lit(0))})


def _anchor_table(keyed: DataFrame, width: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            k1, k2 = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in steps(offsets):
                for text, start, count, anchor in anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width, k):
                    yield pa.RecordBatch.from_arrays([pa.array(k1[a:b][text]), pa.array(k2[a:b][text]), pa.array(anchor), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], names=["k1", "k2", "anchor", "start", "count"])

    return keyed.select("text", "k1", "k2").mapInArrow(run, "k1 long, k2 long, anchor long, start int, count int")


def _fine(data: bytes, start: int, count: int, anchor: int, width: int, k: int) -> Iterator[tuple[int, int, int]]:
    """Cuts a stretch into (start, number, route): starts with the anchor about as far off, dealt by the bytes they share."""
    hashes = substring_hashes(np.frombuffer(data, np.uint8)[start : start + count + width - 1], k).view(np.int64)
    places = np.flatnonzero(hashes == anchor)
    each = np.arange(count)
    away = places[np.searchsorted(places, each)]
    block = (away - each) // FINE
    new = np.append(True, (away[1:] != away[:-1]) | (block[1:] != block[:-1]))
    cuts = np.append(np.flatnonzero(new), count)
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        low = int(away[a] - (block[a] + 1) * FINE + 1)  # the block's first and last possible starts around this anchor
        high = int(away[a] - block[a] * FINE)
        core = data[start + high : start + low + width]
        yield start + a, b - a, xxhash.xxh3_64_intdigest(core, int(block[a]))


def _pieces(found: DataFrame, width: int, k: int) -> DataFrame:
    """kind 0: where a piece occurs; kind 1: a piece, with its bytes the first time that a task sees it."""
    names = ["kind", "k1", "k2", "start", "count", "p1", "p2", "route", "piece", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again: dict[tuple[int, int], list[int]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(1, None, None, None, 0, p1, p2, v[1], None, v[0]) for (p1, p2), v in again.items() if v[0]]
            again.clear()
            return as_batch(rows)

        def as_batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 10, kinds, strict=True)], names=names)

        for batch in batches:
            for k1, k2, text, lists in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                data, rows = text.as_py().encode(), []
                parts = lists.values.flatten()
                for start, count, anchor, frequent in zip(*(p.to_pylist() for p in parts), strict=True):
                    cut = _fine(data, start, count, anchor, width, k) if frequent else [(start, count, anchor)]
                    for a, m, route in cut:
                        piece = data[a : a + m + width - 1]
                        digest = xxhash.xxh3_128_digest(piece)
                        key = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
                        route = route - (1 << 64) if route >= 1 << 63 else route
                        rows.append((0, k1, k2, a, m, *key, None, None, 1))
                        if (seen := again.get(key)) is not None:
                            seen[0] += 1
                        else:
                            again[key] = [0, route]
                            rows.append((1, None, None, None, m, *key, route, piece, 1))
                    if len(rows) >= 20_000:
                        yield as_batch(rows)
                        rows = []
                if rows:
                    yield as_batch(rows)
                if len(again) > COMBINED:
                    yield flush()
        if again:
            yield flush()

    return found.mapInArrow(run, "kind byte, k1 long, k2 long, start int, count int, p1 long, p2 long, route long, piece binary, n long")


class _ShardFile:
    """A shard's distinct pieces in files of the task's own, and their sort; what is in memory doesn't grow with the shard."""

    KIND = np.dtype([("p1", "<i8"), ("p2", "<i8"), ("length", "<i8"), ("number", "<i8")])
    #: Pieces that are handled at once.
    SOME = 1 << 15

    def __init__(self, width: int) -> None:
        self.width = width
        self.folder = tempfile.mkdtemp(prefix="suffixes-")
        self.text, self.records = (open(os.path.join(self.folder, name), "wb") for name in ("text", "records"))
        self.held: list[tuple[int, int, int, int]] = []
        self.key, self.length, self.number = None, 0, 0

    def add(self, key: tuple[int, int], piece: bytes | None, n: int) -> None:
        """Rows of a key come one after another; one of them at least has the piece."""
        if key != self.key:
            self._finish()
            self.key, self.length, self.number = key, 0, 0
        self.number += n
        if piece is not None and not self.length:
            self.length = len(piece)
            self.text.write((np.frombuffer(piece, np.uint8) + 1).tobytes() + b"\0")

    def _finish(self) -> None:
        if self.key is not None:
            self.held.append((*self.key, self.length, self.number))
            if len(self.held) >= self.SOME:
                self._flush()

    def _flush(self) -> None:
        np.array(self.held, self.KIND).tofile(self.records)
        self.held = []

    def _stretches(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Records and their begins in the text, some at a time."""
        count, at = os.path.getsize(self.records.name) // self.KIND.itemsize, 0
        for i in range(0, count, self.SOME):
            part = np.fromfile(self.records.name, self.KIND, min(self.SOME, count - i), offset=i * self.KIND.itemsize)
            ends = at + np.cumsum(part["length"] + 1)
            yield part, ends - part["length"] - 1
            at = int(ends[-1])

    def repeats(self) -> Iterator[tuple[tuple[int, int], bytes]]:
        """Each piece that has repeats, with their (first start, number) as pairs of 32-bit integers."""
        self._finish()
        self._flush()
        n = self.text.tell()
        self.text.write(bytes([PAD]) * (self.width + 16))
        self.text.close()
        self.records.close()
        if not n:
            return
        weights = os.path.join(self.folder, "weight")
        with open(weights, "wb") as file:  # of each start: how many there are, two at most; 0 where no string of the width starts
            for part, _ in self._stretches():
                starts = part["length"] - self.width + 1
                counts = np.stack([starts, part["length"] + 1 - starts], axis=1).ravel()
                np.repeat(np.stack([np.minimum(part["number"], 2), np.zeros(len(part), np.int64)], axis=1).ravel(), counts).astype(np.uint8).tofile(file)
        twice = np.memmap(os.path.join(self.folder, "twice"), bool, "w+", shape=(n,))
        self._mark(np.memmap(weights, np.uint8, "r"), twice, n)
        for part, begins in self._stretches():
            low, high = int(begins[0]), int(begins[-1] + part["length"][-1] + 1)
            flags = np.diff(np.concatenate([[0], np.asarray(twice[low:high]).view(np.int8), [0]]))
            first, end = np.flatnonzero(flags == 1), np.flatnonzero(flags == -1)
            piece = np.searchsorted(begins, first + low, side="right") - 1
            pairs = np.stack([first + low - begins[piece], end - first], axis=1).astype("<i4")
            edges = np.append(np.flatnonzero(np.append(True, piece[1:] != piece[:-1])), len(piece)) if len(piece) else np.zeros(1, np.int64)
            for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
                record = part[piece[a]]
                yield (int(record["p1"]), int(record["p2"])), pairs[a:b].tobytes()

    def _mark(self, weight: np.ndarray, twice: np.ndarray, n: int) -> None:
        """Runs of strings with a common prefix of the width that stand for two or more; a run may go on from stretch to stretch."""
        total, alone = 0, None  # of the run so far: its weight, and its only start while that is one
        for suffixes, prefixes in sorted_suffixes(self.text.name, n, self.width, self.folder):
            run = np.cumsum(prefixes < self.width)
            own = weight[suffixes]
            there = own > 0
            starts, of, own = suffixes[there], run[there], own[there]
            totals = np.bincount(of, own, run[-1] + 1)
            totals[0] += total
            if alone is not None and totals[0] >= 2:
                twice[alone] = True
            twice[starts[totals[of] >= 2]] = True
            last = int(run[-1])
            total = min(2, int(totals[last]))
            mine = starts[of == last] if total == 1 else starts[:0]
            alone = (int(mine[0]) if len(mine) else alone if last == 0 else None) if total == 1 else None

    def close(self) -> None:
        self.text.close()
        self.records.close()
        shutil.rmtree(self.folder, ignore_errors=True)


def _sort_shards(pieces: DataFrame, shards: int, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, shard, current = ["p1", "p2", "repeats"], None, None

        def finish(file: _ShardFile) -> Iterator[pa.RecordBatch]:
            rows = []
            for (p1, p2), found in file.repeats():
                rows.append((p1, p2, found))
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

        try:
            for batch in batches:
                for s, p1, p2, piece, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    if s != shard:
                        if current:
                            yield from finish(current)
                            current.close()
                        shard, current = s, _ShardFile(width)
                    current.add((p1, p2), piece, n)
            if current:
                yield from finish(current)
        finally:
            if current:
                current.close()

    dealt = pieces.select(F.pmod("route", F.lit(shards)).cast("int").alias("shard"), "p1", "p2", "piece", "n")
    return dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "p1", "p2").mapInArrow(run, "p1 long, p2 long, repeats binary")


def _string_by_string(pieces: DataFrame, width: int) -> DataFrame:
    """(p1, p2, repeats) of pieces that share their route but run on apart, so that no shard could hold them: each string goes its own way."""
    whole = pieces.groupBy("p1", "p2").agg(F.max("piece").alias("piece"), F.sum("n").alias("n"))
    starts = whole.select("p1", "p2", "n", "piece", F.explode(F.sequence(F.lit(0), F.octet_length("piece") - width)).alias("at"))
    string = F.substring(F.col("piece"), F.col("at") + 1, F.lit(width))
    strings = starts.select("p1", "p2", "n", "at", F.xxhash64(string).alias("s1"), F.xxhash64(F.lit(7), string).alias("s2"))
    again = strings.groupBy("s1", "s2").agg(F.sum("n").alias("total")).where("total > 1").select("s1", "s2")
    low, high = (F.lpad(F.hex(c.cast("long")), 2, "0") for c in (F.col("at") % 256, F.floor(F.col("at") / 256)))
    one = F.unhex(F.concat(low, high, F.lit("000001000000")))  # (start, 1) as little-endian 32-bit integers; a piece has no 65,536 starts
    return strings.join(again, ["s1", "s2"]).select("p1", "p2", one.alias("repeats"))


def cut_out(text: bytes, begins: np.ndarray, numbers: np.ndarray, width: int) -> tuple[bytes, int, np.ndarray]:
    """What stays of a text, the bytes removed, and the removed runs as (begin, end)."""
    if not len(begins):
        return text, 0, np.zeros((0, 2), np.int64)
    order = np.argsort(begins, kind="stable")
    begin, end = begins[order], (begins + numbers - 1 + width)[order]
    reach = np.maximum.accumulate(end)
    new = np.append(True, begin[1:] > reach[:-1])
    first = np.flatnonzero(new)
    runs = np.stack([begin[first], np.append(reach[first[1:] - 1], reach[-1])], axis=1)
    kept, at = [], 0
    for a, b in runs.tolist():
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept), int((runs[:, 1] - runs[:, 0]).sum()), runs


def _cut(docs: DataFrame, width: int, with_text: bool, keep: list[str]) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "passages")
    k = max(4, width // 4)
    keyed = _keyed(docs)
    table = scratch.write(_anchor_table(keyed.where(F.octet_length("text") >= width), width, k))
    shared = table.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", (F.col("n") >= FREQUENT).alias("frequent"))
    shared = scratch.write(shared)  # both sides of the join are then dealt anew, and a very frequent anchor can be split
    lists = table.join(shared, "anchor").groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "count", "anchor", "frequent")).alias("found"))
    lists = scratch.write(lists)
    scratch.drop(table, shared)
    texts = keyed.select("k1", "k2", "text").where(F.octet_length("text") >= width)
    pieces = scratch.write(_pieces(texts.join(lists, ["k1", "k2"]).select("k1", "k2", "text", "found"), width, k), partition_by=["kind"])
    scratch.drop(lists)
    distinct = pieces.where("kind = 1")
    routes = scratch.write(distinct.groupBy("route").agg(F.sum(F.octet_length("piece")).alias("bytes")).where(F.col("bytes") >= HOT_BYTES).select("route"))
    size = distinct.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    sorted_ = _sort_shards(distinct.join(routes, "route", "left_anti"), max(1, -(-size // SHARD_BYTES)), width)
    repeats = scratch.write(sorted_.unionAll(_string_by_string(distinct.join(routes, "route", "left_semi"), width)))
    places = pieces.where("kind = 0").select("k1", "k2", "start", "p1", "p2").join(repeats, ["p1", "p2"])
    places = scratch.write(places.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "repeats")).alias("places")))
    scratch.drop(pieces, repeats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                data = (text.as_py() or "").encode()
                begins, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for place in found.as_py() or []:
                    pairs = np.frombuffer(place["repeats"], "<i4").reshape(-1, 2).astype(np.int64)
                    begins.append(pairs[:, 0] + place["start"])
                    numbers.append(pairs[:, 1])
                kept, removed, runs = cut_out(data, np.concatenate(begins), np.concatenate(numbers), width)
                rows.append((len(data), removed, len(runs), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "ignore"), runs.ravel().tolist()] if with_text else [])))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (6 if with_text else 4)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=False))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "remaining_sha256", "remaining", "spans"]
            yield together(batch, dict(zip(names, arrays, strict=False)), keep)

    taken = "doc_id long, n_bytes long, n_removed long, n_spans long, remaining_sha256 string" + ", remaining string, spans array<long>" * with_text
    carried = carried_along(docs, keep)
    _, schema = beside(docs, keep, taken)
    found = _keyed(docs, *(c.alias(name) for name, c in carried.items())).join(places, ["k1", "k2"], "left").select("doc_id", "text", "places", *carried)
    return found.mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, width: int = 200, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), and with with_text: kept (text) and spans (begin, end, begin, end, ...).

    A text is its UTF-8 bytes, a null one empty. Removed is every byte covered by a `width`-byte string
    that also starts anywhere else, in the same text or another; overlaps count, strings are judged on
    the input, and none crosses a text's end. Texts shorter than `width` keep all. Rows that repeat a
    document are repeats of each other, whatever their ids; null doc_ids are kept; other columns are
    ignored; an empty table gives no rows. kept_sha256 is of the remaining bytes; in kept, what is left
    of a character that was cut in two is dropped. width is from 8 to 254.
    """
    return _cut(docs, width, with_text, []).withColumnsRenamed({"remaining_sha256": "kept_sha256", "remaining": "kept"})


def without_repeats(docs: DataFrame, width: int = 200) -> DataFrame:
    """The rows of docs, with all their columns, their text cut; those of which nothing but white space is left go."""
    found = _cut(docs, width, True, docs.columns).where("n_removed = 0 or trim(remaining) <> ''")
    text = [i for i, c in enumerate(docs.columns) if c == "text"]
    cut = found.withColumns({f"kept_{i}": F.when(F.col("n_removed") > 0, F.col("remaining")).otherwise(F.col(f"kept_{i}")) for i in text})
    return restored(cut, docs.columns, own=False)
