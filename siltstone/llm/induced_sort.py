"""External induced suffix sorting with common prefixes.

The text lives in a file; symbols are bytes with 0 as the separator and the end. Left-most S-type
suffixes (those that start a rise after a fall) are sorted first, in files: dealt by eight symbols at a
time, again and again, until a part fits in memory. Then two sweeps induce all others: the
first takes suffixes in ascending order from a priority queue and pushes each one's L-type
predecessor, the second in descending order the S-type predecessors. The queue carries tuples of
symbol, suffix and common prefix with the suffix before; it is monotone, so what shares a symbol
leaves in the order in which it came, and it spills to files beyond its budget. The common prefix of
an induced suffix is one more than the least common prefix that was scanned since the last push of
its symbol.

Prefixes count up to a cap, and suffixes that agree in as many symbols may stand in either order:
repeats of that length need no more. It is the cap that lets the stars be dealt by their symbols; without
one their order would take the recursion over a reduced string. Text, stars and tuples are in files, and
what is in memory is bounded by BUDGET and BATCH, however long the text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

#: Symbol that pads the file's end; no text may hold it.
PAD = 0xFF
#: Tuples that are scanned at once.
BATCH = 1 << 18
#: Pairs of neighbours that are compared at once.
_NEAR = 1 << 14
#: Tuples that a queue holds in memory, and keys that are sorted at once.
BUDGET = 1 << 22
#: Star suffixes that are sorted in memory at once.
STARS = 1 << 21


class TupleQueue:
    """Disk-backed monotone priority queue of (symbol, suffix, prefix): first in, first out for each symbol."""

    def __init__(self, folder: str, name: str, kind: type, budget: int) -> None:
        self.base, self.kind, self.budget = os.path.join(folder, name), np.dtype(kind), budget
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(256)]
        self.size = 0
        self.written, self.read = [0] * 256, [0] * 256

    def push(self, symbol: int, suffixes: np.ndarray, prefixes: np.ndarray) -> None:
        self.held[symbol].append((suffixes, prefixes))
        self.size += len(suffixes)
        if self.size > self.budget:
            self.spill()

    def spill(self) -> None:
        for symbol, parts in enumerate(self.held):
            if parts:
                for suffix, place in (("s", 0), ("p", 1)):
                    with open(f"{self.base}-{symbol}{suffix}", "ab") as file:
                        for part in parts:
                            part[place].tofile(file)
                self.written[symbol] += sum(len(p[0]) for p in parts)
                parts.clear()
        self.size = 0

    def _load(self, symbol: int, begin: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        suffixes = np.fromfile(f"{self.base}-{symbol}s", self.kind, count, offset=begin * self.kind.itemsize)
        return suffixes, np.fromfile(f"{self.base}-{symbol}p", np.uint8, count, offset=begin)

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The symbol's next tuples, oldest first."""
        if self.read[symbol] < self.written[symbol]:
            count = min(BATCH, self.written[symbol] - self.read[symbol])
            self.read[symbol] += count
            return self._load(symbol, self.read[symbol] - count, count)
        parts = self.held[symbol]
        if not parts:
            return None
        take, n = [], 0
        while parts and n < BATCH:
            take.append(parts.pop(0))
            n += len(take[-1][0])
        self.size -= n
        return np.concatenate([p[0] for p in take]), np.concatenate([p[1] for p in take])

    def backwards(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All of the symbol's tuples in stretches, the last stretch first; within one, oldest first."""
        parts = self.held[symbol]
        while parts:
            yield parts.pop()
        end = self.written[symbol]
        while end:
            begin = max(0, end - BATCH)
            yield self._load(symbol, begin, end - begin)
            end = begin


def range_minimum(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least of values[left..right], ends included, for many ranges."""
    levels, span = [values], 1
    while 2 * span <= len(values):
        last = levels[-1]
        levels.append(np.concatenate([np.minimum(last[: len(last) - span], last[span:]), last[len(last) - span :]]))
        span *= 2
    flat = np.concatenate(levels)
    level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    base = level.astype(np.int64) * len(values)
    return np.minimum(flat[base + left], flat[base + right - (1 << level.astype(np.int64)) + 1])


class Sweep:
    """One direction of induction into a queue."""

    def __init__(self, text: np.ndarray, queue: TupleQueue, cap: int, down: bool) -> None:
        self.text, self.queue, self.cap, self.down = text, queue, cap, down
        self.low = np.full(256, 255, np.uint8)  # least prefix scanned since the symbol's last push
        self.begun = np.zeros(256, bool)

    def scan(self, symbol: int, suffixes: np.ndarray, prefixes: np.ndarray, same: bool) -> None:
        """suffixes in scanning order, each with its prefix common with the one scanned before; same: they are of the induced type."""
        before = suffixes - 1
        drawn = self.text[np.maximum(before, 0)]
        chosen = (drawn < symbol) if self.down else (drawn > symbol)
        if same:
            chosen |= drawn == symbol
        place = np.flatnonzero(chosen & (suffixes > 0))
        if not len(place):
            np.minimum(self.low, prefixes.min(), out=self.low)
            return
        place = place[np.argsort(drawn[place], kind="stable")]
        key = drawn[place]
        first = np.empty(len(key), bool)
        first[0] = True
        np.not_equal(key[1:], key[:-1], out=first[1:])
        left = np.empty_like(place)
        left[1:] = place[:-1] + 1
        left[first] = 0
        least = range_minimum(prefixes, left, place)
        starts = np.flatnonzero(first)
        symbols = key[starts]
        least[starts] = np.minimum(least[starts], self.low[symbols])
        common = np.minimum(least.astype(np.int16) + 1, self.cap).astype(np.uint8)
        common[starts[~self.begun[symbols]]] = 0
        ends = np.append(starts[1:], len(key))
        rest = np.minimum.accumulate(prefixes[::-1])[::-1]
        after = place[ends - 1] + 1
        np.minimum(self.low, rest[0], out=self.low)
        self.low[symbols] = np.where(after < len(rest), rest[np.minimum(after, len(rest) - 1)], 255)
        self.begun[symbols] = True
        induced = before[place]
        for s, a, b in zip(symbols.tolist(), starts.tolist(), ends.tolist(), strict=True):
            self.queue.push(s, induced[a:b], common[a:b])


def star_suffixes(text: np.ndarray, n: int, chunk: int = BATCH) -> Iterator[np.ndarray]:
    """Starts of the left-most S-type suffixes, a stretch of the text at a time, the last stretch first; the last symbol is one."""
    rises, end = True, n
    while end:  # from the right, as a symbol's type depends on the next
        begin = max(0, end - chunk)
        part = np.asarray(text[begin : end + 1])
        if end == n:
            part = np.append(part[: end - begin], PAD)  # the end counts as S-type
        up, level = part[:-1] < part[1:], part[:-1] == part[1:]
        at = np.where(level, len(up), np.arange(len(up)))
        at = np.minimum.accumulate(at[::-1])[::-1]
        kind = np.append(up, rises)[at]
        before = text[begin - 1] if begin else 0
        falls = np.empty(len(kind), bool)
        falls[1:] = ~kind[:-1]
        falls[0] = begin > 0 and (before > part[0] or (before == part[0] and not kind[0]))
        yield np.flatnonzero(kind & falls) + begin
        rises, end = bool(kind[0]), begin


def _in_order(words: np.ndarray, starts: np.ndarray, at: int, cap: int) -> np.ndarray:
    """Suffixes that agree in their first `at` symbols, by the next ones up to `cap`, eight at a time; only ties go on."""
    starts = starts[np.argsort(words[starts + at])]
    tied = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    while len(tied):
        key = words[starts[tied] + at]
        order = np.lexsort((key, group))
        starts[tied], key = starts[tied[order]], key[order]
        new = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))
        more = ~new | np.append(~new[1:], False)
        tied, group = tied[more], np.cumsum(new)[more]
        at += 8
        if at >= cap:
            break
    return starts


class StarSort:
    """Sorts star suffixes by their first `cap` symbols in files: by distribution until a part fits the budget.

    A part is dealt by the next eight symbols into ranges between sampled ones and into the sampled ones
    themselves; what equals a sampled one goes on with the eight symbols after, so parts always shrink.
    """

    def __init__(self, words: np.ndarray, folder: str, kind: np.dtype, cap: int, budget: int) -> None:
        self.words, self.folder, self.kind, self.cap, self.budget = words, folder, np.dtype(kind), cap, budget
        self.parts, self.most = 0, 0  # files so far; suffixes in memory at once so far

    def new_file(self) -> str:
        self.parts += 1
        return os.path.join(self.folder, f"stars-{self.parts}")

    def _stretches(self, path: str, count: int) -> Iterator[np.ndarray]:
        for begin in range(0, count, BATCH):
            yield np.fromfile(path, self.kind, min(BATCH, count - begin), offset=begin * self.kind.itemsize)

    def sort(self, path: str, count: int, at: int = 0) -> Iterator[np.ndarray]:
        if at >= self.cap:
            yield from self._stretches(path, count)
        elif count <= self.budget:
            self.most = max(self.most, count)
            yield _in_order(self.words, np.fromfile(path, self.kind), at, self.cap)
        else:
            yield from self._distribute(path, count, at)
        if os.path.exists(path):
            os.remove(path)

    def _distribute(self, path: str, count: int, at: int) -> Iterator[np.ndarray]:
        some = np.memmap(path, self.kind, "r")[:: max(1, count // 4096)]
        sample = np.sort(self.words[some + at])
        ranges = min(128, 2 * count // self.budget + 1)
        cuts = np.unique(sample[:: max(1, len(sample) // ranges)])
        paths, sizes = [self.new_file() for _ in range(2 * len(cuts) + 1)], [0] * (2 * len(cuts) + 1)
        for starts in self._stretches(path, count):
            key = self.words[starts + at]
            below = np.searchsorted(cuts, key)
            part = 2 * below + (cuts[np.minimum(below, len(cuts) - 1)] == key)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(len(paths) + 1)).tolist()
            for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                if a < b:
                    with open(paths[p], "ab") as file:
                        starts[order[a:b]].tofile(file)
                    sizes[p] += b - a
        os.remove(path)
        for p, size in enumerate(sizes):
            if size:
                yield from self.sort(paths[p], size, at + 8 * (p % 2))


def common_prefixes(words: np.ndarray, suffixes: np.ndarray, before: int, cap: int) -> np.ndarray:
    """Prefix that each suffix shares with the one before, up to cap; before: the one ahead of the first, or -1 for a prefix of 0."""
    out = np.zeros(len(suffixes), np.uint8)
    words = words.view("<u8")  # the first symbol lowest
    last = len(words) - 1
    ahead = np.append(before, suffixes[:-1])
    for begin in range(before < 0, len(suffixes), _NEAR):  # few enough that what they read stays near
        active = np.arange(begin, min(begin + _NEAR, len(suffixes)))
        a, b = suffixes[active], ahead[active]
        for at in range(0, cap, 8):
            differ = words[np.minimum(a + at, last)] ^ words[np.minimum(b + at, last)]
            over = differ != 0
            ended, differ = active[over], differ[over]
            lead = np.zeros(len(ended), np.int64)
            for k in range(1, 8):
                lead += (differ << np.uint64(8 * (8 - k))) == 0
            out[ended] = np.minimum(at + lead, cap)
            active, a, b = active[~over], a[~over], b[~over]
            if not len(active):
                break
        out[active] = cap
    return out


def _run(text: np.ndarray, at: int, cap: int) -> int:
    part = np.asarray(text[at : at + cap])
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def sorted_suffixes(path: str, n: int, cap: int, folder: str, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stretches of (suffixes, prefixes) in descending order; a prefix is the one common with the suffix before, up to cap.

    path: n symbols, the last 0, then at least cap + 16 times PAD. cap is below 255. The suffix that is
    the last symbol alone is left out.
    """
    if n < 2:
        return
    text = np.memmap(path, np.uint8, "r")
    words = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))
    kind = np.int32 if n < 2**31 - 1 else np.int64
    sort = StarSort(words, folder, kind, cap, min(budget, STARS))
    unsorted, count = sort.new_file(), 0
    with open(unsorted, "wb") as file:
        for part in star_suffixes(text, n):
            part.astype(kind).tofile(file)
            count += len(part)
    star_file, prefix_file = os.path.join(folder, "stars"), os.path.join(folder, "star-prefixes")
    before, edges = -1, np.zeros(257, np.int64)  # edges: how many stars begin with a smaller symbol
    with open(star_file, "wb") as starts, open(prefix_file, "wb") as shared:
        for part in sort.sort(unsorted, count):
            for begin in range(0, len(part), BATCH):
                some = part[begin : begin + BATCH]
                common_prefixes(words, some, before, cap).tofile(shared)
                some.tofile(starts)
                edges[1:] += np.bincount(text[some], minlength=256)
                before = int(some[-1])
    edges = np.cumsum(edges)
    stars, prefixes = np.memmap(star_file, kind, "r"), np.memmap(prefix_file, np.uint8, "r")
    queue, kept = TupleQueue(folder, "l", kind, budget), TupleQueue(folder, "k", kind, budget)
    sweep = Sweep(text, queue, cap, down=False)
    for symbol in range(256):
        last = None
        while (batch := queue.pop(symbol)) is not None:
            sweep.scan(symbol, *batch, same=True)
            kept.push(symbol, *batch)
            last = batch[0][-1]
        for begin in range(edges[symbol], edges[symbol + 1], BATCH):
            part = slice(begin, min(begin + BATCH, edges[symbol + 1]))
            own = np.array(prefixes[part])
            if begin == edges[symbol]:
                own[0] = 0 if last is None else min(_run(text, int(last), cap), _run(text, int(stars[begin]), cap))
            sweep.scan(symbol, np.array(stars[part]), own, same=False)
    queue = TupleQueue(folder, "s", kind, budget)
    sweep = Sweep(text, queue, cap, down=True)
    for symbol in range(255, -1, -1):
        last = None
        while (batch := queue.pop(symbol)) is not None:
            sweep.scan(symbol, *batch, same=True)
            yield batch
            last = batch[0][-1]
        carried = None
        for suffixes, own in kept.backwards(symbol):
            turned = np.empty(len(own), np.uint8)
            turned[1:] = own[:0:-1]
            if carried is not None:
                turned[0] = carried
            else:
                turned[0] = 0 if last is None else min(_run(text, int(last), cap), _run(text, int(suffixes[-1]), cap))
            carried = own[0]
            sweep.scan(symbol, suffixes[::-1], turned, same=False)
            yield suffixes[::-1], turned
