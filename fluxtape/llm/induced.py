"""External induced suffix sorting with common-prefix values.

A suffix is L-type if it is larger than the next one and S-type otherwise; S*
suffixes are S-type ones that follow an L-type.  The S*-substrings are named, the
string of names is sorted by the same procedure, and all other suffixes are induced:
L-type ones from left to right, S-type ones from right to left.

Both inductions take suffixes from a priority queue in order of first symbol and
insert their predecessors.  The queue is a sequence heap: every insertion is a sorted
run of (position, common prefix) tuples, runs of one size are merged into longer ones,
and past a memory budget they lie on disk.  Keys only ever grow (or only shrink) while
the queue is drained, so a symbol's tuples are the slices of all runs, oldest first.
A bucket is drained in blocks, and a predecessor's common prefix is one more than the
least value in the stream since the last predecessor with the same first symbol,
carried from block to block.

Where the alphabet is large, as in strings of names, buckets are small; then as many
neighbouring buckets as do not induce into each other are drained in one step.
S*-substrings are named in groups of equal first symbols.

The text, its types, names and orders are arrays that are mapped from disk past the
budget, so what a sort holds in memory is the budget, some blocks, ``base`` names and
the largest group of S*-substrings that start with the same two symbols.  Working
files are unlinked as they are opened: they are the working memory of one task, hold
nothing that another task reads, and vanish with it.
"""

from __future__ import annotations

import bisect
import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Runs of one level that are merged into one of the next.
FAN = 8
#: Entries that are first tried as one step of several buckets, and the fewest.
STEP, LEAST = 4096, 64


class Segment:
    """A working file of entries, which goes when no piece lies in it any more."""

    def __init__(self):
        self.file, self.end = tempfile.TemporaryFile(buffering=0), 0

    def write(self, entries: np.ndarray) -> int:
        data, at = memoryview(np.ascontiguousarray(entries)).cast("B"), self.end
        while len(data):
            n = os.pwrite(self.file.fileno(), data, self.end)
            data, self.end = data[n:], self.end + n
        return at

    def read(self, at: int, count: int, kind: np.dtype) -> np.ndarray:
        data = bytearray()
        while len(data) < count * kind.itemsize:
            data += os.pread(self.file.fileno(), count * kind.itemsize - len(data), at + len(data))
        return np.frombuffer(data, kind)


class Disk:
    """The working memory of one sort: a budget of queue entries, and files for what is beyond it."""

    def __init__(self, memory: int, n: int):
        self.memory, self.left, self.spilled = memory, memory, 0
        self.place = np.dtype("<i4" if n < 1 << 31 else "<i8")
        self.entry = np.dtype([("pos", self.place), ("lcp", "<i4")])  # a suffix, and its common prefix with the one before it
        self.segment = None

    def array(self, count: int, dtype) -> np.ndarray:
        """An array of undefined values, mapped from disk if it is longer than the budget."""
        if count <= self.memory:
            return np.empty(count, dtype)
        with tempfile.TemporaryFile() as f:
            f.truncate(count * np.dtype(dtype).itemsize)
            return np.memmap(f, dtype, "r+", shape=(count,))

    def write(self, entries: np.ndarray) -> tuple[Segment, int]:
        if self.segment is None or self.segment.end > self.memory * self.entry.itemsize:
            self.segment = Segment()
        self.spilled += len(entries)
        return self.segment, self.segment.write(entries)


class Piece:
    """Entries that stay in memory while the budget lasts."""

    __slots__ = ("disk", "data", "segment", "at")

    def __init__(self, disk: Disk, entries: np.ndarray):
        self.disk, self.data, self.segment, self.at = disk, None, None, 0
        if len(entries) <= disk.left:
            disk.left -= len(entries)
            self.data = entries
        else:
            self.segment, self.at = disk.write(entries)

    def __del__(self):
        if self.data is not None:
            self.disk.left += len(self.data)

    def read(self, lo: int, hi: int) -> np.ndarray:
        if self.data is not None:
            return self.data[lo:hi]
        kind = self.disk.entry
        return self.segment.read(self.at + lo * kind.itemsize, hi - lo, kind)


class Sequence:
    """Entries in order of insertion, as parts of pieces."""

    def __init__(self, disk: Disk):
        self.disk, self.parts, self.ends, self.count = disk, [], [], 0

    def _add(self, piece: Piece, lo: int, hi: int) -> None:
        self.parts.append((piece, lo, hi))
        self.count += hi - lo
        self.ends.append(self.count)

    def put(self, entries: np.ndarray) -> None:
        if len(entries):
            self._add(Piece(self.disk, entries), 0, len(entries))

    def append(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        entries = np.empty(len(pos), self.disk.entry)
        entries["pos"], entries["lcp"] = pos, lcp
        self.put(entries)

    def extend(self, other: Sequence, lo: int, hi: int) -> None:
        """Take over a range of another sequence's entries, without copying them."""
        k = bisect.bisect_right(other.ends, lo)
        while lo < hi:
            piece, a, b = other.parts[k]
            begin = other.ends[k] - (b - a)
            upto = min(hi, other.ends[k])
            self._add(piece, a + lo - begin, a + upto - begin)
            lo, k = upto, k + 1

    def forget(self, lo: int, hi: int) -> None:
        """Let go of what lies outside of a range."""
        for k in [*range(bisect.bisect_right(self.ends, lo)), *range(bisect.bisect_left(self.ends, hi) + 1, len(self.parts))]:
            self.parts[k] = None

    def _ranges(self, size: int, back: bool) -> Iterator[list[tuple[Piece, int, int]]]:
        held, have = [], 0
        for piece, lo, hi in reversed(self.parts) if back else self.parts:
            while lo < hi:
                take = min(size - have, hi - lo)
                held.append((piece, hi - take, hi) if back else (piece, lo, lo + take))
                lo, hi = (lo, hi - take) if back else (lo + take, hi)
                have += take
                if have == size:
                    yield held
                    held, have = [], 0
        if held:
            yield held

    def blocks(self, size: int) -> Iterator[np.ndarray]:
        for held in self._ranges(size, False):
            yield held[0][0].read(*held[0][1:]) if len(held) == 1 else np.concatenate([p.read(a, b) for p, a, b in held])

    def blocks_back(self, size: int) -> Iterator[np.ndarray]:
        for held in self._ranges(size, True):
            yield held[0][0].read(*held[0][1:]) if len(held) == 1 else np.concatenate([p.read(a, b) for p, a, b in reversed(held)])


class Run:
    """Sorted entries: those of ``symbols[i]`` are at ``ends[i]`` to ``ends[i + 1]``."""

    def __init__(self, level: int, symbols: np.ndarray, ends: np.ndarray, entries: Sequence):
        self.level, self.symbols, self.ends, self.entries = level, symbols, ends, entries

    def of(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Beginning and number of the entries of each symbol."""
        at = np.searchsorted(self.symbols, symbols)
        near = np.minimum(at, len(self.symbols) - 1)
        here = self.symbols[near] == symbols
        return np.where(here, self.ends[near], 0), np.where(here, self.ends[near + 1] - self.ends[near], 0)


class Heap:
    """The priority queue of one induction, a sequence heap."""

    def __init__(self, disk: Disk, sigma: int, block: int):
        self.disk, self.block, self.runs, self.passed = disk, block, [], 0
        self.counts = np.zeros(sigma, np.int64)

    def push(self, symbols: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Insert entries that are sorted by symbol, in order within each."""
        cuts = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        own, ends = symbols[cuts], np.r_[cuts, len(symbols)]
        self.counts[own] += np.diff(ends)
        entries = Sequence(self.disk)
        entries.append(pos, lcp)
        self.runs.append(Run(0, own, ends, entries))
        while len(self.runs) >= FAN and self.runs[-FAN].level == self.runs[-1].level:
            last, self.runs = self.runs[-FAN:], self.runs[:-FAN]
            self.runs.append(self._merged(last))

    def _merged(self, runs: list[Run]) -> Run:
        symbols = np.unique(np.concatenate([r.symbols for r in runs]))
        symbols = symbols[self.counts[symbols] > 0]  # those that were taken are done with
        lo, n = (np.array(x) for x in zip(*(r.of(symbols) for r in runs)))
        total = n.sum(axis=0)
        out, at = Sequence(self.disk), 0
        while at < len(symbols):
            to = at + 1
            size = total[at]
            while to < len(symbols) and size + total[to] <= self.block:
                size += total[to]
                to += 1
            if to == at + 1:
                for run, a, k in zip(runs, lo[:, at], n[:, at]):
                    out.extend(run.entries, int(a), int(a + k))
            else:
                here = Sequence(self.disk)
                for run, a, k in zip(runs, lo[:, at:to], n[:, at:to]):
                    if k.any():
                        begin = int(a[k > 0][0])
                        here.extend(run.entries, begin, begin + int(k.sum()))
                keys = np.concatenate([np.repeat(symbols[at:to], k) for k in n[:, at:to]])
                entries = np.concatenate(list(here.blocks(self.block)))
                out.put(entries[np.argsort(keys, kind="stable")])
            at = to
        return Run(runs[0].level + 1, symbols, np.r_[0, np.cumsum(total)], out)

    def look(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and entries of a range of symbols, by symbol and in order of insertion within one."""
        keys, parts = [], []
        for run in self.runs:
            i, j = np.searchsorted(run.symbols, (low, high + 1)).tolist()
            if i < j:
                own = Sequence(self.disk)
                own.extend(run.entries, int(run.ends[i]), int(run.ends[j]))
                parts += own.blocks(own.count)
                keys.append(np.repeat(run.symbols[i:j], np.diff(run.ends[i : j + 1])))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, self.disk.entry)
        keys, entries = np.concatenate(keys), np.concatenate(parts)
        order = np.argsort(keys, kind="stable")
        return keys[order], entries[order]

    def done(self, low: int, high: int) -> None:
        """Forget the entries of a range of symbols; none may be inserted into it afterwards."""
        self.counts[low : high + 1] = 0
        self.passed += 1
        if self.passed % FAN == 0:
            self.runs = [r for r in self.runs if r.symbols[-1] > high or r.symbols[0] < low]
            for r in self.runs:
                left = self.counts[r.symbols] > 0
                if left[0] != left[-1]:
                    at = int(left.argmax()) if left[-1] else int(left.argmin())
                    r.entries.forget(*((int(r.ends[at]), r.entries.count) if left[-1] else (0, int(r.ends[at]))))
            self.runs = [r for r in self.runs if self.counts[r.symbols[0]] or self.counts[r.symbols[-1]]]

    def pop(self, symbol: int) -> Sequence:
        """All entries of a symbol in order of insertion; none may be inserted afterwards."""
        out = Sequence(self.disk)
        for run in self.runs:
            begin, n = run.of(np.array([symbol]))
            if n[0]:
                out.extend(run.entries, int(begin[0]), int(begin[0] + n[0]))
        self.done(symbol, symbol)
        return out


def _types(disk: Disk, text: np.ndarray, limit: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is S-type, and the length (up to the limit) of the run of one symbol it starts with."""
    n = len(text)
    small, run = disk.array(n, bool), disk.array(n, np.int16 if limit < 1 << 15 else np.int32)
    small[n - 1], run[n - 1] = True, 1
    hi = n - 1
    while hi > 0:
        lo = max(hi - block, 0)
        part = np.asarray(text[lo : hi + 1])
        k = len(part) - 1
        ends = np.flatnonzero(part[:-1] != part[1:])
        sizes = np.diff(np.r_[-1, ends])
        c = int(ends[-1]) + 1 if len(ends) else 0
        s, r = np.full(k, bool(small[hi])), np.empty(k, np.int64)
        s[:c] = np.repeat(part[ends] < part[ends + 1], sizes)
        r[:c] = np.repeat(ends, sizes) - np.arange(c) + 1
        r[c:] = int(run[hi]) + k - np.arange(c, k)
        small[lo:hi], run[lo:hi] = s, np.minimum(r, limit)
        hi = lo
    return small, run


def _refine(rank: np.ndarray, sel: np.ndarray, key: np.ndarray) -> None:
    """Split the groups of equal rank among ``sel`` by ``key``; a rank is its group's first place."""
    own = rank[sel]
    order = np.argsort(key) if (own == own[0]).all() else np.lexsort((key, own))
    who, old, val = sel[order], rank[sel][order], key[order]
    fresh = np.r_[True, old[1:] != old[:-1]]
    first = np.flatnonzero(fresh)
    inner = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
    split = fresh | np.r_[True, val[1:] != val[:-1]]
    lead = np.maximum.accumulate(np.where(split, np.arange(len(who)), 0))
    rank[who] = old + inner[lead]


def _crowded(rank: np.ndarray) -> np.ndarray:
    """For each element, whether another has its rank."""
    return np.bincount(rank, minlength=len(rank))[rank] > 1


def _name(text: np.ndarray, small: np.ndarray, stars: np.ndarray, size: np.ndarray, sigma: int) -> np.ndarray:
    """Rank of each S*-substring of ``size`` symbols, compared with their types (L before S)."""
    bits = max(1, (2 * sigma + 1).bit_length())
    per = 63 // bits
    rank = np.zeros(len(stars), np.int64)
    at = 0
    sel = np.arange(len(stars))
    while len(sel):
        word = np.zeros(len(sel), np.int64)
        for k in range(at, at + per):
            here = np.minimum(stars[sel] + k, len(text) - 1)
            code = text[here].astype(np.int64) * 2 + small[here] + 1
            word = (word << bits) | np.where(k < size[sel], code, 0)
        _refine(rank, sel, word)
        at += per
        going = _crowded(rank) & (size > at)
        # an ended substring stays apart from longer ones: its type at the end differs
        sel = np.flatnonzero(going)
    return rank


def _named(disk: Disk, text: np.ndarray, small: np.ndarray, stars: np.ndarray, sigma: int, block: int) -> tuple[np.ndarray, bool]:
    """Rank of each S*-substring, in groups of equal first symbols; and whether all differ."""
    m = len(stars)
    two = sigma <= 512
    spots = range(0, m, block)

    def keys(lo: int) -> np.ndarray:
        s = stars[lo : min(lo + block, m)]
        first = text[s].astype(np.int64)
        return first * sigma + text[np.minimum(s + 1, len(text) - 1)] if two else first

    counts = np.zeros(sigma * sigma if two else sigma, np.int64)
    for lo in spots:
        counts += np.bincount(keys(lo), minlength=len(counts))
    names, distinct, done, key = disk.array(m, disk.place), True, 0, 0
    before = np.r_[0, np.cumsum(counts)]
    while done < m:
        upto = max(int(np.searchsorted(before, done + block, side="right")) - 1, key + 1)
        while before[upto] == done:
            upto += 1
        if before[upto] - done == m:
            sel = np.arange(m)
        else:
            sel = np.concatenate([lo + np.flatnonzero(((k := keys(lo)) >= key) & (k < upto)) for lo in spots])
        after = np.minimum(sel + 1, m - 1)
        own = np.asarray(stars[sel], np.int64)
        rank = _name(text, small, own, np.where(sel + 1 < m, stars[after] - own + 1, 1), sigma)
        distinct &= not _crowded(rank).any()
        names[sel] = rank + done
        done, key = int(before[upto]), upto
    return names, distinct


def _doubling(names: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a short string by doubling ranks, and common prefixes from them."""
    m = len(names)
    order = np.argsort(names)
    ranks = []
    rank = np.zeros(m, np.int64)
    rank[order] = np.cumsum(np.r_[0, names[order][1:] != names[order][:-1]])
    ranks.append(rank.astype(np.int32))
    step = 1
    while rank.max() < m - 1 and step < limit:
        after = np.zeros(m, np.int64)
        after[: m - step] = rank[step:] + 1
        key = rank * (m + 1) + after
        order = np.argsort(key)
        rank = np.zeros(m, np.int64)
        rank[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
        ranks.append(rank.astype(np.int32))
        step *= 2
    a, b = order[:-1], order[1:]
    common = np.zeros(m - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < m) & (y < m)
        same = np.zeros(m - 1, bool)
        same[inside] = ranks[k][x[inside]] == ranks[k][y[inside]]
        common[same] += 1 << k
    return order, np.r_[0, common]


def _extend(text: np.ndarray, a: np.ndarray, b: np.ndarray, common: np.ndarray, limit: int) -> np.ndarray:
    """Common prefixes of the suffixes a and b that agree in ``common`` symbols at least."""
    out = np.minimum(common, limit)
    live = np.flatnonzero(out < limit)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        inside = (x < len(text)) & (y < len(text))
        same = np.zeros(len(live), bool)
        same[inside] = text[x[inside]] == text[y[inside]]
        live = live[same]
        out[live] += 1
        live = live[out[live] < limit]
    return out


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo..hi]) of each pair, lo <= hi, by doubling windows."""
    out = np.empty(len(lo), values.dtype)
    level = np.zeros(len(lo), np.int64)
    size = hi - lo + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    table = values
    for k in range(int(level.max()) + 1 if len(level) else 0):
        mine = np.flatnonzero(level == k)
        if len(mine):
            out[mine] = np.minimum(table[lo[mine]], table[hi[mine] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
    return out


def _stars(disk: Disk, text: np.ndarray, small: np.ndarray, sigma: int, limit: int, memory: int, base: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """S* suffixes in order, and their common prefixes."""
    spots = range(1, len(text), block)
    new = lambda lo: np.flatnonzero(small[lo : lo + block] & ~small[lo - 1 : min(lo + block, len(text)) - 1]) + lo
    m = sum(len(new(lo)) for lo in spots)
    stars, at = disk.array(m, disk.place), 0
    for lo in spots:
        found = new(lo)
        stars[at : at + len(found)] = found
        at += len(found)
    if m == 1:
        return stars, np.zeros(1, np.int32)
    names, distinct = _named(disk, text, small, stars, sigma, block)
    half = limit // 2 + 2  # S* suffixes are two symbols apart at least
    if distinct:
        order, shared = disk.array(m, disk.place), disk.array(m, np.int32)
        shared[:] = 0
        for lo in range(0, m, block):
            part = names[lo : lo + block]
            order[part] = np.arange(lo, lo + len(part))
    elif m <= base:
        order, shared = _doubling(np.asarray(names), half)
    else:  # the last S*-substring is the end mark, the smallest, so names end with their own end mark
        order, shared = disk.array(m, disk.place), disk.array(m + 1, np.int32)  # shared[i + 1] belongs to order[i] and order[i + 1]
        place = m

        def emit(pos: np.ndarray, lcp: np.ndarray) -> None:
            nonlocal place
            order[place - len(pos) : place] = pos[::-1]
            shared[place - len(pos) + 1 : place + 1] = lcp[::-1]
            place -= len(pos)

        sort_suffixes(names, half, memory, base, block, emit)
        shared[0] = 0
    del names
    found, common = disk.array(m, disk.place), disk.array(m, np.int32)
    for lo in range(0, m, block):
        hi = min(lo + block, m)
        found[lo:hi] = stars[order[lo:hi]]
        a = np.asarray(order[np.maximum(np.arange(lo, hi) - 1, 0)], np.int64)
        least = stars[np.minimum(a + shared[lo:hi], m - 1)] - stars[a]
        common[lo:hi] = _extend(text, np.asarray(stars[a], np.int64), np.asarray(found[lo:hi], np.int64), least.astype(np.int64), limit)
    common[0] = 0
    return found, common


def _insert(text: np.ndarray, heap: Heap, pos: np.ndarray, lcp: np.ndarray, use: np.ndarray, limit: int, since: np.ndarray | None = None) -> None:
    """Insert the predecessors of the entries at ``use`` of a stream; ``since`` goes with it from block to block."""
    passed = int(lcp.min())
    if len(use):
        before = text[pos[use] - 1]
        by = np.argsort(before, kind="stable")
        order, symbols = use[by], before[by]
        starts = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        lo = np.r_[0, order[:-1] + 1]
        lo[starts] = order[starts] if since is None else 0
        least = _range_min(lcp, lo, order)
        own = symbols[starts]
        # without an earlier predecessor in this stream, one in another starts with another symbol
        other = np.where(heap.counts[own] > 0, 0, -1)
        least[starts] = other if since is None else np.where(since[own] >= 0, np.minimum(since[own], least[starts]), other)
        heap.push(symbols, pos[order] - 1, np.minimum(least + 1, limit))
    if since is not None:
        np.minimum(since, passed, out=since, where=since >= 0)
        if len(use):
            last = order[np.r_[starts[1:], len(order)] - 1]
            tails = np.full(len(last), limit, np.int64)
            more = np.flatnonzero(last + 1 < len(lcp))
            if len(more):
                tails[more] = _range_min(lcp, last[more] + 1, np.full(len(more), len(lcp) - 1))
            since[own] = tails


def _own_runs(text: np.ndarray, start: Sequence, symbol: int, disk: Disk, block: int, limit: int) -> list[Sequence]:
    """The bucket's inserted entries, then those they induce into the bucket itself, run by run."""
    out, length = [start], 1
    while True:
        grown = Sequence(disk)
        least, any_yet = limit, False
        for part in out[-1].blocks(block):
            pos, lcp = part["pos"], part["lcp"]
            use = np.flatnonzero((pos > 0) & (text[np.maximum(pos - 1, 0)] == symbol))
            if not len(use):
                least = min(least, int(lcp.min()))
                continue
            low = _range_min(lcp, np.r_[0, use[:-1] + 1], use)
            low[0] = min(low[0], least) if any_yet else length - 1
            grown.append(pos[use] - 1, np.minimum(low + 1, limit))
            tail = lcp[use[-1] + 1 :]
            least, any_yet = int(tail.min()) if len(tail) else limit, True
        if not grown.count:
            return out
        out.append(grown)
        length += 1


class _Feed:
    """Gathers the stream of one bucket into blocks and inserts its predecessors beyond (``side`` 1) or below (-1) a symbol."""

    def __init__(self, sort: _Sort, heap: Heap, symbol: int, side: int, put=None):
        self.sort, self.heap, self.symbol, self.side, self.put = sort, heap, symbol, side, put
        self.held, self.count, self.since = [], 0, None

    def take(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        if self.count and self.count + len(pos) > self.sort.block:
            if self.since is None:
                self.since = np.full(self.sort.sigma, -1, np.int64)
            self.flush()
        self.held.append((pos, lcp))
        self.count += len(pos)

    def flush(self) -> None:
        if self.count:
            pos, lcp = (np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*self.held))
            before = np.where(pos > 0, self.sort.text[np.maximum(pos - 1, 0)], self.symbol)
            _insert(self.sort.text, self.heap, pos, lcp, np.flatnonzero(before > self.symbol if self.side > 0 else before < self.symbol), self.sort.limit, self.since)
            if self.put:
                self.put(pos, lcp)
            self.held, self.count = [], 0


class _Sort:
    """One sort: the text, its types, the sorted S* suffixes, and the L-type ones once they are induced."""

    def __init__(self, text: np.ndarray, limit: int, memory: int, base: int, block: int):
        self.text, self.limit, self.block = text, limit, block
        n, sigma = len(text), int(text.max()) + 1
        self.disk = Disk(memory, n)
        self.small, self.run = _types(self.disk, text, limit, block)
        self.stars, self.shared = _stars(self.disk, text, self.small, sigma, limit, memory, base, block)
        present, heads = np.zeros(sigma, bool), np.zeros(sigma, np.int64)
        for lo in range(0, n, block):
            present[text[lo : lo + block]] = True
        for lo in range(0, len(self.stars), block):
            heads += np.bincount(text[self.stars[lo : lo + block]], minlength=sigma)
        self.sigma, self.symbols = sigma, np.flatnonzero(present)
        self.cuts = np.r_[0, np.cumsum(heads)]  # of the S* suffixes by first symbol
        self.large = Sequence(self.disk)  # all L-type suffixes in order
        self.larges = np.zeros(sigma + 1, np.int64)  # their ends by first symbol, moved by one
        self.step = STEP

    def _reach(self, heap: Heap, sizes: np.ndarray, at: int, ahead: int) -> int:
        """How many symbols from ``at`` on, in steps of ``ahead``, make one step."""
        near = self.symbols[at : at + self.step] if ahead > 0 else self.symbols[max(at - self.step + 1, 0) : at + 1][::-1]
        have = np.cumsum(heap.counts[near] + sizes[near])
        return max(int(np.searchsorted(have, self.step, side="right")), 1)

    def _adapt(self, tried: int, done: int) -> None:
        self.step = min(self.step * 2, self.block) if done == tried else max(self.step // 2, LEAST) if 2 * done < tried else self.step

    def _joint(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of suffixes of different types that start with the same symbol."""
        return np.minimum(np.minimum(self.run[a], self.run[b]), self.limit)

    def up(self) -> None:
        """Induce the L-type suffixes."""
        heap, at = Heap(self.disk, self.sigma, self.block), 0
        sizes = np.diff(self.cuts)
        while at < len(self.symbols):
            n = self._reach(heap, sizes, at, 1)
            done = self._up_step(heap, at, n) if n > 1 else 0
            if n > 1:
                self._adapt(n, done)
            if not done:
                self._up_one(heap, int(self.symbols[at]))
                done = 1
            at += done

    def _up_step(self, heap: Heap, at: int, n: int) -> int:
        """Drain up to ``n`` buckets that do not induce into each other; their number, 0 if the first induces into itself."""
        text, chosen = self.text, self.symbols[at : at + n]
        low, high = int(chosen[0]), int(chosen[-1])
        keys, found = heap.look(low, high)
        a, b = int(self.cuts[low]), int(self.cuts[high + 1])
        stars = np.asarray(self.stars[a:b])
        heads = text[stars].astype(np.int64)
        order = np.argsort(np.r_[keys * 2, heads * 2 + 1], kind="stable")
        key, pos = np.r_[keys, heads][order], np.r_[found["pos"], stars][order]
        lcp = np.r_[found["lcp"], self.shared[a:b]].astype(np.int64)[order]
        star = order >= len(keys)
        before = np.where(pos > 0, text[np.maximum(pos - 1, 0)], -1)
        inner = before[(before >= key) & (before <= high)]
        if len(inner):
            n = int(np.searchsorted(chosen, inner.min()))
            if not n:
                return 0
            high = int(chosen[n - 1])
            key, pos, lcp, star, before = (x[: np.searchsorted(key, high, side="right")] for x in (key, pos, lcp, star, before))
        if len(key):
            fresh = np.r_[True, key[1:] != key[:-1]]
            lcp[fresh] = 0
            turn = np.flatnonzero(star & ~fresh & np.r_[False, ~star[:-1]])
            lcp[turn] = self._joint(pos[turn - 1], pos[turn])
            self.large.append(pos[~star], lcp[~star])
            self.larges[1:] += np.bincount(key[~star], minlength=self.sigma) if self.sigma < 4 * len(key) else 0
            if self.sigma >= 4 * len(key):
                np.add.at(self.larges, key[~star] + 1, 1)
            heap.done(low, high)
            _insert(text, heap, pos, lcp, np.flatnonzero(before >= key), self.limit)
        return n

    def _up_one(self, heap: Heap, c: int) -> None:
        """Drain one bucket of any size, also into itself."""
        last, feed = None, _Feed(self, heap, c, 1)
        if heap.counts[c]:
            for seq in _own_runs(self.text, heap.pop(c), c, self.disk, self.block, self.limit):
                self.large.extend(seq, 0, seq.count)
                self.larges[c + 1] += seq.count
                for part in seq.blocks(self.block):
                    lcp = part["lcp"].astype(np.int64)
                    if last is None:
                        lcp[0] = 0
                    feed.take(part["pos"], lcp)
                    last = part["pos"][-1]
        for at in range(int(self.cuts[c]), int(self.cuts[c + 1]), self.block):
            end = min(at + self.block, int(self.cuts[c + 1]))
            lcp = self.shared[at:end].astype(np.int64)
            if at == self.cuts[c]:
                lcp[0] = 0 if last is None else self._joint(last, self.stars[at])
            feed.take(np.asarray(self.stars[at:end]), lcp)
        feed.flush()

    def down(self, put) -> None:
        """Induce the S-type suffixes and put all, from the largest to the smallest."""
        heap, at = Heap(self.disk, self.sigma, self.block), len(self.symbols) - 1
        sizes, self.ends, self.step = self.larges[1:].copy(), np.cumsum(self.larges), STEP
        self.stars = self.shared = None
        while at > 0:
            n = min(self._reach(heap, sizes, at, -1), at)
            done = self._down_step(heap, at, n, put) if n > 1 else 0
            if n > 1:
                self._adapt(n, done)
            if not done:
                self._down_one(heap, int(self.symbols[at]), put)
                done = 1
            at -= done
            if self.large.count:
                self.large.forget(0, int(self.ends[self.symbols[at] + 1]))
        put(np.array([len(self.text) - 1]), np.zeros(1, np.int64))

    def _large_part(self, low: int, high: int) -> Sequence:
        out = Sequence(self.disk)
        out.extend(self.large, int(self.ends[low]), int(self.ends[high + 1]))
        return out

    def _down_step(self, heap: Heap, at: int, n: int, put) -> int:
        """As :meth:`_up_step`, downwards."""
        text, chosen = self.text, self.symbols[at - n + 1 : at + 1]
        low, high = int(chosen[0]), int(chosen[-1])
        keys, found = heap.look(low, high)
        part = self._large_part(low, high)
        large = np.concatenate(list(part.blocks(part.count))) if part.count else np.zeros(0, self.disk.entry)
        heads = text[large["pos"]][::-1].astype(np.int64)
        order = np.argsort(np.r_[-keys * 2, -heads * 2 + 1], kind="stable")
        key, pos = np.r_[keys, heads][order], np.r_[found["pos"], large["pos"][::-1]][order]
        # an entry's value belongs to its pair with the smaller neighbour: hand it on
        lcp = np.r_[found["lcp"], 0, large["lcp"][:0:-1]][: len(key)].astype(np.int64)[order]
        big = order >= len(keys)
        before = np.where(pos > 0, text[np.maximum(pos - 1, 0)], high + 1)
        fits = (before < key) | ((before == key) & ~big)
        inner = before[fits & (before >= low)]
        if len(inner):
            n = len(chosen) - int(np.searchsorted(chosen, inner.max(), side="right"))
            if not n:
                return 0
            low = int(chosen[-n])
            upto = int(np.searchsorted(-key, -low, side="right"))
            key, pos, lcp, big, fits = (x[:upto] for x in (key, pos, lcp, big, fits))
        if len(key):
            fresh = np.r_[True, key[1:] != key[:-1]]
            lcp[fresh] = 0
            turn = np.flatnonzero(big & ~fresh & np.r_[False, ~big[:-1]])
            lcp[turn] = self._joint(pos[turn - 1], pos[turn])
            heap.done(low, high)
            _insert(text, heap, pos, lcp, np.flatnonzero(fits), self.limit)
            put(pos, lcp)
        return n

    def _down_one(self, heap: Heap, c: int, put) -> None:
        last, held, feed = None, 0, _Feed(self, heap, c, -1, put)
        for seq in _own_runs(self.text, heap.pop(c), c, self.disk, self.block, self.limit) if heap.counts[c] else []:
            for part in seq.blocks(self.block):
                lcp = part["lcp"].astype(np.int64)
                if last is None:
                    lcp[0] = 0
                feed.take(part["pos"], lcp)
                last = part["pos"][-1]
        first = True
        for part in self._large_part(c, c).blocks_back(self.block):
            pos = part["pos"][::-1]
            lcp = np.r_[held, part["lcp"][:0:-1]].astype(np.int64)
            if first:
                lcp[0] = 0 if last is None else self._joint(last, pos[0])
            first, held = False, int(part["lcp"][0])
            feed.take(pos, lcp)
        feed.flush()


def sort_suffixes(text: np.ndarray, limit: int, memory: int = 1 << 20, base: int = 1 << 20, block: int = 1 << 18, emit=None):
    """Suffix order of ``text`` and each suffix's common prefix with the one before it.

    The last symbol is the only smallest one, and symbols are whole numbers from 0 that
    are not much larger than the text is long.  Common prefixes are cut at ``limit``,
    and suffixes that agree that far are in any order.  ``memory`` is the
    number of queue entries kept in memory and ``base`` the longest string of names that is
    sorted in memory; ``block`` entries are worked on at a time.  With ``emit``, the
    pairs go to ``emit(positions, common prefixes)`` from the largest suffix to the
    smallest, each with its common prefix with the next larger one, and are not kept.
    """
    order, common = [], []

    def keep(pos: np.ndarray, lcp: np.ndarray) -> None:
        order.append(pos.astype(np.int64))
        common.append(lcp.astype(np.int64))

    put = emit or keep
    if len(text) == 1:
        put(np.zeros(1, np.int64), np.zeros(1, np.int64))
    else:
        sort = _Sort(text, limit, memory, base, block)
        sort.up()
        sort.down(put)
    if emit:
        return None
    down, with_larger = np.concatenate(order), np.concatenate(common)
    return down[::-1], np.r_[0, with_larger[::-1][:-1]]


def repeated(text: np.ndarray, length: int, **options) -> np.ndarray:
    """Whether the ``length`` symbols from each position also start at another one.

    ``text`` ends with its only smallest symbol.
    """
    out = np.zeros(len(text), bool)
    seen = -1

    def emit(pos: np.ndarray, lcp: np.ndarray) -> None:
        nonlocal seen
        hit = lcp >= length
        out[pos[hit]] = True
        out[np.r_[seen, pos[:-1]][hit]] = True
        seen = int(pos[-1])

    sort_suffixes(text, length, emit=emit, **options)
    return out
