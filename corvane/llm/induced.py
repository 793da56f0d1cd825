"""External induced sorting of suffixes, with common-prefix values.

The suffixes that start a descent (S*) are sorted first: their substrings get names, and
where names repeat, the string of names is sorted, by recursion or, once it fits the memory
given, by rank doubling. All other suffixes are then induced in two scans. Each scan takes
suffix tuples (symbol, position, common prefix with its predecessor) from a priority queue,
smallest (then largest) symbol first, and puts the suffix one place to the left back in.
The common prefix of two induced suffixes is one more than the least value met between
their sources, so the values travel with the tuples and no suffix is compared again.

What grows with the text lies in files of the task's own scratch folder once it exceeds the
memory given: queues and sorted sequences as runs that are read in blocks; the text, its
suffix types, and names, places and order of S* suffixes as mapped arrays that are written
and read block by block, and from which the system takes pages back as it needs them. The
files belong to one attempt of one task and go when it ends.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np

#: Tuples up to which a scan goes one by one; for more, array operations are faster.
FEW = 64
#: Tuple columns: position and common prefix with the tuple before it in the same symbol.
TUPLE = np.dtype([("at", np.int64), ("lcp", np.int32)])


class Scratch:
    """Memory budget (in tuples) and the folder that what exceeds it goes to; counts what it did."""

    def __init__(self, tuples: int = 1 << 22):
        self.tuples, self.folder, self.done = tuples, None, Counter()

    def file(self):
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="induced-")
        return tempfile.TemporaryFile(dir=self.folder.name)

    def array(self, n: int, kind) -> np.ndarray:
        """Zeros; beyond the budget in a mapped file, which goes with the array."""
        if n <= self.tuples:
            return np.zeros(n, kind)
        self.done["mapped"] += 1
        with self.file() as file:
            return np.memmap(file, kind, "w+", shape=(n,))

    def blocks(self, n: int) -> Iterator[tuple[int, int]]:
        """Borders of blocks within the budget."""
        return ((at, min(n, at + self.tuples)) for at in range(0, n, self.tuples))

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()
            self.folder = None


def _stored(file, at: int, n: int) -> np.ndarray:
    """``n`` tuples of a file from the given one on."""
    return np.frombuffer(bytearray(os.pread(file.fileno(), n * TUPLE.itemsize, at * TUPLE.itemsize)), TUPLE)


class Spool:
    """A sequence of tuples, kept in memory up to the budget and beyond it in a file; read again by rows."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.held, self.waiting, self.rows, self.file = scratch, [], 0, 0, None

    def append(self, block: np.ndarray) -> None:
        self.held.append(block)
        self.waiting += len(block)
        self.rows += len(block)
        if self.waiting > self.scratch.tuples:
            self._spill()

    def _spill(self) -> None:
        self.scratch.done["spills"] += 1
        self.file = self.file or self.scratch.file()
        np.concatenate(self.held).tofile(self.file)
        self.file.flush()
        self.held, self.waiting = [], 0

    def finish(self) -> None:
        """To be called between the last row written and the first one read."""
        if self.file and self.held:
            self._spill()
        self.held = [np.concatenate(self.held)] if self.held else []

    def backwards(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """Blocks of the rows from start to stop, the last one first."""
        while stop > start:
            at = max(start, stop - self.scratch.tuples)
            yield _stored(self.file, at, stop - at) if self.file else self.held[0][at:stop]
            stop = at

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class TupleQueue:
    """Priority queue of tuples by symbol; tuples of one symbol leave in the order they came in, block by block.

    New tuples wait in memory by symbol. Over the budget, the buffer is written as a run
    sorted by symbol; a symbol's tuples are then the heads of the runs, oldest first.
    """

    def __init__(self, scratch: Scratch, descending: bool):
        self.scratch, self.sign = scratch, -1 if descending else 1
        self.buffer: dict[int, list] = {}  # arrays of tuples, and lists of single ones
        self.heap: list[int] = []
        self.rows, self.runs = 0, []

    def push(self, symbols: np.ndarray, tuples: np.ndarray) -> None:
        """``symbols`` sorted; tuples of one symbol in order."""
        edges = np.concatenate(([0], np.flatnonzero(symbols[1:] != symbols[:-1]) + 1, [len(symbols)])).tolist()
        for symbol, a, b in zip(symbols[edges[:-1]].tolist(), edges[:-1], edges[1:], strict=True):
            self._waiting(symbol).append(tuples[a:b])
        self.rows += len(symbols)
        if self.rows > self.scratch.tuples:
            self._spill()

    def push_one(self, symbol: int, at: int, lcp: int) -> None:
        own = self._waiting(symbol)
        if own and isinstance(own[-1], list):
            own[-1].append((at, lcp))
        else:
            own.append([(at, lcp)])
        self.rows += 1
        if self.rows > self.scratch.tuples:
            self._spill()

    def _waiting(self, symbol: int) -> list:
        own = self.buffer.get(symbol)
        if own is None:
            own = self.buffer[symbol] = []
            heapq.heappush(self.heap, self.sign * symbol)
        return own

    @staticmethod
    def _arrays(own: list) -> list[np.ndarray]:
        return [np.array(x, TUPLE) if isinstance(x, list) else x for x in own]

    def _spill(self) -> None:
        file, index, at = self.scratch.file(), [], 0
        held = []
        for key in sorted(self.heap):
            own = self._arrays(self.buffer[self.sign * key])
            n = sum(map(len, own))
            held += own
            index.append((key, at, n))
            at += n
        np.concatenate(held).tofile(file)
        file.flush()
        self.scratch.done["spills"] += 1
        self.runs.append([file, index, 0])
        self.buffer, self.heap, self.rows = {}, [], 0

    def smallest(self) -> int | None:
        """The next symbol, or None when the queue is empty."""
        keys = [index[k][0] for _, index, k in self.runs] + self.heap[:1]
        return self.sign * min(keys) if keys else None

    def pop(self, symbol: int) -> np.ndarray:
        """The first block of the tuples of ``symbol``, which is the next symbol."""
        key = self.sign * symbol
        for run in self.runs:
            file, index, k = run
            if index[k][0] == key:
                _, at, n = index[k]
                taken = min(n, self.scratch.tuples)
                found = _stored(file, at, taken)
                if taken < n:
                    index[k] = (key, at + taken, n - taken)
                elif k + 1 < len(index):
                    run[2] += 1
                else:
                    file.close()
                    self.runs.remove(run)
                return found
        heapq.heappop(self.heap)
        own = self._arrays(self.buffer.pop(symbol))
        self.rows -= sum(map(len, own))
        return np.concatenate(own) if len(own) > 1 else own[0]


class Inducer:
    """Puts the left neighbours of scanned suffixes into a queue, with their common prefixes."""

    def __init__(self, text: np.ndarray, kind: np.ndarray, wanted: bool, queue: TupleQueue, cap: int):
        self.text, self.kind, self.wanted, self.queue, self.cap = np.asarray(text), np.asarray(kind), wanted, queue, cap
        self.scanned = 0
        self.pushed: dict[int, int] = {}  # for each symbol: the number, in scan order, of the last source of a tuple
        # Numbers and values of the scanned tuples below all later ones: the least value from
        # any number on is the first such value there. There are at most ``cap`` + 1.
        self.numbers: list[int] = []
        self.values: list[int] = []

    def scan(self, tuples: np.ndarray) -> None:
        """``tuples`` in scan order; lcp is that with the suffix scanned just before."""
        n = len(tuples)
        if n <= FEW:
            self._scan_few(tuples)
            return
        lcp, left = tuples["lcp"], tuples["at"] - 1
        taken = np.flatnonzero((left >= 0) & (self.kind[np.maximum(left, 0)] == self.wanted))
        if len(taken):
            self._induce(lcp, left, taken)
        ahead = np.minimum.accumulate(lcp[::-1])[::-1]
        lower = np.append(np.flatnonzero(ahead[:-1] < ahead[1:]), n - 1)
        keep = len(self.values)
        least = int(ahead[0])
        while keep and self.values[keep - 1] >= least:
            keep -= 1
        self.numbers[keep:], self.values[keep:] = (lower + self.scanned).tolist(), ahead[lower].tolist()
        self.scanned += n

    def _scan_few(self, tuples: np.ndarray) -> None:
        numbers, values, pushed, text, kind, wanted = self.numbers, self.values, self.pushed, self.text, self.kind, self.wanted
        for at, value in tuples.tolist():
            while values and values[-1] >= value:
                values.pop()
                numbers.pop()
            numbers.append(self.scanned)
            values.append(value)
            if at and kind[at - 1] == wanted:
                symbol = int(text[at - 1])
                before = pushed.get(symbol)
                least = -1 if before is None else values[bisect_right(numbers, before)]
                pushed[symbol] = self.scanned
                self.queue.push_one(symbol, at - 1, min(least + 1, self.cap))
            self.scanned += 1

    def _induce(self, lcp: np.ndarray, left: np.ndarray, taken: np.ndarray) -> None:
        symbols = self.text[left[taken]]
        order = np.argsort(symbols, kind="stable")
        symbols, taken = symbols[order], taken[order]
        first = np.concatenate(([True], symbols[1:] != symbols[:-1]))
        # Least value of lcp over (previous source of the symbol, this one].
        value, table = np.empty(len(taken), np.int64), _RangeMinimum(lcp)
        same = np.flatnonzero(~first)
        if len(same):
            value[same] = table.least(taken[same - 1] + 1, taken[same] + 1)
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(taken)) - 1
        heads = table.least(np.zeros(len(starts), np.int64), taken[starts] + 1).tolist()
        pushed, numbers, values = self.pushed, self.numbers, self.values
        found = []
        for symbol, head, end in zip(symbols[starts].tolist(), heads, taken[ends].tolist(), strict=True):
            before = pushed.get(symbol)
            pushed[symbol] = self.scanned + end
            if before is None:
                found.append(-1)
                continue
            k = bisect_right(numbers, before)
            found.append(min(head, values[k]) if k < len(values) else head)
        value[starts] = found
        out = np.empty(len(taken), TUPLE)
        out["at"], out["lcp"] = left[taken], np.minimum(value + 1, self.cap)
        self.queue.push(symbols, out)


class _RangeMinimum:
    """Minima of ranges of an array, in blocks of doubling length."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]

    def least(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Minima over [start, end); no range is empty."""
        length = end - start
        level = np.zeros(len(length), np.int64)
        longest = int(length.max())
        while 1 << len(self.levels) <= longest:
            k = 1 << (len(self.levels) - 1)
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:-k], below[k:]))
        for k in range(1, longest.bit_length()):
            level += length >= 1 << k
        out = np.empty(len(length), np.int64)
        for k in np.unique(level).tolist():
            own = np.flatnonzero(level == k)
            values = self.levels[k]
            out[own] = np.minimum(values[start[own]], values[end[own] - (1 << k)])
        return out


def classify(text: np.ndarray, scratch: Scratch | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(is the suffix smaller than its right neighbour, that is of type S; length of the run of equal symbols from here)."""
    scratch, n = scratch or Scratch(), len(text)
    rising, runs = scratch.array(n, bool), scratch.array(n, np.int32)
    for a, b in reversed(list(scratch.blocks(n))):
        own = text[a:b]
        last = np.flatnonzero(np.append(own[1:] != own[:-1], True))  # ends of runs
        after, more = np.zeros(len(last), bool), 0
        after[:-1] = own[last[:-1] + 1] > own[last[:-1]]
        if b < n:  # else the sentinel behind the text, which is smallest
            goes_on = text[b] == own[-1]
            after[-1] = rising[b] if goes_on else text[b] > own[-1]
            more = int(runs[b]) if goes_on else 0
        sizes = np.diff(np.concatenate(([-1], last)))
        lengths = np.repeat(last, sizes) - np.arange(b - a) + 1
        lengths[b - a - sizes[-1] :] += more
        rising[a:b], runs[a:b] = np.repeat(after, sizes), lengths
    return rising, runs


def _star_places(rising: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Places of type S behind one that is not."""
    n = len(rising)
    found = lambda a, b: np.flatnonzero(rising[max(1, a) : b] & ~rising[max(1, a) - 1 : b - 1]) + max(1, a)
    out, at = scratch.array(sum(len(found(a, b)) for a, b in scratch.blocks(n)), np.int64), 0
    for a, b in scratch.blocks(n):
        own = found(a, b)
        out[at : at + len(own)] = own
        at += len(own)
    return out


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight symbols from each place as one number, most significant first (symbols of one byte); zeros behind the end."""
    out = np.zeros(len(at), np.uint64)
    near = at >= len(text) - 8
    inside = np.flatnonzero(~near)
    if len(inside):
        out[inside] = np.ndarray((len(text) - 7,), ">u8", text.data, 0, (1,))[at[inside]]
    tail = np.concatenate((text[max(0, len(text) - 8) :], np.zeros(16, np.uint8)))
    end = np.flatnonzero(near)
    if len(end):
        spot = np.minimum(at[end] - max(0, len(text) - 8), len(tail) - 8)
        out[end] = np.ndarray((len(tail) - 7,), ">u8", tail.data, 0, (1,))[spot]
    return out


def _ranges(text: np.ndarray, places: np.ndarray, scratch: Scratch) -> Iterator[np.ndarray]:
    """The numbers of all places, by ranges of their first symbols, each within the budget unless one first symbol has more."""
    n = len(places)
    top = int(text.max()) + 1 if n > scratch.tuples else 0
    if n <= scratch.tuples:
        yield np.arange(n)
        return
    counts = scratch.array(top, np.int64)
    for a, b in scratch.blocks(n):
        np.add.at(counts, text[places[a:b]], 1)
    border, held = 0, 0
    for symbol in np.flatnonzero(counts).tolist() + [top]:
        more = int(counts[symbol]) if symbol < top else 0
        if held and (symbol == top or held + more > scratch.tuples):
            own = [np.flatnonzero((heads >= border) & (heads < symbol)) + a for a, b in scratch.blocks(n) for heads in [text[places[a:b]]]]
            yield np.concatenate(own)
            border, held = symbol, 0
        held += more


def name_substrings(text: np.ndarray, places: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, bool]:
    """Names of the S* substrings, in the order of their contents (the number of those before); are they all different?

    A substring reaches to the first symbol of the next one. One that is another's prefix is
    the larger of the two. Work goes by first symbols, so that memory holds one range's keys.
    """
    n = len(places)
    per = 8 if text.dtype == np.uint8 else 1
    names, base, unique = scratch.array(n, np.int64), 0, True
    for own in _ranges(text, places, scratch):
        starts = places[own]
        follow = np.where(own + 1 < n, places[np.minimum(own + 1, n - 1)], len(text))
        lengths = np.maximum(1, follow - starts + (own + 1 < n))
        rank, going, t = np.zeros(len(own), np.int64), np.arange(len(own)), 0
        while len(going):
            at, left, closing = starts[going] + t * per, lengths[going] - t * per, own[going] == n - 1
            if per == 8:
                key = _words(text, at)
                short = np.clip(8 - left, 0, 7).astype(np.uint64) * np.uint64(8)
                beyond = (np.uint64(1) << short) - np.uint64(1)
                key = np.where(closing, key & ~beyond, key | beyond)
            else:
                key = text[at].astype(np.uint64)
            # The last substring ends with the sentinel, which is smaller than all that can follow.
            end = np.where(left > per, 1, np.where(closing, 0, 2))
            sort = np.lexsort((end, key, rank[going]))
            r, k, end = rank[going][sort], key[sort], end[sort]
            done = end != 1
            new = np.concatenate(([True], (r[1:] != r[:-1]) | (k[1:] != k[:-1]) | (end[1:] != end[:-1])))
            group_start = np.concatenate(([True], r[1:] != r[:-1]))
            first = np.flatnonzero(new)
            # A name is the number of substrings that sort before it.
            offset = np.flatnonzero(group_start)[np.cumsum(group_start) - 1]
            rank[going[sort]] = r + (first[np.cumsum(new) - 1] - offset)
            sizes = np.diff(np.append(first, len(going)))[np.cumsum(new) - 1]
            more = (sizes > 1) & ~done
            unique &= not bool(((sizes > 1) & done).any())
            going, t = np.sort(going[sort[more]]), t + 1
        names[own] = rank + base
        base += len(own)
    return names, unique


def double_ranks(names: np.ndarray, cap: int) -> np.ndarray:
    """The order of the suffixes of a string of names, by rank doubling in memory.

    Suffixes that agree in ``cap`` names are left as they stand: their common prefix counts
    as ``cap`` in any order.
    """
    n = len(names)
    order = np.argsort(names, kind="stable")
    sorted_names = names[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_names[1:] != sorted_names[:-1])))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    h = 1
    while h < cap:
        sizes = np.bincount(rank[:n], minlength=n)
        going = np.flatnonzero(sizes[rank[:n]] > 1)
        if not len(going):
            break
        second = rank[np.minimum(going + h, n)]
        sort = np.lexsort((second, rank[going]))
        r, s = rank[going][sort], second[sort]
        group = np.concatenate(([True], r[1:] != r[:-1]))
        new = group | np.concatenate(([True], s[1:] != s[:-1]))
        at = np.arange(len(going))
        offset = at[new][np.cumsum(new) - 1] - at[group][np.cumsum(group) - 1]
        fresh = rank.copy()
        fresh[going[sort]] = r + offset
        rank, h = fresh, 2 * h
    return np.argsort(rank[:n], kind="stable")


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int, known: np.ndarray | None = None) -> np.ndarray:
    """Common prefixes of pairs of suffixes, up to ``cap``; ``known``: what they are at least."""
    n = len(text)
    out = np.zeros(len(a), np.int64) if known is None else np.minimum(known, cap).astype(np.int64)
    going = np.arange(len(a))
    bytewise = text.dtype == np.uint8
    while len(going):
        x, y = a[going] + out[going], b[going] + out[going]
        inside = (x < n) & (y < n) & (out[going] < cap)
        going, x, y = going[inside], x[inside], y[inside]
        if not bytewise:
            same = text[x] == text[y]
            out[going] += same
            going = going[same]
            continue
        differ = _words(text, x) ^ _words(text, y)
        room = np.minimum(8, n - np.maximum(x, y))
        equal = np.full(len(going), 8, np.int64)
        odd = np.flatnonzero(differ)
        top = differ[odd]
        zeros = np.zeros(len(odd), np.int64)
        for shift in (32, 16, 8):
            high = (top >> np.uint64(64 - shift)) == 0
            zeros += np.where(high, shift // 8, 0)
            top = np.where(high, top << np.uint64(shift), top)
        equal[odd] = zeros
        equal = np.minimum(equal, room)
        out[going] += equal
        going = going[equal == 8]
    return np.minimum(out, cap)


def sorted_suffixes(text: np.ndarray, cap: int, scratch: Scratch | None = None, base: int = 1 << 22) -> Iterator[np.ndarray]:
    """Blocks of tuples of all suffixes of ``text``, largest first.

    lcp is the common prefix (up to ``cap``) with the suffix before it, that is the next larger
    one; 0 for the first. Suffixes that agree in ``cap`` symbols may come in any order. ``text``:
    bytes below 255, or integers. ``base``: the most names that are sorted in memory; longer
    strings of names are sorted by recursion.
    """
    scratch = scratch or Scratch()
    n = len(text)
    if not n:
        return
    rising, runs = classify(text, scratch)
    order, star_lcp = _sorted_stars(text, _star_places(rising, scratch), cap, scratch, base)

    # First scan, smallest symbol first: suffixes larger than their right neighbour (L).
    queue = TupleQueue(scratch, descending=False)
    inducer = Inducer(text, rising, False, queue, cap)
    end = np.zeros(1, TUPLE)
    end["at"] = n
    inducer.scan(end)
    at_star, falling, symbols = 0, Spool(scratch), []  # symbols: (symbol, its first row among those of type L)
    while True:
        symbol = queue.smallest()
        star = int(text[order[at_star]]) if at_star < len(order) else None
        if symbol is None and star is None:
            break
        symbol = min(x for x in (symbol, star) if x is not None)
        last = None
        while queue.smallest() == symbol:
            tuples = queue.pop(symbol)
            if last is None:
                symbols.append((symbol, falling.rows))
                tuples["lcp"][0] = 0
            inducer.scan(tuples)
            falling.append(tuples)
            last = int(tuples["at"][-1])
        if star != symbol:
            continue
        until = bisect_right(range(len(order)), symbol, at_star, key=lambda k: text[order[k]])
        for a in range(at_star, until, scratch.tuples):
            b = min(until, a + scratch.tuples)
            tuples = np.empty(b - a, TUPLE)
            tuples["at"], tuples["lcp"] = order[a:b], star_lcp[a:b]
            if a == at_star:
                tuples["lcp"][0] = 0 if last is None else min(cap, runs[last], runs[order[a]])
            inducer.scan(tuples)
        at_star = until
    falling.finish()

    # Second scan, largest symbol first: suffixes smaller than their right neighbour (S).
    queue = TupleQueue(scratch, descending=True)
    inducer = Inducer(text, rising, True, queue, cap)
    stop = falling.rows
    while True:
        symbol = queue.smallest()
        if symbol is None and not symbols:
            break
        symbol = max(x for x in (symbol, symbols[-1][0] if symbols else None) if x is not None)
        last = None
        while queue.smallest() == symbol:
            tuples = queue.pop(symbol)
            if last is None:
                tuples["lcp"][0] = 0
            inducer.scan(tuples)
            yield tuples
            last = int(tuples["at"][-1])
        if symbols and symbols[-1][0] == symbol:
            (_, start), carry = symbols.pop(), None
            for block in falling.backwards(start, stop):
                # Going down, a tuple's value belongs to the one that follows it.
                tuples = block[::-1].copy()
                tuples["lcp"][1:] = block["lcp"][:0:-1]
                if carry is None:
                    tuples["lcp"][0] = 0 if last is None else min(cap, runs[last], runs[tuples["at"][0]])
                else:
                    tuples["lcp"][0] = carry
                carry = int(block["lcp"][0])
                inducer.scan(tuples)
                yield tuples
            stop = start
    falling.close()


def _sorted_stars(text: np.ndarray, stars: np.ndarray, cap: int, scratch: Scratch, base: int) -> tuple[np.ndarray, np.ndarray]:
    """S* suffixes in order, and their common prefixes with the one before."""
    n = len(stars)
    if not n:
        return stars, np.zeros(0, np.int64)
    names, unique = name_substrings(text, stars, scratch)
    order, equal = scratch.array(n, np.int64), None
    if unique:
        for a, b in scratch.blocks(n):
            order[names[a:b]] = np.arange(a, b)
    elif n <= base:
        order = double_ranks(np.asarray(names), cap)
    else:
        scratch.done["recursions"] += 1
        equal, done = scratch.array(n + 1, np.int64), 0
        for block in sorted_suffixes(names, cap, scratch, base):  # largest first
            stop = done + len(block)
            order[n - stop : n - done] = block["at"][::-1]
            equal[n - stop + 1 : n - done + 1] = block["lcp"][::-1]  # with the next larger one, whose value it is
            done = stop
    del names
    places, lcp, before = scratch.array(n, np.int64), scratch.array(n, np.int64), None
    for a, b in scratch.blocks(n):
        own = stars[order[a:b]]
        places[a:b] = own
        known = None
        if equal is not None:
            # Equal names are equal substrings: that much of the common prefix is known.
            until = order[a:b] + (equal[a:b] if a else np.concatenate(([0], equal[1:b])))
            known = np.where(until < n, stars[np.minimum(until, n - 1)], len(text)) - own
        left = np.concatenate(([own[0] if before is None else before], own[:-1]))
        lcp[a:b] = common_prefixes(text, left, own, cap, known)
        before = own[-1]
    lcp[0] = 0
    return places, lcp
