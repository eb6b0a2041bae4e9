"""Suffix order by external induced sorting.

A suffix is of type S if it is smaller than its successor, else of type L; S* marks an S after an L. The order of the S*
suffixes, found by naming the stretches between them and sorting the names the same way (recursion), induces that of
the L suffixes, and that the order of all S suffixes. Each induction is a pass over a monotone priority queue:
an entry leaves in order of its first symbol and of its arrival, and puts its predecessor in at a place that is never before it.
As the number of entries of every symbol is known, the queue is laid out by symbol in one array, on disk where it is large; all
entries up to the first empty place leave at once, so a pass is a series of steps over whole arrays. With the suffixes
travel the lengths of their common prefixes: that of two entries put in one after the other is one more than the least
between the two they came from.
"""

from __future__ import annotations

import tempfile

import numpy as np

_UNKNOWN = 255
_MOST = 1 << 16


class Store:
    """Arrays of one sort: in memory up to a budget, beyond it in nameless files of the task's scratch folder.

    The files hold nothing that another task reads; a task that is run again makes its own.
    """

    def __init__(self, budget: int = 64 << 20, folder: str | None = None):
        self.budget, self.folder, self.on_disk = budget, folder, 0

    def array(self, n: int, kind, fill: int | None = None) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if size <= self.budget:
            self.budget -= size
            out = np.empty(n, dtype=kind)
        else:
            self.on_disk += size
            out = np.memmap(tempfile.TemporaryFile(dir=self.folder), dtype=kind, mode="w+", shape=(n,))
        if fill is not None:
            out[:] = fill
        return out

    def free(self, *arrays: np.ndarray) -> None:
        for a in arrays:
            if not isinstance(a, np.memmap):
                self.budget += a.nbytes


def _types(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """True for suffixes of type S (the last one, before the end of the text, is L); the equal symbols directly before each place."""
    n = len(x)
    ends = np.append(np.flatnonzero(x[:-1] != x[1:]), n - 1)
    size = np.diff(ends, prepend=-1)
    rising = np.append(x[ends[:-1]] < x[ends[:-1] + 1], False)
    back = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    back -= np.repeat((ends - size + 1).astype(back.dtype), size)
    return np.repeat(rising, size), back


class _Text:
    """Common prefixes, up to ``cap`` symbols of one byte, by direct comparison of words of eight bytes."""

    def __init__(self, x: np.ndarray, cap: int):
        self.n, self.cap = len(x), cap
        self.padded = np.concatenate([x, np.zeros(cap + 16, dtype=np.uint8)])
        self.words = np.ndarray((self.n + cap + 8,), dtype="<u8", buffer=self.padded, strides=(1,))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), self.cap, dtype=np.int64)
        left = np.arange(len(a))
        for at in range(0, self.cap, 8):
            apart = self.words[a[left] + at] ^ self.words[b[left] + at]
            differ = np.flatnonzero(apart)
            low = apart[differ] & (~apart[differ] + np.uint64(1))
            out[left[differ]] = at + (np.log2(low.astype(float)).astype(np.int64) >> 3)
            left = left[apart == 0]
            if not len(left):
                break
        return np.minimum(np.minimum(out, self.n - np.maximum(a, b)), self.cap).astype(np.uint8)


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low..high], ends included, for many ranges."""
    span = high - low + 1
    level = np.log2(span).astype(np.int64)
    out = np.empty(len(low), dtype=values.dtype)
    table, width = values, 1
    for k in range(int(level.max()) + 1):
        here = np.flatnonzero(level == k)
        if len(here):
            out[here] = np.minimum(table[low[here]], table[high[here] - width + 1])
        if len(table) <= width:
            break
        table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


def _chains(entries, back, common, sources, cap: int) -> tuple[np.ndarray, np.ndarray | None]:
    """What entries at the end of a run of one symbol put in before it ends at the front: all of the run, and common prefixes.

    Of every run its last but one suffix comes first, then of every run the one before, and so on.
    """
    length = back[entries[sources]]
    which = np.repeat(np.arange(len(sources)), length)
    step = np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length) + 1
    order = np.argsort(step, kind="stable")
    which, step = which[order], step[order]
    if common is None:
        return entries[sources][which] - step, None
    first = np.concatenate([[True], step[1:] != step[:-1]])
    low = np.concatenate([[0], sources[which[:-1]] + 1])
    high = sources[which]
    least = _least(common, np.where(first, high, low), high).astype(np.int64)
    return entries[sources][which] - step, np.minimum(np.where(first, step, least + step), cap).astype(np.uint8)


def _induce(x, kinds, back, kind: bool, queue: np.ndarray, head: np.ndarray, lcp: np.ndarray | None, text: _Text | None, fresh, since) -> None:
    """One pass over the queue; predecessors of type ``kind`` are put in at ``head`` of their symbol.

    ``back``: how many equal symbols are directly before each place. ``lcp``: common prefix of each entry with the one before it.
    ``fresh``: symbols without an entry put in so far; ``since``: least common prefix between entries that left after the last one
    that put something in there.
    """
    i, n, width = 0, len(queue), 1 << 12
    while i < n:
        window = queue[i : i + width]
        empty = np.flatnonzero(window < 0)
        k = int(empty[0]) if len(empty) else len(window)
        if not k:
            raise AssertionError("the queue has a gap")
        entries = np.array(window[:k], dtype=np.int64)
        before = entries - 1
        mine, other = x[entries], x[before]
        inner = (other == mine) & (entries > 0)
        chain = np.flatnonzero(inner & (kinds[entries] == kind))
        if len(chain):
            # Only the last one of a run puts in the run, and only once all such entries of the symbol are there.
            chain = chain[(entries[chain] == len(x) - 1) | (x[np.minimum(entries[chain] + 1, len(x) - 1)] != mine[chain])]
        if len(chain):
            symbol = mine[chain[-1]]
            if k == len(window) and i + k < n and mine[-1] == symbol:
                width *= 2
                continue
            if mine[0] != symbol:
                k = int(np.flatnonzero(mine == symbol)[0])
                entries, before, mine, other, inner, chain = entries[:k], before[:k], mine[:k], other[:k], inner[:k], chain[:0]
        common = None
        if lcp is not None:
            common = np.array(lcp[i : i + k])
            unknown = np.flatnonzero(common == _UNKNOWN)
            if len(unknown):
                last = np.array(queue[np.maximum(i + unknown - 1, 0)], dtype=np.int64)
                alike = (mine[unknown] == x[last]) & (i + unknown > 0)
                common[unknown] = np.where(alike, text.common(entries[unknown], last), 0)
                lcp[i + unknown] = common[unknown]
        source = np.flatnonzero((entries > 0) & (kinds[before] == kind) & ~inner)
        if len(source):
            symbol = other[source]
            order = np.argsort(symbol, kind="stable")
            symbol, source = symbol[order], source[order]
            first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
            each, size = symbol[first], np.diff(np.append(first, len(symbol)))
            place = np.arange(len(symbol)) + np.repeat(head[each] - first, size)
            queue[place] = before[source]
            head[each] += size
            if lcp is not None:
                low = np.concatenate([[0], source[:-1] + 1])
                low[first] = 0
                least = _least(common, low, source)
                least[first] = np.minimum(least[first], since[each])
                new = np.minimum(least.astype(np.int64) + 1, text.cap).astype(np.uint8)
                new[first[fresh[each]]] = 0
                lcp[place] = new
                fresh[each] = False
        if len(chain):
            symbol = mine[0]
            put, shared = _chains(entries, back, common, chain, text.cap if text else 0)
            queue[head[symbol] : head[symbol] + len(put)] = put
            if lcp is not None:
                lcp[head[symbol] : head[symbol] + len(put)] = shared
            head[symbol] += len(put)
        if lcp is not None:
            np.minimum(since, common.min(), out=since)
            if len(source):
                # After the last source of a symbol only what follows it counts.
                rest = np.append(np.minimum.accumulate(common[::-1])[::-1], np.uint8(_UNKNOWN))
                since[each] = rest[source[first + size - 1] + 1]
        i += k
        width = min(width * 2, _MOST) if k == len(window) else max(256, min(2 * k, _MOST))


def _both(x, kinds, back, counts, stars: np.ndarray, store: Store, text: _Text | None = None, star_lcp: np.ndarray | None = None):
    """All suffixes in order, from S* suffixes in order (or only grouped by symbol: then ordered up to the next S*)."""
    n_l, n_s, n_star = counts
    sigma, n = len(n_l), len(x)
    number = np.int32 if n < 1 << 31 else np.int64
    carry = text is not None
    # L: every symbol's L entries to come, then its S* entries.
    start = np.cumsum(n_l + n_star) - n_l - n_star
    queue = store.array(int(n_l.sum() + len(stars)), number, -1)
    lcp = store.array(len(queue), np.uint8, 0) if carry else None
    if len(stars):
        place = np.arange(len(stars)) + (start + n_l - (np.cumsum(n_star) - n_star))[x[stars]]
        queue[place] = stars
        if carry:
            mine = np.array(star_lcp)
            mine[np.concatenate([[True], x[stars[1:]] != x[stars[:-1]]])] = _UNKNOWN
            lcp[place] = mine
    head, fresh, since = start.copy(), np.ones(sigma, dtype=bool), np.full(sigma, _UNKNOWN, dtype=np.uint8)
    end = int(x[n - 1])
    queue[head[end]] = n - 1  # put in by the end of the text, which is before every suffix
    head[end] += 1
    fresh[end], since[end] = False, 0
    _induce(x, kinds, back, False, queue, head, lcp, text, fresh, since)
    # S, from the largest suffix down: every symbol's S entries to come, then its L entries.
    start = np.cumsum(n_l + n_s) - n_l - n_s
    order = store.array(n, number, -1)
    down = store.array(n, np.uint8, 0) if carry else None
    at = np.flatnonzero(~kinds[queue])
    longs = np.array(queue[at])
    symbol = x[longs]
    place = np.arange(len(longs)) + (start - (np.cumsum(n_l) - n_l))[symbol]
    order[place] = longs
    if carry:
        # Downwards an entry's common prefix is that with the next larger one.
        mine = np.append(lcp[at][1:], np.uint8(0))
        mine[np.append(symbol[1:] != symbol[:-1], True)] = _UNKNOWN
        down[n - 1 - place] = mine
        store.free(lcp)
    store.free(queue)
    head = n - (start + n_l + n_s)
    _induce(x, kinds, back, True, order[::-1], head, down, text, np.ones(sigma, dtype=bool), np.full(sigma, _UNKNOWN, dtype=np.uint8))
    return order, down


def _names(x: np.ndarray, stars: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, int]:
    """Name of every S* (in order of the text): equal stretches up to and with the next S* have one name."""
    n, m = len(x), len(stars)
    size = np.append(stars[1:] + 1, n + 1) - stars
    which = np.searchsorted(stars, found)
    long = size[which]
    same = long[1:] == long[:-1]
    same &= (which[1:] != m - 1) & (which[:-1] != m - 1)  # the last stretch ends with the text, so it is like no other
    left, at = np.flatnonzero(same), 0
    while len(left):
        equal = x[found[left] + at] == x[found[left + 1] + at]
        same[left[~equal]] = False
        at += 1
        left = left[equal & (long[left] > at)]
    names = np.empty(m, dtype=np.int64)
    names[which] = np.concatenate([[0], np.cumsum(~same)])
    return names, int(m - same.sum())


def suffix_order(x: np.ndarray, store: Store | None = None, cap: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    """The suffixes of ``x`` (whole numbers from 0) in order, each before its own extensions.

    With ``cap`` (below 255; symbols must be bytes) also every suffix's common prefix with the one before it, counted up to ``cap``.
    """
    store = store or Store()
    n = len(x)
    if n < 2:
        return np.arange(n), np.zeros(n, dtype=np.uint8) if cap else None
    kinds, back = _types(x)
    stars = np.flatnonzero(kinds[1:] & ~kinds[:-1]) + 1
    sigma = int(x.max()) + 1
    counts = tuple(np.bincount(x[c], minlength=sigma) for c in (~kinds, kinds, stars))
    if len(stars) > 1:
        rough = stars[np.argsort(x[stars], kind="stable")]
        order, _ = _both(x, kinds, back, counts, rough, store)
        is_star = np.zeros(n, dtype=bool)
        is_star[stars] = True
        found = np.array(order[is_star[order]], dtype=np.int64)
        store.free(order)
        names, different = _names(x, stars, found)
        if different < len(stars):
            found = stars[suffix_order(names, store)[0]]
    else:
        found = stars
    if not cap:
        return _both(x, kinds, back, counts, found, store)
    text = _Text(x, cap)
    # The S* suffixes, a third of all or fewer, are compared directly; all others carry what follows from these.
    star_lcp = np.zeros(len(found), dtype=np.uint8)
    for k in range(1, len(found), _MOST):
        b = found[k : k + _MOST]
        star_lcp[k : k + len(b)] = text.common(found[k - 1 : k - 1 + len(b)], b)
    order, down = _both(x, kinds, back, counts, found, store, text, star_lcp)
    return order, np.append(np.uint8(0), down[::-1][:-1])
