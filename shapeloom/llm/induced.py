"""Suffix order and common prefixes of one shard by external induced sorting.

Suffixes are classed as L (larger than the next one) or S. Starting from the sorted S* suffixes (S
after an L), the order of all L suffixes is induced by scanning upwards, that of all S suffixes by
scanning downwards: whenever a suffix is scanned, the one before it, if of the sought class, is
pushed into a priority queue under its first symbol. Entries of a symbol leave in the order in which they
came, so the queue holds a list per symbol, and whole lists leave at once. Tuples carry the
position, the scan rank of the suffix that induced them; common prefixes are induced along: one
more than the least one between the inducing ranks, kept up to `depth`.

S* suffixes themselves are sorted by a first induction, which orders their substrings; equal ones
get equal names, and the string of names is sorted in turn: by doubling once it fits `memory`, by
this procedure again if not. The queue, and every array, moves to disk beyond `memory`.
"""
import tempfile

import numpy as np

from . import words


def room(n, dtype, memory, fill=None):
    """An array in memory, or in a file that vanishes with it."""
    n = int(n)
    if n * np.dtype(dtype).itemsize <= memory:
        a = np.empty(n, dtype)
    else:
        a = np.memmap(tempfile.TemporaryFile(), dtype, "w+", shape=(n,))
    if fill is not None:
        a[:] = fill
    return a


class Queue:
    """Priority queue of (symbol, position, rank): a first-in first-out list per symbol.

    Lists of the symbols that leave last go to disk when more than `memory` bytes wait.
    """

    def __init__(self, memory, downwards=False):
        self.memory, self.down, self.held, self.lists, self.file = memory, downwards, 0, {}, None

    def push(self, symbols, positions, ranks):
        # Sixteen bits are sorted digit by digit.
        order = np.argsort(symbols.astype(np.uint16) if symbols.max() < 1 << 16 else symbols, kind="stable")
        symbols = symbols[order]
        cuts = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
        for a, b in zip(cuts, [*cuts[1:], len(symbols)]):
            some = order[a:b]
            pair = np.stack([positions[some], ranks[some]])
            self.lists.setdefault(int(symbols[a]), []).append(pair)
            self.held += pair.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self):
        self.file = self.file or tempfile.TemporaryFile()
        for s in sorted(self.lists, reverse=not self.down):
            for i, pair in enumerate(self.lists[s]):
                if isinstance(pair, np.ndarray):
                    at = self.file.seek(0, 2)
                    self.file.write(pair.tobytes())
                    self.lists[s][i] = (at, pair.shape[1])
                    self.held -= pair.nbytes
            if self.held <= self.memory // 2:
                return

    def pop(self, symbol):
        """Positions and ranks waiting under a symbol."""
        out = []
        for pair in self.lists.pop(symbol, ()):
            if isinstance(pair, tuple):
                self.file.seek(pair[0])
                pair = np.frombuffer(self.file.read(16 * pair[1]), np.int64).reshape(2, -1)
            else:
                self.held -= pair.nbytes
            out.append(pair)
        return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)


def classes(t, memory):
    """Whether each suffix is of class S; the last one is."""
    n = len(t)
    s = room(n, bool, memory)
    change = np.flatnonzero(t[1:] != t[:-1])
    up = t[change + 1] > t[change]
    lengths = np.diff(np.concatenate([[0], change + 1]))
    s[:int(lengths.sum())] = np.repeat(up, lengths)
    s[int(lengths.sum()):] = True
    return s


def hashed(t, star, step=1 << 18):
    """Hashes of the substrings from each S* to the next, both included."""
    out = np.empty(len(star), np.uint64)
    out[-1] = 0  # the end mark
    for lo in range(0, len(star) - 1, step):
        begin = star[lo:min(lo + step, len(star) - 1) + 1].astype(np.int64)
        size = np.diff(begin)
        at = np.arange(size.sum(), dtype=np.int64)
        first = np.cumsum(size) - size
        off = (at - np.repeat(first, size)).astype(np.uint64)
        some = t[begin[0]:begin[-1]].astype(np.uint64)
        total = np.add.reduceat(words.mix(some * words.STEP[0] + off * words.STEP[1] + np.uint64(1)), first)
        ends = t[begin[1:]].astype(np.uint64)
        out[lo:lo + len(size)] = words.mix(total + words.mix(ends * words.STEP[2] + size.astype(np.uint64) * words.STEP[3]))
    return out


def least_between(values, ranks, before):
    """min(values[a + 1 .. b]) for consecutive ranks a < b of [before, *ranks]."""
    at = np.concatenate([[before], ranks])
    lo = int(at[0])
    at = at.astype(np.int64)
    return np.minimum.reduceat(values[lo:int(at[-1]) + 1], at[:-1] + 1 - lo)


def common(t, a, b, depth, known=0):
    """Common prefix lengths of the suffixes at a and b, up to depth; `known` symbols agree."""
    out = np.minimum(np.zeros(len(a), np.int64) + known, depth)
    live, n = np.arange(len(a)), len(t)
    while len(live):
        k = out[live]
        ok = (k < depth) & (np.maximum(a[live], b[live]) + k < n)
        live, k = live[ok], k[ok]
        live = live[t[a[live] + k] == t[b[live] + k]]
        out[live] += 1
    return out


def induce(t, s, star, star_lcp, symbols, depth, memory):
    """All suffixes in order, from the S* suffixes in order; common prefixes if star_lcp is given."""
    n, with_lcp = len(t), star_lcp is not None
    kind, place = np.uint8 if depth < 256 else np.int32, np.int32 if n < 1 << 31 else np.int64
    l_total = int(n - np.count_nonzero(s))
    lcp = room(l_total + len(star), kind, memory, 0)  # of each scanned suffix with the one before
    l_sa, l_lcp = room(l_total, place, memory), room(l_total, kind, memory, 0)
    first = t[star]
    star_cut = np.searchsorted(first, symbols)
    queue, at, l_at, l_start = Queue(memory), 0, 0, {}

    def preceding(positions, ranks, upwards):
        ok = positions > 0
        p, r = positions[ok] - 1, ranks[ok]
        ok = ~s[p] if upwards else s[p]
        return p[ok], r[ok], t[p[ok]]

    for j, c in enumerate(symbols.tolist()):
        l_start[c] = l_at
        p, r = queue.pop(c)
        last = None  # rank that induced the entry before
        while len(p):
            ranks = np.arange(at, at + len(p))
            l_sa[l_at:l_at + len(p)] = p
            if with_lcp:
                value = np.zeros(len(p), np.int64)
                if last is not None:
                    value[:] = np.minimum(least_between(lcp, r, last).astype(np.int64) + 1, depth)
                elif len(p) > 1:
                    value[1:] = np.minimum(least_between(lcp, r[1:], r[0]).astype(np.int64) + 1, depth)
                lcp[at:at + len(p)] = l_lcp[l_at:l_at + len(p)] = value
            last = int(r[-1])
            at, l_at = at + len(p), l_at + len(p)
            q, from_, sym = preceding(p, ranks, True)
            same = sym == c
            queue.push(sym[~same], q[~same], from_[~same]) if (~same).any() else None
            p, r = q[same], from_[same]
        a, b = star_cut[j], (star_cut[j + 1] if j + 1 < len(symbols) else len(star))
        if a < b:
            p = star[a:b]
            if with_lcp:
                lcp[at:at + len(p)] = star_lcp[a:b]
                before = l_sa[l_at - 1] if l_at > l_start[c] else None
                lcp[at] = 0 if before is None else common(t, np.array([before]), p[:1], depth)[0]
            q, from_, sym = preceding(p, np.arange(at, at + len(p)), True)
            at += len(p)
            queue.push(sym, q, from_) if len(q) else None

    # Downwards: S suffixes of a symbol from its end, then its L suffixes.
    out, out_lcp = room(n, place, memory), room(n, kind, memory, 0)
    down, gap = room(n, place, memory), room(n, kind, memory, 0)  # gap: common prefix with the one scanned before
    queue, at = Queue(memory, True), 0
    ends = {c: (l_start[c], l_start[d] if d is not None else l_total)
            for c, d in zip(symbols.tolist(), [*symbols.tolist()[1:], None])}
    for c in symbols.tolist()[::-1]:
        p, r = queue.pop(c)
        if c == t[n - 1]:  # the end mark alone, which nothing induces
            p, r = np.array([n - 1]), np.array([0])
        last, begun = None, at
        while len(p):
            ranks = np.arange(at, at + len(p))
            down[at:at + len(p)] = p
            if with_lcp:
                value = np.zeros(len(p), np.int64)
                if last is not None:
                    value[:] = np.minimum(least_between(gap, r, last).astype(np.int64) + 1, depth)
                elif len(p) > 1:
                    value[1:] = np.minimum(least_between(gap, r[1:], r[0]).astype(np.int64) + 1, depth)
                gap[at:at + len(p)] = value
            last = int(r[-1])
            at += len(p)
            q, from_, sym = preceding(p, ranks, False)
            same = sym == c
            queue.push(sym[~same], q[~same], from_[~same]) if (~same).any() else None
            p, r = q[same], from_[same]
        a, b = ends[c]
        if a < b:
            p = l_sa[a:b][::-1]
            down[at:at + len(p)] = p
            if with_lcp:
                gap[at] = common(t, down[at - 1:at], p[:1], depth)[0] if at > begun else 0
                gap[at + 1:at + len(p)] = l_lcp[a + 1:b][::-1]
            q, from_, sym = preceding(p, np.arange(at, at + len(p)), False)
            at += len(p)
            queue.push(sym, q, from_) if len(q) else None
    out[:] = down[::-1]
    out_lcp[1:] = gap[1:][::-1]
    # Between symbols there is nothing in common.
    out_lcp[0] = 0
    return out, out_lcp


def doubled(names, depth):
    """Order of the suffixes of a string of names, and the names each shares with the one before, both
    as far as `depth` names tell suffixes apart."""
    n, k = len(names), 1
    _, rank = np.unique(names, return_inverse=True)
    levels = [rank.astype(np.int32 if n < 1 << 30 else np.int64)]
    order = np.argsort(rank, kind="stable")
    while k < depth:
        after = np.zeros(n, np.int64)
        after[:max(0, n - k)] = levels[-1][k:]
        after[:max(0, n - k)] += 1
        both = levels[-1].astype(np.int64) * (n + 1) + after
        order = np.argsort(both, kind="stable")
        new = np.concatenate([[0], np.cumsum(both[order][1:] != both[order][:-1])])
        rank = np.empty(n, levels[-1].dtype)
        rank[order] = new
        levels.append(rank)
        k *= 2
        if new[-1] == n - 1:
            break
    shared = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(levels) - 1, -1, -1):
        step = 1 << level
        for _ in range(2 if level == len(levels) - 1 else 1):
            live = np.flatnonzero(np.maximum(a, b) + step <= n)
            live = live[levels[level][a[live]] == levels[level][b[live]]]
            a[live] += step
            b[live] += step
            shared[live + 1] += step
    return order, shared


def sort_suffixes(t, depth=255, memory=256 << 20):
    """Positions of all suffixes of t in order, and each one's common prefix with the one before.

    t holds integers from 0; order and prefixes are exact as far as `depth` symbols tell suffixes apart.
    """
    if not len(t):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = room(len(t) + 1, np.int32 if t.max() < 1 << 30 else np.int64, memory)
    whole[:-1], whole[-1] = t, 0
    whole[:-1] += 1
    order, lcp = _sorted(whole, depth, memory)
    return order[1:], lcp[1:]


def _sorted(t, depth, memory):
    """As sort_suffixes, of a string that ends in its only 0."""
    n = len(t)
    s = classes(t, memory)
    symbols = np.unique(t)
    star = np.flatnonzero(s[1:] & ~s[:-1]) + 1  # holds the last suffix, as what precedes 0 is larger
    by = np.argsort(t[star], kind="stable")
    rough, _ = induce(t, s, star[by], None, symbols, depth, memory)
    place = room(n, np.int32 if len(star) < 1 << 31 else np.int64, memory, -1)
    place[star] = np.arange(len(star))
    found = place[rough]
    found = found[found >= 0]  # S* substrings in order
    # Names: substrings from one S* to the next, both included, told apart by hash.
    h = hashed(t, star)[found]
    differ = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
    names = np.empty(len(star), np.int64)
    names[found] = differ
    if differ[-1] == len(star) - 1:
        order, shared = found, np.zeros(len(star), np.int64)
    elif names.nbytes * 12 <= memory:
        order, shared = doubled(names, depth // 2 + 2)
    else:
        order, shared = sort_suffixes(names, depth // 2 + 2, memory)
    ordered = star[order]
    star_lcp = np.zeros(len(star), np.int64)
    if len(star) > 1:
        # Shared names are shared symbols up to the next S*; what follows is shorter than one name.
        known = star[np.minimum(order[1:] + shared[1:], len(star) - 1)] - ordered[1:]
        star_lcp[1:] = common(t, ordered[:-1], ordered[1:], depth, known)
    return induce(t, s, ordered, star_lcp, symbols, depth, memory)
