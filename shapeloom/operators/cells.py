"""Sweeps over whole blocks of the plane with arrays: slabs between cuts, events on y, running sums.

Numbers inside a block count from its corner, so a slab or a line and a place on it make one integer
key; one sort of such keys orders the events of many blocks at a time.
"""
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Events held at a time; a strip that has more is swept some slabs at a time.
EVENTS = 1 << 21


def groups(table, names) -> np.ndarray:
    """Numbers from 0 of the runs of rows that agree in the columns `names`."""
    new = np.zeros(table.num_rows, bool)
    for c in names:
        v = table.column(c).combine_chunks()
        same = pc.or_(pc.equal(v[1:], v[:-1]).fill_null(False), pc.and_(pc.is_null(v[1:]), pc.is_null(v[:-1])))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def whole_groups(batches, names, rows: int):
    """(table, groups) of at least `rows` rows, where no group goes on in the next table."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            g = groups(t, names)
            cut = int(np.searchsorted(g, g[-1]))
            if cut:
                yield t.slice(0, cut).combine_chunks(), g[:cut]
            held, size = t.slice(cut).to_batches(), t.num_rows - cut
    if size:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, groups(t, names)


def _runs(count):
    """Row and place in its run for runs of `count` rows each."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def ordered(key):
    """(key in order, places): like argsort, by one sort of numbers that hold the key and the place, where both fit."""
    n = len(key)
    bits = max(1, n - 1).bit_length() if n else 1
    if not n or int(key.min()) < 0 or int(key.max()) >> (63 - bits):
        order = np.argsort(key, kind="stable")
        return key[order], order
    both = np.sort(key << bits | np.arange(n))
    return both >> bits, both & ((1 << bits) - 1)


def swept(g, l, b, r, t, wa, wb, hit, size: int, strip: int):
    """Disjoint rectangles (g, l, b, r, t) where `hit` holds of the two sums of weights.

    Coordinates count from the corner of block g; l and r lie in 0..size, as do b and t. Blocks are cut
    to strips, whose few distinct x form slabs.
    """
    per, step = -(-size // strip), size + 1
    row, at = _runs((r - 1) // strip - l // strip + 1)
    c = l[row] // strip + at
    left, right = np.maximum(l[row], c * strip), np.minimum(r[row], (c + 1) * strip)
    base = (g[row] * per + c) * (strip + 1)
    kl, kr = base + left - c * strip, base + right - c * strip
    cuts = np.sort(np.concatenate([kl, kr]))
    cuts = cuts[np.diff(cuts, prepend=-1) > 0]
    first, last = np.searchsorted(cuts, kl), np.searchsorted(cuts, kr)
    load = np.cumsum(np.bincount(first, minlength=len(cuts)) - np.bincount(last, minlength=len(cuts)))
    before, s0, found = np.concatenate([[0], np.cumsum(2 * load)]), 0, []
    while s0 < len(cuts):
        s1 = max(s0 + 1, int(np.searchsorted(before, before[s0] + EVENTS, side="right")) - 1)
        some = slice(None) if s0 == 0 and s1 >= len(cuts) else np.flatnonzero((first < s1) & (last > s0))
        lo, of = np.maximum(first[some], s0), row[some]
        piece, at = _runs(np.minimum(last[some], s1) - lo)
        slab, of = lo[piece] + at, of[piece]
        key, order = ordered(np.concatenate([slab * step + b[of], slab * step + t[of]]))
        end = np.append(key[1:] != key[:-1], True) if len(key) else np.zeros(0, bool)
        sums = [np.cumsum(np.concatenate([w[of], -w[of]])[order])[end] for w in (wa, wb)]
        key, state = key[end], hit(sums[0] > 0, sums[1] > 0)
        # Every slab ends with sums of 0, so states rise and fall in turn.
        was = np.concatenate([[False], state[:-1]]) if len(key) else state
        found.append((key[state & ~was], key[~state & was]))
        s0 = s1
    up, down = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
    slab = up // step
    cell, x = cuts[slab] // (strip + 1), cuts[slab] % (strip + 1) + cuts[slab] // (strip + 1) % per * strip
    wide = cuts[np.minimum(slab + 1, len(cuts) - 1)] - cuts[slab]
    return _widened(cell // per, x, up % step, x + wide, down % step, step)


def _widened(g, l, b, r, t, step: int):
    """Disjoint rectangles with those of equal height that stand side by side made one."""
    order = (ordered(((g * step + b) * step + t) * step + l)[1] if len(g) and (int(g[-1]) + 1) * step ** 3 < 1 << 62
             else np.lexsort((l, t, b, g)))
    g, l, b, r, t = (v[order] for v in (g, l, b, r, t))
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (b[1:] != b[:-1]) | (t[1:] != t[:-1]) | (l[1:] != r[:-1])
    first = np.flatnonzero(new)
    return g[first], l[first], b[first], r[np.append(first[1:] - 1, len(g) - 1)] if len(g) else r, t[first]


def summed(line, lo, hi, s, step: int):
    """Spans (line, lo, hi, sum) of constant sum other than 0 of signed spans on lines."""
    key = np.concatenate([line * step + lo, line * step + hi])
    key, order = ordered(key)
    total = np.cumsum(np.concatenate([s, -s])[order])
    end = np.append(key[1:] != key[:-1], True) if len(key) else np.zeros(0, bool)
    key, total = key[end], total[end]
    turn = np.append(True, total[1:] != total[:-1]) if len(key) else end
    key, total = key[turn], total[turn]
    some = np.flatnonzero(total)
    return key[some] // step, key[some] % step, key[some + 1] % step, total[some]


def outlined(g, l, b, r, t, size: int):
    """Boundary spans (g, horizontal, coord, lo, hi, s) of the disjoint rectangles of each block."""
    step, one = size + 1, np.ones(len(g), np.int64)
    signs, out = np.concatenate([one, -one]), []
    for horizontal, near, far, lo, hi in ((True, b, t, l, r), (False, l, r, b, t)):
        line = np.concatenate([g * step + near, g * step + far])
        line, a, z, s = summed(line, np.concatenate([lo, lo]), np.concatenate([hi, hi]), signs, step)
        out.append((line // step, np.full(len(line), horizontal), line % step, a, z, s))
    return [np.concatenate(v) for v in zip(*out)]
