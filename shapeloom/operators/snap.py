"""Whole cells of slanted pieces with arrays: where pieces cross, which points they are led through, what covers them.

A piece runs from (lx, ly) to (hx, hy), its low end first (smaller x, then smaller y); g numbers the cells, (x, y) are
the cells' corners. All is exact in 64 bits while coordinates and their differences stay below 2**30. Pairs are looked at
PAIRS at a time, so that a crowded cell takes time but no memory.
"""
import numpy as np

from shapeloom.operators.cells import _runs

PAIRS = 1 << 20
STRIPS = 32


def nearest(start, step, num, den):
    """start + step * num / den, rounded to the nearest integer (halves up); den > 0 and 0 <= num <= den."""
    q = np.floor(step * (num / den) + 0.5).astype(np.int64)
    # The guess is off by one at most; the rest is a small number, which 64 bits hold even where its parts overflow.
    rest = step * num * 2 + den - den * q * 2
    return start + q + (rest >= 2 * den) - (rest < 0)


def spread(lx, ly, hx, hy, cell: int):
    """(row, cx, cy) for each cell that a piece passes, with a margin of one unit."""
    if len(lx) and max(int(np.abs(v).max()) for v in (lx, ly, hx, hy)) >= 1 << 30:
        raise ValueError("coordinates must stay below 2**30 in size")
    first = (lx - 1) // cell
    row, at = _runs((hx + 1) // cell - first + 1)
    cx = first[row] + at
    lx, ly, hx, hy = lx[row], ly[row], hx[row], hy[row]
    dx, dy = hx - lx, hy - ly
    a, b = (ly + dy * (np.clip(v, lx, hx) - lx) // np.maximum(dx, 1) for v in (cx * cell - 1, (cx + 1) * cell + 1))
    flat = dx == 0
    first = (np.where(flat, ly, np.minimum(a, b)) - 1) // cell
    up, at = _runs((np.where(flat, hy, np.maximum(a, b) + 1) + 1) // cell - first + 1)
    return row[up], cx[up], first[up] + at


def slices(load, most: int = PAIRS):
    """Ranges (from, to) of rows whose loads add up to `most`, or of one row."""
    before, i = np.concatenate([[0], np.cumsum(load)]), 0
    while i < len(load):
        j = max(i + 1, int(np.searchsorted(before, before[i] + most, side="right")) - 1)
        yield i, j
        i = j


def crossings(g, x, y, lx, ly, hx, hy, cell: int):
    """Grid points (g, px, py) in their cell that are nearest to places where two pieces cross inside both; with repeats."""
    wide = cell + 3
    near, far = np.maximum(lx - x + 1, 0), np.minimum(hx - x + 1, cell + 2)
    order = np.argsort(g * wide + near, kind="stable")
    key, last = (g * wide + near)[order], (g * wide + far)[order]
    g, x, y, lx, ly, hx, hy = (v[order] for v in (g, x, y, lx, ly, hx, hy))
    low, high = np.minimum(ly, hy), np.maximum(ly, hy)
    count = np.searchsorted(key, last, side="right") - np.arange(len(key)) - 1
    found = []
    for s, e in slices(count):
        i, at = _runs(count[s:e])
        i += s
        j = i + 1 + at
        some = np.flatnonzero((low[i] <= high[j]) & (low[j] <= high[i]))
        i, j = i[some], j[some]
        ax, ay, cx, cy = lx[i], ly[i], lx[j], ly[j]
        ux, uy, vx, vy = hx[i] - ax, hy[i] - ay, hx[j] - cx, hy[j] - cy
        s3 = vx * (ay - cy) - vy * (ax - cx)
        s4 = s3 + vx * uy - vy * ux
        s1 = ux * (cy - ay) - uy * (cx - ax)
        s2 = s1 + ux * vy - uy * vx
        some = np.flatnonzero((np.sign(s1) * np.sign(s2) < 0) & (np.sign(s3) * np.sign(s4) < 0))
        i, ax, ay, ux, uy, s3, s4 = (v[some] for v in (i, ax, ay, ux, uy, s3, s4))
        num, den = np.abs(s3), np.abs(s3 - s4)
        px, py = nearest(ax, ux, num, den), nearest(ay, uy, num, den)
        own = np.flatnonzero((px >= x[i]) & (px < x[i] + cell) & (py >= y[i]) & (py < y[i] + cell))
        found.append((g[i[own]], px[own], py[own]))
    return [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3)]


def hot_points(g, x, y, lx, ly, hx, hy, cell: int):
    """Distinct grid points (g, px, py) of each cell at which pieces end or cross."""
    ends = []
    for px, py in ((lx, ly), (hx, hy)):
        own = np.flatnonzero((px >= x) & (px < x + cell) & (py >= y) & (py < y + cell))
        ends.append((g[own], px[own], py[own]))
    at, px, py = (np.concatenate(v) for v in zip(*ends, crossings(g, x, y, lx, ly, hx, hy, cell)))
    corner = np.flatnonzero(np.diff(g, prepend=-1))
    x0, y0 = x[corner], y[corner]
    key = np.unique((at * cell + px - x0[at]) * cell + py - y0[at])
    at = key // (cell * cell)
    return at, key // cell % cell + x0[at], key % cell + y0[at]


def in_strips(g, first, last, at_g, at, strips: int, strip: int):
    """Pairs (rows, place): of rows that reach over columns first..last and places in a column, both in one strip of a cell."""
    row, k = _runs(np.maximum(last // strip - first // strip + 1, 0))
    key = g[row] * strips + first[row] // strip + k
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    here = at_g * strips + at // strip
    start = np.searchsorted(key, here)
    count = np.searchsorted(key, here, side="right") - start
    for s, e in slices(count):
        of, k = _runs(count[s:e])
        of += s
        yield row[start[of] + k], of


def led(g, x, y, lx, ly, hx, hy, cell: int):
    """(piece, px, py) of the cell's hot points that pieces are led through, in order along each piece.

    A piece is led through a point if it meets the half-open unit square around it: borders below and left belong to the square.
    """
    at, px, py = hot_points(g, x, y, lx, ly, hx, hy, cell)
    strip = max(1, cell // STRIPS)
    low, high, dx, dy = np.minimum(ly, hy), np.maximum(ly, hy), hx - lx, hy - ly
    found, x0 = [], x[np.flatnonzero(np.diff(g, prepend=-1))]
    for i, p in in_strips(g, np.maximum(lx - x, 0), np.minimum(hx - x, cell - 1), at, px - x0[at], -(-cell // strip), strip):
        u, v = px[p], py[p]
        near = np.flatnonzero((lx[i] <= u) & (u <= hx[i]) & (low[i] <= v) & (v <= high[i]))
        i, p, u, v = i[near], p[near], u[near], v[near]
        a, b = dx[i], dy[i]
        # Twice the cross product at the middle; at corners it differs by dx and dy.
        side = 2 * (a * (v - ly[i]) - b * (u - lx[i]))
        meets = np.flatnonzero((np.abs(side) < a + np.abs(b)) | (side == a - b))
        found.append((i[meets], p[meets]))
    i, p = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(2))
    px, py = px[p], py[p]
    order = np.lexsort(((px - lx[i]) * dx[i] + (py - ly[i]) * dy[i], i))
    return i[order], px[order], py[order]


def steps(g, x, y, lx, ly, hx, hy, cell: int):
    """((piece, x0, y0, x1, y1), (piece, px, py, joined)): steps between points that follow each other, and points for the rest.

    Where both points lie two units or more inside the cell, no other cell holds a point between them. Points next to
    any other step are given for a join over the whole piece; `joined` are those whose way from the point before is among the steps.
    """
    i, px, py = led(g, x, y, lx, ly, hx, hy, cell)
    deep = (px >= x[i] + 2) & (px < x[i] + cell - 2) & (py >= y[i] + 2) & (py < y[i] + cell - 2)
    whole = np.zeros(len(i) + 1, bool)  # whole[k]: the step from point k - 1 to k
    if len(i):
        whole[1:-1] = (i[1:] == i[:-1]) & deep[1:] & deep[:-1]
    begins, ends = (px == lx[i]) & (py == ly[i]), (px == hx[i]) & (py == hy[i])
    far = np.flatnonzero(~(whole[:-1] | begins) | ~(whole[1:] | ends))
    k = np.flatnonzero(whole)
    return (i[k], px[k - 1], py[k - 1], px[k], py[k]), (i[far], px[far], py[far], whole[far])


def merged(g, lx, ly, hx, hy, wa, wb):
    """One piece of each that is given more than once in a cell, with summed weights; without those whose sums are 0."""
    order = np.lexsort((hy, hx, ly, lx, g))
    rows = [v[order] for v in (g, lx, ly, hx, hy)]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in rows])
    first = np.flatnonzero(new)
    sums = [np.add.reduceat(w[order], first) if len(first) else w for w in (wa, wb)]
    some = np.flatnonzero((sums[0] != 0) | (sums[1] != 0))
    return [v[first[some]] for v in rows] + [s[some] for s in sums]


def covers(g, x, y, lx, ly, hx, hy, wa, wb, seeds, cell: int):
    """(piece, ca, cb): for pieces with their low end in the cell, how many shapes cover the place below them, or left of upright ones.

    Pieces must meet at ends only and be closed outlines; `seeds` (two arrays by g) is the cover of the place half a unit left of and below
    the corner. From there a way leads along that height to the piece's first column (upright: the column before it), and then up to it.
    """
    dx, dy, low, high = hx - lx, hy - ly, np.minimum(ly, hy), np.maximum(ly, hy)
    upright = dx == 0
    # Pieces that the way to the right crosses, by the first column right of the crossing; no point of a column is at half a unit.
    k = np.flatnonzero((low < y) & (high >= y))
    rising = hy[k] > ly[k]
    num, den = np.where(rising, 1, -1) * (2 * y[k] - 1 - 2 * ly[k]), 2 * np.abs(dy[k])
    column = np.where(rising, 1, -1) * nearest(np.where(rising, 1, -1) * lx[k], np.where(rising, 1, -1) * dx[k], num, den) - x[k] + 1
    k, column = k[(column > 0) & (column <= cell)], column[(column > 0) & (column <= cell)]
    passed = g[k] * (cell + 1) + column
    order = np.argsort(passed, kind="stable")
    passed, k = passed[order], k[order]
    turn = np.where(hy[k] > ly[k], 1, -1)

    own = np.flatnonzero((lx >= x) & (lx < x + cell) & (ly >= y) & (ly < y + cell))
    s = np.where(upright, lx - 1, lx)[own]
    place = g[own] * (cell + 1) + s - x[own] + 1
    from_, to = np.searchsorted(passed, g[own] * (cell + 1)), np.searchsorted(passed, place, side="right")
    out = []
    for w, seed in zip((wa, wb), seeds):
        before = np.concatenate([[0], np.cumsum(turn * w[k])])
        out.append(seed[g[own]] + before[to] - before[from_])

    flat = np.flatnonzero(~upright)
    strip = max(1, cell // STRIPS)
    first, last = np.maximum(lx[flat] - x[flat] + 1, 0), np.minimum(hx[flat] - x[flat], cell)
    for i, q in in_strips(g[flat], first, last, g[own], s - x[own] + 1, -(-(cell + 1) // strip), strip):
        i = flat[i]
        over = np.flatnonzero((lx[i] <= s[q]) & (s[q] < hx[i]))
        i, q = i[over], q[over]
        o = own[q]
        side = dx[i] * (ly[o] - ly[i]) - dy[i] * (lx[o] - lx[i])
        # Pieces from one end follow each other by slope; one that ends at the foot of an upright piece lies below.
        below = (side > 0) | ((side == 0) & (upright[o] | (dx[i] * dy[o] - dy[i] * dx[o] > 0)))
        under = dx[i] * (2 * y[o] - 1 - 2 * ly[i]) - dy[i] * (2 * s[q] + 1 - 2 * lx[i]) >= 0
        # A steep piece may be under the way already, and others from its end with it, itself among them.
        some = np.flatnonzero(below != under)
        sign = np.where(under[some], 1, -1)
        for c, w in zip(out, (wa, wb)):
            np.add.at(c, q[some], sign * w[i[some]])
    return own, *out


def seeds(lx, ly, hx, hy, wa, wb, cell: int):
    """(row, cx, cy, wa, wb): what each piece adds to the cover of the places half a unit left of and below the corners above it, at the
    lowest corner of each line x = cx * cell that it crosses."""
    first = lx // cell + 1
    row, at = _runs(np.where(hx > lx, hx // cell - first + 1, 0))
    cx = first[row] + at
    over = 1 - nearest(-ly[row], -(hy - ly)[row], 2 * cx * cell - 1 - 2 * lx[row], 2 * (hx - lx)[row])
    return row, cx, -(-over // cell), -wa[row], -wb[row]
