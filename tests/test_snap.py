"""Arrays of whole cells against brute force: steps do not depend on cells, covers are counted without rows per column."""
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from shapeloom.operators import planar, snap
from tests.test_scale import plan


def low_first(p, q, w):
    return (*p, *q, w) if p < q else (*q, *p, -w)


def summed(rows):
    total = defaultdict(int)
    for *k, w in rows:
        total[tuple(k)] += w
    return sorted((*k, w) for k, w in total.items() if w)


def outlines(rng):
    """Pieces of random triangles and of boxes that share sides, material on the right."""
    found = [[(rng.randint(-60, 60), rng.randint(-60, 60)) for _ in range(3)] for _ in range(8)]
    for _ in range(4):
        l, b, r, t = rng.randint(-40, 0), rng.randint(-40, 0), rng.randint(1, 40), rng.randint(1, 40)
        found.append([(l, b), (l, t), (r, t), (r, b)])
    rows = []
    for p in found:
        p = p if sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(p, p[1:] + p[:1])) < 0 else p[::-1]
        rows += [low_first(a, b, 1) for a, b in zip(p, p[1:] + p[:1]) if a != b]
    return summed(rows)


def in_cells(rows, cell):
    v = [np.array(c, np.int64) for c in zip(*rows)]
    row, cx, cy = snap.spread(*v[:4], cell)
    order = np.lexsort((cy, cx))
    row, cx, cy = row[order], cx[order], cy[order]
    new = np.append(True, (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1]))
    return row, cx, cy, np.cumsum(new) - 1, [c[row] for c in v]


def stepped(rows, cell):
    row, cx, cy, g, v = in_cells(rows, cell)
    (i, *ends), (far, px, py, joined) = snap.steps(g, cx * cell, cy * cell, *v[:4], cell)
    out = [low_first((a, b), (c, d), w) for a, b, c, d, w in zip(*[x.tolist() for x in ends], v[4][i].tolist())]
    open_ = defaultdict(list)
    for f, x, y, j in zip(row[far], px.tolist(), py.tolist(), joined):
        open_[f].append((x, y, j))
    for f, points in open_.items():
        lx, ly, hx, hy, w = rows[f]
        points.sort(key=lambda p: (p[0] - lx) * (hx - lx) + (p[1] - ly) * (hy - ly))
        out += [low_first(p[:2], q[:2], w) for p, q in zip(points, points[1:]) if not q[2]]
    return summed(out)


def brute_cover(rows):
    out = {}
    for lx, ly, hx, hy, _ in rows:
        upright = lx == hx
        s, h = (lx - 1, Fraction(ly + hy, 2)) if upright else (lx, ly + Fraction(hy - ly, 2 * (hx - lx)))
        at = Fraction(lx) if upright else Fraction(2 * s + 1, 2)
        out[lx, ly, hx, hy] = -sum(w for a, b, c, d, w in rows if a <= s < c and (a, b, c, d) != (lx, ly, hx, hy)
                                   and b + (d - b) * (at - a) / (c - a) < h)
    return out


def covered(rows, cell):
    row, cx, cy, g, v = in_cells(rows, cell)
    _, sx, sy, sw, _ = snap.seeds(*[np.array(c, np.int64) for c in zip(*rows)], np.zeros(len(rows), np.int64), cell)
    first = np.flatnonzero(np.diff(g, prepend=-1))
    seed = np.array([sw[(sx == cx[k]) & (sy <= cy[k])].sum() for k in first])
    own, ca, _ = snap.covers(g, cx * cell, cy * cell, *v, np.zeros(len(g), np.int64), [seed, seed], cell)
    return {tuple(int(c[o]) for c in v[:4]): int(a) for o, a in zip(own, ca)}


@pytest.mark.parametrize("seed", range(6))
def test_steps_and_covers_do_not_depend_on_cells(seed):
    rows = outlines(random.Random(seed))
    steps = stepped(rows, 1000)
    cover = brute_cover(steps)
    for cell in (1000, 64, 9, 4, 1):
        assert stepped(rows, cell) == steps
        assert covered(steps, cell) == cover


def test_crowded_cells_are_looked_at_in_parts(monkeypatch):
    rows = outlines(random.Random(7))
    steps = stepped(rows, 1000)
    monkeypatch.setattr(snap.slices, "__defaults__", (50,))
    assert stepped(rows, 1000) == steps and covered(steps, 1000) == brute_cover(steps)


def test_crossings_are_rounded_exactly():
    rng = random.Random(1)
    start, step = ([rng.randint(-(1 << 30), 1 << 30) for _ in range(2000)] for _ in range(2))
    den = [rng.choice((rng.randint(1, 9), rng.randint(1, 1 << 61), (1 << 61) - rng.randint(0, 3))) for _ in start]
    num = [rng.choice((rng.randint(0, d), d // 2, d - d // 3)) for d in den]
    want = [(2 * (a * d + s * n) + d) // (2 * d) for a, s, n, d in zip(start, step, num, den)]
    assert snap.nearest(*[np.array(v, np.int64) for v in (start, step, num, den)]).tolist() == want
    with pytest.raises(ValueError, match="2\\*\\*30"):
        snap.spread(*[np.array([1 << 30])] * 4, 64)


def test_no_row_is_made_per_column(spark):
    """Long pieces over many ends are not cut into a row for each column between ends."""
    comb = [(1, x, 10, x + 2, 12, 1, 0) for x in range(0, 1000, 2)] + [(1, x, 12, x + 2, 10, -1, 0) for x in range(0, 1000, 2)]
    rows = [(1, 0, 0, 1000, 0, -1, 0), (1, 0, 20, 1000, 20, 1, 0), (1, 0, 0, 0, 20, 1, 0), (1, 1000, 0, 1000, 20, -1, 0)]
    pieces = spark.createDataFrame(rows + comb, "layer int, lx long, ly long, hx long, hy long, wa long, wb long")
    found = planar._with_cover(pieces, ["layer"], 4096)
    assert "Generate" not in plan(found)
    got = {(r["lx"], r["ly"], r["hx"], r["hy"]): r["ca"] for r in found.collect()}
    assert got[0, 0, 1000, 0] == 0 and got[0, 20, 1000, 20] == 1 and got[0, 0, 0, 20] == 0 and got[1000, 0, 1000, 20] == 1
