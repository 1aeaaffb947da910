"""Rings across blocks and hulls of holes against tracing by hand."""
import random

import numpy as np
from pyspark.sql import functions as F

from shapeloom.operators import chains, contours, region


def outline(df):
    return region.directed_edges(region.boundary_edges(region.union(df)))


def traced(edges):
    """Rings of directed edges as tuples of vertices from the smallest edge on; at a crossing, turn right."""
    leave = {}
    for e in edges:
        leave.setdefault(e[:2], []).append(e)
    out, left = set(), set(edges)
    while left:
        e = first = min(left)
        ring = []
        while True:
            left.discard(e)
            ring.append(e)
            dx, dy = np.sign(e[2] - e[0]), np.sign(e[3] - e[1])
            ways = leave[e[2:]]
            e = ways[0] if len(ways) == 1 else next(w for w in ways if (np.sign(w[2] - w[0]), np.sign(w[3] - w[1])) == (dy, -dx))
            if e == first:
                break
        out.add(tuple(ring))
    return out


def rings_of(df):
    rows = {}
    for r in df.collect():
        rows.setdefault(r["ring"], []).append((r["ord"], (r["x0"], r["y0"], r["x1"], r["y1"]), r["n"]))
    for v in rows.values():
        v.sort()
        assert [o for o, _, _ in v] == list(range(len(v))) and {n for _, _, n in v} == {len(v)}
    assert sorted(rows) == list(range(len(rows)))
    assert [rows[k][0][1] for k in sorted(rows)] == sorted(rows[k][0][1] for k in rows)
    return {tuple(e for _, e, _ in v) for v in rows.values()}


def test_rings_across_blocks_equal_traced_rings(boxes):
    rng = random.Random(4)
    rows = [(x, y, x + rng.randint(1, 14), y + rng.randint(1, 14)) for x, y in
            ((rng.randint(-40, 40), rng.randint(-40, 40)) for _ in range(90))]
    rows += [(0, 0, 1, 1), (1, 1, 2, 2), (-60, -60, 60, -59), (-60, 59, 60, 60)]
    edges = outline(boxes(*rows)).checkpoint()
    want = traced([tuple(r) for r in edges.select("x0", "y0", "x1", "y1").collect()])
    for block in (7, 10_000):
        assert rings_of(contours.assemble_rings(edges, block=block)) == want
    # An open chain is left out, wherever its blocks are; an empty table has no rings.
    some = sorted(want, key=len)[-1]
    broken = edges.filter((F.col("x0") != some[2][0]) | (F.col("y0") != some[2][1]) | (F.col("x1") != some[2][2]) | (F.col("y1") != some[2][3]))
    assert rings_of(contours.assemble_rings(broken, block=7)) == want - {some}
    assert contours.assemble_rings(edges.limit(0)).count() == 0


def test_hundred_nested_rings_and_rows_of_holes(boxes):
    """Frame in frame, and a wide hull with a row of holes each right of the one before and above it."""
    frames = []
    for k in range(0, 200, 4):
        l, b, r, t = k, k, 1000 - k, 1000 - k
        frames += [(l, b, r, b + 2), (l, t - 2, r, t), (l, b, l + 2, t), (r - 2, b, r, t)]
    wide = [(2000, 0, 200_000, 10), (2000, 0, 2010, 400), (2000, 390, 200_000, 400), (199_990, 0, 200_000, 400)]
    stairs = [(2000, 10, 200_000, 390)]
    edges = outline(region.difference(boxes(*stairs), boxes(*[(2100 + 30 * k, 20 + 3 * k, 2150 + 30 * k, 22 + 3 * k) for k in range(60)])).drop("cx", "cy"))
    for e, rings, holes in ((outline(boxes(*frames)), 100, 50), (outline(boxes(*wide)), 2, 1), (edges, 61, 60)):
        p = contours.polygons(contours.assemble_rings(e)).checkpoint()
        got = p.agg(F.count_distinct("ring"), F.count_distinct(F.when(F.col("is_hole"), F.col("ring")))).first()
        assert tuple(got) == (rings, holes)
        # Each hole lies in the smallest hull around it.
        box = {r["ring"]: r for r in contours.ring_summary(p).collect()}
        for r in p.filter("is_hole").select("ring", "polygon").distinct().collect():
            hole, hull = box[r["ring"]], box[r["polygon"]]
            around = [h for h in box.values() if h["area2"] < 0 and h["l"] < hole["l"] and h["r"] > hole["r"] and h["b"] < hole["b"] and h["t"] > hole["t"]]
            assert hull == min(around, key=lambda h: -h["area2"])


def test_followed_by_arrays():
    after = np.array([1, 2, 0, 4, -1, 5, 7, 6])
    head, dist, size = chains.followed(after, np.arange(8))
    assert head.tolist() == [0, 0, 0, 3, 3, 5, 6, 6] and size.tolist() == [3, 3, 3, 0, 0, 1, 2, 2]
    assert dist.tolist() == [0, 1, 2, 0, 1, 0, 0, 1]


def test_a_task_holds_few_edges_at_a_time(boxes):
    """Memory of the workers follows the batch, so it has to stay small; rings do not depend on it."""
    import pyarrow as pa
    batches = [pa.record_batch({"k": np.repeat(np.arange(i, i + 1000), 10)}) for i in range(0, 200_000, 1000)]
    sizes = [t.num_rows for t, _ in chains.whole_groups(iter(batches), ["k"], chains.ROWS)]
    assert sum(sizes) == 2_000_000 and max(sizes) < 50_000
    df = boxes(*[(x, y, x + 30, y + 30) for x in range(0, 400, 25) for y in range(0, 200, 40)])
    edges = outline(df)
    whole, one = (sorted(map(tuple, chains.contracted(edges, ["layer"], 64, rows).collect()), key=repr) for rows in (None, 1))
    assert whole == one and len(whole) == edges.count()
