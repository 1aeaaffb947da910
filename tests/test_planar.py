"""Set algebra on slanted polygons: exact cases, random shapes against sampling, validity of the arrangement."""
import random

import pytest
from pyspark.sql import functions as F

from shapeloom.operators import planar

EDGE = "layer int, x0 long, y0 long, x1 long, y1 long"
OPS = {"union": lambda a, b: a or b, "intersection": lambda a, b: a and b, "difference": lambda a, b: a and not b, "xor": lambda a, b: a != b}


def diamond(x, y, r):
    return [(x - r, y), (x, y + r), (x + r, y), (x, y - r)]


def winding(edges, x, y):
    """Coverage of a point off the edges, from edges with the material on the right."""
    n = 0
    for x0, y0, x1, y1 in edges:
        if (x0 <= x) != (x1 <= x) and (y0 - y) * (x1 - x0) + (y1 - y0) * (x - x0) > 0 if x1 > x0 else \
                (x0 <= x) != (x1 <= x) and (y0 - y) * (x0 - x1) + (y1 - y0) * (x0 - x) > 0:
            n += 1 if x1 > x0 else -1
    return n


def rows_of(df):
    return [tuple(r) for r in df.select("x0", "y0", "x1", "y1").collect()]


def doubled_area(df):
    got = planar.area2(df).collect()
    return got[0]["area2"] if got else 0


def test_diamonds_and_boxes_have_exact_areas(spark, polygons, boxes):
    a = planar.material_edges(polygons([diamond(0, 0, 10)]))
    b = planar.material_edges(polygons([diamond(10, 0, 10)[::-1]]))  # either way round
    assert [doubled_area(planar.overlay(a, b, op, cell=8, column=4)) for op in OPS] == [700, 100, 300, 600]
    box = planar.box_edges(boxes((-10, -10, 10, 10)))
    assert doubled_area(planar.intersection(a, box)) == 400 and doubled_area(planar.difference(box, a)) == 400
    assert planar.difference(a, box).isEmpty() and planar.overlay(a, a, "xor").isEmpty()
    hole = planar.material_edges(polygons([diamond(0, 0, 10), diamond(0, 0, 4)]))
    assert doubled_area(planar.union(hole)) == 400 - 64
    assert doubled_area(planar.union(hole.unionByName(planar.material_edges(polygons([diamond(0, 0, 4)]))))) == 400
    # A result is an input again, and copies count once.
    twice = planar.overlay(planar.overlay(a, b), planar.overlay(a, b), "intersection")
    assert doubled_area(twice) == 700 and planar.union(a.limit(0)).isEmpty()


@pytest.mark.parametrize("seed", range(2))
def test_random_triangles_against_sampling(spark, polygons, seed):
    rng, size = random.Random(seed), 120
    def some(n):
        out = []
        while len(out) < n:
            x, y = rng.randint(-size, size), rng.randint(-size, size)
            t = [(x + rng.randint(-60, 60), y + rng.randint(-60, 60)) for _ in range(3)]
            if (t[1][0] - t[0][0]) * (t[2][1] - t[0][1]) != (t[1][1] - t[0][1]) * (t[2][0] - t[0][0]):
                out.append([t])
        return planar.material_edges(polygons(*out))
    a, b = some(20).checkpoint(), some(20).checkpoint()
    ra, rb = rows_of(a), rows_of(b)
    pieces = planar.snapped(planar._pieces(a.unionByName(b), ["layer"], F.lit(1), F.lit(0)), cell=50)
    got = [tuple(r) for r in pieces.select("lx", "ly", "hx", "hy").collect()]
    assert len(set(got)) == len(got)

    def cross(o, p, q):
        return (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])

    for i, (x0, y0, x1, y1) in enumerate(got):  # pieces meet at ends only
        for u0, v0, u1, v1 in got[:i]:
            p, q, r, s = (x0, y0), (x1, y1), (u0, v0), (u1, v1)
            assert not (cross(p, q, r) * cross(p, q, s) < 0 and cross(r, s, p) * cross(r, s, q) < 0)

    def near(x, y, edges):
        for x0, y0, x1, y1 in edges:
            dx, dy = x1 - x0, y1 - y0
            t = max(0, min(1, ((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy)))
            if (x0 + t * dx - x) ** 2 + (y0 + t * dy - y) ** 2 <= 0.51:
                return True
        return False

    points = [(rng.uniform(-size, size), rng.uniform(-size, size)) for _ in range(250)]
    points = [p for p in points if not near(*p, ra + rb)]
    for op, hit in OPS.items():
        edges = rows_of(planar.overlay(a, b, op, cell=64, column=32))
        ends = {}
        for x0, y0, x1, y1 in edges:
            ends[x0, y0] = ends.get((x0, y0), 0) + 1
            ends[x1, y1] = ends.get((x1, y1), 0) - 1
        assert not any(ends.values())  # closed
        for x, y in points:
            assert (winding(edges, x, y) == 1) == hit(winding(ra, x, y) > 0, winding(rb, x, y) > 0), (op, x, y)
            assert winding(edges, x, y) in (0, 1)


def test_a_plan_without_broadcast_or_cross_join(spark, polygons):
    a = planar.material_edges(polygons([diamond(0, 0, 10)]))
    plan = planar.union(a)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "cartesian" not in plan.lower()
