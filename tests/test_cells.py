"""Sweeps by whole cells: results against brute force, and plans that shuffle boxes once by cell."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapeloom.operators import cells, region


def covered(rows):
    return {(x, y) for l, b, r, t in rows for x in range(l, r) for y in range(b, t)}


@pytest.mark.parametrize("op", list(region.PREDICATES))
def test_slabs_taken_apart_equal_brute_force(monkeypatch, op):
    """Also when a strip has more events than are held at a time."""
    rng = random.Random(3)
    a, b = ([(x, y, rng.randint(x + 1, 12), rng.randint(y + 1, 12)) for x, y in ((rng.randint(0, 11), rng.randint(0, 11)) for _ in range(n))]
            for n in (9, 7))
    v = np.array(a + b, np.int64).T
    side = np.repeat([1, 0], [len(a), len(b)])
    want = {p for p in covered(a) | covered(b) if region.PREDICATES[op](np.bool_(p in covered(a)), np.bool_(p in covered(b)))}
    for events in (1, 1 << 21):
        monkeypatch.setattr(cells, "EVENTS", events)
        got = cells.swept(np.zeros(len(side), np.int64), *v, side, 1 - side, region.PREDICATES[op], 12, 5)
        rows = [tuple(int(x) for x in r) for r in zip(*got[1:])]
        assert covered(rows) == want and sum((r - l) * (t - b) for l, b, r, t in rows) == len(want)


def test_outlines_shuffle_few_rows(boxes):
    """Boxes are dealt by cell once; edges inside their cell go through no later shuffle."""
    df = boxes((0, 0, 100, 100), (50, 0, 150, 100), (150, 100, 200, 150), (2000, 10, 2100, 20), (2048, 20, 2060, 30))
    edges = region.outline(df)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and plan.split("Union")[1].split("Window")[0].count("RepartitionByExpression") <= 2
    rects = region.union(df)
    assert "Window" not in rects._jdf.queryExecution().optimizedPlan().toString()
    whole = {tuple(r) for r in region.outline(df, cell=8192).collect()}
    assert {tuple(r) for r in edges.collect()} == whole == {tuple(r) for r in region.boundary_edges(rects, cell=32).collect()}
    assert (1, True, 10, 2000, 2100, 1) in whole and len(whole) == 16


def test_edges_of_a_vertex_meet_in_one_shuffle(spark):
    """Neighbours on a ring are found inside the blocks that hold both, also across a block's border."""
    from shapeloom.operators import chains, contours
    ring = [(1, 0, 0, 0, 9), (1, 0, 9, 12, 9), (1, 12, 9, 12, 0), (1, 12, 0, 0, 0)]
    edges = spark.createDataFrame(ring, "layer int, x0 long, y0 long, x1 long, y1 long")
    found = chains.contracted(edges, ["layer"], 8)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Aggregate" not in plan
    before = {r[1:5]: (r["px"], r["py"]) for r in found.collect()}
    assert before == {e[1:]: p[1:3] for e, p in zip(ring, [ring[-1], *ring])}
    assert [r["n"] for r in contours.assemble_rings(edges, block=8).collect()] == [4] * 4
    # Two in, two out: each turns right.
    into, out = np.array([0, 2]), np.array([1, 3])
    assert chains.successors(np.array([5, 5]), np.array([5, 5]), into, out).tolist() == [1, 0]


def test_macros_of_owners_stay_short_expressions(spark):
    """The macro of a tile names the tile's number once; its definition is not repeated inside."""
    from shapeloom.operators import segments as seg, tiling
    from shapeloom.plans import prepare
    grid, macros = tiling.Grid.even((0, 0, 9000, 9000), 1000, 10), tiling.Grid.even((0, 0, 9000, 9000), 4000, 10)
    cut = spark.createDataFrame([(8500.0, 100.0, 8600.0, 100.0), (-9.0, 0.0, -9.0, 9.0)], "sx double, sy double, ex double, ey double")
    found = prepare.macro_of(seg.owners(cut, grid), macros, grid).filter("macro_id >= -1")
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 12_000
    assert [(r["core_id"], r["macro_id"]) for r in found.orderBy("sx").collect()] == [(-1, -1), (8, 2)]


def test_ordered_keys_and_places_agree_with_argsort():
    rng = np.random.default_rng(5)
    for top in (1 << 30, 1 << 62):  # the second leaves no room for the places
        key = np.concatenate([rng.integers(0, top, 500), rng.integers(0, 20, 500), [top - 1]])
        got, at = cells.ordered(key)
        assert np.array_equal(at, np.argsort(key, kind="stable")) and np.array_equal(got, key[at])
    for key in (np.zeros(0, np.int64), np.array([-3, 5, -3])):
        got, at = cells.ordered(key)
        assert np.array_equal(got, np.sort(key)) and np.array_equal(key[at], got)


def test_chained_operations_equal_single_ones_after_one_shuffle(spark):
    import random
    from shapeloom.operators import region
    rnd = random.Random(9)

    def some(n):
        rows = []
        for _ in range(n):
            l, b = rnd.randrange(-40, 120), rnd.randrange(-40, 120)
            rows += [(rnd.choice([1, 2]), l, b, l + rnd.randrange(0, 50), b + rnd.randrange(1, 50))] * rnd.choice([1, 1, 3])
        return spark.createDataFrame(rows, "layer int, l long, b long, r long, t long")

    def points(df):
        out = set()
        for k, l, b, r, t in df.select("layer", "l", "b", "r", "t").collect():
            new = {(k, x, y) for x in range(l, r) for y in range(b, t)}
            assert not new & out  # rectangles are disjoint
            out |= new
        return out

    a, b, c = some(25), some(25), some(8)
    pa_, pb, pc = (points(region.union(df, cell=32)) for df in (a, b, c))
    both = region.replace_local(a, b, c, cell=32)
    assert points(both) == (pa_ - pb) | pc
    assert both._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    # A side is used twice, and a step by two later ones.
    steps = [("union", 0), ("xor", 3, 1), ("intersection", 4, 3), ("difference", 5, 2)]
    assert points(region.chain([a, b, c], steps, cell=32)) == (pa_ - pb) - pc
    assert region.chain([a], [("union", 0), ("xor", 1, 0)], cell=32).isEmpty()
    # Signed boxes keep their weights in a chain.
    signed = a.withColumn("w", F.lit(1)).unionByName(a.withColumn("w", F.lit(-1))).unionByName(c.withColumn("w", F.lit(2)))
    assert points(region.chain([signed, b], [("union", 0), ("difference", 2, 1)], cell=32)) == pc - pb
    for bad in ([("union", 1)], [("union", 0), ("xor", 0, 2)], [("nand", 0)], [("xor", 0, 0, 0)]):
        with pytest.raises(ValueError):
            region.chain([a], bad)
