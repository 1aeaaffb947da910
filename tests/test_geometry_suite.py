"""The five published geometry cases and random unions: counts, ownership, zero shift."""
import random

import pytest
from pyspark.sql import functions as F

from shapeloom.operators import contours, quality, region, segments as seg
from shapeloom.operators.tiling import Grid
from shapeloom.plans import prepare

CORNER, MAXIMUM, HALO = 8, 25, 24
# Fixed coordinates and expected values: polygons, rings, edges, segments, memberships, longest.
CASES = {
    "hole_overlap": ([(-110, -90, 80, 90), (45, -45, 135, 55), (70, 10, 155, 105)],
                     [(-55, -40, 25, 45)], (1, 2, 14, 70, 101, 24.857142857142875)),
    "negative_cross_core": ([(-260, -25, 180, 25), (-35, -150, 35, 135)], [],
                            (1, 1, 12, 78, 127, 25.0)),
    "overlap_corner_touch": ([(-120, -75, 10, 35), (-40, -25, 85, 85), (85, 85, 135, 135)], [],
                             (2, 2, 12, 48, 69, 25.0)),
}
RINGS = {
    "orthogonal_concave": ([(-100, -70), (110, -70), (110, -25), (35, -25), (35, 30), (85, 30),
                            (85, 90), (-100, 90), (-100, 45), (-25, 45), (-25, -15), (-100, -15)],
                           (12, 56, 70, 25.0)),
    "diagonal_angles": ([(-110, -75), (5, -105), (95, -25), (120, 80), (15, 105), (-80, 35)],
                        (6, 39, 55, 24.504385627478452)),
}


def grid_of(l, b, r, t):
    l, b, r, t = l - 20, b - 20, r + 20, t + 20
    return Grid.from_cuts([l, l + (r - l) // 2, r], [b, b + (t - b) // 2, t], HALO)


def case_grid(name):
    plus = CASES[name][0]
    return grid_of(min(p[0] for p in plus), min(p[1] for p in plus),
                   max(p[2] for p in plus), max(p[3] for p in plus))


def test_boolean_cases(spark):
    """All box cases at once, one layer each."""
    names, schema = list(CASES), "layer int, l long, b long, r long, t long"
    plus = [(i, *b) for i, n in enumerate(names) for b in CASES[n][0]]
    first = [(i, *CASES[n][0][0]) for i, n in enumerate(names) if CASES[n][1]]
    holes = [(i, *b) for i, n in enumerate(names) for b in CASES[n][1]]
    cut_out = region.difference(spark.createDataFrame(first, schema), spark.createDataFrame(holes, schema))
    rest = spark.createDataFrame([p for p in plus if p not in first], schema)
    shape = cut_out.select("layer", "l", "b", "r", "t").unionByName(rest).checkpoint()
    edges = prepare.merged_edges(shape).checkpoint()
    cut = prepare.cut_edges(edges, CORNER, MAXIMUM).checkpoint()
    counts = {r["layer"]: tuple(r)[1:] for r in edges.groupBy("layer").agg(
        F.count_distinct("polygon_id"), F.count_distinct("ring_id"), F.count("*")).collect()}
    sizes = {r["layer"]: (r["n"], r["longest"]) for r in cut.groupBy("layer").agg(
        F.count("*").alias("n"), F.max(F.hypot(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy"))).alias("longest")).collect()}
    for i, name in enumerate(names):
        want, one = CASES[name][2], cut.filter(F.col("layer") == i)
        assert (*counts[i], sizes[i][0], seg.memberships(one, case_grid(name)).count()) == want[:5]
        assert sizes[i][1] == pytest.approx(want[5], abs=1e-12)
        assert seg.owners(one, case_grid(name)).filter("core_id < 0").isEmpty()
    assert quality.parameter_issues(cut).isEmpty() and quality.normal_issues(cut).isEmpty()
    rebuilt = seg.reconstruct(cut.withColumn("d", F.lit(0.0)), CORNER, MAXIMUM, keep=("layer", "is_hole")).checkpoint()
    again = prepare.rebuilt_region(rebuilt).checkpoint()
    assert region.is_empty(region.symmetric_difference(again, shape))
    assert seg.ring_issues(edges, rebuilt).isEmpty()
    assert prepare.escaped_holes(rebuilt).isEmpty()


@pytest.mark.parametrize("name", RINGS)
def test_ring_cases(spark, polygons, name):
    ring, want = RINGS[name]
    xs, ys = zip(*ring)
    grid = grid_of(min(xs), min(ys), max(xs), max(ys))
    edges = contours.ring_edges(polygons([ring]), ("layer",))
    cut = seg.prepare(edges, CORNER, MAXIMUM).checkpoint()
    members = seg.memberships(cut, grid)
    longest = cut.agg(F.max(F.hypot(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")))).first()[0]
    assert (edges.count(), cut.count(), members.count()) == want[:3]
    assert longest == pytest.approx(want[3], abs=1e-12)
    rebuilt = seg.reconstruct(cut.withColumn("d", F.lit(0.0)), CORNER, MAXIMUM).collect()
    assert {(r["x1"], r["y1"]) for r in rebuilt} == set(ring) and len(rebuilt) == len(ring)


def test_uniform_outward_growth(spark, boxes):
    shape = boxes((0, 0, 100, 60))
    grid = Grid.from_cuts([0, 53, 100], [0, 60], 10)
    edges = prepare.merged_edges(shape).checkpoint()
    cut = seg.owners(prepare.cut_edges(edges, 10, 20), grid)
    members = seg.memberships(cut.drop("core_id"), grid)
    crossing = members.filter("sx <> ex and least(sx, ex) < 53 and greatest(sx, ex) > 53")
    assert crossing.groupBy("x0", "y0", "seg_ord").agg(F.count_distinct("core_id").alias("c"),
                                                       F.count_distinct("owner_id").alias("o")
                                                       ).filter("c <> 2 or o <> 1").isEmpty()
    for d, want in ((0.0, shape), (5.0, region.grow(shape, 5))):
        moved = seg.reconstruct(cut.withColumn("d", F.lit(d)), 10, 20, keep=("layer", "is_hole"))
        again = prepare.rebuilt_region(moved)
        assert region.is_empty(region.symmetric_difference(again, want))


def test_slanted_quadrilateral_has_no_spikes(spark, polygons):
    ring = [(230, 130), (140, 140), (150, 220), (210, 210)]
    cut = seg.prepare(contours.ring_edges(polygons([ring]), ("layer",)), 5, 20)
    got = seg.reconstruct(cut.withColumn("d", F.lit(0.0)), 5, 20).collect()
    assert {(r["x1"], r["y1"]) for r in got} == set(ring) and len(got) == 4


def test_random_unions_survive_zero_shift(spark):
    rng = random.Random(7)
    rows = []
    for case in range(100):
        for _ in range(rng.randint(2, 8)):
            l, b = rng.randint(-300, 300), rng.randint(-300, 300)
            rows.append((case, l, b, l + rng.randint(8, 139), b + rng.randint(8, 139)))
    shapes = spark.createDataFrame(rows, "layer int, l long, b long, r long, t long")
    edges = prepare.merged_edges(shapes, cell=128).checkpoint()
    cut = prepare.cut_edges(edges, 7, 23)
    rebuilt = seg.reconstruct(cut.withColumn("d", F.lit(0.0)), 7, 23, keep=("layer", "is_hole"))
    assert region.is_empty(region.symmetric_difference(prepare.rebuilt_region(rebuilt), shapes))
    # Areas against counting unit cells.
    want = {}
    for case, l, b, r, t in rows:
        want.setdefault(case, set()).update((x, y) for x in range(l, r) for y in range(b, t))
    got = {r["layer"]: r["area"] for r in region.area(region.union(shapes, cell=64)).collect()}
    assert got == {k: len(v) for k, v in want.items()}
