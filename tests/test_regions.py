"""Set algebra, outlines and rings on hand fixtures; crowded cells; rasters."""
import random

import pytest
from pyspark.sql import functions as F

from shapeloom.operators import contours, filters, raster, region
from shapeloom.plans import prepare


def areas(df):
    return {r["layer"]: r["area"] for r in region.area(df).collect()}


def test_union_of_overlapping_boxes(boxes):
    shape = boxes((0, 0, 100, 100), (50, 0, 150, 100), (150, 100, 200, 150))
    rects = region.union(shape)
    assert areas(rects) == {1: 17500}
    p = prepare.merged_edges(shape)
    got = p.agg(F.count("*"), F.count_distinct("polygon_id"), F.count_distinct("ring_id")).first()
    assert tuple(got) == (8, 2, 2)


def test_keyhole_ring_becomes_a_hole(spark, polygons):
    keyhole = [(0, 0), (0, 100), (100, 100), (100, 0), (50, 0), (50, 25), (75, 25), (75, 75),
               (25, 75), (25, 25), (50, 25), (50, 0)]
    e = contours.ring_edges(polygons([keyhole]), ("layer",))
    rects = region.union(region.ring_boxes(prepare.ring_base(e), ("layer",)))
    assert areas(rects) == {1: 7500}
    edges = region.directed_edges(region.boundary_edges(rects))
    p = contours.polygons(contours.assemble_rings(edges))
    got = p.agg(F.count("*"), F.count_distinct("polygon"), F.count_distinct("ring"), F.count_if("is_hole")).first()
    assert tuple(got) == (8, 1, 2, 4)


def test_operations_against_unit_cells_with_crowded_cells(spark):
    """Narrow and wide cells give the same points; copies are plentiful."""
    rng = random.Random(3)

    def some(n):
        rows = []
        for _ in range(n):
            l, b = rng.randint(-20, 40), rng.randint(-20, 40)
            rows.append((1, l, b, l + rng.randint(1, 20), b + rng.randint(1, 20)))
        return rows + rows[:3] * 20

    def cells(rows):
        return {(x, y) for _, l, b, r, t in rows for x in range(l, r) for y in range(b, t)}

    a, b = some(30), some(20)
    schema = "layer int, l long, b long, r long, t long"
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    ca, cb = cells(a), cells(b)
    want = {"union": ca | cb, "intersection": ca & cb, "difference": ca - cb, "xor": ca ^ cb}
    for op in ("difference", "xor"):
        got = region.sweep(da, db, op, cell=32).collect()
        points = [(x, y) for r in got for x in range(r["l"], r["r"]) for y in range(r["b"], r["t"])]
        assert len(points) == len(set(points)) and set(points) == want[op]
    split = region.union(da.unionByName(db), cell=32).checkpoint()
    assert areas(split) == {1: len(want["union"])}
    # The outline does not depend on how cells were split.
    whole = region.union(da.unionByName(db), cell=512)
    one = region.boundary_edges(split, cell=32).collect()
    two = region.boundary_edges(whole.drop("cx", "cy")).collect()
    assert {tuple(r) for r in one} == {tuple(r) for r in two} and len(one) == len(two)


def test_crowded_cell_and_its_plan(spark):
    """A hundred thousand distinct boxes in one cell; one shuffle between merging copies and the sweep."""
    n = F.col("id")
    b = spark.range(100_000).select((F.col("id") % 1 + 1).cast("int").alias("layer"), (n % 100).alias("l"), (F.floor(n / 100) % 900).alias("b"),
                                    (n % 100 + 1 + F.floor(n / 90_000)).alias("r"), (F.floor(n / 100) % 900 + 1 + F.floor(n / 300)).alias("t"))
    got = region.union(b)
    import numpy as np
    on = np.zeros((1300, 110), bool)
    for r in b.distinct().toLocalIterator():
        on[r["b"]:r["t"], r["l"]:r["r"]] = True
    assert areas(got) == {1: int(on.sum())}
    plan = got._jdf.queryExecution().executedPlan().toString()
    after_merge = plan[:plan.index("HashAggregate")]  # printed from the result down
    assert after_merge.count("Exchange hashpartitioning") == 1, plan


def test_ring_numbers_depend_on_geometry_alone(spark, boxes):
    b = boxes((0, 0, 10, 10), (20, 0, 30, 10), (5, 5, 25, 30), (40, 40, 60, 60), (100, 0, 101, 1))
    e = region.directed_edges(region.boundary_edges(region.difference(b, boxes((45, 45, 50, 50)))))
    one = {tuple(r) for r in contours.assemble_rings(e.repartition(1)).select("ring", "ord", "n", "x0", "y0").collect()}
    two = {tuple(r) for r in contours.assemble_rings(e.repartition(5, "x1")).select("ring", "ord", "n", "x0", "y0").collect()}
    assert one == two and {r[0] for r in one} == {0, 1, 2, 3} and all(min(r for r in one if r[0] == k)[1] == 0 for k in range(4))
    assert contours.unclosed(e).isEmpty() and contours.unclosed(e.filter("x0 <> 100")).count() > 0


def test_slanted_edges_are_refused(spark, polygons):
    e = contours.ring_edges(polygons([[(0, 5), (5, 10), (10, 5), (5, 0)]]), ("layer",)).withColumn("base", F.lit(0).cast("long"))
    assert region.slanted(e).count() == 4
    with pytest.raises(Exception, match="slanted edge"):
        region.union(region.ring_boxes(e)).collect()


def test_long_edges_cross_blocks(spark, boxes):
    long = boxes((-5, 0, 600, 3))
    edges = region.boundary_edges(region.union(long, cell=2), cell=2).collect()
    assert {(r["horizontal"], r["coord"], r["lo"], r["hi"], r["s"]) for r in edges} == {
        (True, 0, -5, 600, 1), (True, 3, -5, 600, -1), (False, -5, 0, 3, 1), (False, 600, 0, 3, -1)}


def test_clip_and_whole(spark, boxes):
    b = boxes((-50, -20, 150, 80), (300, 300, 400, 400)).withColumn("kind", F.lit("box"))
    roi = (0, 0, 100, 50)
    assert [tuple(r) for r in filters.clip(b, roi).select("l", "b", "r", "t").collect()] == [(0, 0, 100, 50)]
    assert [tuple(r) for r in filters.intersecting(b, roi).select("l", "b", "r", "t").collect()] == [(-50, -20, 150, 80)]


def image(df, width, height):
    got = {(r["y"], r["x"]): r["value"] for r in raster.quantised(df).collect()}
    return [[got.get((y, x), 0) for x in range(width)] for y in range(height)]


def test_rasters(spark, boxes):
    assert image(raster.region_raster(boxes((0, 0, 15, 10)), (0, 0, 20, 20), 10), 2, 2) == [[255, 128], [0, 0]]
    assert image(raster.region_raster(boxes((0, 0, 12, 7)), (0, 0, 12, 7), 5), 3, 2) == [[255, 255, 102], [102, 102, 41]]
    ring = region.difference(boxes((0, 0, 20, 20)), boxes((5, 5, 15, 15))).select("layer", "l", "b", "r", "t")
    got = image(raster.region_raster(ring.unionByName(boxes((0, 0, 5, 5))), (0, 0, 20, 20), 5), 4, 4)
    assert got == [[255] * 4, [255, 0, 0, 255], [255, 0, 0, 255], [255] * 4]


def test_general_angle_coverage_against_sampling(spark, polygons):
    ring = [(3, 2), (1, 17), (14, 27), (29, 9)]
    e = contours.ring_edges(polygons([ring]), ("layer",))
    got = {(r["y"], r["x"]): r["value"] for r in raster.ring_coverage(e, 5).collect()}
    n = 40

    def inside(px, py):
        odd = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > py) != (by > py) and px < ax + (py - ay) / (by - ay) * (bx - ax):
                odd = not odd
        return odd

    for y in range(6):
        for x in range(6):
            hit = sum(inside(5 * x + 5 * (i + .5) / n, 5 * y + 5 * (j + .5) / n) for i in range(n) for j in range(n))
            assert abs(got.get((y, x), 0.0) - hit / n / n) < 0.02
    area2 = abs(contours.signed_area2(e).first()["area2"])
    assert abs(sum(got.values()) * 50 - area2) < 1e-6


def test_patch_rules(spark):
    rows = [("a", 1, 0, 0, 50, 50), ("b", 1, 50, 0, 100, 50), ("c", 2, 0, 0, 50, 50),
            ("d", 1, 25, 25, 75, 75), ("a", 3, 500, 500, 510, 510)]
    p = spark.createDataFrame(rows, "patch_id string, layer int, l long, b long, r long, t long")
    got = {tuple(r) for r in filters.patch_issues(p).collect()}
    assert got == {("duplicate_id", "a"), ("ownership_overlap", "a"), ("ownership_overlap", "b"), ("ownership_overlap", "d")}
    assert filters.patch_issues(p.limit(3)).isEmpty()


def test_all_macros_own_what_the_whole_owns(spark, boxes):
    from shapeloom.operators import tiling
    from shapeloom.plans import prepare
    # Shapes in every macro, across macro borders, and one whose lower edge ends at a shape far from it.
    df = boxes((-20, 20, 220, 60), (40, 60, 90, 180), (95, 70, 105, 130), (150, 110, 220, 190), (5, 150, 30, 199), (120, 90, 190, 95))
    grid = tiling.Grid.even((0, 0, 200, 200), 50, 20)
    cols = ["core_id", "sx", "sy", "ex", "ey", "nx", "ny"]
    whole, _ = prepare.prepare_problem(df, grid, 5, 20)
    want = sorted(map(tuple, whole.filter("core_id >= 0").select(*cols).collect()))
    wide = prepare.prepare_macros(df, tiling.Grid.even((0, 0, 200, 200), 100, 250), grid, 5, 20)
    assert sorted(map(tuple, wide.select(*cols).collect())) == want and wide.filter("open").count() == 0
    assert {r.macro_id for r in wide.select("macro_id").distinct().collect()} == {0, 1, 2, 3}
    # A narrow context keeps whole shapes, and marks the edges that leave it.
    # Halos that are far too narrow widen until nothing is open.
    closed = prepare.closed_macros(df, tiling.Grid.even((0, 0, 200, 200), 100, 3), grid, 5, 20)
    assert sorted(map(tuple, closed.select(*cols).collect())) == want
    assert closed.agg(F.max("halo")).first()[0] > 24
    narrow = prepare.prepare_macros(df, tiling.Grid.even((0, 0, 200, 200), 100, 24), grid, 5, 20).collect()
    assert {tuple(r[c] for c in cols) for r in narrow if not r.open} <= set(want) and any(r.open for r in narrow)
