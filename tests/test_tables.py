"""Tiles, macros, hierarchy, text layouts, archives, scores and rounds on hand fixtures."""
import math

import pytest
from pyspark.sql import functions as F

from shapeloom import schemas
from shapeloom.errors import CapacityError, LayoutError
from shapeloom.operators import capacity, contours, filters, hierarchy, metrics, pixels, raster, segments as seg, tiling
from shapeloom.plans import prepare, rounds
from shapeloom.sources import archive, glp, shapes


def test_owner_lookup_and_contexts(spark):
    grid = tiling.Grid.from_cuts([0, 50, 100], [0, 40, 100], 10)
    pts = spark.createDataFrame([(0, 0.0, 0.0), (1, 49.5, 20.0), (2, 50.0, 20.0), (3, 100.0, 100.0), (4, -1.0, 0.0)],
                                "i int, x double, y double")
    assert [r["core_id"] for r in tiling.owner(pts, grid, "x", "y").orderBy("i").collect()] == [0, 0, 1, 3, -1]
    t = grid.tiles(spark).filter("core_id = 0").first()
    assert (t["cl"], t["cb"], t["cr"], t["ct"], t["name"]) == (-10, -10, 60, 50, "r0c0")


def test_macros_and_checks(spark):
    first = tiling.macro_boxes(spark, [0, 40, 80, 105], [0, 30, 60], 70).orderBy("macro_id").collect()
    assert [tuple(r)[1:] for r in first] == [(0, 0, 40, 60), (40, 0, 105, 60)]
    assert tiling.cuts_by_size(0, 105, 40) == [0, 40, 80, 105]
    assert tiling.cuts_by_count(3, 13, 4) == [3, 5, 8, 10, 13]
    tiling.check_halo(30, 40, 20, 9.5, 10)
    with pytest.raises(ValueError):
        tiling.check_halo(29, 40, 20, 9.5, 10)
    with pytest.raises(ValueError):
        seg.check_config(10, 15)


def test_macro_borders_are_not_edges(spark, boxes):
    grid = tiling.Grid.from_cuts([0, 50, 100], [0, 50, 100], 10)
    active, members = prepare.prepare_macro(boxes((-20, 10, 120, 90)), (0, 0, 100, 100), (0, 0, 100, 100), grid, 5, 20)
    assert active.filter("x0 = x1").isEmpty() and not active.isEmpty()
    one = tiling.Grid.from_cuts([0, 50], [0, 50], 10)
    active, members = prepare.prepare_macro(boxes((-8, 10, 40, 40)), (-10, 0, 50, 50), (0, 0, 50, 50), one, 5, 20)
    left = members.filter("sx = -8 and ex = -8")
    assert not left.isEmpty() and left.filter("owner_id <> -1").isEmpty()


def test_owned_and_opaque_pixels(spark):
    tiles = spark.createDataFrame([(0, 0, 0, 50, 40, -10, -10, 60, 50)],
                                  "core_id long, l long, b long, r long, t long, cl long, cb long, cr long, ct long")
    canvas = raster.canvas_scaffold(spark.createDataFrame([(0,)], "core_id long"), 7, 7).withColumn("value", F.lit(1.0))
    own = raster.owned_pixels(canvas, tiles, 10).agg(F.count("*"), F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    assert tuple(own) == (20, 1, 4, 1, 5)


def layout(spark):
    cells = spark.createDataFrame([("TOP",), ("LEAF",)], schemas.CELLS)
    s = [("LEAF", 1, 0, 1, "box", 0, 0, 100, 50), ("LEAF", 1, 0, 2, "path", 0, 90, 100, 110),
         ("LEAF", 1, 0, 3, "polygon", 0, 150, 100, 250), ("LEAF", 1, 0, 4, "text", 5, 5, 5, 5),
         ("TOP", 1, 0, 5, "polygon", -100, -50, 100, 50), ("TOP", 2, 5, 6, "box", -200, -200, -100, -100)]
    i = [("TOP", "LEAF", 1000, 0, 1, 0, 0, 0, 0, 0, 1, 1), ("TOP", "LEAF", 0, 1000, 0, 1, 0, 0, 0, 0, 1, 1),
         ("TOP", "LEAF", 0, 2000, 0, 0, 300, 0, 0, 400, 3, 2)]
    return shapes.Layout(cells, spark.createDataFrame(s, schemas.CELL_SHAPES),
                         spark.createDataFrame(i, schemas.CELL_INSTANCES))


def test_hierarchy(spark):
    lay = layout(spark)
    assert lay.top == "TOP"
    stats = {(r["layer"], r["datatype"]): (r["polygon_like"], r["text"]) for r in lay.stats().collect()}
    assert stats == {(1, 0): (25, 8), (2, 5): (1, 0)}
    assert [(r["cell"], r["children"]) for r in lay.children().orderBy("cell").collect()] == [("LEAF", []), ("TOP", ["LEAF"])]
    assert filters.layer_list(lay.shapes).collect()[1][:] == (2, 5)
    with pytest.raises(LayoutError):
        lay.query([(9, 0)])
    with pytest.raises(LayoutError):
        hierarchy.top_cell(lay.cells, lay.instances, "NONE")
    whole = lay.query([(1, 0)])
    box = (0, 2000, 350, 2120)
    want = filters.candidates(whole, box).count()
    assert lay.query([(1, 0)], box, clip=False).count() == want > 0


def test_large_array_is_pruned_before_expansion(spark):
    s = spark.createDataFrame([("LEAF", 1, 0, 1, "box", 0, 0, 100, 100)], schemas.CELL_SHAPES)
    i = spark.createDataFrame([("TOP", "LEAF", 0, 0, 0, 0, 200, 0, 0, 200, 1000, 1000)], schemas.CELL_INSTANCES)
    flat = hierarchy.flatten(s, i, "TOP", (90000, 90000, 91000, 91000))
    assert filters.candidates(flat, (90000, 90000, 91000, 91000)).count() == 25


GOOD = """BEGIN /* a
comment */
EQUIV 1 1000 MICRON +X,+Y
LEVEL METAL
LEVEL E1TARGET
CELL TOP PRIME
RECT N METAL 10 20 30 40
PGON N METAL 100 100 140 100 120 130
ENDMSG"""


def test_text_layout(spark):
    texts = [("good", GOOD), ("nomap", GOOD.replace("RECT N METAL", "PATH N METAL")),
             ("polarity", GOOD.replace("RECT N", "RECT P")), ("tail", GOOD + "\nBEGIN"), ("cut", "BEGIN\nLEVEL M1")]
    df = spark.createDataFrame(texts, "file string, text string")
    parsed = glp.parse(df, {"METAL": (7, 2)}).checkpoint()
    good = glp.shapes(parsed).filter("file = 'good'")
    area = good.select(F.abs(contours.ring_area2(F.col("rings")[0])).alias("a")).agg(F.sum("a")).first()[0]
    assert area == 3600 and {(r["layer"], r["datatype"]) for r in good.collect()} == {(7, 2)}
    assert glp.units(parsed).filter("file = 'good'").first()["dbu_um"] == 0.001
    bad = {(r["file"], r["code"]) for r in glp.issues(parsed).collect()}
    assert bad == {("nomap", "unknown_statement"), ("polarity", "bad_shape"), ("tail", "after_endmsg"),
                   ("cut", "missing_equiv"), ("cut", "missing_cell"), ("cut", "missing_endmsg")}
    unmapped = glp.issues(glp.parse(df.filter("file = 'good'")))
    assert {r["code"] for r in unmapped.collect()} == {"unmapped_level"}
    two = spark.createDataFrame([("f", "EQUIV 1 1000 MICRON\nLEVEL M12\nCELL A\nCELL B\nRECT N M12 20 0 10 10\nENDMSG")],
                                "file string, text string")
    got = glp.shapes(glp.parse(two)).first()
    assert (got["cell"], got["layer"], got["datatype"]) == ("B", 12, 0)


def test_archive(spark, tmp_path, boxes):
    path = str(tmp_path / "arc")
    archive.write_archive({"boxes": boxes((0, 0, 1, 1), (2, 2, 3, 3))}, path, "demo", 2, '{"pixel": 5}')
    schema = {"boxes": boxes((0, 0, 1, 1)).schema}
    tables, meta = archive.read_archive(spark, path, "demo", (1, 2), schema)
    assert tables["boxes"].count() == 2 and meta == '{"pixel": 5}'
    for fmt, versions, want in (("other", (2,), schema), ("demo", (1,), schema), ("demo", (2,), {"pixels": schemas.PIXELS}),
                                ("demo", (2,), {"boxes": schemas.PIXELS})):
        with pytest.raises(LayoutError):
            archive.read_archive(spark, path, fmt, versions, want)
    with pytest.raises(LayoutError):
        archive.write_archive({"boxes": boxes((0, 0, 1, 1))}, path, "demo", 2)


def test_shape_and_tile_sinks(spark, tmp_path, boxes):
    b = boxes((0, 0, 10, 10), (9000, 5, 9010, 15)).withColumn("datatype", F.lit(0))
    shapes.write_shapes(b, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.filter("l >= 9000").count() == 1 and back.count() == 2
    grid = tiling.Grid.from_cuts([0, 50, 100], [0, 40], 10)
    full = raster.canvas_scaffold(grid.tiles(spark).select("core_id"), 6, 7).withColumn("value", F.lit(1.0))
    m = archive.write_tiles(full, grid.tiles(spark), str(tmp_path / "t"), 10).orderBy("core_id").collect()
    assert [(r["origin_x"], r["origin_y"], r["height"], r["width"]) for r in m] == [(0, 0, 4, 5), (50, 0, 4, 5)]


def picture(spark, rows, image=0):
    return spark.createDataFrame([(image, y, x, float(v)) for y, r in enumerate(rows) for x, v in enumerate(r)], schemas.PIXELS)


def test_edge_probe_fixture(spark):
    target = [[1.0 if 2 <= y <= 5 and 2 <= x <= 5 else 0.0 for x in range(8)] for y in range(8)]
    shown = [r[:] for r in target]
    shown[3][3], shown[4][6], shown[5][3], shown[5][6] = 0.0, 1.0, 0.0, 1.0
    inner, outer = [(3, 3), (4, 4), (3, 5), (1, 1), (3, 3)], [(1, 3), (6, 4), (6, 5), (0, 1), (3, 3)]
    p = spark.createDataFrame([(i, 0, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(inner, outer))],
                              "probe_id long, image_id long, inner_x double, inner_y double, outer_x double, outer_y double")
    got = metrics.edge_probes(p, picture(spark, target), picture(spark, shown)).orderBy("probe_id").collect()
    assert [r["valid"] for r in got] == [True, True, True, False, False]
    assert [r["inner_violation"] for r in got] == [True, False, True, False, False]
    assert [r["outer_violation"] for r in got] == [False, True, True, False, False]
    assert [r["direction"] for r in got] == [1, -1, 0, 0, 0]


def test_shots(spark):
    box = [[2 <= y <= 5 and 1 <= x <= 6 for x in range(8)] for y in range(8)]
    ell = [[(1 <= y <= 6 and 1 <= x <= 2) or (5 <= y <= 6 and 3 <= x <= 6) for x in range(8)] for y in range(8)]
    ring = [[1 <= y <= 6 and 1 <= x <= 6 and not (2 <= y <= 5 and 2 <= x <= 5) for x in range(8)] for y in range(8)]
    df = picture(spark, box, 0).union(picture(spark, ell, 1)).union(picture(spark, ring, 2))
    assert {r["image_id"]: r["shots"] for r in metrics.shot_count(df).collect()} == {0: 1, 1: 2, 2: 4}


def test_distance_extremes(spark):
    df = picture(spark, [[1] * 3] * 2, 0).union(picture(spark, [[0] * 3] * 2, 1))
    got = {r["image_id"]: r["value"] for r in pixels.signed_distance(df, 0.5, 2, 3).collect()}
    assert got == {0: -3.0, 1: 3.0}


def test_soft_raster_is_exact_without_movement(spark):
    base = picture(spark, [[0.25, 0.5], [0.0, 1.0]]).withColumnRenamed("image_id", "core_id").withColumn(
        "cl", F.lit(0)).withColumn("cb", F.lit(0))
    s = spark.createDataFrame([(0, 0.0, 0.0, 20.0, 0.0, 0.0, -1.0, d) for d in (0.0, 2.0)],
                              "core_id long, sx double, sy double, ex double, ey double, nx double, ny double, d double")
    still = pixels.soft_edge_raster(base, s.filter("d = 0"), 10, 2.0)
    assert {tuple(r) for r in still.collect()} == {tuple(r) for r in base.select("core_id", "y", "x", "value").collect()}
    moved = {(r["y"], r["x"]): r["value"] for r in pixels.soft_edge_raster(base, s, 10, 2.0).collect()}
    sig = lambda v: 1 / (1 + math.exp(-v))
    want = 0.25 + sig(5 / 2) * sig(15 / 2) * (sig((2 + 5) / 2) - sig(5 / 2))
    assert moved[(0, 0)] == pytest.approx(want, abs=1e-12)


def test_membership_limit(spark, boxes):
    grid = tiling.Grid.even((0, 0, 100, 100), 10, 0)
    with pytest.raises(CapacityError):
        tiling.membership(boxes((0, 0, 100, 100)), grid, limit=5)
    assert tiling.membership(boxes((0, 0, 100, 100)), grid, limit=100).count() == 100


def test_preflight_bounds_the_real_counts(spark, polygons):
    p = polygons([[(0, 0), (0, 300), (170, 300), (170, 0)]])
    grid = tiling.Grid.even((0, 0, 170, 300), 64, 8)
    e = contours.ring_edges(p, ("layer",))
    row = capacity.preflight(e, grid, 8, 25, 1 << 30).first()
    s = seg.prepare(e, 8, 25)
    assert row["accepted"] and row["segments"] == s.count()
    assert row["memberships"] >= seg.memberships(s, grid).count()
    assert capacity.preflight(e, grid, 8, 25, 10).first()["reason"] == "too_many_bytes"


def test_long_rings_are_dealt_by_edge(spark, polygons):
    ring = [(230, 130), (140, 140), (150, 220), (210, 210)]
    hull = [(0, 0), (0, 90), (120, 90), (120, 40), (60, 40), (60, 0)]
    s = seg.prepare(contours.ring_edges(polygons([ring], [hull]), ("layer",)), 5, 20)
    s = s.withColumn("d", ((F.col("seg_ord") * 3 + F.col("ord")) % 4).cast("double"))
    rows = sorted(seg.previous_shift(s, 5, 20).collect(), key=lambda r: (r["polygon_id"], r["ord"], r["seg_ord"]))
    for p in (0, 1):
        mine = [r for r in rows if r["polygon_id"] == p]
        assert [r["dp"] for r in mine] == [mine[-1]["d"], *[r["d"] for r in mine[:-1]]]
    out = seg.reconstruct(s, 5, 20).collect()
    ends = {(r["polygon_id"], r["x1"], r["y1"]) for r in out}
    assert ends == {(r["polygon_id"], r["x0"], r["y0"]) for r in out} and len(out) > 10
    # A comb of a hundred thousand edges is one ring.
    n = 25_000
    k = F.col("id")
    comb = spark.range(4 * n).select(
        F.lit(0).cast("long").alias("polygon_id"), F.lit(0).alias("ring_id"), k.cast("int").alias("ord"), F.lit(4 * n).alias("n"),
        (k * 10).alias("x0"), (F.pmod(k, F.lit(2)) * 10).alias("y0"), (k * 10 + 10).alias("x1"), (F.pmod(k + 1, F.lit(2)) * 10).alias("y1"),
        (k * 10 - 10).alias("px"), (F.pmod(k + 1, F.lit(2)) * 10).alias("py"), F.lit(0.0).alias("nx"), F.lit(1.0).alias("ny"),
        F.lit(0).alias("seg_ord"), F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"), (k % 7).cast("double").alias("d"))
    got = seg.previous_shift(comb, 5, 20)
    assert got.count() == 4 * n and got.filter("ord > 0 and dp <> pmod(ord - 1, 7)").isEmpty()


def test_rounds_reach_a_fixed_point_and_roll_back(spark, polygons):
    e = contours.ring_edges(polygons([[(20, 20), (20, 80), (100, 80), (100, 20)]]), ("layer",)).checkpoint()
    grid = tiling.Grid.from_cuts([0, 60, 120], [0, 100], 20)
    s = seg.owners(seg.prepare(e, 10, 40), grid).checkpoint()

    def model(gain):
        def evaluate(mask):
            c = F.explode(F.array(*[F.struct(F.lit(n).alias("condition"), F.lit(v).alias("k")) for n, v in (
                ("nominal", 0.0), ("dose_max", 0.04), ("defocus_min", -0.04))]))
            return mask.withColumn("c", c).select("core_id", "c.condition", "y", "x", (F.col("value") * gain + F.col("c.k")).alias("value"))
        return evaluate

    base = dict(initial_step=4.0, decay_every=2, probe_distance=6.0, pixel=10, corner=10, maximum=40)
    done = rounds.run(e, s, grid, rounds.Settings(iterations=2, max_displacement=8.0, **base), model(1.0))
    first = done.rounds.collect()
    assert done.stop_reason == "zero_epe" and len(first) == 1 and first[0]["epe"] == 0 and first[0]["valid"] > 0
    # Nothing prints: every owned probe asks to move outwards.
    more = rounds.run(e, s, grid, rounds.Settings(iterations=1, max_displacement=8.0, **base), model(0.1))
    rows = more.rounds.orderBy("iteration").collect()
    assert more.stop_reason == "iteration_limit" and more.best_iteration == 0 and len(rows) == 2
    # A thin bar asked to shrink past itself: the whole round is rolled back.
    thin = contours.ring_edges(polygons([[(20, 20), (20, 80), (40, 80), (40, 20)]]), ("layer",)).checkpoint()
    t = seg.owners(seg.prepare(thin, 10, 40), grid).checkpoint()
    wide = dict(base, initial_step=15.0)
    bad = rounds.run(thin, t, grid, rounds.Settings(iterations=2, max_displacement=15.0, **wide),
                     lambda m: model(1.0)(m.withColumn("value", F.lit(1.0))))
    last = bad.rounds.collect()
    assert bad.stop_reason == "no_legal_update" and last[0]["rejected"] > 0 and last[0]["moved"] == 0
    assert bad.best.filter("d <> 0").isEmpty()
    assert rows[0]["epe"] == rows[0]["valid"] and rows[0]["moved"] == rows[0]["epe"] and rows[0]["step"] == 4.0


def test_valid_probes_are_those_of_edge_probes(spark):
    k = F.col("id")
    image = spark.range(2 * 6 * 7).select((k % 2).alias("core_id"), (F.floor(k / 2) % 6).cast("int").alias("y"), F.floor(k / 12).cast("int").alias("x"))
    target = image.withColumn("value", F.pmod(F.hash("core_id", "y", "x"), F.lit(10)) / 10.0)
    printed = image.withColumn("value", F.pmod(F.hash("x", "core_id", "y"), F.lit(10)) / 10.0)
    holes = target.filter("core_id = 0 or x <> 3")  # rows of one image lack a pixel
    at = [((F.pmod(F.hash(k, F.lit(i)), F.lit(100)) / 10.0) - 1).alias(c) for i, c in enumerate(("inner_x", "inner_y", "outer_x", "outer_y"))]
    probes = spark.range(800).select(F.struct(k.alias("polygon_id")).alias("probe_id"), (k % 3).alias("core_id"), *at)
    keys = ("core_id",)
    for t in (target, holes):
        want = metrics.edge_probes(probes, t, printed.join(t.select("core_id", "y", "x"), ["core_id", "y", "x"]), 0.5, keys).filter("valid")
        got = metrics.valid_scores(metrics.valid_probes(probes, t, 0.5, keys), printed, 0.5, keys)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 10


def test_rounds_write_no_segments(spark, polygons):
    """What a round writes follows edges and pixels: long edges make many segments, which are computed again, not stored or dealt."""
    from shapeloom.schemas import SEGMENT_KEY
    e = contours.ring_edges(polygons([[(0, 0), (0, 400), (4000, 400), (4000, 0)]]).repartition(3, "polygon_id"), ("layer",))
    s = seg.owners(seg.prepare(e, 1, 4), tiling.Grid.from_cuts([0, 2000, 4000], [0, 400], 20))
    moved = s.filter("seg_ord = 5").select(*SEGMENT_KEY, F.lit(2.0).alias("d"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (rounds.shifted(s, moved, 3), rounds.shifts_of(s, moved, 3)):
        # The source and the shifts are dealt; their segments are not.
        assert plan(df).count("Exchange") == 2 and plan(df).count("hashpartitioning(polygon_id") == 2 and "Join" not in plan(df)
        assert df.count() == s.count() and df.filter("d = 2").count() == 4 and df.filter("d = 0").count() == s.count() - 4
    same = rounds.shifted(s, moved, 3).drop("d")
    assert same.exceptAll(s.select(*same.columns)).isEmpty()


def test_outlines_and_properties_survive_the_hierarchy(spark):
    ring = [[(0, 0), (0, 100), (60, 100), (60, 0)], [(20, 20), (40, 20), (40, 80), (20, 80)]]
    s = spark.createDataFrame([("LEAF", 1, 0, 1, "polygon", 0, 0, 60, 100, ring, {1: "net"}), ("LEAF", 1, 0, 2, "box", 70, 0, 80, 10, None, None)],
                              schemas.CELL_POLYGONS)
    i = spark.createDataFrame([("TOP", "LEAF", 1000, 0, 1, 1, 0, 0, 0, 0, 1, 1), ("TOP", "LEAF", 0, 0, 0, 0, 0, 0, 0, 0, 1, 1)], schemas.CELL_INSTANCES)
    flat = hierarchy.flatten(s, i, "TOP")
    from shapeloom.operators import region
    assert region.area(region.union(filters.shape_boxes(flat, ("shape_id",)), keys=("shape_id",)), ("shape_id",)).filter(
        "shape_id = 1").first()["area"] == 2 * (6000 - 1200)
    cut = filters.clip_polygons(flat, (10, 10, 30, 50))
    rows = cut.collect()
    assert sum((r["r"] - r["l"]) * (r["t"] - r["b"]) for r in rows) == 20 * 40 - 10 * 30
    assert {r["props"][1] for r in rows} == {"net"} and {r["shape_id"] for r in rows} == {1}


def test_cyclic_hierarchy_is_refused(spark):
    s = spark.createDataFrame([("A", 1, 0, 1, "box", 0, 0, 1, 1)], schemas.CELL_SHAPES)
    one = (0, 0, 0, 0, 0, 0, 0, 0, 1, 1)
    i = spark.createDataFrame([("TOP", "A", *one), ("A", "B", *one), ("B", "A", *one)], schemas.CELL_INSTANCES)
    with pytest.raises(LayoutError):
        hierarchy.flatten(s, i, "TOP")
    with pytest.raises(LayoutError):
        hierarchy.cell_extents(s, i)


def test_paths_off_the_grid_are_refused(spark):
    from shapeloom.functions import scalars
    pts = spark.createDataFrame([([(0, 0), (0, 50), (30, 50)],), ([(0, 0), (100, 100)],)], "p array<struct<x:long,y:long>>")
    got = pts.select(scalars.path_issue("p", 20).alias("a"), scalars.path_issue("p", 21).alias("o"), scalars.path_boxes("p", 20).alias("b")).collect()
    assert [(r["a"], r["o"], r["b"] is None) for r in got] == [(None, "odd_path_width", False), ("slanted_path_leg", "odd_path_width", True)]


def test_absent_pixels_are_zero(spark):
    from shapeloom.operators import metrics, pixels
    px = "image_id long, y int, x int, value double"
    target, shown = spark.createDataFrame([(0, 0, 0, 1.0)], px), spark.createDataFrame([(0, 0, 0, 1.0), (0, 3, 3, 1.0), (1, 0, 0, 1.0)], px)
    assert {r["image_id"]: r["l2"] for r in metrics.binary_mismatch(target, shown).collect()} == {0: 1, 1: 1}
    printed = shown.withColumn("condition", F.lit("nominal"))
    assert {r["image_id"]: r["total"] for r in metrics.loss_terms(target, printed, "nominal").collect()} == {0: 1.0, 1: 1.0}
    mix = {(r["image_id"], r["y"]): r["value"] for r in pixels.blend_images(target, shown, target.limit(0)).collect()}
    assert mix == {(0, 0): 1.0, (0, 3): 1.0, (1, 0): 1.0}


def test_bounds_masks_and_one_input_path(spark, boxes, tmp_path):
    from shapeloom.operators import pixels, quality, tiling
    from shapeloom.plans import prepare
    grid = tiling.Grid.even((0, 0, 100, 60), 50, 10)
    tiles = grid.tiles(spark)
    assert quality.bound_issues(tiles, (0, 0, 100, 60)).isEmpty()
    got = {tuple(r) for r in quality.bound_issues(tiles.filter("col = 1"), (0, 0, 100, 70)).collect()}
    assert got == {("l", 50), ("t", 60)}
    assert quality.bound_issues(tiles.limit(0), (0, 0, 1, 1)).count() == 4

    def image(*ids, n=2):
        rows = [(i, y, x, 1.0) for i in ids for y in range(n) for x in range(n)]
        return spark.createDataFrame(rows, "image_id long, y int, x int, value double")

    bad = pixels.mask_issues(image(1, 2, 3), image(1, 4).unionByName(image(3, n=3)))
    assert {tuple(r) for r in bad.collect()} == {(2, "no_mask"), (3, "other_shape"), (4, "no_image")}
    shapes = boxes((0, 0, 70, 40), (60, 30, 100, 60))
    direct = prepare.problem(spark, shapes, grid, 5, 20)
    prepare.write_problem(*direct, str(tmp_path / "p"))
    for a, b in zip(direct, prepare.problem(spark, str(tmp_path / "p"), grid, 5, 20)):
        assert a.exceptAll(b.select(a.columns)).isEmpty() and a.count() == b.count()
