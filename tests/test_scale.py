"""Plans and sizes: what grows with the input is never gathered in one place."""
import pytest
from pyspark.sql import functions as F

from shapeloom.operators import quality, raster, segments as seg, tiling
from shapeloom.plans import rounds
from shapeloom.schemas import SEGMENT_KEY

GRID = tiling.Grid.even((0, 0, 8192, 8192), 4096, 256)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def gathers(df):
    return "Broadcast" in plan(df)


@pytest.fixture
def cut(spark, polygons):
    from shapeloom.operators.contours import ring_edges
    shape = polygons([[(0, 0), (0, 100), (100, 100), (100, 0)]], [[(4000, 4000), (4000, 4200), (4200, 4200), (4200, 4000)]])
    return seg.prepare(ring_edges(shape, ("layer",)), 16, 32)


def test_context_pixels_need_no_table_of_tiles(boxes):
    rects = boxes((0, 0, 300, 300), (4000, 4000, 4200, 4200))
    area = raster.tile_coverage_area(rects, GRID, 256)
    assert "Join" not in plan(area)
    assert {r["core_id"]: r["a"] for r in area.groupBy("core_id").agg(F.sum("area").alias("a")).collect()} == {
        0: 90000 + 40000, 1: 40000, 2: 40000, 3: 40000}


def test_owned_pixels_are_not_gathered(spark, boxes):
    area = raster.tile_coverage_area(boxes((0, 0, 300, 300)), GRID, 256)
    assert not gathers(raster.owned_pixels(area, GRID.tiles(spark), 256))
    assert not gathers(rounds.dense(area.withColumn("value", F.lit(1.0)), GRID, 256))


def test_owners_are_not_gathered(cut):
    owned = seg.owners(cut, GRID)
    found = quality.owner_issues(owned, seg.memberships(cut, GRID), 4)
    assert not gathers(found)
    assert found.isEmpty()


def test_proposed_shifts_are_not_gathered(cut):
    state = cut.select(*SEGMENT_KEY, F.lit(0.0).alias("d"))
    scored = cut.select(F.struct(*SEGMENT_KEY).alias("probe_id"), F.lit(1).alias("direction"))
    after = rounds.propose(state, scored, 2.0, 5.0)
    assert not gathers(after)
    assert {r["d"] for r in after.collect()} == {2.0}


def test_proposed_shifts_of_tables_dealt_alike_are_not_shuffled(spark):
    dealt = spark.range(40).select((F.col("id") % 8).alias("polygon_id"), F.lit(0).alias("ring_id"), F.lit(0).alias("ord"),
                                   (F.col("id") / 8).cast("int").alias("seg_ord")).repartition(3, "polygon_id")
    state = dealt.select(*SEGMENT_KEY, F.col("seg_ord").cast("double").alias("d"))
    scored = dealt.select(F.struct(*SEGMENT_KEY).alias("probe_id"), F.lit(-1).alias("direction")).filter("probe_id.seg_ord > 1")
    after = rounds.propose(state, scored, 2.0, 1.5)
    total = after.groupBy("polygon_id").agg(F.sum("d").alias("d"))
    assert "Join" not in plan(total) and plan(total).count("Exchange") == plan(dealt).count("Exchange") * 2
    assert {(r["seg_ord"], r["d"]) for r in after.collect()} == {(0, 0.0), (1, 1.0), (2, 0.0), (3, 1.0), (4, 1.5)}
    assert {r["d"] for r in total.collect()} == {3.5}
    assert rounds.propose(state, scored.limit(0), 2.0, 9.0).count() == 40
    with pytest.raises(Exception, match="two directions"):
        rounds.propose(state, scored.unionByName(scored), 2.0, 1.5).collect()


def test_soft_edges_are_not_gathered(spark, cut):
    from shapeloom.operators import pixels
    base = GRID.tiles(spark).select("core_id", "cl", "cb", F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(0.5).alias("value"))
    moved = seg.memberships(cut, GRID).withColumn("d", F.lit(2.0))
    assert not gathers(pixels.soft_edge_raster(base, moved, 256, 8.0, 64.0))


def test_probes_of_a_tile_need_no_table_of_tiles(cut):
    probes = rounds.local_probes(seg.owners(cut, GRID), GRID, 10.0, 256)
    assert "Join" not in plan(probes)
    assert probes.count() == cut.count()


def test_statements_are_dealt_once(spark):
    from shapeloom.sources import glp
    corpus = spark.createDataFrame([("a", "BEGIN\nCELL C PRIME\nRECT N M1 0 0 5 5"), ("b", "ENDMSG\n/* x */")], "file string, text string")
    parsed = glp.parse(corpus, {"M1": (7, 2)})
    found = glp.issues(parsed)
    for df in (parsed, found):
        assert plan(df).count("Exchange") == 1 and "Join" not in plan(df)
    assert sorted((r["file"], r["line"] or 0, r["code"]) for r in found.collect()) == [
        ("a", 0, "missing_endmsg"), ("a", 0, "missing_equiv"), ("a", 3, "shape_too_early"),
        ("b", 0, "missing_cell"), ("b", 0, "missing_equiv")]


def test_even_cuts_are_arithmetic(spark):
    x, y = list(range(0, 40_000_000, 4096)) + [40_000_000], [0, 4096, 8192, 9000]
    even, by_cuts = tiling.Grid.even((0, 0, 40_000_000, 9000), 4096), tiling.Grid.from_cuts(x, y)
    assert by_cuts == even
    assert len(plan(by_cuts.tiles(spark))) < 10_000  # no list of cuts in it
    uneven = tiling.Grid.from_cuts([0, 10, 30, 40], [0, 5])
    assert uneven.x.cuts == (0, 10, 30, 40)
    assert [r["l"] for r in uneven.tiles(spark).orderBy("core_id").collect()] == [0, 10, 30]
    # On cuts and by arithmetic, owners and memberships are the same, on borders and outside as well.
    steps = tiling.Grid(tiling.Axis(0, 50, cuts=(0, 20, 40, 50)), tiling.Axis(0, 10, cuts=(0, 10)), 3)
    boxes = spark.createDataFrame([(v, 0, v + w, 5) for v in range(-30, 90) for w in (1, 20)], "l long, b long, r long, t long")
    for clamp in (True, False):
        got = [sorted(tuple(r) for r in tiling.membership(tiling.owner(boxes, g, "l", "b", "o"), g, clamp=clamp).collect())
               for g in (steps, tiling.Grid.from_cuts([0, 20, 40, 50], [0, 10], 3))]
        assert got[0] == got[1]


def test_heights_in_a_slab_are_integers(spark):
    """Pieces that differ by far less than a unit keep their order, and nothing is divided as a decimal."""
    from shapeloom.operators import planar
    n = (1 << 29) - 1
    rows = [(1, 0, 0, n, 1, 1, 0), (1, 0, 0, n - 1, 1, -1, 0)]
    pieces = spark.createDataFrame(rows, "layer int, lx long, ly long, hx long, hy long, wa long, wb long")
    covered = planar._with_cover(pieces.withColumn("lx", F.col("lx") + n - 3).withColumn("hx", F.col("hx") + n - 3), ["layer"], 1 << 30)
    assert "decimal" not in plan(covered)
    assert {r["hx"] - n + 3: r["ca"] for r in covered.collect()} == {n: 0, n - 1: -1}


def test_ordered_members_are_counted_in_their_order(spark):
    rows = [(c, p, 0, 0, s) for c in range(3) for p in range(40) for s in range(5)] + [(1, 7, 0, 0, 2)] * 2 + [(2, 7, 0, 0, 2)]
    members = spark.createDataFrame(rows[::-1], "core_id long, polygon_id long, ring_id int, ord int, seg_ord int")
    found = tiling.member_counts(tiling.ordered_members(members, SEGMENT_KEY, 5), SEGMENT_KEY)
    text = plan(found)
    assert text.count("Exchange hashpartitioning(core_id") == 1 and text.count("Sort [") == 1 and "keys=[core_id#" in text
    assert not any("polygon_id" in line for line in text.splitlines() if "HashAggregate" in line)
    assert sorted(tuple(r) for r in found.collect()) == [(0, 200, 200, 0), (1, 202, 200, 1), (2, 201, 200, 1)]
    assert tiling.parts_for(spark, 10, 4) == 3 and tiling.parts_for(spark, 0) == 2


def test_members_are_thinned_before_they_are_joined(spark):
    from shapeloom.operators import filters
    from shapeloom.plans import prepare
    members = spark.range(100_000).select((F.col("id") % 50).alias("core_id"), F.col("id").alias("polygon_id"),
                                          F.lit(0).alias("ring_id"), F.lit(0).alias("ord"), F.lit(0).alias("seg_ord"))
    state = members.select(*SEGMENT_KEY, F.when(F.col("polygon_id") % 10_007 == 3, 1.0).otherwise(0.0).alias("d"))
    moved = state.filter("d <> 0")
    left = filters.thinned(members, moved, SEGMENT_KEY)
    assert left.columns == members.columns
    assert {3 + i * 10_007 for i in range(10)} <= {r["polygon_id"] for r in left.collect()} and left.count() < 100
    # A full or small bitmap only keeps more.
    assert filters.thinned(members, members, SEGMENT_KEY).count() == 100_000
    assert filters.thinned(members, moved, SEGMENT_KEY, bits=6).count() >= left.count()
    text = plan(prepare.moved_tiles(members, state))
    exact = text.index("SortMergeJoin")
    assert "getbit" in text[exact:] and "getbit" not in text[:exact]
    assert {r["core_id"] for r in prepare.moved_tiles(members, state).collect()} == {(3 + i * 10_007) % 50 for i in range(10)}
    assert prepare.moved_tiles(members, state.withColumn("d", F.lit(0.0))).isEmpty()


def test_shifts_dealt_like_their_segments_are_not_shuffled(spark):
    rows = [(p, 0, 0, s) for p in range(6) for s in range(3)]
    s = spark.createDataFrame(rows, "polygon_id long, ring_id int, ord int, seg_ord int").repartition(3, "polygon_id")
    d = F.when(F.col("polygon_id") == 1, 9.5).when(F.col("polygon_id") == 2, float("nan")).otherwise(1.0)
    state = s.filter("polygon_id <> 0").withColumn("d", d)
    state = state.unionByName(state.filter("polygon_id = 3")).withColumn("seg_ord", F.when(
        (F.col("polygon_id") == 5) & (F.col("seg_ord") == 2), 7).otherwise(F.col("seg_ord")))
    found = seg.displacement_issues(s, state, 9.0)
    got = sorted((r["polygon_id"], r["seg_ord"], r["code"]) for r in found.collect())
    assert got == [*[(p, i, c) for p, c in enumerate(["missing", "out_of_range", "out_of_range", "repeated"]) for i in range(3)],
                   (5, 2, "missing"), (5, 7, "unknown_segment")]
    same = seg.displacement_issues(s, s.withColumn("d", F.lit(0.0)), 9.0)
    assert "Join" not in plan(same) and plan(same).count("Exchange hashpartitioning(polygon_id") == plan(same).count("REPARTITION_BY_NUM")
    assert same.isEmpty()


def test_tasks_of_a_table_follow_its_rows(spark, tmp_path, monkeypatch):
    from catalog import tables
    spark.range(1000).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    assert tables.read(spark, str(tmp_path), "orders").rdd.getNumPartitions() == 2
    monkeypatch.setitem(tables.SPREAD, "orders", ("o_orderkey", 100))
    assert tables.read(spark, str(tmp_path), "orders").rdd.getNumPartitions() == 10
