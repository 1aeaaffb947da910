"""Compositions: merged contours, rasters per tile, preparation, reconstruction, patches."""
from pyspark.sql import functions as F

from catalog import tables as T
from catalog.region_queries import EDGE_SQL, ONE, area_sql, sweep_sql
from catalog.registry import query, scratch
from catalog.segment_queries import EDGES, SEGS, SHIFT, edges, segments, shift
from catalog.shape_queries import ROI, roi
from shapeloom.operators import contours, filters, pixels, quality, raster, region, segments as seg, tiling
from shapeloom.plans import prepare, rounds
from shapeloom.schemas import SEGMENT_KEY
from shapeloom.sources import archive, shapes



# --- set algebra, continued ------------------------------------------------------------------

@query(area_sql(T.BOXES + ", " + T.SOLID + """, sides AS (SELECT layer, 0 AS side, l, b, r, t FROM boxes
 UNION ALL SELECT layer, 1, l, b, r, t FROM solid WHERE kind = 'path'
 UNION ALL SELECT layer, 2, l + 5, b + 5, r + 5, t + 5 FROM solid WHERE kind = 'path')""", "ca > 0 AND cb = 0 OR cc > 0")
       .replace("AS db FROM (", "AS db, sum(dc) AS dc FROM (")
       .replace("CASE side WHEN 1 THEN 1 ELSE 0 END AS db FROM", "CASE side WHEN 1 THEN 1 ELSE 0 END AS db, CASE side WHEN 2 THEN 1 ELSE 0 END AS dc FROM")
       .replace("CASE side WHEN 1 THEN -1 ELSE 0 END FROM", "CASE side WHEN 1 THEN -1 ELSE 0 END, CASE side WHEN 2 THEN -1 ELSE 0 END FROM")
       .replace("sum(db) OVER w AS cb", "sum(db) OVER w AS cb, sum(dc) OVER w AS cc"))
def local_replacement_area(spark, sf_dir):
    """(boxes - paths) + shifted paths."""
    old = T.solid(spark, sf_dir).filter("kind = 'path'")
    new = old.select("layer", *[(F.col(c) + 5).alias(c) for c in "lbrt"])
    return region.area(region.replace_local(T.boxes(spark, sf_dir), old, new))


@query(area_sql(T.BOXES + ", sides AS (SELECT layer, 0 AS side, l - 9 AS l, b - 9 AS b, r + 9 AS r, t + 9 AS t FROM boxes)",
                "ca > 0").replace("l // 512", "CAST(floor(l / 512.0) AS BIGINT)").replace(
    "(r - 1) // 512 + 1", "CAST(floor((r - 1) / 512.0) AS BIGINT) + 1"))
def grown_area(spark, sf_dir):
    return region.area(region.grow(T.boxes(spark, sf_dir), 9))


@query(area_sql(T.BOXES + ", " + T.SOLID + """, sides AS (SELECT layer, 1 AS side, l, b, r, t FROM boxes
 UNION ALL SELECT layer, 0, 0, 0, max(r) + 100, 9000 FROM boxes GROUP BY layer)""", "ca > 0 AND cb = 0"))
def polarity_complement_area(spark, sf_dir):
    """What a field box per layer covers and the shapes do not."""
    b = T.boxes(spark, sf_dir)
    field = b.groupBy("layer").agg(F.lit(0).cast("long").alias("l"), F.lit(0).cast("long").alias("b"),
                                   (F.max("r") + 100).alias("r"), F.lit(9000).cast("long").alias("t"))
    return region.area(region.polarity_complement(b, field))


@query("WITH " + T.BOXES + " SELECT layer, CAST(0 AS BIGINT) AS rectangles FROM boxes GROUP BY layer")
def empty_differences(spark, sf_dir):
    """The merged shapes and the shapes themselves have no difference."""
    b = T.boxes(spark, sf_dir)
    rest = region.chain([b], [("union", 0), ("xor", 1, 0)])
    count = rest.groupBy("layer").agg(F.count("*").alias("n"))
    return b.select("layer").distinct().join(count, "layer", "left").select(
        "layer", F.coalesce("n", F.lit(0)).alias("rectangles"))


@query("WITH " + T.SOLID + ROI + ", " + sweep_sql(
    "sides AS (SELECT layer, 0 AS side, greatest(l, ql) AS l, greatest(b, qb) AS b, least(r, qr) AS r, least(t, qt) AS t"
    " FROM solid, roi WHERE l < qr AND r > ql AND b < qt AND t > qb)", "ca > 0") + """, px AS (
 SELECT layer, x, y, (least(r, ql + (x + 1) * 100) - greatest(l, ql + x * 100)) *
 (least(t, qb + (y + 1) * 100) - greatest(b, qb + y * 100)) AS a FROM (
 SELECT *, unnest(range((b - qb) // 100, (t - qb - 1) // 100 + 1)) AS y FROM (
 SELECT *, unnest(range((l - ql) // 100, (r - ql - 1) // 100 + 1)) AS x FROM covered, roi)))
 SELECT layer, y, x, CAST(round_even(least(sum(a) / 10000.0, 1.0) * 255.0, 0) AS INTEGER) AS value FROM px GROUP BY layer, y, x""")
def coverage_raster(spark, sf_dir):
    """Quantised coverage of the merged shapes inside the region, 100 units per pixel."""
    return raster.quantised(raster.region_raster(T.solid(spark, sf_dir), roi(spark, sf_dir), 100))


@query("WITH " + T.SOLID + """ SELECT shape_id AS polygon_id, 2 * (r - l) * (t - b) AS area FROM solid""")
def slanted_coverage(spark, sf_dir):
    """Coverage of every diamond summed over its pixels gives its exact area."""
    e = contours.ring_edges(T.diagonals(spark, sf_dir))
    cover = raster.ring_coverage(e, 128, ("polygon_id",))
    return cover.groupBy("polygon_id").agg(F.round(F.sum("value") * 16384.0).cast("long").alias("area"))


# --- merged contours ------------------------------------------------------------------------------

CORNERS = """, hv AS (SELECT layer, x, y, max(hs) AS hs, max(vd) AS vd, count(*) AS n FROM (
 SELECT layer, lo AS x, coord AS y, s AS hs, NULL AS vd FROM boundary WHERE horizontal
 UNION ALL SELECT layer, hi, coord, s, NULL FROM boundary WHERE horizontal
 UNION ALL SELECT layer, coord, lo, NULL, 1 FROM boundary WHERE NOT horizontal
 UNION ALL SELECT layer, coord, hi, NULL, -1 FROM boundary WHERE NOT horizontal) GROUP BY layer, x, y)"""


@query("WITH " + sweep_sql(ONE, "ca > 0") + EDGE_SQL + CORNERS + """ SELECT h.layer, e.edges, area2,
 CAST((sum(CASE WHEN n = 4 THEN 2 WHEN hs = vd THEN 1 ELSE -1 END)) / 4 AS BIGINT) AS hulls_less_holes
 FROM hv h JOIN (SELECT layer, count(*) AS edges FROM boundary GROUP BY layer) e ON e.layer = h.layer
 JOIN (SELECT layer, CAST(-2 * sum((r - l) * (t - b)) AS BIGINT) AS area2 FROM covered GROUP BY layer) a ON a.layer = h.layer
 GROUP BY h.layer, e.edges, area2""")
def merged_contours(spark, sf_dir):
    """Rings of the merged shapes per layer: edges, signed area, hulls minus holes."""
    ringed = contours.assemble_rings(region.directed_edges(region.outline(T.boxes(spark, sf_dir))))
    rings = contours.ring_summary(ringed)
    return rings.groupBy("layer").agg(
        F.sum("n").alias("edges"), F.sum("area2").alias("area2"),
        (F.count_if(F.col("area2") < 0) - F.count_if(F.col("area2") > 0)).alias("hulls_less_holes"))


@query("WITH " + T.SOLID + """ SELECT shape_id AS polygon_id, CASE WHEN shape_id % 4 = 0 THEN 8 ELSE 4 END AS edges,
 CASE WHEN shape_id % 4 = 0 THEN 2 ELSE 1 END AS rings, CASE WHEN shape_id % 4 = 0 THEN 4 ELSE 0 END AS hole_edges FROM solid""")
def polygons_with_holes(spark, sf_dir):
    """Rings assembled from loose edges; each hole finds the hull around it."""
    e = edges(spark, sf_dir).select("polygon_id", "x0", "y0", "x1", "y1")
    p = contours.polygons(contours.assemble_rings(e, ("polygon_id",)), ("polygon_id",))
    return p.groupBy("polygon_id").agg(F.count("*").alias("edges"), F.count_distinct("ring").alias("rings"),
                                       F.count_if("is_hole").alias("hole_edges"))


MERGED_SEGS = """, edges AS (SELECT layer, CAST(lo AS BIGINT) AS polygon_id, 0 AS ring_id, 0 AS ord, CASE WHEN horizontal THEN lo ELSE coord END AS x0,
 CASE WHEN horizontal THEN coord ELSE lo END AS y0, CASE WHEN horizontal THEN hi ELSE coord END AS x1,
 CASE WHEN horizontal THEN coord ELSE hi END AS y1 FROM boundary)"""


@query("WITH " + T.SOLID + ", " + sweep_sql("sides AS (SELECT layer, 0 AS side, l, b, r, t FROM solid)", "ca > 0") + EDGE_SQL
       + MERGED_SEGS + T.SEGMENTS + T.MEMBERS + """ SELECT layer, core_id, count(*) AS members,
 count(*) FILTER (WHERE owner_id = core_id) AS owned FROM membership GROUP BY 1, 2""")
def prepared_problem(spark, sf_dir):
    """Merge, outline, cut, own and list memberships, per layer and tile."""
    # Owners and memberships are by place; they need no numbers of rings.
    _, members = prepare.prepare_problem(T.solid(spark, sf_dir), T.grid(spark, sf_dir), T.CORNER, T.MAXIMUM, rings=False)
    return members.groupBy("layer", "core_id").agg(
        F.count("*").alias("members"), F.count_if(F.col("owner_id") == F.col("core_id")).alias("owned"))


@query("WITH " + T.SOLID + ", " + sweep_sql("sides AS (SELECT layer, 0 AS side, l, b, r, t FROM solid)", "ca > 0") + EDGE_SQL
       + MERGED_SEGS + T.SEGMENTS + T.MEMBERS + """ SELECT layer, count(*) AS members, count(*) FILTER (WHERE owner_id = core_id) AS owned,
 round(sum(sx + ex + 2 * (sy + ey)), 3) AS moment FROM membership GROUP BY 1""")
def archived_problem(spark, sf_dir):
    """The prepared problem by the same call from shapes and from its archive: what the archive gives back, per layer."""
    g, path = T.grid(spark, sf_dir), scratch(spark, "problem")
    prepare.write_problem(*prepare.problem(spark, T.solid(spark, sf_dir), g, T.CORNER, T.MAXIMUM, rings=False), path)
    _, members = prepare.problem(spark, path, g, T.CORNER, T.MAXIMUM)
    return members.groupBy("layer").agg(
        F.count("*").alias("members"), F.count_if(F.col("owner_id") == F.col("core_id")).alias("owned"),
        F.round(F.sum(F.col("sx") + F.col("ex") + 2 * (F.col("sy") + F.col("ey"))), 3).alias("moment"))


@query(SEGS + T.MEMBERS + """ SELECT s.polygon_id, e.edges, s.segments, m.members, s.longest FROM
 (SELECT polygon_id, count(*) AS segments, round(max(sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy))), 6) AS longest FROM segments GROUP BY 1) s
 JOIN (SELECT polygon_id, count(*) AS edges FROM edges GROUP BY 1) e ON e.polygon_id = s.polygon_id
 JOIN (SELECT polygon_id, count(*) AS members FROM membership GROUP BY 1) m ON m.polygon_id = s.polygon_id""")
def suite_report(spark, sf_dir):
    """The geometry suite's report with every polygon as a case: edges, segments, memberships and the longest segment."""
    s = segments(spark, sf_dir)
    m = seg.memberships(s, T.grid(spark, sf_dir)).groupBy("polygon_id").agg(F.count("*").alias("members"))
    cut = s.groupBy("polygon_id").agg(F.count("*").alias("segments"), F.round(F.max(
        F.hypot(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy"))), 6).alias("longest"))
    e = edges(spark, sf_dir).groupBy("polygon_id").agg(F.count("*").alias("edges"))
    return e.join(cut.hint("merge"), "polygon_id").join(m.hint("merge"), "polygon_id")


@query("WITH " + T.SOLID + T.EXTENT + """ SELECT * FROM (SELECT 'r' AS side, (ncols - 1) * 4096 AS found FROM grid
 UNION ALL SELECT 't', least(2 * 4096, ye) FROM grid) WHERE (side = 'r') OR found <> (SELECT ye FROM grid)""")
def region_bound_issues(spark, sf_dir):
    """Borders at which a tiling without its last column and upper rows does not fill its region."""
    g = T.grid(spark, sf_dir)
    some = g.tiles(spark).filter((F.col("col") < g.columns - 1) & (F.col("row") < 2))
    top = T.solid(spark, sf_dir).agg(F.max("r"), F.max("t")).first()
    return quality.bound_issues(some, (0, 0, top[0], top[1]))


@query("WITH " + T.SOLID + T.EXTENT + """, mac AS (SELECT ncols // 2 * 4096 AS ml, xe AS mr, CAST(4096 AS BIGINT) AS mt FROM grid), """
       + sweep_sql("sides AS (SELECT layer, 0 AS side, l, b, r, t FROM solid, mac WHERE l < mr + 300 AND r > ml - 300"
                   " AND b < mt + 300 AND t > -300)", "ca > 0") + EDGE_SQL + MERGED_SEGS + T.SEGMENTS
       + T.OWNERS.replace(T.EXTENT, "") + """, act AS (SELECT o.*, ncols, nrows, ml FROM owners o, mac, grid
 WHERE greatest(sx, ex) >= ml - 300 AND least(sx, ex) <= mr + 300 AND greatest(sy, ey) >= -300 AND least(sy, ey) <= mt + 300),
 mem AS (SELECT owner_id, layer, unnest(range(greatest(ix0, ml // 4096), ix1 + 1)) AS core_id FROM (
 SELECT core_id AS owner_id, layer, ml, greatest(CAST(ceil((least(sx,ex)-256)/4096) AS BIGINT)-1, 0) AS ix0,
 least(CAST(floor((greatest(sx,ex)+256)/4096) AS BIGINT), ncols-1) AS ix1 FROM act
 WHERE least(sy, ey) <= 4096 + 256 AND greatest(sy, ey) >= -256 AND least(sx,ex) <= 256 + (SELECT xe FROM extent)))
 SELECT layer, core_id, count(*) AS members, count(*) FILTER (WHERE owner_id = core_id) AS owned FROM mem GROUP BY 1, 2""")
def prepared_macro(spark, sf_dir):
    """Right half of the lowest tile row as one macro, from whole intersecting shapes."""
    g = T.grid(spark, sf_dir)
    left, right = g.columns // 2 * T.TILE, g.x.end
    _, members = prepare.prepare_macro(
        T.solid(spark, sf_dir), (left - 300, -300, right + 300, T.TILE + 300), (left, 0, right, T.TILE), g,
        T.CORNER, T.MAXIMUM)
    return members.groupBy("layer", "core_id").agg(
        F.count("*").alias("members"), F.count_if(F.col("owner_id") == F.col("core_id")).alias("owned"))


@query("WITH " + T.SOLID + ", " + sweep_sql("sides AS (SELECT layer, 0 AS side, l, b, r, t FROM solid)", "ca > 0") + EDGE_SQL
       + MERGED_SEGS + T.SEGMENTS + T.OWNERS + """ SELECT layer, (core_id // ncols // 4) * ((ncols + 3) // 4) + core_id % ncols // 4 AS macro_id,
 count(*) AS owned, 0 AS missing, 0 AS extra, 0 AS open FROM owners, grid WHERE core_id >= 0 GROUP BY 1, 2""")
def macros_equal_whole(spark, sf_dir):
    """Every macro of 4 x 4 tiles prepared on its own: its owned segments are those of the whole."""
    g, shapes = T.grid(spark, sf_dir), T.solid(spark, sf_dir)
    macros = tiling.Grid.even(g.bounds, 4 * T.TILE, 1024)
    # Segments are compared by place; they need no numbers of rings.
    parts, whole = prepare.macro_edges(shapes, macros, rings=False), prepare.merged_edges(shapes, rings=False)
    return prepare.macro_balance(parts, whole, macros, g, T.CORNER, T.MAXIMUM, tasks=tiling.parts_for(spark, shapes.count(), prepare.EDGES))


WIRED = "WITH " + T.SOLID + ", " + sweep_sql("""sides AS (SELECT layer, 0 AS side, l, b, r, t FROM solid UNION ALL
 SELECT layer, 0, l, b, least(l + 30000, (SELECT max(r) FROM solid)), b + 24 FROM solid WHERE shape_id % 40 = 0)""", "ca > 0")


@query(WIRED + EDGE_SQL + MERGED_SEGS + T.SEGMENTS + T.OWNERS + """ SELECT layer, (core_id // ncols // 4) * ((ncols + 3) // 4) + core_id % ncols // 4 AS macro_id,
 count(*) AS owned, round(sum(sx + ex + 2 * (sy + ey)), 3) AS moment FROM owners, grid WHERE core_id >= 0 GROUP BY 1, 2""")
def long_wires_by_macro(spark, sf_dir):
    """Macros of 4 x 4 tiles prepared apart, with wires that cross several of them and halos that widen as they need to."""
    g, shapes_ = T.grid(spark, sf_dir), T.solid(spark, sf_dir).select("layer", "shape_id", "l", "b", "r", "t")
    wires = shapes_.filter("shape_id % 40 = 0").select(
        "layer", "shape_id", "l", "b", F.least(F.col("l") + 30_000, F.lit(g.x.end)).alias("r"), (F.col("b") + 24).alias("t"))
    macros = tiling.Grid.even(g.bounds, 4 * T.TILE, 1024)
    parts = prepare.closed_macros(shapes_.unionByName(wires), macros, g, T.CORNER, T.MAXIMUM, rings=False)
    return parts.groupBy("layer", "macro_id").agg(
        F.count("*").alias("owned"), F.round(F.sum(F.col("sx") + F.col("ex") + 2 * (F.col("sy") + F.col("ey"))), 3).alias("moment"))


# --- reconstruction ------------------------------------------------------------------------------------

REBUILT = SEGS + f""", st AS (SELECT *, {SHIFT} AS d FROM segments),
pr AS (SELECT *, coalesce(lag(d) OVER w, last_value(d) OVER v) AS dp, coalesce(lag(x0) OVER w, last_value(x0) OVER v) AS ax,
 coalesce(lag(y0) OVER w, last_value(y0) OVER v) AS ay, coalesce(lag(nx) OVER w, last_value(nx) OVER v) AS pnx,
 coalesce(lag(ny) OVER w, last_value(ny) OVER v) AS pny FROM st
 WINDOW w AS (PARTITION BY polygon_id, ring_id ORDER BY ord, seg_ord), v AS (PARTITION BY polygon_id, ring_id ORDER BY ord, seg_ord
 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
jn AS (SELECT *, sx + dp * pnx AS bx, sy + dp * pny AS b_y, sx + d * nx AS hx, sy + d * ny AS hy,
 CASE WHEN seg_ord = 0 THEN CASE WHEN x0 = ax THEN x0 + dp * pnx ELSE x0 + d * nx END END AS ix,
 CASE WHEN seg_ord = 0 THEN CASE WHEN x0 = ax THEN y0 + d * ny ELSE y0 + dp * pny END END AS iy FROM pr),
ok AS (SELECT *, sqrt((ix - x0) ** 2 + (iy - y0) ** 2) > 1.2 * greatest(abs(d), abs(dp), 1.0) AS bevel FROM jn),
pts AS (SELECT polygon_id, ring_id, ord, seg_ord, 0 AS k, CASE WHEN seg_ord = 0 AND NOT bevel THEN ix ELSE bx END AS x,
 CASE WHEN seg_ord = 0 AND NOT bevel THEN iy ELSE b_y END AS y FROM ok WHERE seg_ord = 0 OR abs(d - dp) > 1e-12
 UNION ALL SELECT polygon_id, ring_id, ord, seg_ord, 1, hx, hy FROM ok WHERE CASE WHEN seg_ord = 0 THEN bevel ELSE abs(d - dp) > 1e-12 END),
rp AS (SELECT polygon_id, ring_id, ord, seg_ord, k, CAST(round_even(x, 0) AS BIGINT) AS x, CAST(round_even(y, 0) AS BIGINT) AS y FROM pts),
el AS (SELECT *, coalesce(lag(x) OVER w, last_value(x) OVER v) AS qx, coalesce(lag(y) OVER w, last_value(y) OVER v) AS qy FROM rp
 WINDOW w AS (PARTITION BY polygon_id, ring_id ORDER BY ord, seg_ord, k), v AS (PARTITION BY polygon_id, ring_id ORDER BY ord, seg_ord, k
 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
made AS (SELECT * FROM el WHERE x <> qx OR y <> qy)"""
MITER = 1.2


def rebuilt(spark, sf_dir, d=None, keep=()):
    s = segments(spark, sf_dir).withColumn("d", shift() if d is None else d)
    return seg.reconstruct(s, T.CORNER, T.MAXIMUM, MITER, keep)


@query(REBUILT + """ SELECT polygon_id, ring_id, count(*) AS points, CAST(sum(qx * y - x * qy) AS BIGINT) AS area2,
 CAST(sum((ord + 1) * (x + 3 * y)) AS BIGINT) AS checksum FROM made GROUP BY 1, 2""")
def reconstructed_contours(spark, sf_dir):
    """Jogs inside edges, intersections or bevels at corners, rounded to the grid."""
    e = rebuilt(spark, sf_dir)
    return e.groupBy("polygon_id", "ring_id").agg(
        F.count("*").alias("points"), F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")).alias("area2"),
        F.sum((F.col("ord") + 1) * (F.col("x1") + 3 * F.col("y1"))).alias("checksum"))


@query(SEGS + f""" SELECT polygon_id, ring_id, ord, seg_ord, CASE WHEN seg_ord > 0 THEN
 CASE WHEN abs(d - dp) <= 1e-12 THEN 0 ELSE 2 END
 WHEN sqrt(d * d + dp * dp) > 1.2 * greatest(abs(d), abs(dp), 1.0) THEN 2 ELSE 1 END AS points
 FROM (SELECT *, coalesce(lag(d) OVER w, last_value(d) OVER v) AS dp FROM (SELECT *, {SHIFT} AS d FROM segments)
 WINDOW w AS (PARTITION BY polygon_id, ring_id ORDER BY ord, seg_ord), v AS (PARTITION BY polygon_id, ring_id
 ORDER BY ord, seg_ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""".replace(
    "SELECT polygon_id, ring_id, ord, seg_ord, CASE", "SELECT points, count(*) AS junctions FROM (SELECT CASE") + ") GROUP BY points")
def junction_kinds(spark, sf_dir):
    """How many junctions emit no point, one intersection, or two points."""
    s = segments(spark, sf_dir).withColumn("d", shift())
    p = seg.junction_points(s, T.CORNER, T.MAXIMUM, MITER)
    return p.groupBy(F.coalesce(F.size("pts"), F.lit(0)).alias("points")).agg(F.count("*").alias("junctions"))


@query(EDGES + """ SELECT polygon_id, CAST(sum(CASE WHEN ring_id = 0 THEN 1 ELSE -1 END * abs(a)) // 2 AS BIGINT) AS area,
 CAST(0 AS BIGINT) AS xor_area FROM (SELECT polygon_id, ring_id, sum(x0 * y1 - x1 * y0) AS a FROM edges GROUP BY 1, 2) GROUP BY 1""")
def zero_shift_reconstruction(spark, sf_dir):
    """Without displacement the rebuilt region equals the source: area, and XOR area 0."""
    keys = ("polygon_id",)
    # One polygon per key, so no cell can be crowded.
    back = prepare.rebuilt_region(rebuilt(spark, sf_dir, F.lit(0.0), ("low",)), keys)
    source = prepare.rebuilt_region(edges(spark, sf_dir), keys)
    cols = ["polygon_id", "l", "b", "r", "t"]
    xor = region.area(region.symmetric_difference(back.select(*cols), source.select(*cols), keys=keys), keys)
    return region.area(source, keys).join(xor.withColumnRenamed("area", "xor_area").hint("merge"), "polygon_id", "left").select(
        "polygon_id", "area", F.coalesce("xor_area", F.lit(0)).alias("xor_area"))


@query("WITH " + T.SOLID + """, h AS (SELECT shape_id, r - l - 50 AS w, t - b - 50 AS h FROM solid WHERE shape_id % 4 = 0)
 SELECT shape_id AS polygon_id, CAST(1 AS INTEGER) AS ring_id, CASE WHEN shape_id % 5 = 0 THEN 'lost_ring' WHEN w = 0 OR h = 0 THEN 'zero_area_ring'
 ELSE 'reversed_ring' END AS code FROM h WHERE shape_id % 5 = 0 OR w = 0 OR h = 0 OR (w < 0) <> (h < 0)
 UNION ALL SELECT shape_id, CAST(2 AS INTEGER), 'new_ring' FROM h WHERE shape_id % 7 = 0""")
def reversed_rings(spark, sf_dir):
    """Holes shrunk by 10 on each side: thin ones turn over or vanish; some are left out, some copied as a ring of their own."""
    e = edges(spark, sf_dir)
    s = segments(spark, sf_dir).withColumn("d", F.when(F.col("is_hole"), 10.0).otherwise(0.0))
    after = seg.reconstruct(s, T.CORNER, T.MAXIMUM, 4.0).select("polygon_id", "ring_id", "x0", "y0", "x1", "y1")
    extra = e.filter("is_hole and polygon_id % 7 = 0").select("polygon_id", F.lit(2).alias("ring_id"), "x0", "y0", "x1", "y1")
    after = after.filter("ring_id = 0 or polygon_id % 5 <> 0").unionByName(extra)
    return seg.ring_issues(e, after).select("polygon_id", "ring_id", "code")


@query("WITH " + T.SOLID + " SELECT shape_id AS polygon_id FROM solid WHERE shape_id % 4 = 0 AND shape_id % 3 = 0")
def escaped_holes(spark, sf_dir):
    """Holes moved partly out of their hull on every third polygon."""
    e = edges(spark, sf_dir)
    by = F.when(F.col("is_hole") & (F.col("polygon_id") % 3 == 0), 16).otherwise(0)
    moved = e.withColumn("x0", F.col("x0") + by).withColumn("x1", F.col("x1") + by)
    return prepare.escaped_holes(moved)


# --- patches, tiles, archives ------------------------------------------------------------------------------

def patch_table(spark, sf_dir):
    """Ownership boxes: tiles per layer; some ids repeated, some boxes overlapping."""
    t = T.grid(spark, sf_dir).tiles(spark)
    t = t.withColumn("layer", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    wide = (F.col("layer") == 1) & (F.col("col") % 9 == 4)
    return t.select("layer", "core_id", "row", "col", F.concat_ws("-", "layer", "name").alias("patch_id"), "l", "b",
                    F.when(wide, F.col("r") + 10).otherwise(F.col("r")).alias("r"), "t")


@query("WITH " + T.SOLID + T.EXTENT + """, p AS (SELECT row, col, ncols, nrows FROM (SELECT *, unnest(range(0, ncols)) AS col FROM
 (SELECT *, unnest(range(0, nrows)) AS row FROM grid)))
 SELECT 'ownership_overlap' AS code, '1-r' || row || 'c' || col AS patch_id FROM p
 WHERE (col % 9 = 4 AND col < ncols - 1) OR (col % 9 = 5)
 UNION ALL SELECT 'duplicate_id', '2-r' || row || 'c' || col FROM p WHERE col % 11 = 3
 UNION ALL SELECT 'ownership_overlap', '2-r' || row || 'c' || col FROM p WHERE col % 11 = 3""")
def patch_conflicts(spark, sf_dir):
    p = patch_table(spark, sf_dir)
    twice = p.filter("layer = 2 and col % 11 = 3")
    return filters.patch_issues(p.unionByName(twice))


@query("WITH " + T.SOLID + T.EXTENT + """, m AS (SELECT layer, shape_id, l, b, r, t, ix, iy FROM (SELECT *, unnest(range(l // 4096, (r - 1) // 4096 + 1)) AS ix
 FROM (SELECT *, unnest(range(b // 4096, (t - 1) // 4096 + 1)) AS iy FROM solid)))
 SELECT layer, layer || '-r' || iy || 'c' || ix AS patch_id, shape_id, greatest(l, ix * 4096) AS l, greatest(b, iy * 4096) AS b,
 least(r, (ix + 1) * 4096) AS r, least(t, (iy + 1) * 4096) AS t FROM m""")
def ownership_patches(spark, sf_dir):
    """Every shape cut to the ownership boxes of the tiles it reaches."""
    g = T.grid(spark, sf_dir)
    flat = tiling.Grid(g.x, g.y, 0)
    own = g.tiles(spark).select("core_id", F.col("name"), "l", "b", "r", "t")
    reach = tiling.membership(T.solid(spark, sf_dir).drop("kind"), flat)
    ids = own.select(F.concat_ws("-", F.lit("t"), "core_id").alias("patch_id"), "core_id", "name", "l", "b", "r", "t")
    s = reach.withColumn("patch_id", F.concat_ws("-", F.lit("t"), "core_id"))
    cut = filters.patches(s.drop("core_id"), ids.select("patch_id", "l", "b", "r", "t")).join(
        ids.select("patch_id", "name"), "patch_id")
    path = scratch(spark, "patches")
    shapes.write_patches(cut.select("layer", F.lit(0).alias("datatype"), F.concat_ws("-", "layer", "name").alias("patch_id"),
                                    "shape_id", "l", "b", "r", "t"), path)
    return spark.read.parquet(path).select("layer", "patch_id", "shape_id", "l", "b", "r", "t")


@query("WITH " + T.SOLID + T.EXTENT + """, m AS (SELECT layer, shape_id, ix, iy, ncols, xe, ye FROM (SELECT *, unnest(range(l // 4096, (r - 1) // 4096 + 1)) AS ix
 FROM (SELECT *, unnest(range(b // 4096, (t - 1) // 4096 + 1)) AS iy FROM solid, grid))),
 p AS (SELECT DISTINCT layer, ix * 4096 AS ol, iy * 4096 AS ob, least((ix + 1) * 4096, xe) AS o_r, least((iy + 1) * 4096, ye) AS ot, 't-' || (iy * ncols + ix) AS patch_id FROM m)
 SELECT row_number() OVER (ORDER BY layer, ol, ob, o_r, ot, patch_id) - 1 AS position, layer, patch_id FROM p""")
def patches_in_order(spark, sf_dir):
    """Non-empty patches per layer, numbered in the order of layer, ownership box and id."""
    g = T.grid(spark, sf_dir)
    flat = tiling.Grid(g.x, g.y, 0)
    reach = tiling.membership(T.solid(spark, sf_dir).drop("kind"), flat).withColumn("patch_id", F.concat_ws("-", F.lit("t"), "core_id"))
    own = g.tiles(spark).select(F.concat_ws("-", F.lit("t"), "core_id").alias("patch_id"), "l", "b", "r", "t")
    cut = filters.patches(reach.drop("core_id"), own).withColumn("datatype", F.lit(0))
    cut = cut.select("layer", "datatype", "ol", "ob", "o_r", "ot", "patch_id").distinct()
    return filters.with_position(cut, filters.PATCH_ORDER).select("position", "layer", "patch_id")


@query("WITH " + T.RECTS + """ SELECT layer, kind, count(*) AS shapes, CAST(sum(shape_id) AS BIGINT) AS ids FROM rects
 WHERE l < 400000 AND r > 50000 AND b < 5000 AND t > 1000 AND kind <> 'text' AND layer <> 1 GROUP BY 1, 2""")
def clustered_region_shapes(spark, sf_dir):
    """Shapes written by layer and tile and read back for a region of two layers."""
    path = scratch(spark, "shapes")
    none = F.lit(None).cast("map<int,string>")
    shapes.write_shapes(T.rects(spark, sf_dir).withColumn("datatype", F.lit(0)).withColumn("props", none), path)
    found = shapes.read_shapes(spark, path).filter(F.col("layer").isin(0, 2))
    return filters.candidates(found, (50_000, 1000, 400_000, 5000)).groupBy("layer", "kind").agg(
        F.count("*").alias("shapes"), F.sum("shape_id").alias("ids"))


PIXEL = 256
TILE_PX = "WITH " + T.SOLID + T.EXTENT + """, mem AS (SELECT layer, ix, iy, ncols, greatest(l, ix*4096-256) - (ix*4096-256) AS l,
 greatest(b, iy*4096-256) - (iy*4096-256) AS b, least(r, least((ix+1)*4096, xe)+256) - (ix*4096-256) AS r,
 least(t, least((iy+1)*4096, ye)+256) - (iy*4096-256) AS t FROM (SELECT *, unnest(range(greatest((l-257)//4096, 0), least((r+255)//4096, ncols-1)+1)) AS ix FROM
 (SELECT *, unnest(range(greatest((b-257)//4096, 0), least((t+255)//4096, nrows-1)+1)) AS iy FROM covered, grid))),
px AS (SELECT iy * ncols + ix AS core_id, ix, iy, layer, x, y, CAST(sum((least(r, (x+1)*256) - greatest(l, x*256)) * (least(t, (y+1)*256) - greatest(b, y*256))) AS BIGINT) AS area
 FROM (SELECT *, unnest(range(b // 256, (t-1) // 256 + 1)) AS y FROM (SELECT *, unnest(range(l // 256, (r-1) // 256 + 1)) AS x FROM mem WHERE l < r) WHERE b < t)
 GROUP BY ALL)"""
TILE_SQL = ("WITH " + T.SOLID + ", " + sweep_sql("sides AS (SELECT layer, 0 AS side, l, b, r, t FROM solid)", "ca > 0")
            + TILE_PX.removeprefix("WITH " + T.SOLID))


def tile_areas(spark, sf_dir):
    rects = region.union(T.solid(spark, sf_dir))
    return raster.tile_coverage_area(rects, T.grid(spark, sf_dir), PIXEL)


def tile_ink(spark, sf_dir):
    """Coverage of every tile context, all layers together."""
    return tile_areas(spark, sf_dir).groupBy("core_id", "y", "x").agg((F.sum("area") / float(PIXEL * PIXEL)).alias("value"))


@query(TILE_SQL + " SELECT core_id, layer, count(*) AS pixels, CAST(sum(area) AS BIGINT) AS area, CAST(sum(area * (x + 2 * y)) AS BIGINT) AS moment FROM px GROUP BY 1, 2")
def tile_rasters(spark, sf_dir):
    """Coverage pixels of every tile context, halo included."""
    return tile_areas(spark, sf_dir).groupBy("core_id", "layer").agg(
        F.count("*").alias("pixels"), F.sum("area").alias("area"),
        F.sum(F.col("area") * (F.col("x") + 2 * F.col("y"))).alias("moment"))


OWNED = TILE_SQL + """, own AS (SELECT px.*, xe, ye FROM px, grid WHERE ix*4096-256 + (x+0.5)*256 >= ix*4096 AND ix*4096-256 + (x+0.5)*256 < least((ix+1)*4096, xe)
 AND iy*4096-256 + (y+0.5)*256 >= iy*4096 AND iy*4096-256 + (y+0.5)*256 < least((iy+1)*4096, ye))"""


@query(OWNED + """ SELECT core_id, CAST(sum(area) AS BIGINT) AS area, count(*) AS pixels FROM own GROUP BY 1""")
def owned_tile_pixels(spark, sf_dir):
    """Pixels whose centre lies in the tile itself."""
    px = tile_areas(spark, sf_dir)
    return raster.owned_pixels(px, T.grid(spark, sf_dir).tiles(spark), PIXEL).groupBy("core_id").agg(
        F.sum("area").alias("area"), F.count("*").alias("pixels"))


@query(OWNED + """ SELECT iy * 16 - 1 + y AS y, ix * 16 - 1 + x AS x, layer, area FROM own""")
def stitched_tiles(spark, sf_dir):
    """Owned pixels of all tiles put together again; no pixel is lost or repeated."""
    t = T.grid(spark, sf_dir).tiles(spark)
    px = raster.owned_pixels(tile_areas(spark, sf_dir), t, PIXEL).withColumn("value", F.struct("layer", "area"))
    return raster.stitch(px, t, PIXEL).select("y", "x", "value.*")


@query("WITH " + T.SOLID + T.EXTENT + """, c AS (SELECT row, col, ncols, l, b, least(l + 4096, xe) AS r, least(b + 4096, ye) AS t FROM (
 SELECT *, col * 4096 AS l, row * 4096 AS b FROM (SELECT *, unnest(range(0, ncols)) AS col FROM (SELECT *, unnest(range(0, nrows)) AS row FROM grid))))
 SELECT row * ncols + col AS core_id, l AS origin_x, b AS origin_y, CAST((t - b + 127) // 256 AS INTEGER) AS height, CAST((r - l + 127) // 256 AS INTEGER) AS width
 FROM c WHERE (t - b + 127) // 256 > 0 AND (r - l + 127) // 256 > 0""")
def tile_manifest(spark, sf_dir):
    """Origin and shape of the owned part of every tile, from the tiles as they are written and read back."""
    g = T.grid(spark, sf_dir)
    t = g.tiles(spark)
    m = archive.write_tiles(rounds.dense(tile_ink(spark, sf_dir), g, PIXEL), t, scratch(spark, "tiles"), PIXEL)
    return m.select("core_id", "origin_x", "origin_y", "height", "width")


@query("WITH " + T.SOLID + T.EXTENT + """ SELECT CAST(0 AS BIGINT) AS broken, count(*) AS tiles FROM (SELECT *, unnest(range(0, ncols)) AS col
 FROM (SELECT *, unnest(range(0, nrows)) AS row FROM grid))""")
def owned_rectangles(spark, sf_dir):
    """Owned pixels of every tile form one full rectangle."""
    g = T.grid(spark, sf_dir)
    full = rounds.dense(tile_ink(spark, sf_dir), g, PIXEL)
    t = g.tiles(spark)
    bad = raster.owned_rectangle_issues(raster.owned_pixels(full, t, PIXEL))
    return t.join(bad.select("core_id", "pixels").hint("merge"), "core_id", "left").agg(
        F.count("pixels").alias("broken"), F.count("*").alias("tiles"))


@query("WITH " + T.SOLID + T.EXTENT + """ SELECT row * ncols + col AS core_id FROM (SELECT *, unnest(range(0, ncols)) AS col
 FROM (SELECT *, unnest(range(0, nrows)) AS row FROM grid)) WHERE least((col+1)*4096, xe) - col*4096 + 512 > 4000
 OR least((row+1)*4096, ye) - row*4096 + 512 > 4000""")
def oversized_tiles(spark, sf_dir):
    """Tiles whose context does not fit a canvas of 40 pixels of 100 units."""
    return raster.too_large(T.grid(spark, sf_dir).tiles(spark), 100, 40).select("core_id")


@query(SEGS + """, s AS (SELECT 'edges' AS name, count(*) AS rows FROM edges UNION ALL SELECT 'segments', count(*) FROM segments
 UNION ALL SELECT 'polygons', count(*) FROM solid) SELECT name, rows FROM s""")
def archive_counts(spark, sf_dir):
    """Row counts as an archive of the prepared tables records them."""
    # Endpoints and lengths follow from edges and places on them, as in `prepare.write_problem`.
    tables = {"edges": edges(spark, sf_dir), "segments": segments(spark, sf_dir).drop(*prepare.DERIVED), "polygons": T.rings(spark, sf_dir)}
    path = scratch(spark, "archive")
    archive.write_archive(tables, path, "prepared", 1)
    found, _ = archive.read_archive(spark, path, "prepared", [1], {n: df.schema for n, df in tables.items()})
    out = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in found.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(SEGS + T.OWNERS + """ SELECT count(DISTINCT polygon_id) AS polygons, count(*) AS segments, count(DISTINCT core_id) AS active_tiles,
 max(ncols * nrows) AS tiles, count(*) FILTER (WHERE core_id < 0) AS unowned FROM owners, (SELECT ncols, nrows FROM grid)""")
def run_summary(spark, sf_dir):
    g = T.grid(spark, sf_dir)
    summary = seg.owners(segments(spark, sf_dir), g).agg(
        F.count_distinct("polygon_id").alias("polygons"), F.count("*").alias("segments"),
        F.count_distinct("core_id").alias("active_tiles"), F.lit(g.columns * g.rows).cast("long").alias("tiles"),
        F.count_if(F.col("core_id") < 0).alias("unowned"))
    path = scratch(spark, "summary")
    archive.write_summary(summary, path)
    return spark.read.schema(summary.schema).json(path)


@query("WITH " + T.SOLID + """ SELECT kind_of, layer, count(*) AS shapes FROM (SELECT 'reference' AS kind_of, layer FROM solid
 UNION ALL SELECT 'rebuilt', layer FROM solid) GROUP BY 1, 2""")
def reference_and_rebuilt(spark, sf_dir):
    """Source polygons and polygons assembled from their edges, told apart by a column."""
    path = scratch(spark, "pair")
    shapes.write_pair(T.rings(spark, sf_dir), contours.assemble_polygons(edges(spark, sf_dir), ("layer", "polygon_id")), path)
    return spark.read.parquet(path).groupBy("kind_of", "layer").agg(F.count("*").alias("shapes"))


# --- moved masks and rounds -----------------------------------------------------------------------------------

SOFT = SEGS + T.MEMBERS + f""", q AS (SELECT core_id, sx, sy, ex, ey, nx, ny, {SHIFT} / 4 AS d FROM membership WHERE {SHIFT} <> 0),
ctx AS (SELECT row * ncols + col AS core_id, col * 4096 - 256 AS cl, row * 4096 - 256 AS cb,
 CAST((least((col + 1) * 4096, xe) - col * 4096 + 512 + 255) // 256 AS BIGINT) AS w,
 CAST((least((row + 1) * 4096, ye) - row * 4096 + 512 + 255) // 256 AS BIGINT) AS h
 FROM (SELECT *, unnest(range(0, ncols)) AS col FROM (SELECT *, unnest(range(0, nrows)) AS row FROM grid))),
near AS (SELECT q.*, cl, cb, w, h, unnest(range(greatest(CAST(floor((least(sy, ey) - 64 - cb) / 256) AS BIGINT), 0),
 least(CAST(floor((greatest(sy, ey) + 64 - cb) / 256) AS BIGINT), h - 1) + 1)) AS y FROM q JOIN ctx USING (core_id)),
pair AS (SELECT *, cl + (x + 0.5) * 256 AS gx, cb + (y + 0.5) * 256 AS gy, sqrt((ex-sx)**2 + (ey-sy)**2) AS len FROM (
 SELECT *, unnest(range(greatest(CAST(ceil((least(sx, ex) - 64 - cl) / 256 - 0.5) AS BIGINT), 0),
 least(CAST(floor((greatest(sx, ex) + 64 - cl) / 256 - 0.5) AS BIGINT), w - 1) + 1)) AS x FROM near)),
proj AS (SELECT *, ((gx-sx)*(ex-sx) + (gy-sy)*(ey-sy)) / len AS a, (gx-sx)*nx + (gy-sy)*ny AS o FROM pair),
chg AS (SELECT core_id, y, x, sum(1/(1+exp(-a/8)) * 1/(1+exp(-(len-a)/8)) * (1/(1+exp(-(d-o)/8)) - 1/(1+exp(o/8)))) AS c FROM proj GROUP BY 1, 2, 3)
 SELECT core_id, count(*) AS changed, round(sum(least(greatest(0.5 + c, 0.0), 1.0)), 4) AS total FROM chg
 WHERE abs(c) > 1e-9 GROUP BY 1"""


@query(SOFT)
def soft_edge_masks(spark, sf_dir):
    """Half-covered tile canvases changed smoothly by moved segments within 64 units."""
    g = T.grid(spark, sf_dir)
    s = seg.memberships(segments(spark, sf_dir).withColumn("d", shift() / 4), g)
    none = spark.range(0).select(F.col("id").alias("core_id"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(0.0).alias("value"))
    corner = g.tiles(spark).select("core_id", "cl", "cb")
    base = rounds.dense(none, g, PIXEL).withColumn("value", F.lit(0.5)).hint("merge").join(corner, "core_id")
    out = pixels.soft_edge_raster(base, g.context(s), PIXEL, 8.0, 64.0)
    return out.filter(F.abs(F.col("value") - 0.5) > 1e-9).groupBy("core_id").agg(
        F.count("*").alias("changed"), F.round(F.sum("value"), 4).alias("total"))


@query(SEGS + f""" SELECT polygon_id, round(sum(greatest(least({SHIFT} / 2 + 3.0 * ((polygon_id + ord) % 3 - 1), 5.0), -5.0)), 6) AS d
 FROM segments GROUP BY 1""")
def proposed_shifts(spark, sf_dir):
    """Next state of a round: direction times step, clipped, one writer per segment."""
    s = segments(spark, sf_dir)
    state = s.select(*SEGMENT_KEY, (shift() / 2).alias("d"))
    scored = s.select(F.struct(*SEGMENT_KEY).alias("probe_id"),
                      (F.pmod(F.col("polygon_id") + F.col("ord"), F.lit(3)) - 1).alias("direction"))
    return rounds.propose(state, scored, 3.0, 5.0).groupBy("polygon_id").agg(F.round(F.sum("d"), 6).alias("d"))


@query(SEGS + T.MEMBERS + """ SELECT core_id % ncols // 4 AS macro_id, count(*) AS members,
 count(*) FILTER (WHERE owner_id = core_id) AS owned, count(DISTINCT core_id) AS tiles FROM membership GROUP BY 1""")
def macro_totals(spark, sf_dir):
    """Members, owned segments and active tiles per macro of four tile columns."""
    g = T.grid(spark, sf_dir)
    m = seg.memberships(segments(spark, sf_dir), g)
    macro = tiling.floor_div(F.pmod(F.col("core_id"), F.lit(g.columns)), 4)
    return m.groupBy(macro.alias("macro_id")).agg(
        F.count("*").alias("members"), F.count_if(F.col("owner_id") == F.col("core_id")).alias("owned"),
        F.count_distinct("core_id").alias("tiles"))


@query()
def update_rounds(spark, sf_dir):
    """Two synchronised rounds over all polygons with an evaluator that prints the mask somewhat fainter."""
    e = edges(spark, sf_dir)
    g = T.grid(spark, sf_dir)
    s = seg.owners(seg.prepare(e, T.CORNER, T.MAXIMUM), g)
    conditions = F.explode(F.array(*[F.struct(F.lit(n).alias("condition"), F.lit(v).alias("shift")) for n, v in (
        ("nominal", 0.0), ("dose_max", 0.04), ("defocus_min", -0.04))]))

    def evaluate(mask):
        return mask.withColumn("c", conditions).select(
            "core_id", "c.condition", "y", "x", (F.col("value") * 0.7 + F.col("c.shift")).alias("value"))

    # Polygons of all layers are one mask here.
    e, s = (d.withColumn("layer", F.lit(0)) for d in (e, s))
    settings = rounds.Settings(1, 8.0, 4, 200.0, PIXEL, T.CORNER, T.MAXIMUM, 12.0)
    return rounds.run(e, s, g, settings, evaluate, parts=T.parts(spark, sf_dir, "orders")).rounds
