"""Rings, edges, segments, tiles, owners and memberships on the driver tables."""
from pyspark.sql import functions as F

from catalog import tables as T
from catalog.registry import query
from shapeloom.functions.scalars import floor_div
from shapeloom.operators import (capacity, contours, quality, region,
                                 segments as seg, tiling)
from shapeloom.plans import prepare
from shapeloom.schemas import SEGMENT_KEY

EDGES = "WITH " + T.EDGES
SEGS = EDGES + T.SEGMENTS
OWN = SEGS + T.OWNERS
MEM = SEGS + T.MEMBERS


def edges(spark, sf_dir):
    return contours.ring_edges(T.rings(spark, sf_dir), ("layer",))


def segments(spark, sf_dir):
    return seg.prepare(edges(spark, sf_dir), T.CORNER, T.MAXIMUM)


def owned(spark, sf_dir):
    return seg.owners(segments(spark, sf_dir), T.grid(spark, sf_dir))


def members(spark, sf_dir):
    return seg.memberships(segments(spark, sf_dir), T.grid(spark, sf_dir))


def parts(spark, sf_dir):
    """Partitions in which segments are sorted, by their number, which edges tell without being cut."""
    e = contours.with_length(edges(spark, sf_dir))
    return tiling.parts_for(spark, e.agg(F.sum(seg.fragment_count("len", T.CORNER, T.MAXIMUM))).first()[0] or 0)


def shift():
    """A deterministic displacement between -8 and 8."""
    return (F.pmod(F.col("polygon_id") * 7 + F.col("ring_id") * 5 + F.col("ord") * 3 +
                   F.col("seg_ord"), F.lit(17)) - 8).cast("double")


SHIFT = "CAST((polygon_id * 7 + ring_id * 5 + ord * 3 + seg_ord) % 17 - 8 AS DOUBLE)"


# --- contours -----------------------------------------------------------------------------

@query(EDGES + """ SELECT layer, polygon_id, ring_id, is_hole, ord, x0, y0, x1, y1,
 sqrt(CAST((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0) AS DOUBLE)) AS len FROM edges""")
def ring_edge_lengths(spark, sf_dir):
    return contours.with_length(edges(spark, sf_dir)).select(
        "layer", "polygon_id", "ring_id", "is_hole", "ord", "x0", "y0", "x1", "y1", "len")


@query(EDGES + """ SELECT polygon_id, ring_id, CAST(sum(x0 * y1 - x1 * y0) AS BIGINT) AS area2
 FROM edges GROUP BY ALL""")
def ring_areas(spark, sf_dir):
    return contours.signed_area2(edges(spark, sf_dir))


@query("WITH " + T.DIAGONAL_EDGES + """ SELECT polygon_id, ord,
 round(-(y1 - y0) / len, 9) + 0.0 AS nx, round((x1 - x0) / len, 9) + 0.0 AS ny
 FROM (SELECT *, sqrt(CAST((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0) AS DOUBLE)) AS len FROM edges)""")
def outward_normals(spark, sf_dir):
    e = contours.with_length(contours.ring_edges(T.diagonals(spark, sf_dir)))
    n = e.select("polygon_id", "ord", *contours.outward_normal())
    return n.select("polygon_id", "ord", (F.round("nx", 9) + 0.0).alias("nx"),
                    (F.round("ny", 9) + 0.0).alias("ny"))


@query(EDGES + """ SELECT polygon_id, count(DISTINCT ring_id) AS rings, count(*) AS points,
 CAST(sum((ring_id + 1) * (ord + 1) * (x0 + 3 * y0)) AS BIGINT) AS checksum FROM edges GROUP BY 1""")
def assembled_polygons(spark, sf_dir):
    """Explode to edges and assemble again; the checksum depends on ring and point order."""
    back = contours.assemble_polygons(edges(spark, sf_dir))
    e = contours.ring_edges(back)
    return e.groupBy("polygon_id").agg(
        F.count_distinct("ring_id").alias("rings"), F.count("*").alias("points"),
        F.sum((F.col("ring_id") + 1) * (F.col("ord") + 1) * (F.col("x0") + 3 * F.col("y0"))).alias("checksum"))


@query(EDGES + """ SELECT layer, count(DISTINCT polygon_id) AS polygons,
 count(DISTINCT (polygon_id, ring_id)) AS rings, count(*) AS vertices FROM edges GROUP BY layer""")
def contour_counts(spark, sf_dir):
    return contours.contour_counts(T.rings(spark, sf_dir))


def damaged(spark, sf_dir):
    """Rings with a repeated vertex, a flat hull, or too few points, by polygon number."""
    key = F.col("polygon_id")
    hull = F.get("rings", F.lit(0))
    flat = F.transform(hull, lambda p: F.struct(p["x"].alias("x"), F.get(hull, F.lit(0))["y"].alias("y")))
    new = (F.when(key % 7 == 0, F.array(F.concat(hull, F.slice(hull, 4, 1))))
           .when(key % 11 == 0, F.array(flat)).when(key % 13 == 0, F.array(F.slice(hull, 1, 2)))
           .when(key % 17 == 0, F.slice(F.array(hull), 1, 0)).otherwise(F.array(hull)))
    return T.rings(spark, sf_dir).select("layer", "polygon_id", new.alias("rings"))


@query("WITH " + T.SOLID + """, k AS (SELECT shape_id AS p, shape_id % 7 = 0 AS z,
 shape_id % 11 = 0 AND shape_id % 7 <> 0 AS f FROM solid)
 SELECT p AS polygon_id, 'zero_length_edge' AS code, CASE WHEN z THEN 1 ELSE 2 END AS n FROM k WHERE z OR f
 UNION ALL SELECT p, 'zero_area_ring', 1 FROM k
 WHERE f OR (p % 13 = 0 AND p % 11 <> 0 AND p % 7 <> 0)""")
def contour_issues(spark, sf_dir):
    """Zero-length edges and zero-area rings of damaged contours."""
    found = contours.contour_issues(contours.ring_edges(damaged(spark, sf_dir)))
    return found.select("polygon_id", "code", F.size("indices").alias("n"))


@query("WITH " + T.SOLID + """ SELECT shape_id AS polygon_id, CASE WHEN shape_id % 13 = 0
 THEN 'short_ring' ELSE 'no_ring' END AS code FROM solid
 WHERE shape_id % 7 <> 0 AND shape_id % 11 <> 0 AND (shape_id % 13 = 0 OR shape_id % 17 = 0)""")
def ring_size_issues(spark, sf_dir):
    return contours.shape_issues(damaged(spark, sf_dir)).select("polygon_id", "code")


@query("WITH " + T.SOLID + """ SELECT shape_id AS polygon_id, CAST(0 AS INTEGER) AS ring_id,
 CAST(2 AS INTEGER) AS ord FROM solid WHERE shape_id % 19 = 0""")
def edge_topology_issues(spark, sf_dir):
    e = edges(spark, sf_dir)
    wrong = (F.col("polygon_id") % 19 == 0) & (F.col("ord") == 2) & (F.col("ring_id") == 0)
    return contours.topology_issues(e.withColumn("x1", F.when(wrong, F.col("x1") + 1).otherwise(F.col("x1"))))


@query("WITH " + T.SOLID + """, p AS (SELECT shape_id, unnest([[0, l, b], [1, l, b], [2, l, t], [3, r, t],
 [4, r, t], [5, r, b], [6, l, b]]) AS v FROM solid)
 SELECT shape_id AS polygon_id, v[1] AS ord, v[2] AS x, v[3] AS y FROM p WHERE v[1] IN (0, 2, 3, 5)""")
def repeated_points_dropped(spark, sf_dir):
    def pt(i, x, y):
        return F.struct(F.lit(i).cast("long").alias("ord"), F.col(x).alias("x"), F.col(y).alias("y"))
    pts = F.array(*[pt(i, x, y) for i, (x, y) in enumerate(
        [("l", "b"), ("l", "b"), ("l", "t"), ("r", "t"), ("r", "t"), ("r", "b"), ("l", "b")])])
    df = T.solid(spark, sf_dir).select(F.col("shape_id").alias("polygon_id"), F.explode(pts).alias("p"))
    return contours.drop_repeated_points(df.select("polygon_id", "p.*"), ("polygon_id",))


@query(EDGES + """, w AS MATERIALIZED (SELECT polygon_id, ring_id, list(x0 ORDER BY ord) AS xs, list(y0 ORDER BY ord) AS ys FROM edges GROUP BY 1, 2)
 SELECT polygon_id, ring_id, CAST(k AS INTEGER) AS ord, xs[(k + 1) % len(xs) + 1] AS qx, ys[(k + 1) % len(xs) + 1] AS qy,
 xs[(k + len(xs) - 1) % len(xs) + 1] AS px, ys[(k + len(xs) - 1) % len(xs) + 1] AS py
 FROM (SELECT *, unnest(range(0, len(xs))) AS k FROM w)""")
def ring_neighbours(spark, sf_dir):
    """Next and previous vertex on the closed ring."""
    return edges(spark, sf_dir).select("polygon_id", "ring_id", "ord", F.col("x1").alias("qx"),
                                       F.col("y1").alias("qy"), "px", "py")


# --- segments -------------------------------------------------------------------------------

PER_EDGE = """ SELECT polygon_id, ring_id, ord, count(*) AS pieces, max(seg_ord) AS last,
 round(sum(t0), 6) AS t0, round(sum(t1), 6) AS t1, round(sum(sx + 2 * sy), 4) AS starts,
 round(sum(ex + 2 * ey), 4) AS ends FROM %s GROUP BY polygon_id, ring_id, ord"""


def per_edge(s):
    return s.groupBy("polygon_id", "ring_id", "ord").agg(
        F.count("*").alias("pieces"), F.max("seg_ord").alias("last"),
        F.round(F.sum("t0"), 6).alias("t0"), F.round(F.sum("t1"), 6).alias("t1"),
        F.round(F.sum(F.col("sx") + 2 * F.col("sy")), 4).alias("starts"),
        F.round(F.sum(F.col("ex") + 2 * F.col("ey")), 4).alias("ends"))


@query(EDGES + """ SELECT polygon_id, ring_id, ord, CASE WHEN len > 64
 THEN 2 + CAST(ceil((len - 32) / 32) AS INTEGER) ELSE CAST(ceil(len / 32) AS INTEGER) END AS pieces
 FROM (SELECT *, sqrt(CAST((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0) AS DOUBLE)) AS len FROM edges)""")
def fragment_counts(spark, sf_dir):
    return contours.with_length(edges(spark, sf_dir)).select(
        "polygon_id", "ring_id", "ord", seg.fragment_count("len", T.CORNER, T.MAXIMUM).alias("pieces"))


@query(SEGS + PER_EDGE % "segments")
def edge_fragments(spark, sf_dir):
    return per_edge(segments(spark, sf_dir))


@query("WITH " + T.DIAGONAL_EDGES + T.SEGMENTS + PER_EDGE % "segments")
def slanted_edge_fragments(spark, sf_dir):
    e = contours.ring_edges(T.diagonals(spark, sf_dir))
    return per_edge(seg.prepare(e, T.CORNER, T.MAXIMUM))


@query(SEGS + f""" SELECT polygon_id, round(sum(sx + d * nx), 4) AS sx, round(sum(sy + d * ny), 4) AS sy,
 round(sum(ex + d * nx), 4) AS ex, round(sum(ey + d * ny), 4) AS ey
 FROM (SELECT *, {SHIFT} AS d FROM segments) GROUP BY 1""")
def moved_endpoints(spark, sf_dir):
    s = seg.endpoints(segments(spark, sf_dir), shift())
    return s.groupBy("polygon_id").agg(*[F.round(F.sum(c), 4).alias(c) for c in ("sx", "sy", "ex", "ey")])


@query(SEGS + """ SELECT polygon_id, round(sum((sx+ex)*0.5 - nx*6), 4) AS inner_x,
 round(sum((sy+ey)*0.5 - ny*6), 4) AS inner_y, round(sum((sx+ex)*0.5 + nx*6), 4) AS outer_x,
 round(sum((sy+ey)*0.5 + ny*6), 4) AS outer_y FROM segments GROUP BY 1""")
def probe_points(spark, sf_dir):
    s = seg.probe_points(segments(spark, sf_dir), 6.0)
    return s.groupBy("polygon_id").agg(*[F.round(F.sum(c), 4).alias(c) for c in (
        "inner_x", "inner_y", "outer_x", "outer_y")])


@query(SEGS + """ SELECT layer, count(*) AS segments, round(max(sqrt((ex-sx)*(ex-sx)+(ey-sy)*(ey-sy))), 9)
 AS longest FROM segments GROUP BY layer""")
def longest_segment(spark, sf_dir):
    size = F.hypot(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy"))
    return segments(spark, sf_dir).groupBy("layer").agg(
        F.count("*").alias("segments"), F.round(F.max(size), 9).alias("longest"))


@query(SEGS + f""" SELECT layer, count(*) FILTER (WHERE abs({SHIFT}) > 1e-12) AS moved
 FROM segments GROUP BY layer""")
def moved_segments(spark, sf_dir):
    return segments(spark, sf_dir).groupBy("layer").agg(
        F.count_if(F.abs(shift()) > 1e-12).alias("moved"))


# --- tiles, owners, memberships -----------------------------------------------------------------

@query("WITH " + T.SOLID + T.EXTENT + """ SELECT row * ncols + col AS core_id, 'r' || row || 'c' || col AS name,
 row, col, col * 4096 AS l, row * 4096 AS b, least((col + 1) * 4096, xe) AS r,
 least((row + 1) * 4096, ye) AS t, col * 4096 - 256 AS cl, row * 4096 - 256 AS cb,
 least((col + 1) * 4096, xe) + 256 AS cr, least((row + 1) * 4096, ye) + 256 AS ct
 FROM (SELECT *, unnest(range(0, ncols)) AS col FROM (SELECT *, unnest(range(0, nrows)) AS row FROM grid))
 ORDER BY row, col""")
def tile_grid(spark, sf_dir):
    """Fixed-size tiles over the layout, last ones shortened, in row-major order."""
    return T.grid(spark, sf_dir).tiles(spark).orderBy("row", "col")


def counted_grid(spark, sf_dir):
    x, y = T.solid(spark, sf_dir).agg(F.max("r"), F.max("t")).first()
    return tiling.Grid.from_cuts(tiling.cuts_by_count(0, x, 13), tiling.cuts_by_count(0, y, 3), T.HALO)


CUTS = """, cx AS (SELECT k, (k * xe) // 13 AS cut FROM extent, range(0, 14) AS g(k)),
cy AS (SELECT k, (k * ye) // 3 AS cut FROM extent, range(0, 4) AS g(k))"""


@query("WITH " + T.SOLID + T.EXTENT + CUTS + """ SELECT core_id, count(*) AS points,
 CAST(sum(l) AS BIGINT) AS xs FROM (SELECT l, CASE WHEN l > xe OR b > ye THEN -1 ELSE
 least((SELECT count(*) FROM cy WHERE cut <= b) - 1, 2) * 13
 + least((SELECT count(*) FROM cx WHERE cut <= l) - 1, 12) END AS core_id FROM solid, extent)
 GROUP BY core_id""")
def owners_on_uneven_cuts(spark, sf_dir):
    """Cuts by count; a point belongs to the half-open tile, the outer border to the last."""
    df = tiling.owner(T.solid(spark, sf_dir), counted_grid(spark, sf_dir), "l", "b")
    return df.groupBy("core_id").agg(F.count("*").alias("points"), F.sum("l").alias("xs"))


@query(OWN + """ SELECT core_id, count(*) AS segments, count(DISTINCT polygon_id) AS polygons
 FROM owners GROUP BY 1""")
def segment_owners(spark, sf_dir):
    return owned(spark, sf_dir).groupBy("core_id").agg(
        F.count("*").alias("segments"), F.count_distinct("polygon_id").alias("polygons"))


@query(MEM + """ SELECT core_id, count(*) AS members, count(*) FILTER (WHERE owner_id = core_id) AS owned,
 CAST(sum(polygon_id) AS BIGINT) AS ids FROM membership GROUP BY 1""")
def halo_memberships(spark, sf_dir):
    return members(spark, sf_dir).groupBy("core_id").agg(
        F.count("*").alias("members"), F.count_if(F.col("owner_id") == F.col("core_id")).alias("owned"),
        F.sum("polygon_id").alias("ids"))


@query(MEM + " SELECT count(*) AS memberships FROM membership")
def membership_bound(spark, sf_dir):
    """The exact number of memberships, from spans alone."""
    s = seg.segment_box(segments(spark, sf_dir))
    return tiling.membership_count(s, T.grid(spark, sf_dir))


@query(OWN + """ SELECT core_id, count(*) AS segments FROM owners, grid
 WHERE core_id % ncols % 2 = 0 AND core_id >= 0 GROUP BY 1""")
def owned_of_cores(spark, sf_dir):
    """Segments owned by the tiles of even columns."""
    g = T.grid(spark, sf_dir)
    cores = g.tiles(spark).filter("col % 2 = 0")
    return tiling.owned_segments(owned(spark, sf_dir), cores).groupBy("core_id").agg(
        F.count("*").alias("segments"))


@query(MEM + """ SELECT core_id, count(*) AS members, min(polygon_id) AS first_polygon FROM membership
 WHERE core_id % ncols % 2 = 1 GROUP BY 1""")
def members_of_cores(spark, sf_dir):
    g = T.grid(spark, sf_dir)
    cores = g.tiles(spark).filter("col % 2 = 1")
    return tiling.members_of(members(spark, sf_dir), cores).groupBy("core_id").agg(
        F.count("*").alias("members"), F.min("polygon_id").alias("first_polygon"))


@query(MEM + """ SELECT core_id, count(*) AS rows, count(DISTINCT (polygon_id, ring_id, ord, seg_ord)) AS segments,
 CAST(0 AS BIGINT) AS repeated FROM membership GROUP BY 1""")
def ordered_memberships(spark, sf_dir):
    """Memberships sorted inside core partitions; no segment is listed twice."""
    m = tiling.ordered_members(members(spark, sf_dir), SEGMENT_KEY, parts(spark, sf_dir))
    return tiling.member_counts(m, SEGMENT_KEY)


MACRO = """, mrows AS (SELECT *, CASE WHEN core_id < 0 THEN -1 ELSE 0 END AS neg FROM membership)"""


@query("WITH " + T.SOLID + T.EXTENT + """ SELECT (row // 1) * CAST(ceil(ncols / 3.0) AS BIGINT) + col // 3 AS macro_id,
 count(*) AS tiles, min(col) * 4096 AS l FROM (SELECT *, unnest(range(0, ncols)) AS col FROM
 (SELECT *, unnest(range(0, nrows)) AS row FROM grid)) GROUP BY 1""")
def tile_macros(spark, sf_dir):
    """Macros of up to 3 x 1 tiles: greedy cuts never split a tile."""
    g = T.grid(spark, sf_dir)
    x, y = tiling.cuts_by_size(0, g.x.end, T.TILE), tiling.cuts_by_size(0, g.y.end, T.TILE)
    mx, my = tiling.macro_cuts(x, 3 * T.TILE), tiling.macro_cuts(y, T.TILE)
    return tiling.tile_macro(g, mx, my, g.tiles(spark)).groupBy("macro_id").agg(
        F.count("*").alias("tiles"), F.min("l").alias("l"))


@query("WITH " + T.SOLID + T.EXTENT + """ SELECT row * CAST(ceil(ncols / 2.0) AS BIGINT) + c AS macro_id, c * 8192 AS l,
 row * 4096 AS b, least((c + 1) * 8192, xe) AS r, least((row + 1) * 4096, ye) AS t FROM (
 SELECT *, unnest(range(0, CAST(ceil(ncols / 2.0) AS BIGINT))) AS c FROM
 (SELECT *, unnest(range(0, nrows)) AS row FROM grid))""")
def macro_boxes(spark, sf_dir):
    g = T.grid(spark, sf_dir)
    x, y = tiling.cuts_by_size(0, g.x.end, T.TILE), tiling.cuts_by_size(0, g.y.end, T.TILE)
    mx, my = tiling.macro_cuts(x, 2 * T.TILE), tiling.macro_cuts(y, T.TILE)
    return tiling.Grid.from_cuts(mx, my).tiles(spark).select(
        F.col("core_id").alias("macro_id"), "l", "b", "r", "t")


@query("WITH " + T.SOLID + T.EXTENT + """ SELECT CAST(xe * ye AS BIGINT) AS area_sum, CAST(xe * ye AS BIGINT) AS union_area,
 CAST(0 AS BIGINT) AS overlap, CAST(0 AS BIGINT) AS gap FROM grid""")
def tile_area_check(spark, sf_dir):
    """Tiles cover the layout once: no overlap and no gap."""
    g = T.grid(spark, sf_dir)
    return region.tile_coverage(g.tiles(spark), g.bounds)


@query(OWN + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY core_id ORDER BY polygon_id, ring_id, ord, seg_ord)
 - 1 AS rank, count(*) OVER (PARTITION BY core_id) AS group_size FROM owners WHERE core_id >= 0)
 SELECT core_id, polygon_id, ring_id, ord, seg_ord, CASE WHEN core_id % 2 = 0 THEN 1 ELSE -1 END AS sign
 FROM ranked WHERE rank = group_size // 2""")
def middle_owned_segment(spark, sf_dir):
    m = seg.middle_owned(owned(spark, sf_dir))
    return m.select("core_id", *SEGMENT_KEY, "sign")


@query(MEM + """ SELECT core_id, count(DISTINCT polygon_id) AS polygons, CAST(sum(DISTINCT polygon_id) AS BIGINT)
 AS ids FROM membership GROUP BY 1""")
def polygons_seen(spark, sf_dir):
    return prepare.seen_polygons(members(spark, sf_dir)).groupBy("core_id").agg(
        F.count("*").alias("polygons"), F.sum("polygon_id").alias("ids"))


@query(MEM + """, seen AS (SELECT DISTINCT polygon_id FROM membership WHERE core_id < ncols // 2)
 SELECT polygon_id, count(DISTINCT ring_id) AS rings, count(*) AS points FROM edges
 WHERE polygon_id IN (SELECT polygon_id FROM seen) GROUP BY 1""")
def polygons_of_tiles(spark, sf_dir):
    """Whole polygons, holes included, seen by the left half of the lowest tile row."""
    g = T.grid(spark, sf_dir)
    cores = g.tiles(spark).filter(F.col("core_id") < g.columns // 2)
    seen = prepare.seen_polygons(members(spark, sf_dir), cores)
    points = F.aggregate("rings", F.lit(0).cast("long"), lambda s, r: s + F.size(r))
    return prepare.subset_polygons(T.rings(spark, sf_dir), seen).select(
        "polygon_id", F.size("rings").cast("long").alias("rings"), points.alias("points"))


@query(MEM + """, movers AS (SELECT DISTINCT core_id FROM membership WHERE polygon_id % 1009 = 0 AND seg_ord = 0)
 SELECT row * ncols + col AS core_id FROM (SELECT *, unnest(range(0, ncols)) AS col FROM
 (SELECT *, unnest(range(0, nrows)) AS row FROM grid)) WHERE core_id NOT IN (SELECT core_id FROM movers)""")
def tiles_at_rest(spark, sf_dir):
    """Tiles seeing no moved segment reuse the reference raster."""
    m = members(spark, sf_dir)
    d = F.when((F.col("polygon_id") % 1009 == 0) & (F.col("seg_ord") == 0), 2.0).otherwise(0.0)
    state = segments(spark, sf_dir).select(*SEGMENT_KEY, d.alias("d"))
    return prepare.still_tiles(T.grid(spark, sf_dir).tiles(spark).select("core_id"), m, state)


# --- capacity -------------------------------------------------------------------------------------

BUDGET = 1 << 30


@query(EDGES + T.EXTENT + f""", e AS (SELECT *, sqrt(CAST((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0) AS DOUBLE)) AS len
 FROM edges), c AS (SELECT *, CASE WHEN len > 64 THEN 2 + CAST(ceil((len - 32) / 32) AS BIGINT)
 ELSE CAST(ceil(len / 32) AS BIGINT) END AS n,
 least(greatest(CAST(ceil((least(x0,x1)-256)/4096.0) AS BIGINT)-1, 0), ncols-1) AS ix0,
 greatest(least(CAST(floor((greatest(x0,x1)+256)/4096.0) AS BIGINT), ncols-1), 0) AS ix1,
 least(greatest(CAST(ceil((least(y0,y1)-256)/4096.0) AS BIGINT)-1, 0), nrows-1) AS iy0,
 greatest(least(CAST(floor((greatest(y0,y1)+256)/4096.0) AS BIGINT), nrows-1), 0) AS iy1 FROM e, grid),
 s AS (SELECT count(*) FILTER (WHERE ring_id = 0 AND ord = 0) AS shapes, count(*) AS vertices,
 CAST(sum(n) AS BIGINT) AS segments, CAST(sum(n * (ix1-ix0+1) * (iy1-iy0+1)) AS BIGINT) AS memberships FROM c),
 b AS (SELECT *, shapes * 256 + vertices * 256 + segments * 128 + memberships * 32 AS prepare_bytes,
 shapes * 128 + vertices * 128 + segments * 128 + memberships * 8 AS solver_bytes FROM s)
 SELECT *, greatest(prepare_bytes, solver_bytes) <= {BUDGET} AS accepted,
 CASE WHEN greatest(prepare_bytes, solver_bytes) <= {BUDGET} THEN 'ok' ELSE 'too_many_bytes' END AS reason,
 CAST({BUDGET // 32} AS BIGINT) AS membership_limit,
 segments <= 2147483647 AND memberships <= 2147483647 AS fits_32_bit_ids FROM b""")
def capacity_preflight(spark, sf_dir):
    return capacity.preflight(edges(spark, sf_dir), T.grid(spark, sf_dir), T.CORNER, T.MAXIMUM, BUDGET)


# --- checks ---------------------------------------------------------------------------------------------

def broken_segments(spark, sf_dir):
    """Segments with wrong intervals, normals or numbers, by polygon number."""
    k, mid = F.col("polygon_id"), F.col("seg_ord") == 1
    s = segments(spark, sf_dir)
    return (s.withColumn("t0", F.when((k % 101 == 0) & mid, F.col("t0") + 1e-3).otherwise(F.col("t0")))
            .withColumn("t1", F.when((k % 103 == 0) & mid, F.col("t0")).otherwise(F.col("t1")))
            .withColumn("nx", F.when((k % 107 == 0) & mid, F.col("nx") + 0.5).otherwise(F.col("nx")))
            .withColumn("seg_ord", F.when((k % 109 == 0) & mid, 100).otherwise(F.col("seg_ord"))))


BROKEN = SEGS + """, broken AS (SELECT polygon_id, ring_id, ord,
 CASE WHEN polygon_id % 109 = 0 AND seg_ord = 1 THEN 100 ELSE seg_ord END AS seg_ord,
 CASE WHEN polygon_id % 101 = 0 AND seg_ord = 1 THEN t0 + 1e-3 ELSE t0 END AS t0,
 CASE WHEN polygon_id % 103 = 0 AND seg_ord = 1 THEN
  (CASE WHEN polygon_id % 101 = 0 THEN t0 + 1e-3 ELSE t0 END) ELSE t1 END AS t1,
 CASE WHEN polygon_id % 107 = 0 AND seg_ord = 1 THEN nx + 0.5 ELSE nx END AS nx, ny FROM segments)"""


@query(BROKEN + """ SELECT polygon_id, ring_id, ord, seg_ord, code FROM (SELECT *, CASE
 WHEN t0 < 0 OR t1 > 1 OR t1 <= t0 THEN 'bad_interval'
 WHEN abs(t0 - coalesce(lag(t1) OVER w, 0.0)) > 1e-12 THEN 'gap_before'
 WHEN lead(t0) OVER w IS NULL AND abs(t1 - 1) > 1e-12 THEN 'open_end' END AS code FROM broken
 WINDOW w AS (PARTITION BY polygon_id, ring_id, ord ORDER BY seg_ord)) WHERE code IS NOT NULL""")
def parameter_issues(spark, sf_dir):
    return quality.parameter_issues(broken_segments(spark, sf_dir))


@query(BROKEN + """ SELECT polygon_id, ring_id, ord, seg_ord FROM broken
 WHERE abs(sqrt(nx * nx + ny * ny) - 1) > 1e-12""")
def normal_issues(spark, sf_dir):
    return quality.normal_issues(broken_segments(spark, sf_dir))


@query(BROKEN + """ SELECT polygon_id, ring_id, ord FROM broken GROUP BY ALL
 HAVING count(*) <> count(DISTINCT seg_ord) OR min(seg_ord) <> 0 OR max(seg_ord) <> count(*) - 1""")
def sequence_issues(spark, sf_dir):
    return quality.sequence_issues(broken_segments(spark, sf_dir))


@query(OWN + """ SELECT polygon_id, ring_id, ord, seg_ord, CASE WHEN polygon_id % 211 = 0 THEN 'owner_range'
 ELSE 'owner_membership' END AS code FROM owners, grid
 WHERE polygon_id % 211 = 0 OR (polygon_id % 223 = 0 AND seg_ord = 0)""")
def owner_issues(spark, sf_dir):
    g = T.grid(spark, sf_dir)
    k = F.col("polygon_id")
    s = owned(spark, sf_dir).withColumn("core_id", F.when(k % 211 == 0, 10 ** 9).otherwise(F.col("core_id")))
    m = members(spark, sf_dir).filter(~((k % 223 == 0) & (F.col("seg_ord") == 0)))
    return quality.owner_issues(s, m, g.columns * g.rows)


@query(MEM + """ SELECT core_id + 10 * ncols * 1000 AS core_id, polygon_id, seg_ord FROM membership
 WHERE polygon_id % 227 = 0""")
def member_range_issues(spark, sf_dir):
    g = T.grid(spark, sf_dir)
    k = F.col("polygon_id")
    m = members(spark, sf_dir).withColumn("core_id", F.when(
        k % 227 == 0, F.col("core_id") + 10 * g.columns * 1000).otherwise(F.col("core_id")))
    return quality.member_issues(m, g.columns * g.rows).select("core_id", "polygon_id", "seg_ord")


@query(MEM + """ SELECT core_id, polygon_id, ring_id, ord, seg_ord, CAST(2 AS BIGINT) AS count FROM membership
 WHERE polygon_id % 229 = 0""")
def repeated_memberships(spark, sf_dir):
    m = members(spark, sf_dir)
    twice = m.filter(F.col("polygon_id") % 229 == 0)
    return quality.repeated_members(m.unionByName(twice))


@query(SEGS + """ SELECT polygon_id, ring_id, ord, seg_ord FROM segments WHERE polygon_id % 233 = 0""")
def double_writes(spark, sf_dir):
    """Updates of segments that two tiles both claim."""
    s = segments(spark, sf_dir).select(*SEGMENT_KEY)
    return quality.double_writes(s.unionByName(s.filter(F.col("polygon_id") % 233 == 0)))


@query("WITH " + T.SOLID + T.EXTENT + """ SELECT row * ncols + col AS core_id FROM (SELECT *,
 unnest(range(0, ncols)) AS col FROM (SELECT *, unnest(range(0, nrows)) AS row FROM grid))
 WHERE col % 5 = 0""")
def context_issues(spark, sf_dir):
    t = T.grid(spark, sf_dir).tiles(spark)
    wrong = t.withColumn("cl", F.when(F.col("col") % 5 == 0, F.col("l") + 1).otherwise(F.col("cl")))
    return quality.context_issues(wrong).select("core_id")


@query("WITH " + T.SOLID + """, c AS (SELECT layer AS axis, l, row_number() OVER (PARTITION BY layer ORDER BY shape_id)
 AS ord FROM solid), d AS (SELECT axis, ord, CASE WHEN ord % 50 = 0 THEN lag(l) OVER w ELSE l END AS cut FROM c
 WINDOW w AS (PARTITION BY axis ORDER BY ord)), e AS (SELECT axis, cut, lag(cut) OVER (PARTITION BY axis ORDER BY ord)
 AS p FROM d) SELECT axis, 'not_increasing' AS code, count(*) AS n FROM e WHERE cut <= p GROUP BY axis""")
def grid_cut_issues(spark, sf_dir):
    """Left borders as cuts, every fiftieth repeated; shape ids give the order."""
    from pyspark.sql import Window as W
    w = W.partitionBy("axis").orderBy("ord")
    c = T.solid(spark, sf_dir).select(F.col("layer").alias("axis"), F.col("l").alias("cut"), F.row_number().over(
        W.partitionBy("layer").orderBy("shape_id")).alias("ord"))
    d = c.withColumn("cut", F.when(F.col("ord") % 50 == 0, F.lag("cut").over(w)).otherwise(F.col("cut")))
    return quality.cut_issues(d).groupBy("axis", "code").agg(F.count("*").alias("n"))


@query("WITH " + T.SOLID + T.EXTENT + """ SELECT row * ncols + col AS core_id, CAST(CASE WHEN col % 7 = 3 THEN 0 ELSE 2 END
 AS BIGINT) AS macros FROM (SELECT *, unnest(range(0, ncols)) AS col FROM
 (SELECT *, unnest(range(0, nrows)) AS row FROM grid)) WHERE col % 7 IN (3, 4)""")
def macro_assignment_issues(spark, sf_dir):
    """Tiles missing from all macros, and tiles listed in two."""
    t = T.grid(spark, sf_dir).tiles(spark)
    a = t.select("core_id", "col", floor_div("col", 3).alias("macro_id")).filter("col % 7 <> 3")
    extra = a.filter("col % 7 = 4").withColumn("macro_id", F.col("macro_id") + 1000)
    return quality.macro_issues(a.unionByName(extra), t)


@query(SEGS + f""", st AS (SELECT polygon_id, ring_id, ord, seg_ord, CASE WHEN polygon_id % 127 = 0 THEN 9.5 ELSE {SHIFT} END AS d
 FROM segments WHERE polygon_id % 113 <> 0) SELECT polygon_id, ring_id, ord, seg_ord, CASE WHEN polygon_id % 113 = 0
 THEN 'missing' WHEN polygon_id % 131 = 0 THEN 'repeated' ELSE 'out_of_range' END AS code FROM segments
 WHERE polygon_id % 113 = 0 OR polygon_id % 127 = 0 OR polygon_id % 131 = 0""")
def displacement_issues(spark, sf_dir):
    s = segments(spark, sf_dir)
    k = F.col("polygon_id")
    state = s.filter(k % 113 != 0).select(*SEGMENT_KEY, F.when(k % 127 == 0, 9.5).otherwise(shift()).alias("d"))
    state = state.unionByName(state.filter(k % 131 == 0))
    return seg.displacement_issues(s, state, 9.0)
