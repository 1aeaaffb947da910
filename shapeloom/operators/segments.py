"""Edge segments: cutting, endpoints, probes, owners, and contour reconstruction."""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shapeloom.functions.scalars import col, pin
from shapeloom.operators import tiling
from shapeloom.operators.contours import outward_normal, with_length
from shapeloom.schemas import SEGMENT_KEY


def check_config(corner: float, maximum: float, displacement: float = 0.0, miter: float = 4.0):
    if corner <= 0 or maximum <= 0 or maximum < 2 * corner or displacement < 0 or miter < 1:
        raise ValueError("need 0 < 2*corner <= maximum, displacement >= 0 and miter >= 1")


def fragment_count(length, corner: float, maximum: float) -> Column:
    """Pieces of an edge: even pieces, or two corner pieces and an even middle."""
    length = col(length)
    return F.when(length > 2.0 * maximum,
                  2 + F.ceil((length - 2.0 * corner) / F.lit(float(maximum)))
                  ).otherwise(F.ceil(length / F.lit(float(maximum)))).cast("int")


def fragment(edges: DataFrame, corner: float, maximum: float) -> DataFrame:
    """One row per segment with seg_ord, t0, t1; edges need `len`."""
    check_config(corner, maximum)
    n, i = F.col("pieces"), F.col("seg_ord")
    share = F.lit(float(corner)) / F.col("len")
    step = (1.0 - 2.0 * share) / (n - 2)
    start = share + (i - 1) * step
    even = F.col("len") <= 2.0 * maximum
    t0 = (F.when(even, i / n).when(i == 0, 0.0).when(i == n - 1, 1.0 - share).otherwise(start))
    t1 = (F.when(even, (i + 1) / n).when(i == n - 1, 1.0).when(i == 0, share)
          .otherwise(start + step))
    return (edges.withColumn("pieces", fragment_count("len", corner, maximum))
            .withColumn("seg_ord", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
            .transform(pin, t0=t0, t1=t1))


def endpoints(segments: DataFrame, shift=None) -> DataFrame:
    """Add sx, sy, ex, ey, moved along the normal by `shift` when given."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    d = F.lit(0.0) if shift is None else col(shift)

    def at(origin, vector, t, normal):
        base = F.col(origin) + vector * F.col(t)
        return base if shift is None else base + d * F.col(normal)

    return (segments.withColumn("sx", at("x0", dx, "t0", "nx"))
            .withColumn("sy", at("y0", dy, "t0", "ny"))
            .withColumn("ex", at("x0", dx, "t1", "nx"))
            .withColumn("ey", at("y0", dy, "t1", "ny")))


def probe_points(segments: DataFrame, distance: float) -> DataFrame:
    """Add inner and outer points on the normal through the segment's middle."""
    if distance <= 0:
        raise ValueError("probe distance must be positive")
    mx, my = (F.col("sx") + F.col("ex")) * 0.5, (F.col("sy") + F.col("ey")) * 0.5
    return (segments.withColumn("inner_x", mx - F.col("nx") * distance)
            .withColumn("inner_y", my - F.col("ny") * distance)
            .withColumn("outer_x", mx + F.col("nx") * distance)
            .withColumn("outer_y", my + F.col("ny") * distance))


def prepare(edges: DataFrame, corner: float, maximum: float, polarity: str = "clear"):
    """Edges (with area2 and is_hole) to segments with normals and endpoints."""
    edges = with_length(edges)
    return endpoints(fragment(edges.select("*", *outward_normal(polarity)), corner, maximum))


def segment_box(segments: DataFrame) -> DataFrame:
    return (segments.withColumn("l", F.least("sx", "ex")).withColumn("r", F.greatest("sx", "ex"))
            .withColumn("b", F.least("sy", "ey")).withColumn("t", F.greatest("sy", "ey")))


def owners(segments: DataFrame, grid: tiling.Grid, name="core_id") -> DataFrame:
    """Add the tile owning the middle of each segment; -1 outside the grid."""
    middle = pin(segments, _mx=(F.col("sx") + F.col("ex")) * 0.5,
                 _my=(F.col("sy") + F.col("ey")) * 0.5)
    return tiling.owner(middle, grid, "_mx", "_my", name).drop("_mx", "_my")


def memberships(segments: DataFrame, grid: tiling.Grid, *, clamp=True, limit=None) -> DataFrame:
    """One row per (segment, tile whose context it touches); owner_id is kept."""
    rows = segment_box(owners(segments, grid, "owner_id"))
    return tiling.membership(rows, grid, clamp=clamp, limit=limit)


def middle_owned(segments: DataFrame, order=tuple(SEGMENT_KEY)) -> DataFrame:
    """The segment of rank n//2 per owning tile; its shift is positive on even tiles.

    Ranks are found by counting per position range first, so that a crowded tile is never
    sorted in one task: see `rank_in_group`.
    """
    owned = segments.filter(F.col("core_id") >= 0)
    ranked = rank_in_group(owned, "core_id", list(order))
    mid = ranked.filter(F.col("rank") == F.floor(F.col("group_size") / 2))
    return mid.withColumn("sign", F.when(F.col("core_id") % 2 == 0, 1).otherwise(-1))


def rank_in_group(df: DataFrame, group: str, order, block: int = 4096) -> DataFrame:
    """0-based `rank` in order, and `group_size`, without one task per group.

    Rows are ranked inside blocks of the leading order column; the sizes of the blocks
    before it are added. Blocks follow the order, so ranks are exact.
    """
    lead = order[0]
    df = df.withColumn("_blk", F.col(lead) - F.pmod(F.col(lead), F.lit(block)))
    sizes = df.groupBy(group, "_blk").agg(F.count("*").alias("_n"))
    over = W.partitionBy(group)
    before = over.orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(group, "_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                         F.sum("_n").over(over).alias("group_size"))
    local = W.partitionBy(group, "_blk").orderBy(*order)
    return (df.withColumn("_rn", F.row_number().over(local) - 1).join(sizes.hint("merge"), [group, "_blk"])
            .withColumn("rank", F.col("_rn") + F.col("_off")).drop("_rn", "_off", "_blk"))


def with_carriers(rows: DataFrame, is_last) -> DataFrame:
    """Rows, and a copy of the last one of each edge addressed to the next edge of its ring.

    The copy has seg_ord -1 and so precedes the rows of that edge: a window per edge sees what came
    before on the closed ring, and no task holds a ring.
    """
    here = F.struct(F.col("ord").alias("o"), F.col("seg_ord").alias("s"))
    onward = F.struct(F.pmod(F.col("ord") + 1, F.col("n")).cast("int").alias("o"), F.lit(-1).alias("s"))
    both = rows.withColumn("_at", F.explode(F.when(is_last, F.array(here, onward)).otherwise(F.array(here))))
    return both.withColumn("ord", F.col("_at.o")).withColumn("seg_ord", F.col("_at.s")).drop("_at")


def previous_shift(segments: DataFrame, corner: float, maximum: float) -> DataFrame:
    """Add dp, the shift of the segment before on the closed ring: one shuffle, by edge."""
    length = F.hypot((F.col("x1") - F.col("x0")).cast("double"), (F.col("y1") - F.col("y0")).cast("double"))
    last = F.col("seg_ord") == fragment_count(length, corner, maximum) - 1
    w = W.partitionBy("ord", "polygon_id", "ring_id").orderBy("seg_ord")
    return with_carriers(segments, last).withColumn("dp", F.lag("d").over(w)).filter("seg_ord >= 0")


def junctions(segments: DataFrame, miter: float = 4.0) -> DataFrame:
    """Add pts: the rounded contour points (0, 1 or 2) at the start of each segment.

    Needs ring_edges columns, normals, t0, d and dp. Pieces of one edge give no point when
    they move alike and two otherwise; corners give the intersection of the moved lines,
    or two points when the lines are parallel or meet too far away.
    """
    vx, vy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    ux, uy = F.col("x0") - F.col("px"), F.col("y0") - F.col("py")
    first = F.col("seg_ord") == 0
    # Normals keep their side of the ring, so the previous one follows from its direction.
    turn = F.signum(F.col("nx") * -vy + F.col("ny") * vx) / F.hypot(ux.cast("double"), uy.cast("double"))
    d, dp, t0 = F.col("d"), F.col("dp"), F.col("t0")
    ends = {"bx": F.when(first, F.col("x0") - dp * uy * turn).otherwise(F.col("x0") + vx * t0 + dp * F.col("nx")),
            "by": F.when(first, F.col("y0") + dp * ux * turn).otherwise(F.col("y0") + vy * t0 + dp * F.col("ny")),
            "hx": F.col("x0") + vx * t0 + d * F.col("nx"), "hy": F.col("y0") + vy * t0 + d * F.col("ny")}
    cur = pin(segments, **ends)
    cross = (ux * vy - uy * vx).cast("double")
    parallel = F.abs(cross) <= 1e-12
    cur = cur.withColumn("factor", F.when(first & ~parallel, (
        (F.col("hx") - F.col("bx")) * vy - (F.col("hy") - F.col("by")) * vx) / cross))
    cur = cur.withColumns({"ix": F.col("bx") + F.col("factor") * ux, "iy": F.col("by") + F.col("factor") * uy})
    away = F.hypot(F.col("ix") - F.col("x0"), F.col("iy") - F.col("y0"))
    reach = miter * F.greatest(F.abs(d), F.abs(dp), F.lit(1.0))
    still = ~first & (F.abs(d - dp) <= 1e-12)
    meets = first & F.col("factor").isNotNull() & (away <= reach)

    def pt(x, y):
        return F.struct(F.rint(x).cast("long").alias("x"), F.rint(y).cast("long").alias("y"))

    two = F.array(pt("bx", "by"), pt("hx", "hy"))
    return pin(cur, pts=F.when(meets, F.array(pt("ix", "iy"))).when(~still, two))


def junction_points(segments: DataFrame, corner: float, maximum: float,
                    miter: float = 4.0) -> DataFrame:
    """Segments with the points of their starting junction; null where there is none."""
    return junctions(previous_shift(segments, corner, maximum), miter)


def reconstruct(segments: DataFrame, corner: float, maximum: float, miter: float = 4.0,
                keep=()) -> DataFrame:
    """Edges of the moved contours (x0, y0) -> (x1, y1), repeated points left out.

    An edge always begins with a corner and so with a point. The predecessor of a point lies on the
    same edge, or is the last point of the edge before, which is carried on to this one.
    """
    edge = ["polygon_id", "ring_id", "ord"]
    moved = previous_shift(segments.select(
        *dict.fromkeys([*keep, *edge, "n", "seg_ord", "x0", "y0", "x1", "y1", "px", "py", "nx", "ny", "t0", "d"])),
        corner, maximum)
    pts = junctions(moved, miter).select(*keep, *edge, "n", "seg_ord", F.posexplode("pts").alias("k", "p"))
    w = W.partitionBy("ord", "polygon_id", "ring_id").orderBy("seg_ord", "k")
    # Points are dealt by edge already; only the carried ones move.
    pts = pts.withColumn("_last", F.lead("k").over(w).isNull())
    pts = with_carriers(pts, F.col("_last")).withColumn("q", F.lag("p").over(w)).filter("seg_ord >= 0")
    return pts.filter(F.col("p") != F.col("q")).select(
        *keep, *edge, "seg_ord", "k", F.col("q.x").alias("x0"), F.col("q.y").alias("y0"),
        F.col("p.x").alias("x1"), F.col("p.y").alias("y1"))


def displacement_issues(segments: DataFrame, state: DataFrame, limit: float) -> DataFrame:
    """Segments without a shift, and shifts that are repeated, not finite or too large."""
    bad = F.isnan("d") | (F.abs("d") > limit)
    both = segments.select(*SEGMENT_KEY, F.lit(True).alias("seg"), F.lit(0).alias("n"), F.lit(False).alias("bad")).unionByName(
        state.select(*SEGMENT_KEY, F.lit(False).alias("seg"), F.lit(1).alias("n"), bad.alias("bad")))
    # One aggregate of both, so that tables which are dealt by polygon alike are not shuffled again.
    seen = both.groupBy(*SEGMENT_KEY).agg(F.max("seg").alias("seg"), F.sum("n").alias("n"), F.max("bad").alias("bad"))
    code = (F.when(F.col("n") == 0, "missing").when(~F.col("seg"), "unknown_segment")
            .when(F.col("n") > 1, "repeated").when(F.col("bad"), "out_of_range"))
    return seen.select(*SEGMENT_KEY, code.alias("code")).filter(F.col("code").isNotNull())


def ring_issues(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rings that vanished, appeared, flipped or lost their area between two edge tables."""
    ring = ["polygon_id", "ring_id"]

    def area(df, name):
        return df.groupBy(*ring).agg(F.sum(
            F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")).alias(name))

    both = area(before, "a").join(area(after, "c"), ring, "full_outer")
    code = (F.when(F.col("a").isNull(), "new_ring").when(F.col("c").isNull(), "lost_ring")
            .when(F.col("c") == 0, "zero_area_ring")
            .when((F.col("a") > 0) != (F.col("c") > 0), "reversed_ring"))
    return both.select(*ring, code.alias("code")).filter(F.col("code").isNotNull())
