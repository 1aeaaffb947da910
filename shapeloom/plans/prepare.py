"""From shapes to owned segments: merge, outline, cut, own, and read-only memberships."""
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shapeloom.functions.scalars import pin
from shapeloom.operators import contours, filters, region, segments as seg, tiling
from shapeloom.schemas import SEGMENT_KEY
from shapeloom.sources import archive

PROBLEM = "segment_problem"
# Edges of a task that cuts them.
EDGES = 1 << 17
# Columns that an archive leaves out, as they follow from the others.
DERIVED = ("len", "sx", "sy", "ex", "ey", "l", "b", "r", "t")
KNOWN = T.StructType([*[T.StructField(c, T.LongType()) for c in ("x0", "y0", "x1", "y1")], *[T.StructField(c, T.DoubleType()) for c in ("t0", "t1")]])


def merged_edges(boxes: DataFrame, keys=("layer",), rings: bool = True, **kw) -> DataFrame:
    """Directed boundary edges of the merged shapes with outward normals.

    With `rings`, adds polygon_id and ring_id (numbers of the hull and of the ring), is_hole, ord, n and the previous vertex; without, only the outline,
    which needs no ring assembly.
    """
    edges = region.directed_edges(region.outline(boxes, keys=keys, **kw), keys)
    if not rings:
        return edges
    ringed = contours.polygons(contours.assemble_rings(edges, keys), keys)
    return ringed.withColumnsRenamed({"polygon": "polygon_id", "ring": "ring_id"})


def cut_edges(edges: DataFrame, corner: float, maximum: float, polarity: str = "clear"):
    """Segments with endpoints from directed edges that carry nx, ny."""
    if polarity not in ("clear", "opaque"):
        raise ValueError(f"unknown polarity {polarity!r}")
    sign = 1.0 if polarity == "clear" else -1.0
    e = edges.withColumn("nx", F.col("nx") * sign).withColumn("ny", F.col("ny") * sign)
    return seg.endpoints(seg.fragment(contours.with_length(e), corner, maximum))


def prepare_problem(boxes: DataFrame, grid: tiling.Grid, corner: float, maximum: float,
                    keys=("layer",), polarity: str = "clear", limit: int | None = None,
                    rings: bool = True, **kw):
    """(segments with core_id, memberships) of the merged shapes.

    Both start from the outline, which is written once to the checkpoint folder; an edge takes far less there than its segments.
    """
    outline = contours.written(merged_edges(boxes, keys, rings, **kw), "outline")
    # A file of edges makes many segments, so its rows are dealt to as many tasks as these need.
    outline = outline.repartition(tiling.parts_for(outline.sparkSession, outline.count(), EDGES), *keys, "x0", "y0")
    cut = cut_edges(outline, corner, maximum, polarity)
    return seg.owners(cut, grid), seg.memberships(cut, grid, limit=limit)


def write_problem(segments: DataFrame, members: DataFrame, path: str) -> None:
    """Both tables as one versioned archive.

    An edge and a segment's place on it are stored, which repeat and take little; endpoints are computed from them again.
    """
    archive.write_archive({"segments": segments.drop(*DERIVED), "members": members.drop(*DERIVED)}, path, PROBLEM, 1)


def problem(spark: SparkSession, source, grid: tiling.Grid, corner: float, maximum: float, schemas=None, **kw):
    """(segments, memberships) from shapes, or, given a path, from the archive that `write_problem` made.

    `schemas` names the fields an archive must have; by default those that its segments are known by.
    """
    if isinstance(source, DataFrame):
        return prepare_problem(source, grid, corner, maximum, **kw)
    fields = schemas or {"segments": KNOWN, "members": KNOWN}
    tables, _ = archive.read_archive(spark, source, PROBLEM, [1], fields)
    segments, members = (seg.endpoints(contours.with_length(tables[n])) for n in ("segments", "members"))
    return segments, seg.segment_box(members)


def prepare_macro(shapes: DataFrame, context, ownership, grid: tiling.Grid, corner: float,
                  maximum: float, keys=("layer",), polarity: str = "clear",
                  limit: int | None = None, **kw):
    """Active segments and memberships of one macro, from whole intersecting shapes.

    Rows carry polygon, ring and edge numbers. The macro's own borders never become edges. Segments outside the grid keep owner -1
    as read-only context. Memberships cover the macro's tiles only and are not clamped.
    """
    l, b, r, t = filters.check_box(ownership)
    if not (context[0] <= l and context[1] <= b and context[2] >= r and context[3] >= t):
        raise ValueError("context must contain the ownership box")
    whole = shapes.filter(filters.overlaps(context))
    cut = cut_edges(merged_edges(whole, keys, True, **kw), corner, maximum, polarity)
    active = seg.segment_box(cut).filter(filters.touches(context))
    owned = seg.owners(active, grid)
    inside = _tiles_inside(grid, ownership)
    members = tiling.membership(owned.withColumnRenamed("core_id", "owner_id"), grid,
                                clamp=False, limit=limit).filter(inside)
    return owned, members


def macro_of(df: DataFrame, macros: tiling.Grid, grid: tiling.Grid, name="macro_id") -> DataFrame:
    """Add the macro of each row's tile; -1 outside the grid."""
    # Each step names the columns of the one before several times, so they are pinned one by one.
    tile = pin(df, core_id=F.col("core_id"))
    low = pin(tile, _x=grid.x.low(F.pmod("core_id", F.lit(grid.columns))), _y=grid.y.low(tiling.floor_div("core_id", grid.columns)))
    found = pin(tiling.owner(low, macros, "_x", "_y", name).drop("_x", "_y"), **{name: F.col(name)})
    return found.withColumn(name, F.when(F.col("core_id") >= 0, F.col(name)).otherwise(F.lit(-1).cast("long")))


def macro_edges(shapes: DataFrame, macros: tiling.Grid, keys=("layer",), rings: bool = True, only: DataFrame | None = None, **kw) -> DataFrame:
    """Merged edges (macro_id, keys, ...) of every macro (of `only` some: macro_id), each from the whole shapes that touch its context.

    An edge is as in the whole if it lies inside the context; `open` marks those that reach the context's border.
    """
    near = tiling.membership(shapes, macros, clamp=False).withColumnRenamed("core_id", "macro_id")
    if only is not None:
        near = near.join(only.select("macro_id").hint("merge"), "macro_id", "left_semi")
    edges = merged_edges(near, ("macro_id", *keys), rings, **kw)
    n, h = F.lit(macros.columns), macros.halo
    row, column = tiling.floor_div("macro_id", macros.columns), F.pmod("macro_id", n)
    inside = ((F.least("x0", "x1") > macros.x.low(column) - h) & (F.greatest("x0", "x1") < macros.x.high(column) + h) &
              (F.least("y0", "y1") > macros.y.low(row) - h) & (F.greatest("y0", "y1") < macros.y.high(row) + h))
    return edges.withColumn("open", ~inside)


def macro_segments(edges: DataFrame, macros: tiling.Grid, grid: tiling.Grid, corner: float, maximum: float, polarity: str = "clear") -> DataFrame:
    """Segments of `macro_edges` that the edge's own macro owns."""
    cut = seg.owners(cut_edges(edges, corner, maximum, polarity), grid)
    return macro_of(cut, macros, grid, "_macro").filter("_macro = macro_id").drop("_macro")


def prepare_macros(shapes: DataFrame, macros: tiling.Grid, grid: tiling.Grid, corner: float, maximum: float,
                   keys=("layer",), polarity: str = "clear", rings: bool = True, only: DataFrame | None = None, **kw) -> DataFrame:
    """Owned segments of every macro (of `only` some: macro_id), each prepared from the whole shapes that touch its context.

    `macros` is a grid of whole tiles; its halo is the context. A segment is as in the whole if its edge
    lies inside the context; `open` marks those whose edge reaches the context's border, where shapes that
    the macro does not see may change the edge, so that a wider halo is needed.
    """
    edges = macro_edges(shapes, macros, keys, rings, only, **kw)
    owned = macro_segments(edges.withColumnRenamed("open", "_open"), macros, grid, corner, maximum, polarity)
    return owned.select("*", F.col("_open").alias("open")).drop("_open")


def macro_balance(parts: DataFrame, whole: DataFrame, macros: tiling.Grid, grid: tiling.Grid, corner: float, maximum: float,
                  keys=("layer",), polarity: str = "clear", tasks: int | None = None) -> DataFrame:
    """Per macro, the segments of `whole` it owns, those missing from or extra in its part, and the open ones (keys, macro_id, owned,
    missing, extra, open).

    `parts` are `macro_edges`, `whole` the merged edges of all shapes. Edges meet before they are cut: one that is alike in both has alike
    segments, which are only counted. Segments of other edges are compared one by one, by place. `tasks` is the number that edges are dealt to.
    """
    keys, ends = list(keys), ["x0", "y0", "x1", "y1", "nx", "ny"]
    bare = tiling.Grid(macros.x, macros.y)

    def near(df):
        """An edge in each macro that its box touches, and so in each that owns a segment of it."""
        box = df.withColumns({"l": F.least("x0", "x1"), "b": F.least("y0", "y1"), "r": F.greatest("x0", "x1"), "t": F.greatest("y0", "y1")})
        return tiling.membership(box, bare)

    count = lambda p, w, o: [F.lit(p).alias("p"), F.lit(w).alias("w"), o.alias("o")]
    own = near(parts).filter("core_id = macro_id").select("macro_id", *keys, *ends, *count(1, 0, F.col("open").cast("int")))
    all_ = near(whole).select(F.col("core_id").alias("macro_id"), *keys, *ends, *count(0, 1, F.lit(0)))
    both = own.unionByName(all_).repartition(tasks or region.shuffle_partitions(whole), *ends, "macro_id", *keys)
    edges = both.groupBy("macro_id", *keys, *ends).agg(*[F.sum(c).alias(c) for c in "pwo"])
    cut = macro_segments(edges, macros, grid, corner, maximum, polarity).filter("core_id >= 0")
    place = ["core_id", "sx", "sy", "ex", "ey", "nx", "ny"]
    unlike = cut.select("macro_id", *keys, *[F.when(F.col("p") != F.col("w"), F.col(c)).alias(c) for c in place], "p", "w", "o")
    met = unlike.groupBy("macro_id", *keys, *place).agg(*[F.sum(c).alias(c) for c in "pwo"])
    more = lambda a, b: F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0)))
    return met.groupBy(*keys, "macro_id").agg(F.sum("w").alias("owned"), more("w", "p").alias("missing"), more("p", "w").alias("extra"),
                                              F.sum("o").alias("open"))


def closed_macros(shapes: DataFrame, macros: tiling.Grid, grid: tiling.Grid, corner: float, maximum: float,
                  keys=("layer",), polarity: str = "clear", rings: bool = True, **kw) -> DataFrame:
    """Owned segments of every macro as in the whole, with the halo that each macro needs.

    Macros with open segments are prepared again with twice the halo, until none is left; a macro whose context
    holds all shapes has none. So steps number the logarithm of the longest edge over the first halo, and
    only macros that long edges leave take part in the later ones. Adds `halo`, the one that was enough.

    A step writes its edges, which take far less than their segments, and cuts only the open ones; the edges that
    hold are cut once, after the last step.
    """
    done, only, halo = [], None, max(macros.halo, 1)
    while True:
        wide = tiling.Grid(macros.x, macros.y, halo)
        edges = contours.written(macro_edges(shapes, wide, keys, rings, only, **kw), "macro_edges")
        only = macro_segments(edges.filter("open"), macros, grid, corner, maximum, polarity).select("macro_id").distinct().checkpoint()
        done.append(edges.drop("open").join(F.broadcast(only), "macro_id", "left_anti").withColumn("halo", F.lit(halo).cast("long")))
        if only.isEmpty():
            break
        halo *= 2
    held = reduce(DataFrame.unionByName, done)
    held = held.repartition(tiling.parts_for(held.sparkSession, held.count(), EDGES), "macro_id", *keys, "x0", "y0")
    return macro_segments(held, macros, grid, corner, maximum, polarity)


def _tiles_inside(grid: tiling.Grid, box):
    """Predicate on core_id: the tile lies in the box, whose borders must be tile cuts."""
    n = grid.columns
    row = (F.col("core_id") - F.pmod(F.col("core_id"), F.lit(n))) / n
    column = F.pmod(F.col("core_id"), F.lit(n))
    l, b, r, t = box
    for axis, values in ((grid.x, (l, r)), (grid.y, (b, t))):
        for v in values:
            on = v in axis.cuts if axis.cuts else v == axis.end or (v - axis.start) % axis.step == 0
            if not on:
                raise ValueError("macro borders must lie on tile cuts")
    return ((grid.x.low(column) >= l) & (grid.x.high(column) <= r) &
            (grid.y.low(row.cast("long")) >= b) & (grid.y.high(row.cast("long")) <= t))


def seen_polygons(members: DataFrame, cores: DataFrame | None = None) -> DataFrame:
    """(core_id, polygon_id) pairs of polygons with a segment in the tile's context."""
    pairs = members.select("core_id", "polygon_id").distinct()
    return pairs if cores is None else pairs.join(cores.select("core_id"), "core_id", "left_semi")


def subset_polygons(shapes: DataFrame, seen: DataFrame) -> DataFrame:
    """Whole polygons, holes included."""
    return shapes.join(seen.select("polygon_id").distinct().hint("merge"), "polygon_id", "left_semi")


def moved_tiles(members: DataFrame, state: DataFrame) -> DataFrame:
    """Tiles that see a segment whose shift is not exactly 0.

    Few segments may have moved, so members are thinned by those before the join.
    """
    moved = state.filter("d <> 0").select(*SEGMENT_KEY)
    seen = filters.thinned(members.select("core_id", *SEGMENT_KEY), moved, SEGMENT_KEY)
    return seen.join(moved.hint("merge"), SEGMENT_KEY, "left_semi").select("core_id").distinct()


def still_tiles(tiles: DataFrame, members: DataFrame, state: DataFrame) -> DataFrame:
    """Tiles that can reuse the reference raster."""
    return tiles.join(moved_tiles(members, state).hint("merge"), "core_id", "left_anti")


def ring_base(edges: DataFrame, margin: int = 0) -> DataFrame:
    """Add `base`, a line at or below the edge's ring, for `region.ring_boxes`.

    Edges that carry `low` (the lowest y of the source ring) need no shuffle; `margin` is
    how far the ring may have moved since.
    """
    if "low" in edges.columns:
        return edges.withColumn("base", F.col("low") - margin)
    low = edges.groupBy("polygon_id", "ring_id").agg(F.min(F.least("y0", "y1")).alias("base"))
    return edges.join(low.hint("merge"), ["polygon_id", "ring_id"])


def rebuilt_region(edges: DataFrame, keys=("layer",), margin: int = 0, **kw) -> DataFrame:
    """Disjoint rectangles of Manhattan contours given as edges with clockwise hulls."""
    return region.union(region.ring_boxes(ring_base(edges, margin), keys), keys=keys, **kw)


def escaped_holes(edges: DataFrame, margin: int = 0, **kw) -> DataFrame:
    """Polygons with hole area outside their hull; edges carry is_hole."""
    boxes = region.ring_boxes(ring_base(edges, margin), ("polygon_id", "is_hole"))
    # Holes run the other way round, so their boxes count negative; turn them positive.
    hole = boxes.filter("is_hole").withColumn("w", -F.col("w"))
    hull = boxes.filter(~F.col("is_hole"))
    return region.difference(hole, hull, keys=("polygon_id",), **kw).select("polygon_id").distinct()
