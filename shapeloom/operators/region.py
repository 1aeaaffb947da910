"""Exact set algebra on boxes: union, intersection, difference, symmetric difference.

Shapes are clipped to blocks of the plane and dealt by block, so that the work of one task is bounded by
blocks and not by the layout. Inside a block, strips an eighth to a sixteenth as wide hold few distinct x
coordinates, which form slabs; each shape gives +1/-1 events on y for the slabs it spans, and a running sum
per side tells where the requested predicate holds (`cells`, many blocks at a time). There is one plan for
every input: copies of a box are merged on the map side, and one shuffle by block serves all that follows.
"""
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from shapeloom.functions.scalars import floor_div
from shapeloom.operators import cells

CELL = 2048
STRIPS = 16
# Spans are joined in stretches of this many cells before they are joined over the layout.
BLOCK = 128
# Clipped boxes that a task takes at a time, in whole cells: few enough that their events stay near the processor.
ROWS = 1 << 14

PREDICATES = {
    "union": lambda a, b: a | b,
    "intersection": lambda a, b: a & b,
    "difference": lambda a, b: a & ~b,
    "xor": lambda a, b: a != b,
}


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _clip(boxes: DataFrame, cell: int) -> DataFrame:
    """One row per (box, cell) with the box clipped to the cell."""
    hi = F.col("r") - 1, F.col("t") - 1
    return (boxes
            .withColumn("cx", F.explode(F.sequence(floor_div("l", cell), floor_div(hi[0], cell))))
            .withColumn("cy", F.explode(F.sequence(floor_div("b", cell), floor_div(hi[1], cell))))
            .withColumn("l", F.greatest("l", F.col("cx") * cell))
            .withColumn("r", F.least("r", (F.col("cx") + 1) * cell))
            .withColumn("b", F.greatest("b", F.col("cy") * cell))
            .withColumn("t", F.least("t", (F.col("cy") + 1) * cell)))


def _merge(pieces: DataFrame, cols) -> DataFrame:
    """One row per distinct box with its summed weight; copies combine on the map side."""
    return (pieces.groupBy(*cols).agg(F.sum("w").alias("w"))
            .filter(F.col("w") != 0))


def cell_pieces(boxes: DataFrame, keys, cell: int = CELL) -> DataFrame:
    """Distinct boxes, clipped to their cells; copies are merged before anything is exploded."""
    return _clip(_merge(boxes, [*keys, "side", "l", "b", "r", "t"]), cell)


def line_sweep(spans: DataFrame, part, keep, weights=("s",), predicate=None) -> DataFrame:
    """Add up signed spans on lines; return maximal spans (lo, hi, s) of constant sum s <> 0.

    `spans` has lo, hi and one column per weight; the columns `part` identify a line and
    the columns `keep` stay in the result. A `predicate` on the sums replaces the sum by
    1 where it holds, so that only its outline is kept.
    """
    w = W.partitionBy(*part).orderBy("pos")
    running = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    cols = list(dict.fromkeys([*part, *keep]))
    events = spans.select(*cols, *weights, F.explode(F.array(
        F.struct(F.col("lo").alias("pos"), F.lit(1).alias("m")),
        F.struct(F.col("hi").alias("pos"), F.lit(-1).alias("m")))).alias("e"))
    events = events.select(*cols, F.col("e.pos").alias("pos"),
                           *[(F.col(x) * F.col("e.m")).alias(x) for x in weights])
    sums = events.select(*cols, "pos", F.lead("pos").over(w).alias("next"),
                         *[F.sum(x).over(running).alias(x) for x in weights])
    # Only the last event at a position shows the settled sum.
    sums = sums.filter(F.col("next").isNull() | (F.col("next") > F.col("pos")))
    state = (F.col(weights[0]) if predicate is None
             else predicate(*[F.col(x) for x in weights]).cast("long"))
    turns = (sums.withColumn("v", state).withColumn("was", F.lag("v", 1, 0).over(w))
             .filter(F.col("was") != F.col("v")))
    out = turns.withColumn("hi", F.lead("pos").over(w)).filter(F.col("v") != 0)
    return out.select(*keep, F.col("pos").alias("lo"), "hi", F.col("v").alias("s"))


def _dealt(sides, keys, cell: int, partitions) -> DataFrame:
    """Boxes of all sides with their side's number and weight w, clipped to cells; rows of a cell follow each other in one task."""
    def rows(df, side):
        weight = F.col("w") if "w" in df.columns else F.lit(1).cast("long")
        return df.select(*keys, *[F.col(c).cast("long").alias(c) for c in "lbrt"], F.lit(side).alias("side"), weight.alias("w"))

    both = reduce(DataFrame.unionByName, [rows(df, i) for i, df in enumerate(sides)])
    both = both.filter((F.col("l") < F.col("r")) & (F.col("b") < F.col("t")))
    where = ["cx", "cy", *keys]
    pieces = cell_pieces(both, keys, cell).select(*where, "l", "b", "r", "t", "side", F.col("w").cast("long").alias("w"))
    return pieces.repartition(partitions or shuffle_partitions(sides[0]), *where).sortWithinPartitions(*where)


def _stepped(g, box, side, w, n: int, steps, cell: int, strip: int):
    """Rectangles (g, l, b, r, t) of the last one of `steps` on boxes of `n` sides."""
    made = []
    for op, *of in steps:
        parts = []
        for place, i in enumerate(of):
            if i < n:
                rows = np.flatnonzero(side == i)
                parts.append((g[rows], *[v[rows] for v in box], w[rows], place))
            else:
                parts.append((*made[i - n], np.ones(len(made[i - n][0]), np.int64), place))
        at = [np.concatenate([p[k] for p in parts]) for k in range(6)]
        place = np.repeat([p[6] for p in parts], [len(p[0]) for p in parts])
        made.append(cells.swept(*at[:5], *[np.where(place == k, at[5], 0) for k in (0, 1)], PREDICATES[op], cell, strip))
    return made[-1]


def _by_cells(pieces: DataFrame, n: int, steps, keys, cell: int, fields, solve) -> DataFrame:
    """Sweep whole cells and give the key columns and what `solve` makes of the rectangles and the cells' corners."""
    where, strip = ["cx", "cy", *keys], max(1, cell // STRIPS)
    schema = T.StructType([*[pieces.schema[c] for c in where], *fields])

    def task(batches):
        for t, g in cells.whole_groups(batches, where, ROWS):
            x, y = (t.column(c).to_numpy() * cell for c in ("cx", "cy"))
            v = [t.column(c).to_numpy() for c in ("l", "b", "r", "t", "side", "w")]
            rects = _stepped(g, (v[0] - x, v[1] - y, v[2] - x, v[3] - y), v[4], v[5], n, steps, cell, strip)
            first = np.flatnonzero(np.diff(g, prepend=-1))
            of, columns = solve(rects, x[first], y[first])
            names = t.select(where).take(pa.array(first[of]))
            out = pa.Table.from_arrays([*names.columns, *[pa.array(c) for c in columns]], names=schema.names)
            yield from out.to_batches(max_chunksize=1 << 16)

    return pieces.mapInArrow(task, schema)


def _two(a, b, op):
    """Sides and steps of one operation."""
    return ([a], [(op, 0)]) if b is None else ([a, b], [(op, 0, 1)])


def chain(sides, steps, *, keys=("layer",), cell: int = CELL, partitions: int | None = None) -> DataFrame:
    """Disjoint rectangles (keys, cx, cy, l, b, r, t) of set operations that follow each other, as `sweep` gives them one by one.

    `steps` are tuples of a predicate and of one or two numbers: of `sides`, or from len(sides) on of the steps before. A set
    operation needs no more of a side than its part of the cell, so every step is swept cell by cell, after one shuffle of the sides.
    """
    keys, sides, steps = list(keys), list(sides), [tuple(s) for s in steps]
    for k, (op, *of) in enumerate(steps):
        if op not in PREDICATES or not 1 <= len(of) <= 2 or any(not 0 <= i < len(sides) + k for i in of):
            raise ValueError(f"step {k} needs a predicate and one or two sides or steps before it: {steps[k]}")

    def solve(rects, x, y):
        g, l, b, r, t = rects
        return g, (l + x[g], b + y[g], r + x[g], t + y[g])

    found = _by_cells(_dealt(sides, keys, cell, partitions), len(sides), steps, keys, cell,
                      [T.StructField(c, T.LongType()) for c in "lbrt"], solve)
    return found.select(*keys, "cx", "cy", "l", "b", "r", "t")


def sweep(a: DataFrame, b: DataFrame | None = None, op: str = "union", *,
          keys=("layer",), cell: int = CELL, partitions: int | None = None) -> DataFrame:
    """Disjoint rectangles (keys, cx, cy, l, b, r, t) where the set predicate holds.

    Inputs need the key columns and l, b, r, t; an integer column `w` gives signed boxes,
    whose sum of weights must be positive exactly where the shape is. The result keeps its cell columns.
    """
    return chain(*_two(a, b, op), keys=keys, cell=cell, partitions=partitions)


def outline(a: DataFrame, b: DataFrame | None = None, op: str = "union", *,
            keys=("layer",), cell: int = CELL, partitions: int | None = None) -> DataFrame:
    """Maximal boundary edges (keys, horizontal, coord, lo, hi, s) of where the set predicate holds.

    `s` is +1 on bottom and left edges, -1 on top and right edges. Sides of rectangles are summed inside
    their cell, where most edges are complete; only spans that touch a cell's border are shuffled: they are
    summed per line and stretch of cells, and then over the whole line.
    """
    keys, (sides, steps) = list(keys), _two(a, b, op)

    def solve(rects, x, y):
        g, flat, coord, lo, hi, s = cells.outlined(*rects, cell)
        inner = (coord > 0) & (coord < cell) & (lo > 0) & (hi < cell)
        across, along = np.where(flat, y[g], x[g]), np.where(flat, x[g], y[g])
        return g, (flat, coord + across, lo + along, hi + along, s, inner)

    long = T.LongType()
    fields = [T.StructField("horizontal", T.BooleanType()), *[T.StructField(c, long) for c in ("coord", "lo", "hi", "s")],
              T.StructField("inner", T.BooleanType())]
    # Both parts read the same shuffled cells; sweeping these twice is cheaper than a shuffle of all edges.
    spans = _by_cells(_dealt(sides, keys, cell, partitions), len(sides), steps, keys, cell, fields, solve)
    line, cols = [*keys, "horizontal", "coord"], [*keys, "horizontal", "coord", "lo", "hi", "s"]
    return spans.filter("inner").select(*cols).unionByName(
        _joined(spans.filter("not inner").select(*cols), line, keys, cell * BLOCK).select(*cols))


def _joined(spans: DataFrame, line, keys, width: int) -> DataFrame:
    """Spans that lie in one stretch of `width` each, summed per line and stretch and then per line."""
    spans = spans.withColumn("_blk", floor_div("lo", width)).repartition(shuffle_partitions(spans), *line, "_blk")
    spans = line_sweep(spans, ["coord", "_blk", *keys, "horizontal"], line)
    at_border = (F.pmod("lo", F.lit(width)) == 0) | (F.pmod("hi", F.lit(width)) == 0)
    spans = spans.withColumn("_own", F.when(~at_border, F.col("lo")))
    return line_sweep(spans, ["coord", "_own", *keys, "horizontal"], line)


def union(boxes, **kw):
    return sweep(boxes, **kw)


def intersection(a, b, **kw):
    return sweep(a, b, "intersection", **kw)


def difference(a, b, **kw):
    return sweep(a, b, "difference", **kw)


def symmetric_difference(a, b, **kw):
    return sweep(a, b, "xor", **kw)


def replace_local(target, reference, current, *, keys=("layer",), **kw):
    """`(target - reference) + current`."""
    return chain([target, reference, current], [("difference", 0, 1), ("union", 3, 2)], keys=keys, **kw)


def polarity_complement(boxes, field, *, keys=("layer",), **kw):
    """What the field boxes cover and the shapes do not; outside the field nothing."""
    return difference(field, boxes, keys=keys, **kw)


def grow(boxes, d: int, *, keys=("layer",), **kw):
    """Every point within `d` of the shapes in both axes."""
    if d < 0:
        raise ValueError("growth must not be negative")
    return union(boxes.select(*keys, (F.col("l") - d).alias("l"), (F.col("b") - d).alias("b"),
                              (F.col("r") + d).alias("r"), (F.col("t") + d).alias("t")),
                 keys=keys, **kw)


def area(rects: DataFrame, keys=("layer",)) -> DataFrame:
    return rects.groupBy(*keys).agg(
        F.sum((F.col("r") - F.col("l")) * (F.col("t") - F.col("b"))).alias("area"))


def is_empty(rects: DataFrame) -> bool:
    return rects.isEmpty()


def boundary_edges(rects: DataFrame, *, keys=("layer",), cell: int = CELL) -> DataFrame:
    """Maximal boundary edges (keys, horizontal, coord, lo, hi, s) of disjoint rectangles, as `outline` gives them."""
    return outline(rects, keys=keys, cell=cell)


def directed_edges(edges: DataFrame, keys=("layer",)) -> DataFrame:
    """Boundary edges as vectors with the covered side on the right, plus outward normals.

    Hulls therefore run clockwise and holes anticlockwise.
    """
    lo_first = F.when(F.col("horizontal"), F.col("s") < 0).otherwise(F.col("s") > 0)
    start = F.when(lo_first, F.col("lo")).otherwise(F.col("hi"))
    stop = F.when(lo_first, F.col("hi")).otherwise(F.col("lo"))
    h = F.col("horizontal")
    out = -F.col("s").cast("double")
    return edges.select(
        *keys,
        F.when(h, start).otherwise(F.col("coord")).alias("x0"),
        F.when(h, F.col("coord")).otherwise(start).alias("y0"),
        F.when(h, stop).otherwise(F.col("coord")).alias("x1"),
        F.when(h, F.col("coord")).otherwise(stop).alias("y1"),
        F.when(h, 0.0).otherwise(out).alias("nx"),
        F.when(h, out).otherwise(0.0).alias("ny"))


def slanted(edges: DataFrame) -> DataFrame:
    """Edges that are neither horizontal nor vertical, which set operations do not take, as issues."""
    name = [c for c in ("polygon_id", "ring_id", "ord") if c in edges.columns]
    where = F.concat(F.lit("edge from "), F.format_string("(%s, %s)", F.col("x0"), F.col("y0")))
    return edges.filter((F.col("x0") != F.col("x1")) & (F.col("y0") != F.col("y1"))).select(
        F.lit("non_manhattan_edge").alias("code"), where.alias("message"), *name)


def ring_boxes(edges: DataFrame, keys=("layer",)) -> DataFrame:
    """Signed boxes whose sum is the area enclosed by Manhattan rings, holes left out.

    Each horizontal edge becomes a box between it and the ring's lowest line: positive under
    an upper edge of the material, negative under a lower one. `edges` must have the
    material on its right and carry `base`, a line at or below the whole ring. A slanted edge is
    refused while the boxes are computed; `slanted` lists them.
    """
    straight = (F.col("x0") == F.col("x1")) | (F.col("y0") == F.col("y1"))
    refused = F.raise_error(F.format_string("slanted edge from (%s, %s) in a set operation", F.col("x0"), F.col("y0")))
    # The check is part of a column in use, so it is not optimised away.
    top = F.when(straight, F.col("y0")).otherwise(refused.cast("long"))
    edges = edges.filter(~straight | (F.col("y0") == F.col("y1")))
    return edges.select(
        *keys, F.least("x0", "x1").alias("l"), F.col("base").alias("b"),
        F.greatest("x0", "x1").alias("r"), top.alias("t"),
        F.when(F.col("x1") > F.col("x0"), 1).otherwise(-1).cast("long").alias("w"))


def touching_pairs(left: DataFrame, right: DataFrame, keys=("layer",), cell: int = 4096):
    """Rows of `left` that share area with some row of `right` (semi-join by cells).

    Both sides are spread over cells and compared inside a cell; `right` is expected to be
    disjoint rectangles, so a cell holds a bounded number of them.
    """
    cols = [*keys, "l", "b", "r", "t"]
    def cut(df):
        return (df.withColumn("_cx", F.explode(F.sequence(
                    floor_div("l", cell), floor_div(F.col("r") - 1, cell))))
                .withColumn("_cy", F.explode(F.sequence(
                    floor_div("b", cell), floor_div(F.col("t") - 1, cell)))))
    other = cut(right.select(*cols)).toDF(*keys, "l2", "b2", "r2", "t2", "_cx", "_cy")
    pairs = cut(left).join(other.hint("merge"), [*keys, "_cx", "_cy"])
    return pairs.filter((F.col("l") < F.col("r2")) & (F.col("r") > F.col("l2")) &
                        (F.col("b") < F.col("t2")) & (F.col("t") > F.col("b2"))
                        ).select(*left.columns).distinct()


def tile_coverage(tiles: DataFrame, bounds) -> DataFrame:
    """One row: summed tile area, union area, overlap and gap against the bounds."""
    l, b, r, t = bounds
    size = (F.col("r") - F.col("l")) * (F.col("t") - F.col("b"))
    none = F.lit(0).cast("long")
    one = tiles.select(F.lit(0).alias("k"), "l", "b", "r", "t")
    merged = union(one, keys=("k",), cell=4096)
    return one.select(size.alias("s"), none.alias("u")).unionByName(
        merged.select(none.alias("s"), size.alias("u"))).agg(
        F.sum("s").alias("area_sum"), F.sum("u").alias("union_area")).select(
        "area_sum", "union_area", (F.col("area_sum") - F.col("union_area")).alias("overlap"),
        (F.lit((r - l) * (t - b)) - F.col("union_area")).alias("gap"))
