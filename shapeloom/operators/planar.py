"""Set algebra on polygons with edges of any angle, on the integer grid.

Shapes are directed edges with the material on their right. Edges are cut where they meet: every end
of an edge and every crossing, rounded to the grid, is a hot point, and an edge that passes through the
unit square around a hot point is led through that point. After that, pieces meet at ends only (snap
rounding), and no piece is further than half a unit in x and y from its edge. Results are edges between grid points
again, so they can be used in turn.

Edges are dealt by cell, and whole cells are taken with arrays (`snap`): an edge is a row in each cell it passes, and a
crossing counts in the cell that holds it. Coverage is counted in cells too: pieces above each other in a column have a
fixed order, and what lies below the cell comes in as the cover of its corner, which is a sum over corners. So no row
is made per column, and no task holds more than the pieces of its cells.

Coordinates and differences must stay below 2**30 in size, so that products of two fit 64 bits; crossings are exact.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from shapeloom.functions.scalars import floor_div
from shapeloom.operators import snap
from shapeloom.operators.cells import whole_groups
from shapeloom.operators.contours import ring_edges, written
from shapeloom.operators.region import PREDICATES, shuffle_partitions

# Edges are compared in pairs inside a cell, but every edge that crosses its border is a row more, twice.
CELL = 1024
COLUMN = 1024
# Rows that a task takes at a time, in whole cells.
ROWS = 1 << 14
PIECE = ["lx", "ly", "hx", "hy"]
ENDS = ["x0", "y0", "x1", "y1"]


def _longs(*names):
    return [T.StructField(c, T.LongType()) for c in names]


def material_edges(shapes: DataFrame, keys=("layer",)) -> DataFrame:
    """Edges (keys, x0, y0, x1, y1) of polygons with their material on the right, whichever way rings run."""
    e = ring_edges(shapes, keys).filter("x0 <> x1 or y0 <> y1")
    turned = (F.col("area2") > 0) != F.col("is_hole")
    return e.select(*keys, *[F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a)
                             for a, b in (("x0", "x1"), ("y0", "y1"), ("x1", "x0"), ("y1", "y0"))])


def box_edges(boxes: DataFrame, keys=("layer",)) -> DataFrame:
    """The same for boxes (keys, l, b, r, t); empty boxes have none."""
    corners = [("l", "b"), ("l", "t"), ("r", "t"), ("r", "b")]
    sides = [F.struct(F.col(p).alias("x0"), F.col(q).alias("y0"), F.col(r).alias("x1"), F.col(s).alias("y1"))
             for (p, q), (r, s) in zip(corners, corners[1:] + corners[:1])]
    solid = boxes.filter((F.col("l") < F.col("r")) & (F.col("b") < F.col("t")))
    return solid.select(*keys, F.explode(F.array(*sides)).alias("e")).select(*keys, "e.*")


def _low_first(edges: DataFrame, keys, wa: Column, wb: Column) -> DataFrame:
    """Undirected pieces with signs: 1 for material below (or right of an upright piece)."""
    low_first = (F.col("x0") < F.col("x1")) | ((F.col("x0") == F.col("x1")) & (F.col("y0") < F.col("y1")))
    sign = F.when(low_first, 1).otherwise(-1)
    ends = [F.when(low_first, F.col(a)).otherwise(F.col(b)).alias(c)
            for a, b, c in (("x0", "x1", "lx"), ("y0", "y1", "ly"), ("x1", "x0", "hx"), ("y1", "y0", "hy"))]
    return edges.filter("x0 <> x1 or y0 <> y1").select(*keys, *ends, (wa * sign).alias("wa"), (wb * sign).alias("wb"))


def _summed(rows: DataFrame, keys) -> DataFrame:
    """One row of each piece."""
    return (rows.groupBy(*keys, *PIECE).agg(F.sum("wa").alias("wa"), F.sum("wb").alias("wb"))
            .filter("wa <> 0 or wb <> 0"))


def _pieces(edges: DataFrame, keys, wa: Column, wb: Column) -> DataFrame:
    """Undirected pieces with summed signs."""
    return _summed(_low_first(edges, keys, wa, wb), keys)


def _arrays(batch):
    """The numbers of a batch's snap."""
    return [batch.column(c).to_numpy() for c in (*PIECE, "wa", "wb")]


def _in_cells(rows: DataFrame, keys, cell: int) -> DataFrame:
    """A row per cell that a piece passes, with a margin of one unit."""
    schema = T.StructType([*[rows.schema[k] for k in keys], *_longs("cx", "cy", *PIECE, "wa", "wb")])

    def task(batches):
        for batch in batches:
            lx, ly, hx, hy, *_ = _arrays(batch)
            for s, e in snap.slices((hx - lx + np.abs(hy - ly)) // cell + 4):
                row, cx, cy = snap.spread(*[v[s:e] for v in (lx, ly, hx, hy)], cell)
                some = batch.slice(s, e - s).take(pa.array(row))
                found = {"cx": pa.array(cx), "cy": pa.array(cy)}
                yield from _batches([found[c] if c in found else some.column(c) for c in schema.names], schema)

    return rows.select(*keys, *PIECE, "wa", "wb").mapInArrow(task, schema)


def _batches(columns, schema):
    return pa.Table.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=schema.names).to_batches(max_chunksize=1 << 16)


def _by_cells(spread: DataFrame, keys, cell: int, schema, solve, parts) -> DataFrame:
    """Whole cells at a time: `solve` gives rows of the table and columns for them."""
    where = ["cx", "cy", *keys]
    dealt = spread.repartition(parts, *where).sortWithinPartitions(*where)

    def task(batches):
        for t, g in whole_groups(batches, where, ROWS):
            x, y = (t.column(c).to_numpy() * cell for c in ("cx", "cy"))
            for row, columns in solve(g, x, y, t):
                yield from _batches([*t.select(list(keys)).take(pa.array(row)).columns, *columns], schema)

    return dealt.mapInArrow(task, schema)


def crossings(rows: DataFrame, keys=("layer",), cell: int = CELL) -> DataFrame:
    """Grid points (keys, px, py) nearest to the places where two pieces cross inside both."""
    keys = list(keys)
    rows = rows.select(*keys, *PIECE, F.lit(0).cast("long").alias("wa"), F.lit(0).cast("long").alias("wb"))
    schema = T.StructType([*[rows.schema[k] for k in keys], *_longs("px", "py")])

    def solve(g, x, y, t):
        at, px, py = snap.crossings(g, x, y, *_arrays(t)[:4], cell)
        yield np.searchsorted(g, at), (px, py)

    return _by_cells(_in_cells(rows, keys, cell), keys, cell, schema, solve, shuffle_partitions(rows)).distinct()


def _steps(rows: DataFrame, keys, cell: int) -> DataFrame:
    """Pieces (keys, lx, ly, hx, hy, wa, wb) cut so that they meet at ends only; one may come from several.

    Most steps lie inside a cell, where they are known at once. For the others, points next to a cell's border meet those of other cells
    along the whole piece.
    """
    schema = T.StructType([*[rows.schema[k] for k in keys], *_longs(*PIECE, "wa", "wb", "px", "py"), T.StructField("joined", T.BooleanType())])

    def solve(g, x, y, t):
        lx, ly, hx, hy, wa, wb = _arrays(t)
        (i, *ends), (far, px, py, joined) = snap.steps(g, x, y, lx, ly, hx, hy, cell)
        none = lambda kind: pa.nulls(len(i), kind)
        yield i, (*ends, wa[i], wb[i], none(pa.int64()), none(pa.int64()), none(pa.bool_()))
        yield far, (*[v[far] for v in (lx, ly, hx, hy, wa, wb)], px, py, joined)

    if not 0 < cell <= 1 << 20:
        raise ValueError("cells are of 1 to 2**20 units")
    # Read twice, so it is written to the checkpoint folder.
    cut = written(_by_cells(_in_cells(rows, keys, cell), keys, cell, schema, solve, shuffle_partitions(rows)), "steps")
    along = (F.col("px") - F.col("lx")) * (F.col("hx") - F.col("lx")) + (F.col("py") - F.col("ly")) * (F.col("hy") - F.col("ly"))
    w = W.partitionBy(*PIECE, *keys).orderBy(along)
    far = cut.filter("joined is not null").withColumns({"x0": F.lag("px").over(w), "y0": F.lag("py").over(w)}).filter("not joined and x0 is not null")
    far = written(far.select(*keys, "x0", "y0", F.col("px").alias("x1"), F.col("py").alias("y1"), "wa", "wb"), "far_steps")
    near = cut.filter("joined is null").select(*keys, *[F.col(c).alias(a) for c, a in zip(PIECE, ENDS)], "wa", "wb")
    return _low_first(near.unionByName(far), keys, F.col("wa"), F.col("wb"))


def snapped(rows: DataFrame, keys=("layer",), cell: int = CELL) -> DataFrame:
    """Pieces (keys, lx, ly, hx, hy, wa, wb) cut so that they meet at ends only."""
    keys = list(keys)
    return _summed(_steps(rows, keys, cell), keys)


def _seeds(rows: DataFrame, keys, cell: int) -> DataFrame:
    """(keys, cx, cy, wa, wb): cover of the place half a unit left of and below the corner of each cell where a piece has its low end.

    A piece counts in the lowest corner above it of each line between columns of cells that it crosses; corners are then added up from below.
    """
    where = [*keys, "cx", "cy"]
    schema = T.StructType([*[rows.schema[k] for k in keys], *_longs("cx", "cy", "wa", "wb")])

    def task(batches):
        for batch in batches:
            lx, ly, hx, hy, wa, wb = _arrays(batch)
            for s, e in snap.slices(hx // cell - lx // cell + 1):
                some = batch.slice(s, e - s)
                row, *found = snap.seeds(*[v[s:e] for v in (lx, ly, hx, hy, wa, wb)], cell)
                yield from _batches([*[some.column(k).take(pa.array(row)) for k in keys], *found], schema)

    below = rows.select(*keys, *PIECE, "wa", "wb").mapInArrow(task, schema).groupBy(*where).agg(
        F.sum("wa").alias("wa"), F.sum("wb").alias("wb"), F.max(F.lit(False)).alias("own"))
    own = rows.groupBy(*keys, floor_div("lx", cell).alias("cx"), floor_div("ly", cell).alias("cy")).agg(
        F.lit(0).cast("long").alias("wa"), F.lit(0).cast("long").alias("wb"), F.max(F.lit(True)).alias("own"))
    w = W.partitionBy("cx", *keys).orderBy("cy")
    sums = below.unionByName(own).select(*where, "own", *[F.sum(c).over(w).alias(c) for c in ("wa", "wb")])
    return sums.filter("own and (wa <> 0 or wb <> 0)").drop("own")


def _with_cover(rows: DataFrame, keys, cell: int) -> DataFrame:
    """Snapped pieces with the numbers of shapes below them (left of upright ones): ca, cb. Copies of a piece are summed."""
    keys = list(keys)
    schema = T.StructType([*[rows.schema[k] for k in keys], *_longs(*PIECE, "wa", "wb", "ca", "cb")])

    def solve(g, x, y, t):
        corner = np.flatnonzero(np.diff(g, prepend=-1))
        x0, y0, v = x[corner], y[corner], _arrays(t)
        # A cell's seed stands among its pieces as a row without a place.
        start = t.column("lx").is_null().to_numpy()
        seeds = [np.bincount(g[start], w[start], len(corner)).astype(np.int64) for w in v[4:]]
        g, lx, ly, hx, hy, wa, wb = snap.merged(g[~start], *[c[~start].astype(np.int64) for c in v])
        own, ca, cb = snap.covers(g, x0[g], y0[g], lx, ly, hx, hy, wa, wb, seeds, cell)
        yield corner[g[own]], (*[c[own] for c in (lx, ly, hx, hy, wa, wb)], ca, cb)

    nowhere = [F.lit(None).cast("long").alias(c) for c in PIECE]
    spread = _in_cells(rows, keys, cell).unionByName(_seeds(rows, keys, cell).select(*keys, "cx", "cy", *nowhere, "wa", "wb"))
    return _by_cells(spread, keys, cell, schema, solve, shuffle_partitions(rows))


def overlay(a: DataFrame, b: DataFrame | None = None, op: str = "union", *, keys=("layer",), cell: int = CELL,
            column: int = COLUMN) -> DataFrame:
    """Boundary edges (keys, x0, y0, x1, y1) of where the set predicate holds, material on the right.

    `a` and `b` are closed outlines as edges with the material on the right; where an input covers a place more than once it
    counts once. `cell` is the size of the cells in which edges are cut, `column` that of those in which coverage is counted.
    """
    keys = list(keys)
    rows = lambda df, side: df.select(*keys, "x0", "y0", "x1", "y1", F.lit(side).alias("side"))
    both = rows(a, 0) if b is None else rows(a, 0).unionByName(rows(b, 1))
    first = F.when(F.col("side") == 0, 1).otherwise(0)
    pieces = _pieces(both, keys, first.cast("long"), (1 - first).cast("long"))
    covered = _with_cover(_steps(pieces, keys, cell), keys, column)
    hit, upright = PREDICATES[op], F.col("lx") == F.col("hx")
    here = hit(F.col("ca") > 0, F.col("cb") > 0)
    turn = F.when(upright, 1).otherwise(-1)
    there = hit(F.col("ca") + turn * F.col("wa") > 0, F.col("cb") + turn * F.col("wb") > 0)
    # Material right of the direction from low to high: below it, or, if it is upright, on its right.
    forth = F.when(upright, there).otherwise(here)
    kept = covered.filter(here != there)
    return kept.select(*keys, *[F.when(forth, F.col(p)).otherwise(F.col(q)).alias(n)
                                for p, q, n in (("lx", "hx", "x0"), ("ly", "hy", "y0"), ("hx", "lx", "x1"), ("hy", "ly", "y1"))])


def union(a, **kw):
    return overlay(a, **kw)


def intersection(a, b, **kw):
    return overlay(a, b, "intersection", **kw)


def difference(a, b, **kw):
    return overlay(a, b, "difference", **kw)


def symmetric_difference(a, b, **kw):
    return overlay(a, b, "xor", **kw)


def area2(edges: DataFrame, keys=("layer",)) -> DataFrame:
    """Twice the area inside edges with the material on the right; exact."""
    return edges.groupBy(*keys).agg(F.sum(F.col("x1") * F.col("y0") - F.col("x0") * F.col("y1")).alias("area2"))
