"""Tile grids, owner lookup and halo membership.

A grid is either evenly spaced (all lookups are closed-form arithmetic, so the number of
tiles is unlimited) or given by explicit cuts (two literal arrays kept on the driver, as
they are the caller's own argument).
"""
from dataclasses import dataclass
from itertools import pairwise
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from shapeloom.errors import CapacityError
from shapeloom.functions.scalars import ceil_div, col, floor_div


def cuts_by_size(start: int, end: int, tile: int) -> list[int]:
    """Fixed-size cuts; the last tile is shortened."""
    if end <= start or tile <= 0:
        raise ValueError("range and tile size must be positive")
    return [*range(start, end, tile), end]


def cuts_by_count(start: int, end: int, count: int) -> list[int]:
    if end <= start or count <= 0 or end - start < count:
        raise ValueError("every tile needs a positive size")
    return [start + (i * (end - start)) // count for i in range(count + 1)]


def macro_cuts(cuts, span: int) -> list[int]:
    """Greedy subset of cuts at most `span` apart; an oversize tile is taken whole."""
    if span <= 0:
        raise ValueError("span must be positive")
    chosen = [cuts[0]]
    for here, after in pairwise(cuts[1:]):
        if after - chosen[-1] > span:
            chosen.append(here)
    return [*chosen, cuts[-1]]


@dataclass(frozen=True)
class Axis:
    """One axis of a grid: even steps from `start` to `end`, or explicit cuts."""
    start: int
    end: int
    step: int | None = None
    cuts: tuple[int, ...] | None = None

    @property
    def count(self) -> int:
        if self.cuts:
            return len(self.cuts) - 1
        return -(-(self.end - self.start) // self.step)

    def _position(self, test) -> Column:
        return F.size(F.filter(F.array(*[F.lit(c) for c in self.cuts]), test)) - 1

    def locate(self, value) -> Column:
        """Index of the half-open interval holding `value`, the outer end closed, else -1."""
        v = col(value)
        if self.cuts:
            index = self._position(lambda c: c <= v)
        else:
            index = F.floor((v - self.start) / self.step)
        return (F.when((v < self.start) | (v > self.end), F.lit(-1))
                .when(v == self.end, F.lit(self.count - 1)).otherwise(index).cast("long"))

    def first_touching(self, low) -> Column:
        """Smallest index whose upper border is >= low (may be `count`)."""
        v = col(low)
        if self.cuts:
            return F.greatest(self._position(lambda c: c < v), F.lit(0)).cast("long")
        index = (F.ceil((v - self.start) / self.step) - 1).cast("long")
        return F.when(v > self.end, F.lit(self.count)).otherwise(F.greatest(index, F.lit(0)))

    def last_touching(self, high) -> Column:
        """Largest index whose lower border is <= high (may be -1)."""
        v = col(high)
        if self.cuts:
            index = self._position(lambda c: c <= v)
        else:
            index = F.floor((v - self.start) / self.step)
        return F.least(index.cast("long"), F.lit(self.count - 1))

    def low(self, index) -> Column:
        if self.cuts:
            return F.get(F.array(*[F.lit(c).cast("long") for c in self.cuts]), index.cast("int"))
        return (self.start + index * self.step).cast("long")

    def high(self, index) -> Column:
        if self.cuts:
            return self.low(index + 1)
        return F.least(self.start + (index + 1) * self.step, F.lit(self.end)).cast("long")


@dataclass(frozen=True)
class Grid:
    x: Axis
    y: Axis
    halo: int = 0

    @staticmethod
    def even(box, tile: int, halo: int = 0) -> "Grid":
        l, b, r, t = box
        if tile <= 0 or l >= r or b >= t or halo < 0:
            raise ValueError("grid needs a positive box, a positive tile and halo >= 0")
        return Grid(Axis(l, r, step=tile), Axis(b, t, step=tile), halo)

    @staticmethod
    def from_cuts(x_cuts, y_cuts, halo: int = 0) -> "Grid":
        for cuts in (x_cuts, y_cuts):
            if len(cuts) < 2 or any(p >= q for p, q in pairwise(cuts)):
                raise ValueError("cuts must be strictly increasing, two at least")
        if halo < 0:
            raise ValueError("halo must not be negative")

        def axis(cuts):
            """Cuts at even steps, the last one shorter or not, are arithmetic like any even axis."""
            step = cuts[1] - cuts[0]
            even = all(q - p == step for p, q in pairwise(cuts[:-1])) and cuts[-1] - cuts[-2] <= step
            return Axis(cuts[0], cuts[-1], step=step) if even else Axis(cuts[0], cuts[-1], cuts=tuple(cuts))

        return Grid(axis(x_cuts), axis(y_cuts), halo)

    @property
    def columns(self) -> int:
        return self.x.count

    @property
    def rows(self) -> int:
        return self.y.count

    @property
    def bounds(self) -> tuple[int, int, int, int]:
        return self.x.start, self.y.start, self.x.end, self.y.end

    def core_id(self, row, column) -> Column:
        return row * F.lit(self.columns).cast("long") + column

    def describe(self, df: DataFrame, core_id="core_id") -> DataFrame:
        """Add name, row, col, ownership (l,b,r,t) and context (cl,cb,cr,ct) of a core id."""
        n, h = self.columns, self.halo
        df = (df.withColumn("row", floor_div(core_id, n))
              .withColumn("col", F.pmod(F.col(core_id), F.lit(n))))
        df = (df.withColumn("l", self.x.low(F.col("col"))).withColumn("b", self.y.low(F.col("row")))
              .withColumn("r", self.x.high(F.col("col")))
              .withColumn("t", self.y.high(F.col("row"))))
        return df.select("*", F.concat(F.lit("r"), F.col("row"), F.lit("c"), F.col("col"))
                         .alias("name"),
                         (F.col("l") - h).alias("cl"), (F.col("b") - h).alias("cb"),
                         (F.col("r") + h).alias("cr"), (F.col("t") + h).alias("ct"))

    def context(self, df: DataFrame, core_id="core_id") -> DataFrame:
        """Add the context (cl,cb,cr,ct) of a core id; arithmetic only, so nothing has to be joined."""
        row, column = floor_div(core_id, self.columns), F.pmod(F.col(core_id), F.lit(self.columns))
        return df.withColumns({"cl": self.x.low(column) - self.halo, "cb": self.y.low(row) - self.halo,
                               "cr": self.x.high(column) + self.halo, "ct": self.y.high(row) + self.halo})

    def tiles(self, spark: SparkSession) -> DataFrame:
        """All tiles; generated by the executors, never listed on the driver."""
        return self.describe(spark.range(self.rows * self.columns).toDF("core_id"))


def owner(df: DataFrame, grid: Grid, x, y, name="core_id") -> DataFrame:
    """Add the tile owning a point; -1 outside the grid."""
    row, column = grid.y.locate(y), grid.x.locate(x)
    return df.withColumn(name, F.when((row < 0) | (column < 0), F.lit(-1).cast("long"))
                         .otherwise(grid.core_id(row, column)))


def halo_span(grid: Grid, l="l", b="b", r="r", t="t", *, clamp=True) -> list[Column]:
    """First/last column and row of the tiles whose context touches a box.

    With `clamp` a box beyond the grid still lands on the border tile.
    """
    h = grid.halo
    ix0, ix1 = grid.x.first_touching(col(l) - h), grid.x.last_touching(col(r) + h)
    iy0, iy1 = grid.y.first_touching(col(b) - h), grid.y.last_touching(col(t) + h)
    if clamp:
        last_x, last_y, zero = F.lit(grid.columns - 1), F.lit(grid.rows - 1), F.lit(0)
        ix0, ix1 = F.least(ix0, last_x), F.greatest(ix1, zero)
        iy0, iy1 = F.least(iy0, last_y), F.greatest(iy1, zero)
    return [ix0.cast("long").alias("ix0"), ix1.cast("long").alias("ix1"),
            iy0.cast("long").alias("iy0"), iy1.cast("long").alias("iy1")]


def membership_count(df: DataFrame, grid: Grid, *, clamp=True, **box) -> DataFrame:
    """Number of memberships an expansion would create, without expanding."""
    span = df.select(*halo_span(grid, clamp=clamp, **box))
    size = (F.greatest(F.col("ix1") - F.col("ix0") + 1, F.lit(0)) *
            F.greatest(F.col("iy1") - F.col("iy0") + 1, F.lit(0)))
    return span.agg(F.coalesce(F.sum(size), F.lit(0)).alias("memberships"))


def membership(df: DataFrame, grid: Grid, *, clamp=True, limit: int | None = None,
               **box) -> DataFrame:
    """One row per (input row, tile whose context it touches); tile ids by arithmetic.

    `limit` refuses the expansion when it would create more rows than allowed.
    """
    if limit is not None:
        total = membership_count(df, grid, clamp=clamp, **box).first()[0]
        if total > limit:
            raise CapacityError(f"{total} memberships exceed the limit of {limit}")
    # An empty span explodes to nothing; a filter here would be pushed down through, and
    # so repeat, the whole chain of expressions behind the endpoints.
    def span(lo, hi):
        return F.explode(F.when(F.col(lo) <= F.col(hi), F.sequence(lo, hi)))

    cells = (df.select("*", *halo_span(grid, clamp=clamp, **box))
             .withColumn("_row", span("iy0", "iy1")).withColumn("_col", span("ix0", "ix1")))
    return (cells.withColumn("core_id", grid.core_id(F.col("_row"), F.col("_col")))
            .drop("ix0", "ix1", "iy0", "iy1", "_row", "_col"))


def owned_segments(segments: DataFrame, cores: DataFrame) -> DataFrame:
    """Segments owned by the listed cores (semi-join on the owner)."""
    return segments.join(cores.select("core_id"), "core_id", "left_semi")


def members_of(members: DataFrame, cores: DataFrame) -> DataFrame:
    return members.join(cores.select("core_id").distinct(), "core_id")


def ordered_members(members: DataFrame, order, partitions: int | None = None) -> DataFrame:
    """Memberships grouped by core and sorted inside each partition.

    A task sorts one partition, so `partitions` should follow the number of rows (`parts_for`).
    """
    dealt = members.repartition(partitions, "core_id") if partitions else members.repartition("core_id")
    return dealt.sortWithinPartitions("core_id", *order)


def member_counts(ordered: DataFrame, order) -> DataFrame:
    """Per core of `ordered_members`: rows, different values of `order` and how many of these are repeated.

    Rows are compared with their neighbours, so nothing is shuffled, sorted or hashed again.
    """
    w = W.partitionBy("core_id").orderBy(*order)
    here = F.struct(*order)
    marked = ordered.select("core_id", (~here.eqNullSafe(F.lag(here).over(w))).alias("_first"),
                            here.eqNullSafe(F.lead(here).over(w)).alias("_again"))
    return marked.groupBy("core_id").agg(F.count("*").alias("rows"), F.count_if("_first").alias("segments"),
                                         F.count_if(F.col("_first") & F.col("_again")).alias("repeated"))


def parts_for(spark: SparkSession, rows: int, per_task: int = 1 << 20) -> int:
    """Partitions for so many rows: those of the session, or more, so that a task's share does not grow with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(rows / per_task))


def tile_macro(grid: Grid, macro_x, macro_y, tiles: DataFrame) -> DataFrame:
    """Add `macro_id` of each tile; macro cuts must be a subset of the tile cuts."""
    for axis, cuts in ((grid.x, macro_x), (grid.y, macro_y)):
        allowed = (set(axis.cuts) if axis.cuts else None)
        for c in cuts:
            on_cut = (c in allowed) if allowed else (
                c == axis.end or (c - axis.start) % axis.step == 0)
            if not on_cut or not axis.start <= c <= axis.end:
                raise ValueError("macro borders must lie on tile cuts")
    macro = Grid.from_cuts(list(macro_x), list(macro_y))
    return owner(tiles, macro, "l", "b", "macro_id")


def macro_boxes(spark: SparkSession, x_cuts, y_cuts, span: int) -> DataFrame:
    """Macro ownership boxes, row by row."""
    grid = Grid.from_cuts(macro_cuts(x_cuts, span), macro_cuts(y_cuts, span))
    return grid.tiles(spark).select(F.col("core_id").alias("macro_id"), "l", "b", "r", "t")


def check_halo(roi_halo: int, tile: int, tile_halo: int, max_displacement: float, pixel: int):
    """The region read must reach beyond the tile halo by the largest displacement."""
    need = tile_halo + -int(-max_displacement // 1)
    if roi_halo < need:
        raise ValueError(f"region halo {roi_halo} is smaller than {need}")
    if tile % pixel or tile_halo % pixel:
        raise ValueError("tile and halo must be multiples of the pixel")


def pixel_shape(width, height, pixel: int) -> tuple[Column, Column]:
    return ceil_div(width, pixel), ceil_div(height, pixel)
