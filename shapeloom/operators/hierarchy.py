"""Cell hierarchy: children, top cell, and placement of shapes through all instances."""
from pyspark.sql import DataFrame, functions as F

from shapeloom.errors import LayoutError
from shapeloom.functions.scalars import transform_x, transform_y


def children(cells: DataFrame, instances: DataFrame) -> DataFrame:
    """Every cell with its sorted distinct direct children."""
    kids = instances.groupBy(F.col("parent").alias("cell")).agg(
        F.array_sort(F.collect_set("child")).alias("children"))
    return cells.select("cell").join(kids, "cell", "left").withColumn(
        "children", F.coalesce("children", F.array().cast("array<string>")))


def top_cells(cells: DataFrame, instances: DataFrame) -> DataFrame:
    used = instances.select(F.col("child").alias("cell")).distinct()
    return cells.select("cell").join(used, "cell", "left_anti")


def top_cell(cells: DataFrame, instances: DataFrame, name: str | None = None) -> str:
    """The chosen cell, or the only cell that nobody places."""
    if name is not None:
        if cells.filter(F.col("cell") == name).isEmpty():
            raise LayoutError(f"unknown cell {name!r}")
        return name
    found = [r[0] for r in top_cells(cells, instances).limit(2).collect()]
    if len(found) != 1:
        raise LayoutError("the layout has no top cell" if not found else
                          "the layout has several top cells; name one")
    return found[0]


def expand_arrays(instances: DataFrame, block: int = 4096) -> DataFrame:
    """One row per array element with its own shift (dx, dy).

    An array becomes ranges of `block` elements, which are dealt over tasks before they expand.
    """
    na, nb = (F.greatest(F.col(c).cast("long"), F.lit(1)) for c in ("na", "nb"))
    ranges = instances.withColumn("_lo", F.explode(F.sequence(F.lit(0).cast("long"), na * nb - 1, F.lit(block).cast("long"))))
    ranges = ranges.withColumn("_hi", F.least(F.col("_lo") + block, na * nb) - 1)
    n = int(instances.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (ranges.repartition(n)
            .withColumn("_k", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
            .withColumn("_i", F.expr("_k div greatest(cast(nb as bigint), 1)")).withColumn("_j", F.pmod("_k", nb))
            .withColumn("dx", F.col("dx") + F.col("_i") * F.col("ax") + F.col("_j") * F.col("bx"))
            .withColumn("dy", F.col("dy") + F.col("_i") * F.col("ay") + F.col("_j") * F.col("by"))
            .drop("_k", "_i", "_j", "ax", "ay", "bx", "by", "na", "nb"))


def cell_extents(shapes: DataFrame, instances: DataFrame) -> DataFrame:
    """Bounding box of each cell with everything below it, from the leaves upwards.

    Array extents come from the array's corners; nothing is expanded.
    """
    own = shapes.groupBy("cell").agg(F.min("l").alias("l"), F.min("b").alias("b"),
                                     F.max("r").alias("r"), F.max("t").alias("t"))
    total, level, depth = own, own, 0
    deepest = _deepest(instances)
    while not level.isEmpty():
        depth += 1
        if depth > deepest + 1:
            raise LayoutError("the cell hierarchy is cyclic")
        placed = instances.join(level.withColumnRenamed("cell", "child"), "child")
        level = _placed_box(placed).groupBy(F.col("parent").alias("cell")).agg(
            F.min("l").alias("l"), F.min("b").alias("b"),
            F.max("r").alias("r"), F.max("t").alias("t")).checkpoint()
        total = total.unionByName(level)
    return total.groupBy("cell").agg(F.min("l").alias("l"), F.min("b").alias("b"),
                                     F.max("r").alias("r"), F.max("t").alias("t"))


def _deepest(instances: DataFrame) -> int:
    """As many levels as there are placing cells: a hierarchy that goes on is cyclic."""
    return instances.select("parent").distinct().count()


def _turn_box(df: DataFrame) -> DataFrame:
    """Transform l, b, r, t by rot, mirror, dx, dy."""
    x = [transform_x(c, d, "rot", "mirror", "dx") for c, d in (("l", "b"), ("r", "t"))]
    y = [transform_y(c, d, "rot", "mirror", "dy") for c, d in (("l", "b"), ("r", "t"))]
    return df.withColumns({"_x0": F.least(*x), "_y0": F.least(*y),
                           "_x1": F.greatest(*x), "_y1": F.greatest(*y)}).drop(
        "l", "b", "r", "t").withColumnsRenamed({"_x0": "l", "_y0": "b", "_x1": "r", "_y1": "t"})


def _turn_rings(df: DataFrame) -> DataFrame:
    """Transform outlines likewise; a flip reverses them, so that hulls keep their direction."""
    def point(p):
        return F.struct(transform_x(p["x"], p["y"], "rot", "mirror", "dx").alias("x"),
                        transform_y(p["x"], p["y"], "rot", "mirror", "dy").alias("y"))

    turned = F.transform("rings", lambda ring: F.transform(ring, point))
    return df.withColumn("rings", F.when(F.col("mirror") == 1, F.transform(turned, F.reverse)).otherwise(turned))


def _placed_box(placed: DataFrame) -> DataFrame:
    far_a, far_b = F.col("na") - 1, F.col("nb") - 1
    zero = F.lit(0)

    def reach(f, a, b):
        return f(zero, far_a * F.col(a)) + f(zero, far_b * F.col(b))

    df = _turn_box(placed)
    return (df.withColumn("l", F.col("l") + reach(F.least, "ax", "bx"))
            .withColumn("b", F.col("b") + reach(F.least, "ay", "by"))
            .withColumn("r", F.col("r") + reach(F.greatest, "ax", "bx"))
            .withColumn("t", F.col("t") + reach(F.greatest, "ay", "by")))


def placements(instances: DataFrame, top: str, box=None, extents: DataFrame | None = None):
    """All placements (cell, dx, dy, rot, mirror) of every cell below `top`.

    A loop over hierarchy levels of equi-joins on the parent. With a region, children whose
    extent misses it are dropped before the next level is expanded.
    """
    spark = instances.sparkSession
    level = spark.range(1).select(
        F.lit(top).alias("cell"), F.lit(0).cast("long").alias("dx"),
        F.lit(0).cast("long").alias("dy"), F.lit(0).alias("rot"), F.lit(0).alias("mirror"))
    done = level
    inst = instances
    if box is not None:
        inst = inst.join(extents.toDF("child", "el", "eb", "er", "et"), "child")
    depth, deepest = 0, _deepest(instances)
    while True:
        depth += 1
        if depth > deepest + 1:
            raise LayoutError("the cell hierarchy is cyclic")
        up = level.toDF("parent", "pdx", "pdy", "prot", "pmirror")
        step = inst.join(up, "parent")
        if box is not None:
            step = prune_arrays(step, box)
        step = expand_arrays(step)
        x = transform_x("dx", "dy", "prot", "pmirror", "pdx")
        y = transform_y("dx", "dy", "prot", "pmirror", "pdy")
        turn = F.when(F.col("pmirror") == 1, -F.col("rot")).otherwise(F.col("rot"))
        step = step.select(
            F.col("child").alias("cell"), x.alias("dx"), y.alias("dy"),
            F.pmod(F.col("prot") + turn, F.lit(4)).cast("int").alias("rot"),
            F.col("pmirror").bitwiseXOR(F.col("mirror")).alias("mirror"),
            *(["el", "eb", "er", "et"] if box is not None else []))
        if box is not None:
            l, b, r, t = box
            at = _turn_box(step.withColumnsRenamed({"el": "l", "eb": "b", "er": "r", "et": "t"}))
            step = at.filter((F.col("l") <= r) & (F.col("r") >= l) & (F.col("b") <= t)
                             & (F.col("t") >= b)).drop("l", "b", "r", "t")
        level = step.select("cell", "dx", "dy", "rot", "mirror").checkpoint()
        if level.isEmpty():
            return done
        done = done.unionByName(level)


def prune_arrays(step: DataFrame, box) -> DataFrame:
    """Shrink axis-parallel arrays to the elements that can touch the region.

    Works in the parent's coordinates: the region is carried back through the placement of
    the parent. Other arrays are left as they are and filtered after expansion.
    """
    l, b, r, t = box
    sx = [F.lit(v) - F.col("pdx") for v in (l, r)]
    sy = [F.lit(v) - F.col("pdy") for v in (b, t)]

    def back_x(x, y):
        return (F.when(F.col("prot") == 0, x).when(F.col("prot") == 1, y)
                .when(F.col("prot") == 2, -x).otherwise(-y))

    def back_y(x, y):
        turned = (F.when(F.col("prot") == 0, y).when(F.col("prot") == 1, -x)
                  .when(F.col("prot") == 2, -y).otherwise(x))
        return F.when(F.col("pmirror") == 1, -turned).otherwise(turned)

    bx = [back_x(x, y) for x, y in zip(sx, sy)]
    by = [back_y(x, y) for x, y in zip(sx, sy)]
    step = step.withColumns({"_l": F.least(*bx), "_r": F.greatest(*bx),
                             "_b": F.least(*by), "_t": F.greatest(*by)})
    ex = [transform_x(c, d, "rot", "mirror", "dx") for c, d in (("el", "eb"), ("er", "et"))]
    ey = [transform_y(c, d, "rot", "mirror", "dy") for c, d in (("el", "eb"), ("er", "et"))]
    step = step.withColumns({"_el": F.least(*ex), "_er": F.greatest(*ex),
                             "_eb": F.least(*ey), "_et": F.greatest(*ey)})
    square = ((F.col("ay") == 0) & (F.col("bx") == 0) & (F.col("ax") > 0) & (F.col("by") > 0))

    def index_range(low, high, near, far, pitch, count):
        pitch = F.greatest(F.col(pitch), F.lit(1)).cast("double")
        first = F.greatest(F.ceil((F.col(low) - F.col(far)) / pitch), F.lit(0))
        last = F.least(F.floor((F.col(high) - F.col(near)) / pitch), F.col(count) - 1)
        return first.cast("long"), last.cast("long")

    i0, i1 = index_range("_l", "_r", "_el", "_er", "ax", "na")
    j0, j1 = index_range("_b", "_t", "_eb", "_et", "by", "nb")
    step = step.withColumns({
        "_i0": F.when(square, i0).otherwise(0), "_j0": F.when(square, j0).otherwise(0),
        "_i1": F.when(square, i1).otherwise(F.col("na") - 1),
        "_j1": F.when(square, j1).otherwise(F.col("nb") - 1)})
    step = step.filter((F.col("_i0") <= F.col("_i1")) & (F.col("_j0") <= F.col("_j1")))
    step = (step.withColumn("dx", F.col("dx") + F.col("_i0") * F.col("ax") + F.col("_j0") * F.col("bx"))
            .withColumn("dy", F.col("dy") + F.col("_i0") * F.col("ay") + F.col("_j0") * F.col("by"))
            .withColumn("na", (F.col("_i1") - F.col("_i0") + 1).cast("int"))
            .withColumn("nb", (F.col("_j1") - F.col("_j0") + 1).cast("int")))
    return step.drop("_l", "_r", "_b", "_t", "_el", "_er", "_eb", "_et", "_i0", "_i1", "_j0", "_j1")


def flatten(shapes: DataFrame, instances: DataFrame, top: str, box=None) -> DataFrame:
    """Shapes of `top` and of all cells below it, in the coordinates of `top`.

    Outlines (`rings`) are placed too, and all other columns, such as properties, ride along.

    With a region only placements that touch it are expanded, and shapes that miss it are
    left out; both use closed intervals, so callers filter further as they need.
    """
    extents = cell_extents(shapes, instances) if box is not None else None
    placed = placements(instances, top, box, extents)
    out = shapes.join(placed, "cell")
    if "rings" in shapes.columns:
        out = _turn_rings(out)
    out = _turn_box(out).drop("dx", "dy", "rot", "mirror")
    if box is not None:
        l, b, r, t = box
        out = out.filter((F.col("l") <= r) & (F.col("r") >= l) & (F.col("b") <= t)
                         & (F.col("t") >= b))
    return out
