"""Layer, region-of-interest and shape-kind filters, and simple shape aggregates."""
from pyspark.sql import Column, DataFrame, functions as F

from shapeloom.errors import LayoutError

POLYGON_KINDS = ("box", "path", "polygon")


def check_box(box):
    l, b, r, t = box
    if not (l < r and b < t):
        raise LayoutError(f"box {box} has no positive area")
    return l, b, r, t


def overlaps(box) -> Column:
    """Positive-area overlap of the row's box with `box`."""
    l, b, r, t = check_box(box)
    return (F.col("l") < r) & (F.col("r") > l) & (F.col("b") < t) & (F.col("t") > b)


def touches(box) -> Column:
    """Closed-interval contact, so that points and shared borders count."""
    l, b, r, t = box
    return (F.col("l") <= r) & (F.col("r") >= l) & (F.col("b") <= t) & (F.col("t") >= b)


def candidates(shapes: DataFrame, box) -> DataFrame:
    """Boxes, paths and polygons with positive-area overlap; pushed into the scan."""
    return shapes.filter(F.col("kind").isin(*POLYGON_KINDS) & overlaps(box))


def clip(shapes: DataFrame, box) -> DataFrame:
    """Exact cut of boxes to the region; all other columns ride along."""
    l, b, r, t = check_box(box)
    return (shapes.filter(overlaps(box))
            .withColumn("l", F.greatest("l", F.lit(l))).withColumn("b", F.greatest("b", F.lit(b)))
            .withColumn("r", F.least("r", F.lit(r))).withColumn("t", F.least("t", F.lit(t))))


def outlines(shapes: DataFrame) -> DataFrame:
    """Shapes whose `rings` are filled in: where null, the clockwise box."""
    corners = [("l", "b"), ("l", "t"), ("r", "t"), ("r", "b")]
    box = F.array(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corners]))
    return shapes.withColumn("rings", F.coalesce("rings", box))


def shape_boxes(shapes: DataFrame, keys) -> DataFrame:
    """Signed boxes per key whose sum is what the outlines enclose, for `region.union`."""
    from shapeloom.operators import contours, region
    from shapeloom.plans.prepare import ring_base
    polygons = outlines(shapes).select(*keys, F.monotonically_increasing_id().alias("polygon_id"), "rings").checkpoint()
    return region.ring_boxes(ring_base(contours.ring_edges(polygons, keys)), keys)


def clip_polygons(shapes: DataFrame, box, cell: int = 4096) -> DataFrame:
    """Exact cut of shapes with outlines to the region: disjoint rectangles, each with all columns of
    its shape but `rings`. Signed boxes are cut one by one, which cuts their sum."""
    from shapeloom.operators import region
    numbered = shapes.filter(overlaps(box)).withColumn("_shape", F.monotonically_increasing_id()).checkpoint()
    rects = region.union(clip(shape_boxes(numbered, ("_shape",)), box), keys=("_shape",), cell=cell)
    return numbered.drop("rings", "l", "b", "r", "t").join(rects.select("_shape", "l", "b", "r", "t"), "_shape").drop("_shape")


def intersecting(shapes: DataFrame, box) -> DataFrame:
    """Whole shapes that share area with the region; nothing is cut."""
    return candidates(shapes, box)


def ring_candidates(shapes: DataFrame, box) -> DataFrame:
    """Polygons (ring arrays) whose bounding box shares area with the region."""
    def bound(f, axis):
        return f(F.transform(F.get("rings", F.lit(0)), lambda p: p[axis]))
    l, b, r, t = check_box(box)
    return shapes.filter((bound(F.array_min, "x") < r) & (bound(F.array_max, "x") > l) &
                         (bound(F.array_min, "y") < t) & (bound(F.array_max, "y") > b))


def select_layers(shapes: DataFrame, layers) -> DataFrame:
    """Keep the named (layer, datatype) pairs; every one of them must exist."""
    wanted = sorted(set(layers))
    if not wanted:
        raise LayoutError("no layer was asked for")
    keys = ["layer", "datatype"]
    spec = shapes.sparkSession.createDataFrame(wanted, "layer int, datatype int")
    unknown = unknown_layers(shapes, spec).limit(5).collect()
    if unknown:
        raise LayoutError(f"unknown layers: {[tuple(u) for u in unknown]}")
    # The list is the caller's own argument and so has a known, small size.
    return shapes.join(F.broadcast(spec), keys, "left_semi")


def unknown_layers(shapes: DataFrame, wanted: DataFrame) -> DataFrame:
    keys = ["layer", "datatype"]
    return wanted.select(*keys).distinct().join(shapes.select(*keys).distinct(), keys, "left_anti")


def layer_list(shapes: DataFrame) -> DataFrame:
    return shapes.select("layer", "datatype").distinct().orderBy("layer", "datatype")


def default_layer(shapes: DataFrame) -> tuple[int, int]:
    """The only layer there is; otherwise the caller has to name one."""
    found = shapes.select("layer", "datatype").distinct().limit(2).collect()
    if len(found) != 1:
        raise LayoutError("the layout has no layer" if not found else
                          "the layout has several layers; name one")
    return found[0][0], found[0][1]


def shape_stats(shapes: DataFrame, box=None, keys=("layer",)) -> DataFrame:
    """Counts per kind of everything touching the region, zero-area texts included."""
    df = shapes if box is None else shapes.filter(touches(box))
    kind = F.col("kind")
    return df.groupBy(*keys).agg(
        F.count_if(kind.isin(*POLYGON_KINDS)).alias("polygon_like"),
        F.count_if(kind == "text").alias("text"), F.count_if(kind == "edge").alias("edge"),
        F.count_if(~kind.isin(*POLYGON_KINDS, "text", "edge")).alias("other"))


def bounding_box(shapes: DataFrame, keys=()) -> DataFrame:
    """Smallest box around all shapes, texts included; nulls when there are none."""
    aggs = [F.min("l").alias("l"), F.min("b").alias("b"), F.max("r").alias("r"), F.max("t").alias("t")]
    return shapes.groupBy(*keys).agg(*aggs) if keys else shapes.agg(*aggs)


def thinned(df: DataFrame, other: DataFrame, on, bits: int = 24) -> DataFrame:
    """Rows of `df` without most of those that match no row of `other` in the columns `on`; those that match all stay.

    Hashes of `other` mark places in a bitmap of 2**bits bits, whatever its size, which goes to all tasks in words of
    64 bits. So the rows that an exact join then shuffles follow the smaller side.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(1 << bits))
    marks = other.select(place.alias("_place")).select(F.shiftrightunsigned("_place", 6).alias("_word"),
                                                       F.expr("shiftleft(1L, cast(_place & 63 as int))").alias("_bit"))
    words = marks.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    here = (F.shiftrightunsigned(place, 6) == F.col("_word")) & (F.getbit("_bits", place.bitwiseAND(63).cast("int")) == 1)
    return df.join(F.broadcast(words), here, "left_semi")


def patch_issues(patches: DataFrame, cell: int = 4096) -> DataFrame:
    """Repeated patch ids and same-layer ownership boxes that share area.

    Overlap is measured, not paired: per layer the sum of areas must equal the area of the
    union, and the patches concerned are those that meet a point covered twice.
    """
    from shapeloom.operators import region
    repeated = (patches.groupBy("patch_id").count().filter("count > 1")
                .select(F.lit("duplicate_id").alias("code"), "patch_id"))
    twice = multiply_covered(patches, ("layer",))
    hit = region.touching_pairs(patches.select("layer", "patch_id", "l", "b", "r", "t"),
                                twice, ("layer",), cell)
    overlap = hit.select(F.lit("ownership_overlap").alias("code"), "patch_id").distinct()
    return repeated.unionByName(overlap)


def multiply_covered(boxes: DataFrame, keys=("layer",)) -> DataFrame:
    """Rectangles covered by two or more input boxes, copies counted."""
    from shapeloom.operators import region
    # A weight of -1 per layer's union leaves exactly the points covered at least twice.
    once = region.union(boxes, keys=keys).select(
        *keys, "l", "b", "r", "t", F.lit(-1).cast("long").alias("w"))
    every = boxes.select(*keys, "l", "b", "r", "t", F.lit(1).cast("long").alias("w"))
    return region.sweep(every.unionByName(once), keys=keys).select(*keys, "l", "b", "r", "t")


def patches(shapes: DataFrame, cores: DataFrame) -> DataFrame:
    """Shapes cut to the ownership box of their patch, in the order layer, box, id."""
    own = cores.select("patch_id", F.col("l").alias("ol"), F.col("b").alias("ob"),
                       F.col("r").alias("o_r"), F.col("t").alias("ot"))
    cut = (shapes.hint("merge").join(own, "patch_id")
           .withColumn("l", F.greatest("l", "ol")).withColumn("b", F.greatest("b", "ob"))
           .withColumn("r", F.least("r", "o_r")).withColumn("t", F.least("t", "ot"))
           .filter((F.col("l") < F.col("r")) & (F.col("b") < F.col("t"))))
    return cut


PATCH_ORDER = ["layer", "datatype", "ol", "ob", "o_r", "ot", "patch_id"]


def patch_order(cut: DataFrame) -> DataFrame:
    return cut.orderBy(*PATCH_ORDER)


def every_nth(df: DataFrame, order, limit: int, total: int | None = None) -> DataFrame:
    """Evenly spaced rows of an ordered table, `limit` at most (a sampling operator).

    Positions come from range partitions and their sizes, not from one sorted task.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    total = df.count() if total is None else total
    step = max(1, -(-total // limit))
    return with_position(df, order).filter(F.col("position") % step == 0)


def with_position(df: DataFrame, order) -> DataFrame:
    """Add the global 0-based `position` in the given order; ties need a unique order."""
    from pyspark.sql import Window as W
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_part", F.spark_partition_id()).checkpoint()
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per partition: bounded by the number of tasks.
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(
        W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    local = W.partitionBy("_part").orderBy(*order)
    return (ranged.withColumn("_rn", F.row_number().over(local) - 1)
            .join(F.broadcast(before), "_part")
            .withColumn("position", F.col("_rn") + F.col("_off")).drop("_rn", "_off", "_part"))
