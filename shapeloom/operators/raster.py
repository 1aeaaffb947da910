"""Coverage rasters as pixel tables, polarity, canvases, and per-tile ownership."""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shapeloom.errors import CapacityError
from shapeloom.functions.scalars import ceil_div, floor_div, quantise


def check_size(box, pixel: int, limit: int) -> tuple[int, int]:
    """(height, width) in pixels, padded to the right and top; refused over the limit."""
    l, b, r, t = box
    if pixel <= 0 or limit <= 0 or l >= r or b >= t:
        raise ValueError("pixel, limit and box must be positive")
    height, width = -(-(t - b) // pixel), -(-(r - l) // pixel)
    if height * width > limit:
        raise CapacityError(f"{width}x{height} pixels exceed the limit of {limit}")
    return height, width


def coverage_area(rects: DataFrame, pixel: int, origin=(0, 0), keys=("layer",)) -> DataFrame:
    """Covered area (integer, in square units) per touched pixel of disjoint rectangles."""
    ox, oy = origin
    keys = list(keys)
    cell = (rects.select(*keys, "l", "b", "r", "t")
            .withColumn("x", F.explode(F.sequence(
                floor_div(F.col("l") - ox, pixel), floor_div(F.col("r") - ox - 1, pixel))))
            .withColumn("y", F.explode(F.sequence(
                floor_div(F.col("b") - oy, pixel), floor_div(F.col("t") - oy - 1, pixel)))))
    px, py = F.col("x") * pixel + ox, F.col("y") * pixel + oy
    w = F.least("r", px + pixel) - F.greatest("l", px)
    h = F.least("t", py + pixel) - F.greatest("b", py)
    return cell.groupBy(*keys, "y", "x").agg(F.sum(w * h).alias("area"))


def coverage(area: DataFrame, pixel: int) -> DataFrame:
    """Covered fraction in [0, 1] from `coverage_area`."""
    share = F.col("area") / F.lit(float(pixel * pixel))
    return area.withColumn("value", F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).drop("area")


def region_raster(boxes: DataFrame, box, pixel: int, keys=("layer",), limit: int | None = None,
                  **kw) -> DataFrame:
    """Coverage of merged boxes inside a region; pixel (0, 0) is at its lower left."""
    from shapeloom.operators import filters, region
    if limit is not None:
        check_size(box, pixel, limit)
    rects = region.union(filters.clip(boxes, box), keys=keys, **kw)
    return coverage(coverage_area(rects, pixel, box[:2], keys), pixel)


def canvas_scaffold(images: DataFrame, height: int, width: int) -> DataFrame:
    """Every pixel of a fixed canvas for each row of `images`."""
    return (images.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
            .withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))))


def pad_canvas(pixels: DataFrame, images: DataFrame, canvas: int, keys=("image_id",)) -> DataFrame:
    """Dense square canvas with 0 where no pixel is given."""
    keys = list(keys)
    full = canvas_scaffold(images.select(*keys), canvas, canvas)
    return full.join(pixels, [*keys, "y", "x"], "left").withColumn(
        "value", F.coalesce("value", F.lit(0.0)))


def too_large(tiles: DataFrame, pixel: int, canvas: int) -> DataFrame:
    """Tiles whose context does not fit the canvas."""
    return tiles.filter((ceil_div(F.col("cr") - F.col("cl"), pixel) > canvas) |
                        (ceil_div(F.col("ct") - F.col("cb"), pixel) > canvas))


def transmission(shape: DataFrame, field: DataFrame | None, polarity: str, keys=("image_id",)):
    """Light let through per pixel: the coverage, or the field's coverage without it."""
    keys = list(keys)
    if polarity == "clear":
        return shape
    if polarity != "opaque" or field is None:
        raise ValueError("opaque needs the field's coverage; other polarities do not exist")
    both = field.withColumnRenamed("value", "f").join(shape, [*keys, "y", "x"], "left")
    v = F.col("f") - F.coalesce("value", F.lit(0.0))
    return both.select(*keys, "y", "x", F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)).alias("value"))


def is_owned(pixel: int) -> Column:
    """Pixel centre inside the half-open ownership box; x, y count from the context corner."""
    cx = F.col("cl") + (F.col("x") + 0.5) * pixel
    cy = F.col("cb") + (F.col("y") + 0.5) * pixel
    return (cx >= F.col("l")) & (cx < F.col("r")) & (cy >= F.col("b")) & (cy < F.col("t"))


def owned_pixels(pixels: DataFrame, tiles: DataFrame, pixel: int) -> DataFrame:
    """Pixels of each tile that the tile owns; its halo is dropped."""
    box = tiles.select("core_id", "l", "b", "r", "t", "cl", "cb")
    return pixels.hint("merge").join(box, "core_id").filter(is_owned(pixel)).select(*pixels.columns)


def owned_rectangle_issues(owned: DataFrame) -> DataFrame:
    """Tiles whose owned pixels are not one full rectangle."""
    w = F.max("x") - F.min("x") + 1
    h = F.max("y") - F.min("y") + 1
    full = owned.groupBy("core_id").agg(F.count("*").alias("pixels"), (w * h).alias("expected"))
    return full.filter("pixels <> expected")


def tile_manifest(owned: DataFrame, tiles: DataFrame, pixel: int) -> DataFrame:
    """Per tile: index, boxes, origin of the owned part and its shape."""
    part = owned.groupBy("core_id").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"),
        (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"))
    return part.hint("merge").join(tiles, "core_id").select(
        "core_id", "name", "l", "b", "r", "t", "cl", "cb", "cr", "ct",
        (F.col("cl") + F.col("x0") * pixel).alias("origin_x"),
        (F.col("cb") + F.col("y0") * pixel).alias("origin_y"), "height", "width")


def stitch(owned: DataFrame, tiles: DataFrame, pixel: int) -> DataFrame:
    """Owned pixels of all tiles in layout pixel coordinates."""
    at = tiles.select("core_id", "cl", "cb")
    return owned.hint("merge").join(at, "core_id").select(
        floor_div(F.col("cb") + F.col("y") * pixel, pixel).alias("y"),
        floor_div(F.col("cl") + F.col("x") * pixel, pixel).alias("x"), "value")


def repeated_pixels(stitched: DataFrame) -> DataFrame:
    return stitched.groupBy("y", "x").count().filter("count > 1")


def tile_coverage_area(rects: DataFrame, grid, pixel: int, keys=("layer",)) -> DataFrame:
    """Coverage area per tile context: rectangles go to every tile whose context they meet."""
    from shapeloom.operators import tiling
    keys = list(keys)
    members = tiling.membership(rects.select(*keys, "l", "b", "r", "t"), grid)
    cut = (grid.context(members)
           .withColumn("l", F.greatest("l", "cl") - F.col("cl"))
           .withColumn("b", F.greatest("b", "cb") - F.col("cb"))
           .withColumn("r", F.least("r", "cr") - F.col("cl"))
           .withColumn("t", F.least("t", "ct") - F.col("cb"))
           .filter((F.col("l") < F.col("r")) & (F.col("b") < F.col("t"))))
    return coverage_area(cut, pixel, keys=["core_id", *keys])


def ring_coverage(edges: DataFrame, pixel: int, keys=("layer",)) -> DataFrame:
    """Coverage of general-angle rings by signed accumulation along their edges.

    Each edge is cut at pixel rows and columns. A piece of height dh covers its own pixel
    partly and all pixels to its right fully; a running sum along the row adds the latter.
    Material must be on the right of the edges and shapes must be disjoint.
    """
    keys = list(keys)
    e = edges.filter(F.col("y0") != F.col("y1"))
    up = F.col("y1") > F.col("y0")
    e = e.select(*keys, F.when(up, 1.0).otherwise(-1.0).alias("s"),
                 *[F.when(up, F.col(p)).otherwise(F.col(q)).cast("double").alias(n)
                   for n, p, q in (("xa", "x0", "x1"), ("ya", "y0", "y1"),
                                   ("xb", "x1", "x0"), ("yb", "y1", "y0"))])
    slope = (F.col("xb") - F.col("xa")) / (F.col("yb") - F.col("ya"))

    def cells(lo, hi):
        first = F.floor(lo / pixel)
        return F.explode(F.sequence(first, F.greatest(first, F.ceil(hi / pixel) - 1)))

    e = e.withColumn("slope", slope).withColumn("y", cells(F.col("ya"), F.col("yb")))
    y0 = F.greatest("ya", F.col("y") * pixel)
    y1 = F.least("yb", (F.col("y") + 1) * pixel)
    e = e.withColumns({"y0": y0, "y1": y1})
    e = e.withColumns({"u0": F.col("xa") + (F.col("y0") - F.col("ya")) * F.col("slope"),
                       "u1": F.col("xa") + (F.col("y1") - F.col("ya")) * F.col("slope")})
    lo, hi = F.least("u0", "u1"), F.greatest("u0", "u1")
    e = e.withColumns({"lo": lo, "hi": hi}).withColumn("x", cells(F.col("lo"), F.col("hi")))
    c0 = F.greatest("lo", F.col("x") * pixel)
    c1 = F.least("hi", (F.col("x") + 1) * pixel)
    part = F.when(F.col("hi") > F.col("lo"), (c1 - c0) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    dh = F.col("s") * (F.col("y1") - F.col("y0")) * part
    own = dh * ((F.col("x") + 1) * pixel - (c0 + c1) / 2)
    acc = e.groupBy(*keys, "y", "x").agg(F.sum(dh).alias("cover"), F.sum(own).alias("own"))
    w = W.partitionBy(*keys, "y").orderBy("x")
    # Fill the gap up to the next edge pixel with the accumulated cover.
    acc = acc.withColumn("left", F.coalesce(F.sum("cover").over(
        w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    acc = acc.withColumn("next", F.lead("x").over(w))
    here = F.struct(F.col("x").alias("x"),
                    ((F.col("left") * pixel + F.col("own")) / (pixel * pixel)).alias("v"))
    flow = F.col("left") + F.col("cover")
    gap = F.when((F.col("next") > F.col("x") + 1) & (F.abs(flow) > 1e-9),
                 F.transform(F.sequence(F.col("x") + 1, F.col("next") - 1),
                             lambda i: F.struct(i.alias("x"), (flow / pixel).alias("v"))))
    out = acc.select(*keys, "y", F.explode(F.concat(F.array(here), F.coalesce(
        gap, F.slice(F.array(here), 1, 0)))).alias("p"))
    return out.select(*keys, "y", "p.x", F.least(F.greatest(F.col("p.v"), F.lit(0.0)), F.lit(1.0))
                      .alias("value")).filter(F.col("value") > 1e-9)


def quantised(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("value", quantise("value"))


def raster_issues(pixels: DataFrame, canvas: int, width: int, height: int) -> DataFrame:
    """Codes of violated raster rules: active size, canvas extent, range, finiteness."""
    v = F.col("value")
    agg = pixels.agg(
        F.count("*").alias("n"), F.max(F.greatest("x", "y")).alias("far"),
        F.min(F.least("x", "y")).alias("near"),
        F.count_if(F.isnan(v) | (F.abs(v) == float("inf"))).alias("odd"),
        F.count_if((v < 0) | (v > 1)).alias("outside"))
    size_ok = 0 < width <= canvas and 0 < height <= canvas
    codes = F.array_compact(F.array(
        F.lit(None if size_ok else "active_size"),
        F.when((F.col("n") != canvas * canvas) | (F.col("far") >= canvas) | (F.col("near") < 0),
               "not_square"),
        F.when(F.col("odd") > 0, "not_finite"), F.when(F.col("outside") > 0, "out_of_range")))
    return agg.select(F.explode(codes).alias("code"))
