"""Operators on pixel tables (image_id, y, x, value): resize, smooth, stencil, distance."""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shapeloom.functions.scalars import floor_div, pin

IMAGE = ("image_id",)


def block_mean(pixels: DataFrame, scale: int, keys=IMAGE) -> DataFrame:
    """Shrink by an integer factor; each output pixel is the mean of its block."""
    return pixels.groupBy(*keys, floor_div("y", scale).cast("int").alias("y"),
                          floor_div("x", scale).cast("int").alias("x")).agg(
        F.avg("value").alias("value"))


def nearest_resize(pixels: DataFrame, source, target, keys=IMAGE) -> DataFrame:
    """Resize (height, width) -> (height, width); source index is floor(dst * in / out).

    Each source pixel lists the target pixels that read it, so no join is needed.
    """
    (h, w), (th, tw) = source, target

    def readers(index, size, new):
        # The targets i with floor(i * size / new) = index.
        first = -floor_div(-F.col(index) * new, size)
        after = -floor_div(-(F.col(index) + 1) * new, size)
        return F.when(first < after, F.sequence(first, after - 1))

    out = pin(pixels, ys=readers("y", h, th), xs=readers("x", w, tw)).select(*keys, "value", "ys", "xs")
    return (out.withColumn("y", F.explode("ys")).withColumn("x", F.explode("xs"))
            .select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "value"))


def box_smooth(pixels: DataFrame, kernel: int, keys=IMAGE) -> DataFrame:
    """Mean over kernel x kernel, outside counted as 0; needs dense images.

    Separable: a running sum along rows, then along columns.
    """
    if kernel < 1 or kernel % 2 == 0:
        raise ValueError("kernel must be odd and positive")
    h = kernel // 2
    row = W.partitionBy(*keys, "y").orderBy("x").rangeBetween(-h, h)
    column = W.partitionBy(*keys, "x").orderBy("y").rangeBetween(-h, h)
    return (pixels.withColumn("value", F.sum("value").over(row))
            .withColumn("value", F.sum("value").over(column) / float(kernel * kernel)))


# Fixed 3 x 3 stencil weights by |dy| + |dx|: centre, side, corner.
STENCIL = {0: -1.0, 1: 5.0 / 16.0, 2: -1.0 / 16.0}


def stencil(pixels: DataFrame, height: int, width: int, keys=IMAGE) -> DataFrame:
    """Curvature response at interior pixels; every pixel adds to its nine neighbours."""
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"),
                                 F.lit(STENCIL[abs(dy) + abs(dx)]).alias("k"))
                        for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    e = pixels.select(*keys, "y", "x", "value", F.explode(offsets).alias("o"))
    e = e.select(*keys, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"),
                 (F.col("value") * F.col("o.k")).alias("value"))
    inner = F.col("y").between(1, height - 2) & F.col("x").between(1, width - 2)
    return e.filter(inner).groupBy(*keys, "y", "x").agg(F.sum("value").alias("value"))


def curvature_loss(pixels: DataFrame, height: int, width: int, keys=IMAGE) -> DataFrame:
    return stencil(pixels, height, width, keys).groupBy(*keys).agg(
        F.sum(F.col("value") * F.col("value")).alias("loss"))


def _column_distance(pixels, feature, height, width, keys):
    """Squared distance of every pixel to the nearest feature; null where there is none."""
    back = W.partitionBy(*keys, "y").orderBy("x")
    ahead = back.rowsBetween(0, W.unboundedFollowing)
    here = F.when(feature, F.col("x"))
    before = F.last(here, ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(here, ignorenulls=True).over(ahead)
    far = height + width
    g = F.least(F.coalesce(F.col("x") - before, F.lit(far)), F.coalesce(after - F.col("x"), F.lit(far)))
    rows = pixels.withColumn("g", g)
    # A column has `height` values, the caller's canvas size.
    cols = rows.groupBy(*keys, "x").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("y", "g"))), lambda s: s["g"]).alias("gs"))
    near = F.transform("gs", lambda own, i: F.array_min(F.transform(
        # Rows further away than the distance along the own row cannot be nearer.
        F.sequence(F.greatest(i - own, F.lit(0)), F.least(i + own, F.lit(height - 1))),
        lambda j: (j - i) * (j - i) + F.get("gs", j) * F.get("gs", j))))
    out = cols.select(*keys, "x", F.posexplode(near).alias("y", "d2"))
    return out.withColumn("d2", F.when(F.col("d2") < far * far, F.col("d2")))


def signed_distance(pixels: DataFrame, threshold: float, height: int, width: int, keys=IMAGE) -> DataFrame:
    """Exact distance to the nearest foreground pixel centre, negative inside.

    All-foreground images get -max(height, width), all-background ones +max(height, width).
    """
    on = F.col("value") >= threshold
    outside = _column_distance(pixels, on, height, width, keys).withColumnRenamed("d2", "fg")
    inside = _column_distance(pixels, ~on, height, width, keys).withColumnRenamed("d2", "bg")
    both = outside.join(inside.hint("merge"), [*keys, "y", "x"])
    whole = F.lit(float(max(height, width)))
    value = (F.when(F.col("fg").isNull(), whole).when(F.col("bg").isNull(), -whole)
             .when(F.col("fg") == 0, -F.sqrt(F.col("bg").cast("double")))
             .otherwise(F.sqrt(F.col("fg").cast("double"))))
    return both.select(*keys, "y", "x", value.alias("value"))


def condition_range(printed: DataFrame, keys=IMAGE) -> DataFrame:
    """Per pixel the largest, smallest and spread of the values of all conditions."""
    return printed.groupBy(*keys, "y", "x").agg(
        F.max("value").alias("high"), F.min("value").alias("low"),
        (F.max("value") - F.min("value")).alias("spread"))


def mismatch(first: DataFrame, second: DataFrame, keys=IMAGE, tolerance: float = 1e-6) -> DataFrame:
    """Per image the number of pixels that differ; absent pixels count as 0."""
    a = first.select(*keys, "y", "x", F.col("value").alias("va"))
    b = second.select(*keys, "y", "x", F.col("value").alias("vb"))
    both = a.join(b, [*keys, "y", "x"], "full_outer")
    gap = F.abs(F.coalesce("va", F.lit(0.0)) - F.coalesce("vb", F.lit(0.0)))
    return both.groupBy(*keys).agg(F.count_if(gap > tolerance).alias("pixels"))


def value_range(pixels: DataFrame, keys=IMAGE) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"))


def image_issues(pixels: DataFrame, keys=IMAGE, by: str = "condition") -> DataFrame:
    """Images whose conditions do not all have the same extent and number of pixels."""
    each = pixels.groupBy(*keys, by).agg(F.count("*").alias("n"), F.max("x").alias("mx"),
                                         F.max("y").alias("my"))
    shape = F.struct("n", "mx", "my")
    return each.groupBy(*keys).agg(F.min(shape).alias("lo"), F.max(shape).alias("hi")).filter(
        F.col("lo") != F.col("hi")).select(*keys)


def mask_issues(images: DataFrame, masks: DataFrame, keys=IMAGE) -> DataFrame:
    """Images without a mask, or with one of another extent or number of pixels; and masks without an image."""
    def shape(df, name):
        return df.groupBy(*keys).agg(F.struct(F.count("*").alias("n"), F.max("x").alias("mx"), F.max("y").alias("my")).alias(name))

    both = shape(images, "i").join(shape(masks, "m"), list(keys), "full_outer")
    code = F.when(F.col("m").isNull(), "no_mask").when(F.col("i").isNull(), "no_image").when(F.col("i") != F.col("m"), "other_shape")
    return both.select(*keys, code.alias("code")).filter(F.col("code").isNotNull())


def blend_images(movable: DataFrame, fixed: DataFrame, mask: DataFrame, keys=IMAGE) -> DataFrame:
    """Movable pixels where the mask is 1 and fixed ones where it is 0; absent pixels are 0."""
    from shapeloom.functions.scalars import blend
    on = [*keys, "y", "x"]
    none = F.lit(None).cast("double")
    parts = [df.select(*on, *[(F.col("value") if c == name else none).alias(c) for c in "mfw"])
             for name, df in (("m", movable), ("f", fixed), ("w", mask))]
    tagged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    both = tagged.groupBy(*on).agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in "mfw"])
    return both.select(*on, blend("m", "f", "w").alias("value"))


def bilinear_sample(probes: DataFrame, pixels: DataFrame, x="px", y="py", keys=IMAGE) -> DataFrame:
    """Add `value`: weighted sum of the four pixels around a point, absent pixels 0.

    `probes` needs probe_id. Only neighbours are looked up, by an equi-join.
    """
    return bilinear_values(neighbours(probes, x, y, keys), pixels, ["probe_id"], keys)


def neighbours(probes: DataFrame, x, y, keys=IMAGE, extra=()) -> DataFrame:
    x0, y0 = F.floor(x), F.floor(y)
    fx, fy = F.col(x) - x0, F.col(y) - y0
    four = F.array(*[F.struct((y0 + i).cast("int").alias("y"), (x0 + j).cast("int").alias("x"),
                              ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("k"))
                     for i in (0, 1) for j in (0, 1)])
    return probes.select("probe_id", *keys, *extra, F.explode(four).alias("o")).select(
        "probe_id", *keys, *extra, "o.*")


def bilinear_values(points: DataFrame, pixels: DataFrame, group, keys=IMAGE) -> DataFrame:
    hit = points.join(pixels.hint("merge"), [*keys, "y", "x"], "left")
    return hit.groupBy(*group).agg(F.sum(F.col("k") * F.coalesce("value", F.lit(0.0))).alias("value"))


def nearest_sample(probes: DataFrame, pixels: DataFrame, x="px", y="py", keys=IMAGE) -> DataFrame:
    """Add `value` of the pixel at the rounded point, 0 outside."""
    at = (probes.withColumn("x", F.rint(x).cast("int")).withColumn("y", F.rint(y).cast("int")))
    return at.join(pixels.hint("merge"), [*keys, "y", "x"], "left").select(
        "probe_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def _s(v) -> Column:
    return 1.0 / (1.0 + F.exp(-v))


def soft_edge_raster(base: DataFrame, segments: DataFrame, pixel: int, temperature: float,
                     reach: float | None = None, keys=("core_id",)) -> DataFrame:
    """Base coverage changed smoothly by moved segments; unchanged where all d are 0.

    `base` has core_id, cl, cb (context corner), y, x, value; `segments` has core_id and
    sx, sy, ex, ey, nx, ny, d. Segments of shift 0 contribute exactly nothing and are not
    joined. Each segment lists the pixels within `reach` itself and changes are summed per pixel before
    they meet the base; without a reach all rows of the tile are listed and the sum is exact. Segments
    that carry the corner (cl, cb) of their tile need not look it up.
    """
    if pixel <= 0 or temperature <= 0:
        raise ValueError("pixel and temperature must be positive")
    keys = list(keys)
    moved = segments.filter("d <> 0")
    p = base.withColumn("gx", F.col("cl") + (F.col("x") + 0.5) * pixel).withColumn(
        "gy", F.col("cb") + (F.col("y") + 0.5) * pixel)
    known = [c for c in ("cl", "cb") if reach is not None and {"cl", "cb"} <= set(segments.columns)]
    q = moved.select(*keys, *known, "sx", "sy", "ex", "ey", "nx", "ny", "d")
    if reach is None:
        rows = base.groupBy(*keys).agg(F.collect_set("y").alias("ys"))
        q = q.join(rows.hint("merge"), keys).select(*q.columns, F.explode("ys").alias("y"))
        both = p.select(*keys, "y", "x", "gx", "gy").join(q.hint("merge"), [*keys, "y"])
    else:
        if not known:
            q = q.join(base.groupBy(*keys).agg(F.min("cl").alias("cl"), F.min("cb").alias("cb")).hint("merge"), keys)

        def near(s, e, corner):
            lo, hi = (F.floor((v - F.col(corner)) / pixel).cast("int") for v in (F.least(s, e) - reach, F.greatest(s, e) + reach))
            lo = F.greatest(lo, F.lit(0))
            return F.explode(F.when(lo <= hi, F.sequence(lo, hi)))

        # Pixels that the base does not have are left out when the changes are joined to it.
        both = q.withColumn("y", near("sy", "ey", "cb")).withColumn("x", near("sx", "ex", "cl")).withColumns(
            {"gx": F.col("cl") + (F.col("x") + 0.5) * pixel, "gy": F.col("cb") + (F.col("y") + 0.5) * pixel})
        both = both.filter((F.col("gx") >= F.least("sx", "ex") - reach) &
                           (F.col("gx") <= F.greatest("sx", "ex") + reach))
    length = F.hypot(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy"))
    dx, dy = F.col("gx") - F.col("sx"), F.col("gy") - F.col("sy")
    along = (dx * (F.col("ex") - F.col("sx")) + dy * (F.col("ey") - F.col("sy"))) / length
    off = dx * F.col("nx") + dy * F.col("ny")
    window = _s(along / temperature) * _s((length - along) / temperature)
    change = window * (_s((F.col("d") - off) / temperature) - _s(-off / temperature))
    total = both.groupBy(*keys, "y", "x").agg(F.sum(change).alias("change"))
    out = base.join(total.hint("merge"), [*keys, "y", "x"], "left")
    v = F.col("value") + F.coalesce("change", F.lit(0.0))
    return out.select(*keys, "y", "x", F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)).alias("value"))
