"""Layout tables derived from the driver tables, as DataFrames and as SQL CTEs."""
from pyspark.sql import DataFrame, SparkSession, functions as F

from shapeloom.functions.scalars import floor_div
from shapeloom.operators import tiling
from shapeloom.operators.tiling import Grid

TILE, HALO = 4096, 256
CORNER, MAXIMUM = 16, 32


# Tables whose rows are expanded many times over, with the column they are spread by and the rows of a task.
SPREAD = {"lineitem": ("l_orderkey", 1 << 18), "orders": ("o_orderkey", 1 << 14), "embeddings": ("vec_id", 1 << 14)}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; those whose rows expand are dealt by key first, to as many tasks as the rows need."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in SPREAD:
        return df
    return df.repartition(parts(spark, sf_dir, name), SPREAD[name][0])


def parts(spark: SparkSession, sf_dir: str, name: str) -> int:
    """The number of tasks that `read` deals a table to."""
    return tiling.parts_for(spark, spark.read.parquet(f"{sf_dir}/{name}.parquet").count(), SPREAD[name][1])


def boxes(spark, sf_dir) -> DataFrame:
    """Overlapping boxes without an id, from lineitem."""
    q = F.floor("l_quantity")
    left = F.col("l_orderkey") * 37
    bottom = F.pmod(F.col("l_partkey") * 1511 + F.col("l_linenumber") * 17, F.lit(8192))
    return read(spark, sf_dir, "lineitem").select(
        F.pmod("l_suppkey", F.lit(3)).cast("int").alias("layer"),
        left.alias("l"), bottom.alias("b"), (left + 40 + q * 8).alias("r"),
        (bottom + 40 + F.pmod("l_suppkey", F.lit(50)) * 8).alias("t"))


BOXES = """boxes AS (SELECT CAST(l_suppkey % 3 AS INTEGER) AS layer, l_orderkey * 37 AS l,
 (l_partkey * 1511 + l_linenumber * 17) % 8192 AS b,
 l_orderkey * 37 + 40 + 8 * CAST(floor(l_quantity) AS BIGINT) AS r,
 (l_partkey * 1511 + l_linenumber * 17) % 8192 + 40 + 8 * (l_suppkey % 50) AS t
 FROM lineitem)"""


def rects(spark, sf_dir) -> DataFrame:
    """Shapes with an id and a kind, from orders; texts are points."""
    key = F.col("o_orderkey")
    left, bottom = key * 37, F.pmod(F.col("o_custkey") * 1511, F.lit(8192))
    kind = (F.when(key % 10 == 0, "text").when(key % 10 == 1, "path")
            .when(key % 10 == 2, "polygon").otherwise("box"))
    text = key % 10 == 0
    return read(spark, sf_dir, "orders").select(
        (key % 3).cast("int").alias("layer"), key.alias("shape_id"),
        left.alias("l"), bottom.alias("b"),
        F.when(text, left).otherwise(left + 40 + F.col("o_custkey") % 50 * 8).alias("r"),
        F.when(text, bottom).otherwise(bottom + 40 + key % 50 * 8).alias("t"),
        kind.alias("kind"))


RECTS = """rects AS (SELECT CAST(o_orderkey % 3 AS INTEGER) AS layer, o_orderkey AS shape_id,
 o_orderkey * 37 AS l, (o_custkey * 1511) % 8192 AS b,
 CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey * 37
      ELSE o_orderkey * 37 + 40 + 8 * (o_custkey % 50) END AS r,
 CASE WHEN o_orderkey % 10 = 0 THEN (o_custkey * 1511) % 8192
      ELSE (o_custkey * 1511) % 8192 + 40 + 8 * (o_orderkey % 50) END AS t,
 CASE o_orderkey % 10 WHEN 0 THEN 'text' WHEN 1 THEN 'path' WHEN 2 THEN 'polygon'
      ELSE 'box' END AS kind FROM orders)"""


def solid(spark, sf_dir) -> DataFrame:
    return rects(spark, sf_dir).filter(F.col("kind") != "text")


SOLID = RECTS + ", solid AS (SELECT * FROM rects WHERE kind <> 'text')"


def ring_of(l, b, r, t, hole: bool):
    """Clockwise hull, or anticlockwise hole, of a box."""
    p = [(l, b), (l, t), (r, t), (r, b)]
    if hole:
        p = [p[0], p[3], p[2], p[1]]
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in p])


def rings(spark, sf_dir) -> DataFrame:
    """Polygons (layer, polygon_id, rings); every fourth has a hole."""
    c = [F.col(n) for n in "lbrt"]
    hull = ring_of(*c, hole=False)
    hole = ring_of(c[0] + 15, c[1] + 15, c[2] - 15, c[3] - 15, hole=True)
    return solid(spark, sf_dir).select(
        "layer", F.col("shape_id").alias("polygon_id"),
        F.when(F.col("shape_id") % 4 == 0, F.array(hull, hole)).otherwise(F.array(hull))
        .alias("rings"))


# The same rings as directed edges; previous and next follow from ord modulo 4.
EDGES = SOLID + """, hulls AS (
 SELECT layer, shape_id AS polygon_id, 0 AS ring_id, l, b, r, t FROM solid
 UNION ALL SELECT layer, shape_id, 1, l + 15, b + 15, r - 15, t - 15 FROM solid
 WHERE shape_id % 4 = 0),
edges AS (SELECT layer, polygon_id, CAST(ring_id AS INTEGER) AS ring_id, ring_id = 1 AS is_hole,
 CAST(o AS INTEGER) AS ord,
 CASE WHEN ring_id = 0 THEN CASE o WHEN 0 THEN l WHEN 1 THEN l WHEN 2 THEN r ELSE r END
      ELSE CASE o WHEN 0 THEN l WHEN 1 THEN r WHEN 2 THEN r ELSE l END END AS x0,
 CASE WHEN ring_id = 0 THEN CASE o WHEN 0 THEN b WHEN 1 THEN t WHEN 2 THEN t ELSE b END
      ELSE CASE o WHEN 0 THEN b WHEN 1 THEN b WHEN 2 THEN t ELSE t END END AS y0,
 CASE WHEN ring_id = 0 THEN CASE o WHEN 0 THEN l WHEN 1 THEN r WHEN 2 THEN r ELSE l END
      ELSE CASE o WHEN 0 THEN r WHEN 1 THEN r WHEN 2 THEN l ELSE l END END AS x1,
 CASE WHEN ring_id = 0 THEN CASE o WHEN 0 THEN t WHEN 1 THEN t WHEN 2 THEN b ELSE b END
      ELSE CASE o WHEN 0 THEN b WHEN 1 THEN t WHEN 2 THEN t ELSE b END END AS y1
 FROM hulls, range(0, 4) AS g(o))"""


def diagonals(spark, sf_dir) -> DataFrame:
    """Diamonds through the side mid-points of the rects, on a doubled grid."""
    l, b, r, t = (F.col(n) for n in "lbrt")
    pts = [(l * 2, b + t), (l + r, t * 2), (r * 2, b + t), (l + r, b * 2)]
    return solid(spark, sf_dir).select(
        "layer", F.col("shape_id").alias("polygon_id"),
        F.array(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in pts])).alias("rings"))


DIAGONAL_EDGES = SOLID + """, edges AS (SELECT layer, shape_id AS polygon_id, CAST(0 AS INTEGER) AS ring_id,
 FALSE AS is_hole, CAST(o AS INTEGER) AS ord,
 CASE o WHEN 0 THEN 2*l WHEN 1 THEN l+r WHEN 2 THEN 2*r ELSE l+r END AS x0,
 CASE o WHEN 0 THEN b+t WHEN 1 THEN 2*t WHEN 2 THEN b+t ELSE 2*b END AS y0,
 CASE o WHEN 0 THEN l+r WHEN 1 THEN 2*r WHEN 2 THEN l+r ELSE 2*l END AS x1,
 CASE o WHEN 0 THEN 2*t WHEN 1 THEN b+t WHEN 2 THEN 2*b ELSE b+t END AS y1
 FROM solid, range(0, 4) AS g(o))"""

# Fragmentation of `edges` into `segments` with parameters t0 and t1.
SEGMENTS = """, measured AS (SELECT *, sqrt(CAST((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0) AS DOUBLE)) AS len
 FROM edges), counted AS (SELECT *, CASE WHEN len > 64 THEN 2 + CAST(ceil((len - 32) / 32) AS INTEGER)
 ELSE CAST(ceil(len / 32) AS INTEGER) END AS n FROM measured),
numbered AS (SELECT *, CAST(unnest(range(0, n)) AS INTEGER) AS seg_ord FROM counted),
parametric AS (SELECT *,
 CASE WHEN len <= 64 THEN seg_ord / CAST(n AS DOUBLE) WHEN seg_ord = 0 THEN 0.0
  WHEN seg_ord = n - 1 THEN 1.0 - 16 / len
  ELSE 16 / len + (seg_ord - 1) * ((1.0 - 2.0 * (16 / len)) / (n - 2)) END AS t0,
 CASE WHEN len <= 64 THEN (seg_ord + 1) / CAST(n AS DOUBLE) WHEN seg_ord = n - 1 THEN 1.0
  WHEN seg_ord = 0 THEN 16 / len
  ELSE 16 / len + (seg_ord - 1) * ((1.0 - 2.0 * (16 / len)) / (n - 2))
       + (1.0 - 2.0 * (16 / len)) / (n - 2) END AS t1 FROM numbered),
segments AS (SELECT *, -(y1 - y0) / len AS nx, (x1 - x0) / len AS ny,
 x0 + (x1 - x0) * t0 AS sx, y0 + (y1 - y0) * t0 AS sy,
 x0 + (x1 - x0) * t1 AS ex, y0 + (y1 - y0) * t1 AS ey FROM parametric)"""

# Hulls run clockwise and holes anticlockwise, so the outward normal is the left one.

# The grid over all rects: even tiles from (0, 0) to the largest right and top border.
EXTENT = """, extent AS (SELECT max(r) AS xe, max(t) AS ye FROM solid),
grid AS (SELECT xe, ye, CAST(ceil(xe / 4096.0) AS BIGINT) AS ncols,
 CAST(ceil(ye / 4096.0) AS BIGINT) AS nrows FROM extent)"""

OWNERS = EXTENT + """, midpoints AS (SELECT *, (sx + ex) * 0.5 AS mx, (sy + ey) * 0.5 AS my
 FROM segments), owners AS (SELECT m.*, CASE WHEN mx < 0 OR mx > xe OR my < 0 OR my > ye THEN -1
 ELSE (CASE WHEN my = ye THEN nrows - 1 ELSE CAST(floor(my / 4096) AS BIGINT) END) * ncols
 + (CASE WHEN mx = xe THEN ncols - 1 ELSE CAST(floor(mx / 4096) AS BIGINT) END) END AS core_id
 FROM midpoints m, grid)"""

MEMBERS = OWNERS + """, spans AS (SELECT o.* EXCLUDE (core_id), core_id AS owner_id, ncols,
 least(greatest(CAST(ceil((least(sx,ex)-256)/4096) AS BIGINT)-1, 0), ncols-1) AS ix0,
 greatest(least(CAST(floor((greatest(sx,ex)+256)/4096) AS BIGINT), ncols-1), 0) AS ix1,
 least(greatest(CAST(ceil((least(sy,ey)-256)/4096) AS BIGINT)-1, 0), nrows-1) AS iy0,
 greatest(least(CAST(floor((greatest(sy,ey)+256)/4096) AS BIGINT), nrows-1), 0) AS iy1
 FROM owners o, grid),
membership AS (SELECT s.*, iy * ncols + ix AS core_id FROM (
 SELECT *, unnest(range(ix0, ix1 + 1)) AS ix FROM (
 SELECT *, unnest(range(iy0, iy1 + 1)) AS iy FROM spans)) s)"""


def grid(spark, sf_dir) -> Grid:
    """Even tiles over all solid rects; four numbers come to the driver."""
    top = solid(spark, sf_dir).agg(F.max("r"), F.max("t")).first()
    return Grid.even((0, 0, top[0], top[1]), TILE, HALO)


def pixels(spark, sf_dir) -> DataFrame:
    """8 x 8 images, one per embedding."""
    return (read(spark, sf_dir, "embeddings")
            .select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "e"))
            .select("image_id", floor_div("p", 8).cast("int").alias("y"),
                    F.pmod("p", F.lit(8)).cast("int").alias("x"),
                    F.col("e").cast("double").alias("value")))


PIXELS = """pixels AS (SELECT vec_id AS image_id, CAST((p - 1) // 8 AS INTEGER) AS y,
 CAST((p - 1) % 8 AS INTEGER) AS x, CAST(embedding[p] AS DOUBLE) AS value
 FROM embeddings, range(1, 65) AS g(p))"""


def printed(spark, sf_dir) -> DataFrame:
    """Three conditions per image; the nominal one is the following embedding."""
    nominal = pixels(spark, sf_dir).withColumn("image_id", F.col("image_id") - 1)
    shifts = F.array(*[F.struct(F.lit(n).alias("condition"), F.lit(s).alias("shift"))
                       for n, s in (("nominal", 0.0), ("dose_max", 0.04), ("defocus_min", -0.04))])
    return nominal.select("image_id", "y", "x", "value", F.explode(shifts).alias("c")).select(
        "image_id", "c.condition", "y", "x", (F.col("value") + F.col("c.shift")).alias("value"))


PRINTED = PIXELS + """, printed AS (SELECT image_id - 1 AS image_id, condition, y, x, value + shift AS value
 FROM pixels, (VALUES ('nominal', 0.0::DOUBLE), ('dose_max', 0.04::DOUBLE),
 ('defocus_min', -0.04::DOUBLE)) AS c(condition, shift))"""


def probes(spark, sf_dir) -> DataFrame:
    """Eight inner/outer pairs per image, some of them out of bounds."""
    k = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), k).select(
        "image_id", (F.col("image_id") * 8 + F.col("k")).alias("probe_id"),
        F.col("k").cast("double").alias("inner_x"),
        F.pmod(F.col("image_id") + F.col("k"), F.lit(8)).cast("double").alias("inner_y"),
        (F.col("k") + 1).cast("double").alias("outer_x"),
        F.pmod(F.col("image_id") + F.col("k"), F.lit(8)).cast("double").alias("outer_y"))


PROBES = """, probes AS (SELECT vec_id AS image_id, vec_id * 8 + k AS probe_id,
 CAST(k AS DOUBLE) AS inner_x, CAST((vec_id + k) % 8 AS DOUBLE) AS inner_y,
 CAST(k + 1 AS DOUBLE) AS outer_x, CAST((vec_id + k) % 8 AS DOUBLE) AS outer_y
 FROM embeddings, range(0, 8) AS g(k))"""


def diamonds(spark, sf_dir) -> DataFrame:
    """Crowded diamonds (layer, polygon_id, side, rings) whose sides cross at grid points only."""
    x, y = F.col("shape_id") * 4 + 4096, F.pmod(F.col("shape_id") * 1511, F.lit(1024)) * 2
    r = 40 + F.pmod("shape_id", F.lit(20)) * 8
    pts = [(x - r, y), (x, y + r), (x + r, y), (x, y - r)]
    return solid(spark, sf_dir).select(
        "layer", F.col("shape_id").alias("polygon_id"), F.pmod(floor_div("shape_id", 3), F.lit(2)).cast("int").alias("side"),
        F.array(F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in pts])).alias("rings"))


# In u = x + y and v = x - y a diamond is a box of twice its area.
DIAMONDS = SOLID + """, sides AS (SELECT layer, CAST(shape_id // 3 % 2 AS INTEGER) AS side, u - r AS l, v - r AS b, u + r AS r, v + r AS t
 FROM (SELECT layer, shape_id, shape_id * 4 + 4096 + shape_id * 1511 % 1024 * 2 AS u, shape_id * 4 + 4096 - shape_id * 1511 % 1024 * 2 AS v,
 40 + shape_id % 20 * 8 AS r FROM solid))"""
