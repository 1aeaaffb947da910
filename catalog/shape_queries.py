"""Scalar functions, filters, shape aggregates and parameter parsing on the driver tables."""
from pyspark.sql import functions as F

from catalog import tables as T
from catalog.registry import query
from shapeloom.functions import scalars as S
from shapeloom.operators import filters

SOLID = "WITH " + T.SOLID


def roi(spark, sf_dir):
    """The middle half of the layout; two numbers come to the driver."""
    x = T.solid(spark, sf_dir).agg(F.max("r")).first()[0]
    return (x // 4, 1000, x * 3 // 4, 7000)


ROI = ", roi AS (SELECT max(r) // 4 AS ql, 1000 AS qb, max(r) * 3 // 4 AS qr, 7000 AS qt FROM solid)"


@query(SOLID + """ SELECT shape_id, r - l AS width, t - b AS height, (r - l) * (t - b) AS area,
 l - 25 AS xl, b - 25 AS xb, r + 25 AS xr, t + 25 AS xt FROM solid""")
def box_measures(spark, sf_dir):
    out = S.box_expand(25)
    grown = [c.alias("x" + n) for c, n in zip(out, "lbrt")]
    return T.solid(spark, sf_dir).select(
        "shape_id", S.box_width().alias("width"), S.box_height().alias("height"),
        S.box_area().alias("area"), *grown)


@query(SOLID + ROI + """ SELECT shape_id,
 CASE WHEN ok THEN il END AS l, CASE WHEN ok THEN ib END AS b,
 CASE WHEN ok THEN ir END AS r, CASE WHEN ok THEN it END AS t FROM (
 SELECT *, il < ir AND ib < it AS ok FROM (SELECT shape_id, greatest(l, ql) AS il,
 greatest(b, qb) AS ib, least(r, qr) AS ir, least(t, qt) AS it FROM solid, roi))""")
def box_intersections(spark, sf_dir):
    box = S.box_intersection([F.col(c) for c in "lbrt"], roi(spark, sf_dir))
    return T.solid(spark, sf_dir).select("shape_id", box.alias("i")).select("shape_id", "i.*")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity * 0.5 AS nm,
 l_quantity * 0.5 / (0.0005 * 1000.0) AS raw, l_extendedprice / (0.0005 * 1000.0) AS raw2,
 l_discount FROM lineitem)
 SELECT count(*) AS n, count(whole) AS exact, CAST(sum(whole) AS BIGINT) AS total,
 count(whole2) AS exact2, count(*) FILTER (WHERE abs(l_discount / 0.5 - round_even(l_discount / 0.5, 0))
  <= 1e-9 AND l_discount >= 0) AS allowed_zero
 FROM (SELECT *, CASE WHEN round_even(raw, 0) > 0 AND abs(raw - round_even(raw, 0)) <= 1e-9
  THEN CAST(round_even(raw, 0) AS BIGINT) END AS whole,
  CASE WHEN round_even(raw2, 0) > 0 AND abs(raw2 - round_even(raw2, 0)) <= 1e-9
  THEN CAST(round_even(raw2, 0) AS BIGINT) END AS whole2 FROM v)""")
def exact_units(spark, sf_dir):
    li = T.read(spark, sf_dir, "lineitem")
    whole = S.nm_to_dbu(F.col("l_quantity") * 0.5, 0.0005)
    whole2 = S.nm_to_dbu("l_extendedprice", 0.0005)
    zero = S.nm_to_dbu("l_discount", 0.0005, allow_zero=True)
    return li.agg(F.count("*").alias("n"), F.count(whole).alias("exact"), F.sum(whole).alias("total"),
                  F.count(whole2).alias("exact2"), F.count(zero).alias("allowed_zero"))


@query("""WITH v AS (SELECT l_quantity / 0.5 AS c, (l_quantity + l_linenumber) / 0.5 AS m,
 l_tax * 100 / 0.5 AS d FROM lineitem)
 SELECT CAST(c AS BIGINT) AS corner, CAST(m AS BIGINT) AS maximum, count(*) AS n,
 round(sum(d), 6) AS displacement FROM v
 WHERE c > 0 AND c = floor(c) AND m = floor(m) GROUP BY 1, 2""")
def segment_parameter_sets(spark, sf_dir):
    p = S.segment_parameters("l_quantity", F.col("l_quantity") + F.col("l_linenumber"),
                             F.col("l_tax") * 100, 0.0005)
    li = T.read(spark, sf_dir, "lineitem").select(p.alias("p")).filter("p is not null")
    return li.groupBy("p.corner", "p.maximum").agg(
        F.count("*").alias("n"), F.round(F.sum("p.displacement"), 6).alias("displacement"))


@query(SOLID + """ SELECT layer, CAST(0 AS INTEGER) AS datatype FROM solid GROUP BY layer""")
def layer_list(spark, sf_dir):
    return filters.layer_list(T.solid(spark, sf_dir).withColumn("datatype", F.lit(0)))


@query("WITH " + T.RECTS + """ SELECT layer, count(*) FILTER (WHERE kind IN ('box','path','polygon'))
 AS polygon_like, count(*) FILTER (WHERE kind = 'text') AS text,
 count(*) FILTER (WHERE kind = 'edge') AS edge, count(*) FILTER (WHERE kind NOT IN
 ('box','path','polygon','text','edge')) AS other
 FROM rects, (SELECT max(r) // 4 AS ql, max(r) * 3 // 4 AS qr FROM rects WHERE kind <> 'text')
 WHERE r >= ql AND l <= qr AND t >= 1000 AND b <= 7000 GROUP BY layer""")
def shape_kind_counts(spark, sf_dir):
    return filters.shape_stats(T.rects(spark, sf_dir), roi(spark, sf_dir))


@query("WITH " + T.RECTS + """ SELECT shape_id, layer FROM rects WHERE layer IN (0, 2)""")
def layer_filter(spark, sf_dir):
    df = T.rects(spark, sf_dir).withColumn("datatype", F.lit(0))
    return filters.select_layers(df, [(2, 0), (0, 0), (2, 0)]).select("shape_id", "layer")


@query("""SELECT CAST(l_linenumber AS INTEGER) AS layer, CAST(0 AS INTEGER) AS datatype FROM lineitem
 GROUP BY 1 HAVING layer NOT IN (SELECT o_orderkey % 3 FROM orders)""")
def unknown_layers(spark, sf_dir):
    wanted = T.read(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").cast("int").alias("layer"), F.lit(0).alias("datatype"))
    return filters.unknown_layers(T.rects(spark, sf_dir).withColumn("datatype", F.lit(0)), wanted)


@query("WITH " + T.RECTS + ", solid AS (SELECT * FROM rects WHERE kind <> 'text')" + ROI +
       """ SELECT layer, shape_id, kind FROM rects, roi
 WHERE kind <> 'text' AND l < qr AND r > ql AND b < qt AND t > qb""")
def region_candidates(spark, sf_dir):
    return filters.candidates(T.rects(spark, sf_dir), roi(spark, sf_dir)).select(
        "layer", "shape_id", "kind")


@query(SOLID + ROI + """ SELECT shape_id, kind, greatest(l, ql) AS l, greatest(b, qb) AS b,
 least(r, qr) AS r, least(t, qt) AS t FROM solid, roi
 WHERE l < qr AND r > ql AND b < qt AND t > qb""")
def region_clip(spark, sf_dir):
    return filters.clip(T.solid(spark, sf_dir), roi(spark, sf_dir)).select(
        "shape_id", "kind", "l", "b", "r", "t")


@query(SOLID + ROI + """ SELECT layer, count(*) AS polygons, min(l) AS l, max(r) AS r FROM solid, roi
 WHERE l < qr AND r > ql AND b < qt AND t > qb GROUP BY layer""")
def region_whole_shapes(spark, sf_dir):
    """Whole shapes of the region and their occurrence count per layer."""
    return filters.intersecting(T.solid(spark, sf_dir), roi(spark, sf_dir)).groupBy("layer").agg(
        F.count("*").alias("polygons"), F.min("l").alias("l"), F.max("r").alias("r"))


@query("WITH " + T.SOLID + ROI + """ SELECT shape_id FROM rects, roi
 WHERE r >= ql AND l <= qr AND t >= qb AND b <= qt""")
def touching_context(spark, sf_dir):
    return T.rects(spark, sf_dir).filter(filters.touches(roi(spark, sf_dir))).select("shape_id")


@query("WITH " + T.RECTS + """ SELECT layer, min(l) AS l, min(b) AS b, max(r) AS r, max(t) AS t
 FROM rects GROUP BY layer""")
def bounding_boxes(spark, sf_dir):
    return filters.bounding_box(T.rects(spark, sf_dir), ("layer",))


@query("""SELECT o_orderkey, CAST(CASE WHEN ok THEN o_orderkey % 90 END AS INTEGER) AS layer,
 CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN ok THEN o_custkey % 7 END AS INTEGER) AS datatype
 FROM (SELECT o.*, o_orderkey % 5 < 3 AS ok FROM orders o)""")
def layer_text(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    head, tail = (key % 90).cast("string"), (cust % 7).cast("string")
    text = (F.when(key % 5 == 0, head).when(key % 5 == 1, F.concat_ws("/", head, tail))
            .when(key % 5 == 2, F.concat_ws(":", head, tail))
            .when(key % 5 == 3, F.concat(F.lit("M"), cust.cast("string")))
            .otherwise(F.concat(head, F.lit("/1/2"))))
    return T.read(spark, sf_dir, "orders").select(
        "o_orderkey", S.parse_layer(text).alias("p")).select("o_orderkey", "p.*")


@query("""SELECT o_custkey % 50 AS name_id, CAST(arg_max(o_orderkey % 90, o_orderkey) AS INTEGER) AS layer,
 CAST(arg_max(o_orderkey % 7, o_orderkey) AS INTEGER) AS datatype FROM orders GROUP BY 1""")
def layer_map(spark, sf_dir):
    """Later entries of a name win."""
    key = F.col("o_orderkey")
    text = F.concat(F.lit("N"), (F.col("o_custkey") % 50).cast("string"), F.lit("="),
                    (key % 90).cast("string"), F.lit("/"), (key % 7).cast("string"))
    df = T.read(spark, sf_dir, "orders").select(
        key, (F.col("o_custkey") % 50).alias("name_id"), S.parse_layer_map(text).alias("m"))
    return df.groupBy("name_id").agg(
        F.max_by("m.layer", "o_orderkey").alias("layer"),
        F.max_by("m.datatype", "o_orderkey").alias("datatype"))


@query("""SELECT s_suppkey, TRY_CAST(nullif(regexp_extract(s_name, '(\\d+)$', 1), '') AS INTEGER)
 AS layer FROM supplier""")
def trailing_layer_number(spark, sf_dir):
    return T.read(spark, sf_dir, "supplier").select(
        "s_suppkey", S.trailing_layer("s_name").alias("layer"))


@query("WITH " + T.PIXELS + """ SELECT image_id, y, x, round(1.0 / (1.0 + exp(-4.0 * (value - 0.05))), 9) AS soft,
 CAST(round_even(least(greatest(value, 0.0), 1.0) * 255.0, 0) AS INTEGER) AS level,
 value >= 0.0 AS printed, CAST(round_even((value * 100 + 3.5) / 2.0 - 0.5, 0) AS INTEGER) AS pixel
 FROM pixels""")
def pixel_functions(spark, sf_dir):
    """Soft step, quantisation, threshold and nearest pixel index."""
    v = F.col("value")
    return T.pixels(spark, sf_dir).select(
        "image_id", "y", "x", F.round(S.soft_step("value", 4.0, 0.05), 9).alias("soft"),
        S.quantise("value").alias("level"), (v >= 0.0).alias("printed"),
        S.pixel_index(v * 100 + 3.5, 0, 2.0).alias("pixel"))


@query("""SELECT event_id % 60 AS iteration, count(*) AS n, 8.0 * pow(0.5, (event_id % 60) // 4) AS step
 FROM events GROUP BY 1, 3""")
def step_schedule(spark, sf_dir):
    it = (F.col("event_id") % 60).alias("iteration")
    return T.read(spark, sf_dir, "events").select(it).groupBy("iteration").agg(
        F.count("*").alias("n")).select("iteration", "n", S.step_size("iteration", 8.0, 4).alias("step"))


@query("""SELECT event_id, greatest(least(value - 10, 12.0), -12.0) AS d FROM events""")
def clipped_displacements(spark, sf_dir):
    return T.read(spark, sf_dir, "events").select(
        "event_id", S.clip_displacement(F.col("value") - 10, 12.0).alias("d"))


@query(SOLID + """, p AS (SELECT shape_id, l AS x, CASE WHEN shape_id % 2 = 1 THEN -b ELSE b END AS y,
 shape_id // 2 % 4 AS rot FROM solid) SELECT shape_id,
 CASE rot WHEN 0 THEN x WHEN 1 THEN -y WHEN 2 THEN -x ELSE y END + 1000 AS tx,
 CASE rot WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN -y ELSE -x END - 500 AS ty FROM p""")
def placed_points(spark, sf_dir):
    df = T.solid(spark, sf_dir).select(
        "shape_id", "l", "b", (S.floor_div("shape_id", 2) % 4).alias("rot"),
        (F.col("shape_id") % 2).alias("mirror"))
    return df.select("shape_id", S.transform_x("l", "b", "rot", "mirror", F.lit(1000)).alias("tx"),
                     S.transform_y("l", "b", "rot", "mirror", F.lit(-500)).alias("ty"))


@query(SOLID + """ SELECT shape_id, l, b - 10 AS b, r + 10 AS r, b + 10 AS t FROM solid WHERE kind = 'path'
 UNION ALL SELECT shape_id, r - 10, b - 10, r + 10, t FROM solid WHERE kind = 'path'""")
def path_outlines(spark, sf_dir):
    """An L-shaped path (l,b)-(r,b)-(r,t) of width 20 as boxes."""
    def pt(x, y):
        return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    pts = F.array(pt("l", "b"), pt("r", "b"), pt("r", "t"))
    return T.solid(spark, sf_dir).filter("kind = 'path'").select(
        "shape_id", F.explode(S.path_boxes(pts, 20)).alias("p")).select("shape_id", "p.*")


@query(SOLID + """ SELECT layer, count(*) AS tiles, max(px) AS largest,
 count(*) FILTER (WHERE px > 1000) AS refused FROM (SELECT layer,
 CAST(ceil((r - l) / 10.0) AS BIGINT) * CAST(ceil((t - b) / 10.0) AS BIGINT) AS px FROM solid) GROUP BY layer""")
def raster_size_guard(spark, sf_dir):
    w, h = S.ceil_div(S.box_width(), 10), S.ceil_div(S.box_height(), 10)
    return T.solid(spark, sf_dir).select("layer", (w * h).alias("px")).groupBy("layer").agg(
        F.count("*").alias("tiles"), F.max("px").alias("largest"),
        F.count_if(F.col("px") > 1000).alias("refused"))


@query("WITH " + T.SOLID + """ SELECT layer, shape_id, l, b, r, t, position FROM (
 SELECT *, row_number() OVER (ORDER BY layer, l, b, shape_id) - 1 AS position, count(*) OVER () AS n
 FROM solid) WHERE position % greatest(1, CAST(ceil(n / 500.0) AS BIGINT)) = 0""")
def evenly_spaced_sample(spark, sf_dir):
    return filters.every_nth(T.solid(spark, sf_dir).drop("kind"), ["layer", "l", "b", "shape_id"], 500)
