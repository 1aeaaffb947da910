"""Pixel-table operators and image scores on 8 x 8 images from the embeddings."""
from pyspark.sql import functions as F

from catalog import tables as T
from catalog.registry import query
from shapeloom.operators import filters, metrics, pixels, raster

PIX = "WITH " + T.PIXELS
PRI = "WITH " + T.PRINTED


def nominal(spark, sf_dir):
    return T.printed(spark, sf_dir).filter("condition = 'nominal'")


NOMINAL = ", nominal AS (SELECT * FROM printed WHERE condition = 'nominal')"


@query(PRI + NOMINAL + """ SELECT image_id, count(*) FILTER (WHERE (coalesce(n.value, 0.0) >= 0.0) <> (coalesce(p.value, 0.0) >= 0.0)) AS l2
 FROM pixels p FULL JOIN nominal n USING (image_id, y, x) GROUP BY 1""")
def binary_mismatch(spark, sf_dir):
    return metrics.binary_mismatch(T.pixels(spark, sf_dir), nominal(spark, sf_dir), 0.0)


@query(PRI + """ SELECT image_id, count(*) FILTER (WHERE h <> w) AS pvband FROM (SELECT image_id, y, x,
 bool_or(value >= 0.0) FILTER (WHERE condition = 'dose_max') AS h,
 bool_or(value >= 0.0) FILTER (WHERE condition = 'defocus_min') AS w FROM printed GROUP BY 1, 2, 3) GROUP BY 1""")
def process_band(spark, sf_dir):
    return metrics.process_band(T.printed(spark, sf_dir), "dose_max", "defocus_min", 0.0)


SCORED = PRI + NOMINAL + T.PROBES + """, either AS MATERIALIZED (SELECT image_id, y, x, sum(a) AS a, sum(c) AS c FROM (
 SELECT image_id, y, x, value AS a, 0.0::DOUBLE AS c FROM pixels UNION ALL SELECT image_id, y, x, 0.0::DOUBLE, value FROM nominal) GROUP BY 1, 2, 3),
looked AS MATERIALIZED (SELECT q.*, i.a AS ti, o.a AS t_o, i.c AS pi, o.c AS po FROM probes q
 LEFT JOIN either i ON i.image_id = q.image_id AND i.x = CAST(inner_x AS INTEGER) AND i.y = CAST(inner_y AS INTEGER)
 LEFT JOIN either o ON o.image_id = q.image_id AND o.x = CAST(outer_x AS INTEGER) AND o.y = CAST(outer_y AS INTEGER)),
judged AS (SELECT *, coalesce(ti >= 0.0 AND t_o < 0.0, FALSE) AS valid FROM looked),
scored AS (SELECT probe_id, image_id, valid, valid AND pi < 0.0 AS i, valid AND po >= 0.0 AS o FROM judged)"""


def scored(spark, sf_dir):
    return metrics.edge_probes(T.probes(spark, sf_dir), T.pixels(spark, sf_dir), nominal(spark, sf_dir), 0.0)


@query(SCORED + """ SELECT probe_id, image_id, valid, i AS inner_violation, o AS outer_violation, i AND o AS ambiguous,
 CAST(CASE WHEN i AND NOT o THEN 1 WHEN o AND NOT i THEN -1 ELSE 0 END AS INTEGER) AS direction FROM scored""")
def edge_probe_scores(spark, sf_dir):
    return scored(spark, sf_dir)


@query(SCORED + """ SELECT image_id, count(*) FILTER (WHERE i OR o) AS epe, count(*) FILTER (WHERE valid) AS valid,
 count(*) FILTER (WHERE i AND o) AS ambiguous FROM scored GROUP BY 1""")
def edge_probe_totals(spark, sf_dir):
    return metrics.probe_totals(scored(spark, sf_dir), ("image_id",))


@query(SCORED + """ SELECT probe_id, round(coalesce(ti, 0.0), 9) AS value FROM looked""")
def probe_lookup(spark, sf_dir):
    """Target value at the rounded inner point; 0 outside."""
    return pixels.nearest_sample(T.probes(spark, sf_dir), T.pixels(spark, sf_dir), "inner_x", "inner_y").select(
        "probe_id", F.round("value", 9).alias("value"))


RUNS = PIX + """, isl AS (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g
 FROM pixels WHERE value >= 0.0), runs AS (SELECT image_id, y, CAST(min(x) AS INTEGER) AS x0,
 CAST(max(x) AS INTEGER) AS x1 FROM isl GROUP BY image_id, y, g)"""


@query(RUNS + " SELECT image_id, y, x0, x1 FROM runs")
def pixel_runs(spark, sf_dir):
    return metrics.pixel_runs(T.pixels(spark, sf_dir), 0.0)


@query(RUNS + """ SELECT image_id, count(*) AS shots FROM runs a WHERE NOT EXISTS (SELECT 1 FROM runs b
 WHERE b.image_id = a.image_id AND b.y = a.y - 1 AND b.x0 = a.x0 AND b.x1 = a.x1) GROUP BY 1""")
def rectangle_shots(spark, sf_dir):
    return metrics.shot_count(T.pixels(spark, sf_dir), 0.0)


@query(RUNS.replace(
    "WITH " + T.PIXELS, "WITH " + T.PIXELS + """, big AS (SELECT image_id, CAST(g.y AS INTEGER) AS y, CAST(h.x AS INTEGER) AS x, value
 FROM range(0, 21) AS g(y), range(0, 21) AS h(x), pixels p WHERE p.y = g.y * 8 // 21 AND p.x = h.x * 8 // 21)""").replace(
    "FROM pixels WHERE", "FROM big WHERE") + """ SELECT image_id, count(*) AS shots FROM runs a WHERE NOT EXISTS
 (SELECT 1 FROM runs b WHERE b.image_id = a.image_id AND b.y = a.y - 1 AND b.x0 = a.x0 AND b.x1 = a.x1) GROUP BY 1""")
def rectangle_shots_resized(spark, sf_dir):
    """Shots on a fixed 21 x 21 evaluation size, nearest resize first."""
    big = pixels.nearest_resize(T.pixels(spark, sf_dir), (8, 8), (21, 21))
    return metrics.shot_count(big, 0.0)


@query(PRI + NOMINAL + """, m AS (SELECT image_id, y, x, max(value) AS hi, min(value) AS lo FROM printed
 WHERE condition <> 'nominal' GROUP BY 1, 2, 3),
 a AS (SELECT image_id, sum((coalesce(n.value, 0.0) - coalesce(p.value, 0.0)) ** 2) AS nominal_l2
 FROM pixels p FULL JOIN nominal n USING (image_id, y, x) GROUP BY 1),
 b AS (SELECT image_id, sum((c.value - coalesce(p.value, 0.0)) ** 2) AS process_l2 FROM printed c LEFT JOIN pixels p USING (image_id, y, x)
 WHERE condition <> 'nominal' GROUP BY 1),
 c AS (SELECT image_id, sum((hi - lo) ** 2) AS pvband FROM m GROUP BY 1)
 SELECT image_id, round(nominal_l2, 6) AS nominal_l2, round(coalesce(process_l2, 0.0), 6) AS process_l2, round(coalesce(pvband, 0.0), 6) AS pvband,
 round(nominal_l2 + 0.5 * coalesce(process_l2, 0.0) + 2.0 * coalesce(pvband, 0.0), 6) AS total
 FROM a LEFT JOIN b USING (image_id) LEFT JOIN c USING (image_id)""")
def continuous_losses(spark, sf_dir):
    out = metrics.loss_terms(T.pixels(spark, sf_dir), T.printed(spark, sf_dir), "nominal", (0.5, 2.0))
    return out.select("image_id", *[F.round(c, 6).alias(c) for c in ("nominal_l2", "process_l2", "pvband", "total")])


@query(PRI + """, v AS (SELECT image_id, y, x, max(value) FILTER (WHERE condition = 'nominal') AS n,
 max(value) FILTER (WHERE condition = 'dose_max') AS h, max(value) FILTER (WHERE condition = 'defocus_min') AS w
 FROM printed GROUP BY 1, 2, 3)
 SELECT round(sum((coalesce(n, 0.0) - coalesce(p.value, 0.0)) ** 2) / count(*), 9) AS l2,
 round(sum((coalesce(h, 0.0) - coalesce(w, 0.0)) ** 2) / count(*), 9) AS pvband
 FROM v FULL JOIN pixels p USING (image_id, y, x)""")
def pixel_normalised_losses(spark, sf_dir):
    out = metrics.owned_loss(T.pixels(spark, sf_dir), T.printed(spark, sf_dir), "dose_max", "defocus_min", "nominal")
    return out.select(F.round("l2", 9).alias("l2"), F.round("pvband", 9).alias("pvband"))


BILINEAR = PRI + NOMINAL + T.PROBES + """, pts AS (SELECT probe_id, image_id, inner_x + 0.25 AS ax, inner_y - 0.375 AS ay,
 outer_x + 0.25 AS bx, outer_y - 0.375 AS b_y FROM probes),
 corners AS (SELECT i, j FROM range(0, 2) AS g(i), range(0, 2) AS h(j)),
 samp AS (SELECT probe_id, s, sum(k * coalesce(value, 0.0)) AS v FROM (
 SELECT probe_id, image_id, s, CAST(floor(py) AS INTEGER) + i AS y, CAST(floor(px) AS INTEGER) + j AS x,
 (CASE i WHEN 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE j WHEN 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) AS k
 FROM (SELECT probe_id, image_id, 'i' AS s, ax AS px, ay AS py FROM pts UNION ALL SELECT probe_id, image_id, 'o', bx, b_y FROM pts), corners) c
 LEFT JOIN nominal n USING (image_id, y, x) GROUP BY 1, 2)"""


def _shifted(spark, sf_dir, side):
    return T.probes(spark, sf_dir).select("probe_id", "image_id", (F.col(f"{side}_x") + 0.25).alias("px"),
                                          (F.col(f"{side}_y") - 0.375).alias("py"))


@query(BILINEAR + " SELECT probe_id, round(v, 9) + 0.0 AS value FROM samp WHERE s = 'i'")
def bilinear_probe_samples(spark, sf_dir):
    return pixels.bilinear_sample(_shifted(spark, sf_dir, "inner"), nominal(spark, sf_dir)).select(
        "probe_id", (F.round("value", 9) + 0.0).alias("value"))


@query(BILINEAR + """ SELECT round(sum(CASE WHEN valid THEN greatest(0.02 - i.v, 0) ** 2 + greatest(o.v - 0.02, 0) ** 2 END)
 / (2.0 * count(*)), 9) AS loss FROM (SELECT *, probe_id % 3 <> 0 AS valid FROM samp WHERE s = 'i') i
 JOIN (SELECT probe_id, v FROM samp WHERE s = 'o') o USING (probe_id)""")
def soft_probe_loss(spark, sf_dir):
    """Squared shortfalls of bilinear samples; every third probe counts as not valid."""
    n = nominal(spark, sf_dir)
    i = pixels.bilinear_sample(_shifted(spark, sf_dir, "inner"), n).withColumnRenamed("value", "inner")
    o = pixels.bilinear_sample(_shifted(spark, sf_dir, "outer"), n).withColumnRenamed("value", "outer")
    s = i.join(o, "probe_id").withColumn("valid", F.col("probe_id") % 3 != 0)
    total = T.probes(spark, sf_dir).count()
    return metrics.soft_probe_loss(s, 0.02, total).select(F.round("loss", 9).alias("loss"))


@query(PIX + " SELECT image_id, min(value) AS low, max(value) AS high FROM pixels GROUP BY 1")
def value_ranges(spark, sf_dir):
    return pixels.value_range(T.pixels(spark, sf_dir))


@query(PRI + """ SELECT image_id, y, x, max(value) AS high, min(value) AS low, round(max(value) - min(value), 9) AS spread
 FROM printed GROUP BY 1, 2, 3""")
def condition_ranges(spark, sf_dir):
    out = pixels.condition_range(T.printed(spark, sf_dir))
    return out.withColumn("spread", F.round("spread", 9))


@query(PRI + NOMINAL + """ SELECT image_id, count(*) FILTER (WHERE abs(coalesce(p.value, 0) - coalesce(n.value, 0)) > 1e-6) AS pixels
 FROM pixels p FULL JOIN nominal n USING (image_id, y, x) GROUP BY 1""")
def raster_mismatch(spark, sf_dir):
    return pixels.mismatch(T.pixels(spark, sf_dir), nominal(spark, sf_dir))


@query(PIX + """ SELECT image_id, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, round(avg(value), 9) AS value
 FROM pixels GROUP BY ALL""")
def block_means(spark, sf_dir):
    return pixels.block_mean(T.pixels(spark, sf_dir), 2).withColumn("value", F.round("value", 9))


@query(PIX + """ SELECT image_id, CAST(g.y AS INTEGER) AS y, CAST(h.x AS INTEGER) AS x, value
 FROM range(0, 12) AS g(y), range(0, 5) AS h(x), pixels p WHERE p.y = g.y * 8 // 12 AND p.x = h.x * 8 // 5""")
def nearest_resized(spark, sf_dir):
    return pixels.nearest_resize(T.pixels(spark, sf_dir), (8, 8), (12, 5))


@query(PIX + """ SELECT a.image_id, a.y, a.x, round(sum(b.value) / 9.0, 9) AS value FROM pixels a JOIN pixels b
 ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3""")
def box_smoothed(spark, sf_dir):
    return pixels.box_smooth(T.pixels(spark, sf_dir), 3).withColumn("value", F.round("value", 9))


@query(PIX + """, c AS (SELECT a.image_id, a.y, a.x, sum(b.value * CASE abs(a.y - b.y) + abs(a.x - b.x)
 WHEN 0 THEN -1.0 WHEN 1 THEN 0.3125 ELSE -0.0625 END) AS v FROM pixels a JOIN pixels b
 ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1
 WHERE a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 GROUP BY 1, 2, 3)
 SELECT image_id, round(sum(v * v), 6) AS loss FROM c GROUP BY 1""")
def curvature_losses(spark, sf_dir):
    return pixels.curvature_loss(T.pixels(spark, sf_dir), 8, 8).withColumn("loss", F.round("loss", 6))


@query(PIX + """, d AS (SELECT a.image_id, a.y, a.x, a.value >= 0.12 AS here,
 min((a.y-b.y)**2 + (a.x-b.x)**2) FILTER (WHERE b.value >= 0.12) AS fg,
 min((a.y-b.y)**2 + (a.x-b.x)**2) FILTER (WHERE b.value < 0.12) AS bg
 FROM pixels a JOIN pixels b ON a.image_id = b.image_id GROUP BY 1, 2, 3, 4)
 SELECT image_id, y, x, round(CASE WHEN fg IS NULL THEN 8.0 WHEN bg IS NULL THEN -8.0
 WHEN here THEN -sqrt(bg) ELSE sqrt(fg) END, 9) AS value FROM d""")
def signed_distances(spark, sf_dir):
    """Exact distance fields against brute force over all pixel pairs."""
    out = pixels.signed_distance(T.pixels(spark, sf_dir), 0.12, 8, 8)
    return out.withColumn("value", F.round("value", 9))


@query(PRI + NOMINAL + """, parts AS MATERIALIZED (SELECT image_id, y, x, sum(m) AS m, sum(f) AS f, sum(w) AS w FROM (
 SELECT image_id, y, x, value AS m, 0.0::DOUBLE AS f, (x + y) % 5 / 4.0 AS w FROM pixels
 UNION ALL SELECT image_id, y, x, 0.0::DOUBLE, value, 0.0::DOUBLE FROM nominal) GROUP BY 1, 2, 3)
 SELECT image_id, y, x, round(m * w + f * (1.0 - w), 9) AS value FROM parts""")
def blended_images(spark, sf_dir):
    """Movable pixels and fixed pixels mixed by a mask in [0, 1]."""
    p = T.pixels(spark, sf_dir)
    mask = p.withColumn("value", (F.col("x") + F.col("y")) % 5 / 4.0)
    fixed = nominal(spark, sf_dir).drop("condition")
    return pixels.blend_images(p, fixed, mask).withColumn("value", F.round("value", 9))


@query(PRI + """ SELECT DISTINCT image_id FROM printed WHERE image_id % 23 = 0""")
def image_shape_issues(spark, sf_dir):
    """Images with a condition that lacks a pixel."""
    p = T.printed(spark, sf_dir)
    hole = (F.col("image_id") % 23 == 0) & (F.col("condition") == "dose_max") & (F.col("x") == 7) & (F.col("y") == 3)
    return pixels.image_issues(p.filter(~hole))


@query(PIX + """ SELECT DISTINCT image_id, CASE WHEN image_id % 17 = 0 THEN 'no_mask' ELSE 'other_shape' END AS code FROM pixels
 WHERE image_id % 17 = 0 OR image_id % 19 = 0""")
def mask_shape_issues(spark, sf_dir):
    """Ownership masks that are missing or lack a row."""
    p = T.pixels(spark, sf_dir)
    whole = p.withColumn("value", F.lit(1.0)).filter("image_id % 17 <> 0 and (image_id % 19 <> 0 or y < 7)")
    return pixels.mask_issues(p, whole)


@query(PIX + """ SELECT image_id, y, x, coalesce(value, 0.0) AS value FROM (SELECT DISTINCT image_id,
 CAST(g.y AS INTEGER) AS y, CAST(h.x AS INTEGER) AS x FROM pixels p, range(0, 10) AS g(y), range(0, 10) AS h(x)) f
 LEFT JOIN (SELECT * FROM pixels WHERE value >= 0.0) USING (image_id, y, x)""")
def padded_canvases(spark, sf_dir):
    p = T.pixels(spark, sf_dir)
    return raster.pad_canvas(p.filter("value >= 0"), p.select("image_id").distinct(), 10)


@query(PIX + """ SELECT image_id, y, x, least(greatest(1.0 - value, 0.0), 1.0) AS value FROM pixels""")
def polarity_images(spark, sf_dir):
    """Opaque polarity: the full field without the coverage."""
    p = T.pixels(spark, sf_dir)
    return raster.transmission(p, p.withColumn("value", F.lit(1.0)), "opaque")


@query(PIX + """ SELECT 'out_of_range' AS code FROM pixels HAVING count(*) FILTER (WHERE value < 0 OR value > 1) > 0
 UNION ALL SELECT 'not_square' FROM pixels HAVING count(*) <> 64""")
def raster_metadata_issues(spark, sf_dir):
    return raster.raster_issues(T.pixels(spark, sf_dir), 8, 8, 8)


@query("""WITH r AS (SELECT user_id % 40 AS run, event_id AS iteration, CAST(floor(value) AS BIGINT) AS epe FROM events)
 SELECT run, min(epe) AS epe, arg_min(iteration, epe * 10000000 + iteration) AS iteration FROM r GROUP BY run""")
def best_rounds(spark, sf_dir):
    """Per run the round of the smallest score, the earliest among equals."""
    r = T.read(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("run"), F.col("event_id").alias("iteration"),
                                               F.floor("value").cast("long").alias("epe"))
    return metrics.best_round(r, keys=("run",))


@query("""SELECT event_id AS iteration, CASE WHEN e = 0 THEN 'zero_epe' WHEN m = 0 AND event_id < n THEN 'no_legal_update'
 ELSE 'iteration_limit' END AS reason FROM (SELECT event_id, CAST(floor(value) AS BIGINT) % 7 AS e, user_id % 3 AS m,
 (SELECT max(event_id) FROM events) AS n FROM events) ORDER BY event_id DESC LIMIT 1""")
def last_round_reason(spark, sf_dir):
    ev = T.read(spark, sf_dir, "events")
    limit = ev.agg(F.max("event_id")).first()[0]
    r = ev.select(F.col("event_id").alias("iteration"), (F.floor("value").cast("long") % 7).alias("epe"),
                  (F.col("user_id") % 3).alias("moved"))
    return metrics.stop_reason(r, limit)


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS k, count(*) OVER () AS n FROM events)
 SELECT CAST(CASE WHEN k < n // 2 THEN 0 WHEN k < n // 2 + n // 3 THEN 1 ELSE 2 END AS INTEGER) AS stage_index, count(*) AS rounds,
 CAST(sum(k - CASE WHEN k < n // 2 THEN 0 WHEN k < n // 2 + n // 3 THEN n // 2
 ELSE n // 2 + n // 3 END) AS BIGINT) AS iterations FROM r GROUP BY 1""")
def stage_positions(spark, sf_dir):
    """Stage and position in the stage of every round of a flat sequence."""
    ev = T.read(spark, sf_dir, "events")
    n = ev.count()
    r = filters.with_position(ev.select("event_id"), ["event_id"]).select(F.col("position").alias("iteration"))
    s = metrics.stage_of_round(r, [n // 2, n // 3, n - n // 2 - n // 3])
    return s.groupBy("stage_index").agg(F.count("*").alias("rounds"), F.sum("stage_iteration").alias("iterations"))


@query("""SELECT p_type AS condition FROM part GROUP BY 1 HAVING count(*) > 1""")
def repeated_condition_names(spark, sf_dir):
    return metrics.check_conditions(T.read(spark, sf_dir, "part").select(F.col("p_type").alias("condition")))
