"""Cell hierarchies and text layouts derived from the driver tables."""
from pyspark.sql import functions as F

from catalog import tables as T
from catalog.region_queries import area_sql
from catalog.registry import query
from shapeloom.operators import filters, hierarchy, region
from shapeloom.sources import glp

# TOP -> regions -> nations -> suppliers; every third nation places its suppliers as 2 x 3 arrays.


def _place(df, parent, child, key, array=None):
    key = F.col(key).cast("long")
    twice = F.lit(False) if array is None else F.col(array) % 3 == 0
    return df.select(
        parent.alias("parent"), child.alias("child"), (key * 1000).alias("dx"), (key * 700).alias("dy"),
        (key % 4).cast("int").alias("rot"), (key % 2).cast("int").alias("mirror"),
        F.lit(200).cast("long").alias("ax"), F.lit(0).cast("long").alias("ay"),
        F.lit(0).cast("long").alias("bx"), F.lit(150).cast("long").alias("by"),
        F.when(twice, 2).otherwise(1).alias("na"), F.when(twice, 3).otherwise(1).alias("nb"))


def instances(spark, sf_dir):
    r, n, s = (T.read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    top = _place(r, F.lit("TOP"), F.col("r_name"), "r_regionkey")
    mid = _place(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")), F.col("r_name"), F.col("n_name"), "n_nationkey")
    low = _place(s.join(n, F.col("s_nationkey") == F.col("n_nationkey")), F.col("n_name"), F.col("s_name"),
                 "s_suppkey", "n_nationkey")
    return top.unionByName(mid).unionByName(low)


def cells(spark, sf_dir):
    names = [T.read(spark, sf_dir, t).select(F.col(c).alias("cell")) for t, c in (
        ("region", "r_name"), ("nation", "n_name"), ("supplier", "s_name"))]
    return spark.range(1).select(F.lit("TOP").alias("cell")).union(names[0]).union(names[1]).union(names[2])


def cell_shapes(spark, sf_dir):
    s = T.read(spark, sf_dir, "supplier")

    def box(df, name, layer, kind, l, b, r, t):
        return df.select(F.col(name).alias("cell"), layer.cast("int").alias("layer"), F.lit(0).alias("datatype"),
                         F.lit(kind).alias("kind"), *[F.lit(v).cast("long").alias(c) for c, v in zip("lbrt", (l, b, r, t))])
    leaf = box(s, "s_name", F.col("s_suppkey") % 2, "box", 0, 0, 100, 50)
    text = box(s.filter("s_suppkey % 5 = 0"), "s_name", F.lit(0), "text", 10, 20, 10, 20)
    own = box(T.read(spark, sf_dir, "nation"), "n_name", F.lit(2), "polygon", -100, -50, 100, 50)
    return leaf.unionByName(text).unionByName(own)


INST = """inst0 AS (
 SELECT 'TOP' AS parent, r_name AS child, r_regionkey AS k, FALSE AS arr FROM region
 UNION ALL SELECT r_name, n_name, n_nationkey, FALSE FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT n_name, s_name, s_suppkey, n_nationkey % 3 = 0 FROM supplier JOIN nation ON s_nationkey = n_nationkey),
inst AS (SELECT parent, child, k * 1000 + i * 200 AS dx, k * 700 + j * 150 AS dy, k % 4 AS rot, k % 2 AS mirror
 FROM inst0, range(0, 2) AS g(i), range(0, 3) AS h(j) WHERE arr OR (i = 0 AND j = 0)),
shapes AS (SELECT s_name AS cell, s_suppkey % 2 AS layer, 'box' AS kind, 0 AS l, 0 AS b, 100 AS r, 50 AS t FROM supplier
 UNION ALL SELECT s_name, 0, 'text', 10, 20, 10, 20 FROM supplier WHERE s_suppkey % 5 = 0
 UNION ALL SELECT n_name, 2, 'polygon', -100, -50, 100, 50 FROM nation)"""

FLAT = "WITH RECURSIVE " + INST + """, placed AS (
 SELECT 'TOP' AS cell, CAST(0 AS BIGINT) AS dx, CAST(0 AS BIGINT) AS dy, CAST(0 AS BIGINT) AS rot, CAST(0 AS BIGINT) AS mirror
 UNION ALL SELECT i.child,
 CASE p.rot WHEN 0 THEN i.dx WHEN 1 THEN -my WHEN 2 THEN -i.dx ELSE my END + p.dx,
 CASE p.rot WHEN 0 THEN my WHEN 1 THEN i.dx WHEN 2 THEN -my ELSE -i.dx END + p.dy,
 (p.rot + CASE WHEN p.mirror = 1 THEN 4 - i.rot ELSE i.rot END) % 4, xor(CAST(p.mirror AS BIGINT), CAST(i.mirror AS BIGINT))
 FROM (SELECT q.cell, q.dx, q.dy, q.rot, q.mirror, j.child, j.dx AS idx, j.dy AS idy,
  CASE WHEN q.mirror = 1 THEN -j.dy ELSE j.dy END AS my, j.rot AS irot, j.mirror AS imirror
  FROM placed q JOIN inst j ON j.parent = q.cell) p,
 LATERAL (SELECT p.child AS child, p.idx AS dx, p.irot AS rot, p.imirror AS mirror) i),
corner AS (SELECT s.cell, layer, kind, dx, dy, rot, l, r, CASE WHEN mirror = 1 THEN -t ELSE b END AS b,
 CASE WHEN mirror = 1 THEN -b ELSE t END AS t FROM shapes s JOIN placed p ON s.cell = p.cell),
flat AS (SELECT cell, CAST(layer AS INTEGER) AS layer, kind,
 CASE rot WHEN 0 THEN l WHEN 1 THEN -t WHEN 2 THEN -r ELSE b END + dx AS l,
 CASE rot WHEN 0 THEN b WHEN 1 THEN l WHEN 2 THEN -t ELSE -r END + dy AS b,
 CASE rot WHEN 0 THEN r WHEN 1 THEN -b WHEN 2 THEN -l ELSE t END + dx AS r,
 CASE rot WHEN 0 THEN t WHEN 1 THEN r WHEN 2 THEN -b ELSE -l END + dy AS t FROM corner)"""


@query("WITH " + INST + """ SELECT cell, list_sort(list_distinct(coalesce(list(child) FILTER (WHERE child IS NOT NULL), []))) AS children
 FROM (SELECT 'TOP' AS cell UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation
 UNION ALL SELECT s_name FROM supplier) c LEFT JOIN inst ON parent = cell GROUP BY cell""")
def cell_children(spark, sf_dir):
    return hierarchy.children(cells(spark, sf_dir), instances(spark, sf_dir))


@query("WITH " + INST + """ SELECT cell FROM (SELECT 'TOP' AS cell UNION ALL SELECT r_name FROM region UNION ALL
 SELECT n_name FROM nation UNION ALL SELECT s_name FROM supplier) WHERE cell NOT IN (SELECT child FROM inst)""")
def top_cells(spark, sf_dir):
    return hierarchy.top_cells(cells(spark, sf_dir), instances(spark, sf_dir))


@query(FLAT + " SELECT cell, layer, kind, l, b, r, t FROM flat")
def flattened_layout(spark, sf_dir):
    flat = hierarchy.flatten(cell_shapes(spark, sf_dir), instances(spark, sf_dir), "TOP")
    return flat.select("cell", "layer", "kind", "l", "b", "r", "t")


@query(FLAT + """ SELECT cell, layer, kind, l, b, r, t FROM flat
 WHERE l <= 30000 AND r >= -20000 AND b <= 20000 AND t >= 0""")
def flattened_region(spark, sf_dir):
    """Only placements whose extent meets the region are expanded."""
    box = (-20000, 0, 30000, 20000)
    flat = hierarchy.flatten(cell_shapes(spark, sf_dir), instances(spark, sf_dir), "TOP", box)
    return flat.select("cell", "layer", "kind", "l", "b", "r", "t")


@query(FLAT + """ SELECT layer, count(*) FILTER (WHERE kind IN ('box','path','polygon')) AS polygon_like,
 count(*) FILTER (WHERE kind = 'text') AS text, CAST(0 AS BIGINT) AS edge, CAST(0 AS BIGINT) AS other FROM flat GROUP BY layer""")
def flattened_kind_counts(spark, sf_dir):
    return filters.shape_stats(hierarchy.flatten(cell_shapes(spark, sf_dir), instances(spark, sf_dir), "TOP"))


@query(FLAT + """ SELECT 'TOP' AS cell, CAST(min(l) AS BIGINT) AS l, CAST(min(b) AS BIGINT) AS b,
 CAST(max(r) AS BIGINT) AS r, CAST(max(t) AS BIGINT) AS t FROM flat""")
def hierarchical_bounding_box(spark, sf_dir):
    """Extents are built from the leaves upwards, without flattening."""
    return hierarchy.cell_extents(cell_shapes(spark, sf_dir), instances(spark, sf_dir)).filter("cell = 'TOP'")


# --- text layouts ----------------------------------------------------------------------------------

def corpus(spark, sf_dir):
    """One text per customer and block of 1024 orders, with faults by order number."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    x, y = (key * 37).cast("string"), F.pmod(cust * 1511, F.lit(8192)).cast("string")
    w, h = (cust % 50 * 8 + 40).cast("string"), (key % 50 * 8 + 40).cast("string")
    rect = F.concat_ws(" ", F.when(key % 83 == 0, "RECT P").otherwise("rect  N"),
                       F.when(key % 79 == 0, "M9").otherwise("M1"),
                       F.when(key % 89 == 0, F.lit("12.5")).otherwise(x), y, F.when(key % 97 == 0, "0").otherwise(w), h)
    tri = F.concat_ws(" ", F.lit("PGON N M2"), x, y, (key * 37 + 60).cast("string"), y, x,
                      F.when(key % 67 == 0, y).otherwise((F.pmod(cust * 1511, F.lit(8192)) + 80).cast("string")))
    line = (F.when(key % 73 == 0, F.concat_ws(" ", F.lit("PATH N M1"), x, y)).when(key % 5 == 0, tri).otherwise(rect))
    line = F.when(key % 7 == 0, F.concat(line, F.lit(" /* a note\n over two lines */"))).otherwise(line)
    per = T.read(spark, sf_dir, "orders").groupBy("o_custkey", T.floor_div("o_orderkey", 1024).alias("blk")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, line.alias("s")))), lambda v: v["s"]), "\n")
        .alias("body"))
    head = F.concat(F.lit("BEGIN\n"), F.when(cust % 43 == 0, "").otherwise("EQUIV 1 1000 MICRON +X,+Y"),
                    F.lit("\nCNAME demo\nLEVEL M1\nLEVEL M2\nCELL C"), cust.cast("string"), F.lit(" PRIME\n"))
    tail = F.when(cust % 41 == 0, "").otherwise("\nENDMSG\n")
    return per.select(F.concat_ws("_", "o_custkey", "blk").alias("file"), F.concat(head, F.col("body"), tail).alias("text"))


GLP = """WITH o AS (SELECT *, o_custkey || '_' || (o_orderkey // 1024) AS file, (o_custkey * 1511) % 8192 AS y,
 CAST(6 + row_number() OVER (PARTITION BY o_custkey, o_orderkey // 1024 ORDER BY o_orderkey) AS INTEGER) AS line FROM orders),
j AS (SELECT *, CASE WHEN o_orderkey % 73 = 0 THEN 'unknown_statement' WHEN o_custkey % 43 = 0 THEN 'shape_too_early'
 WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 67 = 0 THEN 'zero_area' END
 WHEN o_orderkey % 83 = 0 THEN 'bad_shape' WHEN o_orderkey % 79 = 0 THEN 'undeclared_level'
 WHEN o_orderkey % 89 = 0 THEN 'not_integer' WHEN o_orderkey % 97 = 0 THEN 'bad_rect_size' END AS code FROM o)"""


@query(GLP + """ SELECT file, 'C' || o_custkey AS cell, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 7 END AS INTEGER) AS layer,
 CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 2 END AS INTEGER) AS datatype, line,
 CASE WHEN o_orderkey % 5 = 0 THEN 'polygon' ELSE 'box' END AS kind,
 CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 4 END AS points, o_orderkey * 37 AS x0, y AS y0,
 CAST(CASE WHEN o_orderkey % 5 = 0 THEN 60 * 80 ELSE 2 * (o_custkey % 50 * 8 + 40) * (o_orderkey % 50 * 8 + 40) END AS BIGINT) AS area2
 FROM j WHERE code IS NULL""")
def text_layout_shapes(spark, sf_dir):
    from shapeloom.operators.contours import ring_area2
    parsed = glp.parse(corpus(spark, sf_dir), {"M1": (7, 2)})
    ring = F.col("rings")[0]
    return glp.shapes(parsed).select(
        "file", "cell", "layer", "datatype", "line", "kind", F.size(ring).alias("points"),
        ring[0]["x"].alias("x0"), ring[0]["y"].alias("y0"), F.abs(ring_area2(ring)).alias("area2"))


@query(GLP + """ SELECT file, line, code FROM j WHERE code IS NOT NULL
 UNION ALL SELECT DISTINCT file, NULL, 'missing_equiv' FROM j WHERE o_custkey % 43 = 0
 UNION ALL SELECT DISTINCT file, NULL, 'missing_endmsg' FROM j WHERE o_custkey % 41 = 0""")
def text_layout_issues(spark, sf_dir):
    return glp.issues(glp.parse(corpus(spark, sf_dir), {"M1": (7, 2)}))


@query(GLP + """ SELECT DISTINCT file, CAST(0.001 AS DOUBLE) AS dbu_um FROM o WHERE o_custkey % 43 <> 0""")
def text_layout_units(spark, sf_dir):
    return glp.units(glp.parse(corpus(spark, sf_dir), {"M1": (7, 2)}))


@query("WITH " + T.SOLID + """ SELECT 'RECT N L' || layer || ' ' || l || ' ' || b || ' ' || (r - l) || ' ' || (t - b) AS value FROM solid""")
def text_layout_lines(spark, sf_dir):
    return glp.shape_text(T.solid(spark, sf_dir))


# --- true outlines --------------------------------------------------------------------------------

def cell_polygons(spark, sf_dir):
    """The cell shapes; the polygons of the nations have a hole, and all shapes a property."""
    hull, hole = T.ring_of(*[F.lit(v).cast("long") for v in (-100, -50, 100, 50)], False), T.ring_of(
        *[F.lit(v).cast("long") for v in (-50, -20, 50, 20)], True)
    return cell_shapes(spark, sf_dir).withColumn("rings", F.when(F.col("kind") == "polygon", F.array(hull, hole))).withColumn(
        "props", F.create_map(F.lit(1), F.col("cell")))


# In SQL the ring is four boxes.
PIECES = FLAT.replace("UNION ALL SELECT n_name, 2, 'polygon', -100, -50, 100, 50 FROM nation", "".join(
    f" UNION ALL SELECT n_name, 2, 'polygon', {v} FROM nation" for v in (
        "-100, -50, -50, 50", "50, -50, 100, 50", "-50, -50, 50, -20", "-50, 20, 50, 50")))
WINDOW = (-3000, -3000, 6000, 5000)


@query(area_sql(PIECES.replace("WITH RECURSIVE ", "", 1) + ", sides AS (SELECT layer, 0 AS side, l, b, r, t FROM flat WHERE kind <> 'text')",
                "ca > 0").replace("WITH ", "WITH RECURSIVE ", 1).replace("l // 512", "CAST(floor(l / 512.0) AS BIGINT)").replace(
    "(r - 1) // 512 + 1", "CAST(floor((r - 1) / 512.0) AS BIGINT) + 1"))
def flattened_merged_area(spark, sf_dir):
    """Area per layer of all placed shapes, holes left out."""
    flat = hierarchy.flatten(cell_polygons(spark, sf_dir), instances(spark, sf_dir), "TOP").filter("kind <> 'text'")
    return region.area(region.union(filters.shape_boxes(flat, ("layer",))))


@query(PIECES + """ SELECT cell, CAST(sum((least(r, 6000) - greatest(l, -3000)) * (least(t, 5000) - greatest(b, -3000))) AS BIGINT) AS area,
 cell AS property FROM flat WHERE kind <> 'text' AND l < 6000 AND r > -3000 AND b < 5000 AND t > -3000 GROUP BY cell""")
def clipped_polygons(spark, sf_dir):
    """Placed shapes cut to a region along their outlines; their properties stay."""
    flat = hierarchy.flatten(cell_polygons(spark, sf_dir), instances(spark, sf_dir), "TOP", WINDOW)
    cut = filters.clip_polygons(filters.candidates(flat, WINDOW), WINDOW)
    return cut.groupBy("cell", F.col("props")[1].alias("property")).agg(
        F.sum((F.col("r") - F.col("l")) * (F.col("t") - F.col("b"))).alias("area")).select("cell", "area", "property")
