"""Polygons as nested arrays of rings, their edges, checks, and ring assembly."""
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shapeloom.functions.scalars import floor_div
from shapeloom.operators.chains import contracted


def ring_area2(ring) -> Column:
    """Twice the signed area of a ring value; exact, positive when anticlockwise."""
    n = F.size(ring)

    def cross(p, i):
        q = F.get(ring, (i + 1) % n)
        return p["x"] * q["y"] - q["x"] * p["y"]

    return F.aggregate(F.transform(ring, cross), F.lit(0).cast("long"), lambda s, v: s + v)


def ring_edges(shapes: DataFrame, keep=()) -> DataFrame:
    """One row per edge, with the previous vertex and the ring's area; no shuffle.

    Needs polygon_id and rings. Adds ring_id, is_hole, ord, n (edges in the ring), x0, y0,
    x1, y1, px, py (start of the previous edge), area2 and low (lowest y of the ring).
    """
    ring = F.col("ring")

    def edge(p, i):
        n = F.size(ring)
        q, o = F.get(ring, (i + 1) % n), F.get(ring, (i + n - 1) % n)
        return F.struct(i.alias("ord"), n.alias("n"), p["x"].alias("x0"), p["y"].alias("y0"),
                        q["x"].alias("x1"), q["y"].alias("y1"),
                        o["x"].alias("px"), o["y"].alias("py"))

    rings = shapes.select(*keep, "polygon_id", F.posexplode("rings").alias("ring_id", "ring"))
    return (rings.select(*keep, "polygon_id", "ring_id", (F.col("ring_id") > 0).alias("is_hole"),
                         ring_area2(ring).alias("area2"),
                         F.array_min(F.transform(ring, lambda p: p["y"])).alias("low"),
                         F.explode(F.transform(ring, edge)).alias("e"))
            .select(*keep, "polygon_id", "ring_id", "is_hole", "area2", "low", "e.*"))


def edge_length() -> Column:
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return F.hypot(dx.cast("double"), dy.cast("double"))


def with_length(edges: DataFrame) -> DataFrame:
    """Add len; rows of length zero are for `zero_length_edges` to report."""
    return edges.withColumn("len", edge_length())


def signed_area2(edges: DataFrame, keys=("polygon_id", "ring_id")) -> DataFrame:
    """Twice the signed area per ring from edge rows."""
    return edges.groupBy(*keys).agg(F.sum(
        F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")).alias("area2"))


def outward_normal(polarity: str = "clear") -> list[Column]:
    """Unit normals from material to empty space; `opaque` turns them round."""
    if polarity not in ("clear", "opaque"):
        raise ValueError(f"unknown polarity {polarity!r}")
    left = (F.col("area2") > 0) == F.col("is_hole")
    sign = F.when(left, 1.0).otherwise(-1.0) * (1.0 if polarity == "clear" else -1.0)
    return [(-(F.col("y1") - F.col("y0")) * sign / F.col("len")).alias("nx"),
            ((F.col("x1") - F.col("x0")) * sign / F.col("len")).alias("ny")]


def assemble_polygons(edges: DataFrame, keys=("polygon_id",)) -> DataFrame:
    """Edges back to nested rings, ordered by ring and position.

    A polygon is one value, so all its points must fit a row, as they do in the input.
    """
    keys = list(keys)
    rings = edges.groupBy(*keys, "ring_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("ord", "x0", "y0"))),
        lambda p: F.struct(p["x0"].alias("x"), p["y0"].alias("y"))).alias("ring"))
    return rings.groupBy(*keys).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("ring_id", "ring"))),
        lambda r: r["ring"]).alias("rings"))


def contour_counts(shapes: DataFrame, keys=("layer",)) -> DataFrame:
    """Polygons, rings and vertices (= edges) per key from ring arrays."""
    points = F.aggregate("rings", F.lit(0).cast("long"), lambda s, r: s + F.size(r))
    return shapes.groupBy(*keys).agg(
        F.count("*").alias("polygons"),
        F.sum(F.size("rings").cast("long")).alias("rings"), F.sum(points).alias("vertices"))


# --- checks ------------------------------------------------------------------------------

def contour_issues(edges: DataFrame) -> DataFrame:
    """zero_length_edge and zero_area_ring issues per ring, with edge positions."""
    ring = edges.groupBy("polygon_id", "ring_id").agg(
        F.sort_array(F.collect_list(F.when(
            (F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1")), F.col("ord"))))
        .alias("zero"),
        F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")).alias("area2"))
    both = F.filter(F.array(
        F.when(F.size("zero") > 0, F.struct(
            F.lit("zero_length_edge").alias("code"), F.col("zero").alias("indices"))),
        F.when(F.col("area2") == 0, F.struct(
            F.lit("zero_area_ring").alias("code"), F.array("ring_id").alias("indices")))),
        lambda i: i.isNotNull())
    return (ring.select("polygon_id", "ring_id", F.explode(both).alias("i"))
            .select("polygon_id", "ring_id", "i.code", "i.indices"))


def shape_issues(shapes: DataFrame) -> DataFrame:
    """Polygons without rings and rings with fewer than three points."""
    few = F.transform(F.filter(
        F.transform("rings", lambda r, i: F.struct(i.alias("i"), F.size(r).alias("n"))),
        lambda v: v["n"] < 3), lambda v: v["i"])
    out = shapes.select("polygon_id", F.when(F.size("rings") < 1, "no_ring")
                        .when(F.size(few) > 0, "short_ring").alias("code"), few.alias("indices"))
    return out.filter(F.col("code").isNotNull())


def topology_issues(edges: DataFrame) -> DataFrame:
    """Edges whose stored successor is not the next vertex of the ring."""
    key = ["polygon_id", "ring_id", "ord"]
    after = edges.select("polygon_id", "ring_id",
                         F.pmod(F.col("ord") - 1, F.col("n")).alias("ord"),
                         F.col("x0").alias("qx"), F.col("y0").alias("qy"))
    wrong = (F.col("qx").isNull() | (F.col("qx") != F.col("x1")) | (F.col("qy") != F.col("y1")))
    return edges.join(after.hint("merge"), key, "left").filter(wrong).select(*key)


# --- ring assembly --------------------------------------------------------------------------

def assemble_rings(edges: DataFrame, keys=("layer",), block: int = 8192) -> DataFrame:
    """Add ring (a BIGINT), ord and n to directed edges.

    Edges are joined to chains inside blocks of the plane first (`chains`), where most rings close. What
    is left are chains that cross a block's border, one row each. On these, pointer doubling: after k
    steps each knows the smallest edge among its next 2**k chains and how many edges away it is. A chain that
    holds the smallest edge of its window and meets itself again names a complete ring, whose chains then leave
    the loop. Steps number the logarithm of the blocks that the longest ring crosses.

    Rings are numbered by the order of their smallest edges and start there, so numbers depend on the geometry alone.
    """
    keys = list(keys)
    found = written(contracted(edges, keys, block), "chains").withColumns(
        {"nx": -F.signum((F.col("y1") - F.col("y0")).cast("double")) + 0.0, "ny": F.signum((F.col("x1") - F.col("x0")).cast("double"))})
    head, least, last = (["hx0", "hy0", "hx1", "hy1"], ["lx0", "ly0", "lx1", "ly1"], ["tx0", "ty0", "tx1", "ty1"])
    chains = found.filter("n is null and len is not null").select(*keys, *head, *least, *last, "px", "py", "len", "low").withColumn(
        "id", F.monotonically_increasing_id()).checkpoint()
    ringed = _closed_chains(chains, keys, head, least, last)
    base = [*keys, "x0", "y0", "x1", "y1", "px", "py", "nx", "ny"]
    local = found.filter("n is not null").select(*base, *[F.col(h).alias(c) for h, c in zip(head, least)], F.col("pos").alias("ord"), "n")
    far = found.filter("n is null").drop("n", "low", *least).join(ringed.hint("merge"), [*keys, *head]).select(
        *base, *least, F.pmod(F.col("pos") - F.col("dist"), F.col("n")).alias("ord"), "n")
    whole = local.unionByName(far)
    from shapeloom.operators.filters import with_position
    numbers = with_position(whole.filter("ord = 0").select(*keys, *least), [*keys, *least])
    return whole.join(numbers.withColumnRenamed("position", "ring").hint("merge"), [*keys, *least]).select(*base, "ring", "ord", "n")


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the checkpoint folder and read back: columns of a file take less disk than a checkpoint's rows,
    and later steps read those they need."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _closed_chains(chains: DataFrame, keys, head, least, last) -> DataFrame:
    """(keys, head, least edge of the ring, dist to it, n) of chains that form rings; the others are left out."""
    # The edge before a chain ends where its first edge starts.
    before = ["px", "py", *head[:2]]
    nexts = chains.select(*keys, *[F.col(h).alias(a) for h, a in zip(before, last)], F.col("id").alias("jump"))
    state = chains.select(*keys, *last, "id", "len", "low", F.struct(*least).alias("edge")).join(nexts.hint("merge"), [*keys, *last]).select(
        "id", "jump", "edge", F.col("id").alias("of"), F.col("low").alias("dist"), F.col("len").alias("span"), F.lit(None).cast("long").alias("n"))
    done = []
    while True:
        for _ in range(3):
            state = _double(state)
        state = state.checkpoint()
        rings = state.filter("n is not null").select(F.col("id").alias("ring"), F.col("n").alias("size"))
        named = state.join(rings.hint("merge"), state["of"] == rings["ring"], "left").checkpoint()
        done.append(named.filter("ring is not null").select("id", "edge", "dist", F.col("size").alias("n")))
        left = named.filter("ring is null").drop("ring", "size")
        if left.isEmpty():
            break
        state = left
    known = reduce(DataFrame.unionByName, done)
    return chains.select(*keys, *head, "id").join(known.hint("merge"), "id").select(
        *keys, *head, *[F.col("edge")[c].alias(c) for c in least], "dist", "n")


def unclosed(edges: DataFrame, keys=("layer",)) -> DataFrame:
    """Vertices at which not as many edges end as begin, as issues: such edges form no ring, and
    `assemble_rings` leaves out those whose chain ends there."""
    keys = list(keys)
    ends = edges.select(*keys, F.explode(F.array(
        F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), F.lit(1).alias("s")),
        F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(-1).alias("s")))).alias("e")).select(*keys, "e.*")
    return (ends.groupBy(*keys, "x", "y").agg(F.sum("s").alias("surplus")).filter("surplus <> 0")
            .select(F.lit("unclosed_ring").alias("code"), *keys, "x", "y", "surplus"))


def _double(state: DataFrame) -> DataFrame:
    """One doubling step; n is set on the chain with a ring's smallest edge when it meets itself."""
    far = state.select(F.col("id").alias("jump"), F.col("jump").alias("_j"), F.col("edge").alias("_e"),
                       F.col("of").alias("_o"), F.col("dist").alias("_d"), F.col("span").alias("_s"))
    less = F.col("_e") < F.col("edge")
    closed = (F.col("of") == F.col("id")) & (F.col("_o") == F.col("id"))
    return state.join(far.hint("merge"), "jump").select(
        "id", F.col("_j").alias("jump"), F.least("_e", "edge").alias("edge"), F.when(less, F.col("_o")).otherwise(F.col("of")).alias("of"),
        F.when(less, F.col("_d") + F.col("span")).otherwise(F.col("dist")).alias("dist"), (F.col("span") + F.col("_s")).alias("span"),
        F.coalesce("n", F.when(closed, F.col("span") + F.col("_d") - F.col("dist"))).alias("n"))


def ring_summary(ringed: DataFrame, keys=("layer",)) -> DataFrame:
    """Per ring: area2 (negative for hulls), bounding box, size and an anchor vertex."""
    return ringed.groupBy(*keys, "ring").agg(
        F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")).alias("area2"),
        F.min("x0").alias("l"), F.min("y0").alias("b"), F.max("x0").alias("r"),
        F.max("y0").alias("t"), F.count("*").alias("n"),
        F.min(F.struct("x0", "y0")).alias("anchor"))


def enclosing_hulls(ringed: DataFrame, keys=("layer",), column: int = 128) -> DataFrame:
    """For every hole ring the hull around it (keys, hole, hull).

    A ray runs down from the material left of each hole's leftmost edge to the first edge below. That is an edge of
    the hull, or of another hole of the same polygon further to the left, whose own ray is followed then.
    Rays and the horizontal edges they may meet are brought together along their x, and the last edge below is
    a running value; no hole is paired with a hull.
    """
    keys = list(keys)
    rings = ring_summary(ringed, keys)
    rays = rings.filter("area2 > 0").select(
        *keys, F.col("ring").alias("hole"), F.col("anchor.x0").alias("x"), F.col("anchor.y0").alias("y"))
    strip = floor_div(F.col("x") - 1, column)
    # The x of rays in a strip are at most `column` numbers.
    xs = rays.groupBy(*keys, strip.alias("s")).agg(F.collect_set("x").alias("xs"))
    flat = ringed.filter("y0 = y1").select(*keys, "ring", F.least("x0", "x1").alias("xa"), F.greatest("x0", "x1").alias("xb"), F.col("y0").alias("y"))
    flat = flat.withColumn("s", F.explode(F.sequence(floor_div("xa", column), floor_div(F.col("xb") - 1, column)))).join(xs.hint("merge"), [*keys, "s"])
    met = F.filter("xs", lambda x: (x > F.col("xa")) & (x <= F.col("xb")))
    below = flat.select(*keys, F.explode(met).alias("x"), "y", "ring", F.lit(None).cast("long").alias("hole"))
    both = below.unionByName(rays.select(*keys, "x", "y", F.lit(None).cast("long").alias("ring"), "hole"))
    # Edges come before rays that start at their height.
    w = W.partitionBy(*keys, "x").orderBy("y", F.col("hole").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    met = both.withColumn("met", F.last("ring", ignorenulls=True).over(w)).filter("hole is not null and met is not null")
    up = met.select(*keys, "hole", F.col("met").alias("hull")).checkpoint()
    while True:  # as many steps as the logarithm of the longest row of holes
        over = up.select(*keys, F.col("hole").alias("hull"), F.col("hull").alias("_h"))
        again = up.join(over.hint("merge"), [*keys, "hull"], "left")
        if again.filter("_h is not null").isEmpty():
            return up
        up = again.select(*keys, "hole", F.coalesce("_h", "hull").alias("hull")).checkpoint()


def polygons(ringed: DataFrame, keys=("layer",)) -> DataFrame:
    """Ringed edges with `polygon` (the hull's ring) and is_hole."""
    keys = list(keys)
    hulls = enclosing_hulls(ringed, keys).select(*keys, F.col("hole").alias("ring"), "hull")
    return (ringed.join(hulls.hint("merge"), [*keys, "ring"], "left")
            .withColumn("is_hole", F.col("hull").isNotNull())
            .withColumn("polygon", F.coalesce("hull", "ring")).drop("hull"))


def drop_repeated_points(points: DataFrame, ring=("polygon_id", "ring_id"), order=("ord",)):
    """Drop points equal to their predecessor and a last point equal to the first."""
    w = W.partitionBy(*ring).orderBy(*order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    here = F.struct("x", "y")
    marked = points.select(
        "*", F.lag(here).over(w).alias("_p"), F.lead(here).over(w).isNull().alias("_last"),
        F.first(here).over(whole).alias("_f"))
    same = here.eqNullSafe(F.col("_p"))
    closing = F.col("_last") & (here == F.col("_f")) & F.col("_p").isNotNull()
    return marked.filter(~same & ~closing).drop("_p", "_last", "_f")
