"""Merkle manifest of a dataset: one tree per group, a tree over their roots, a proof per row.

A leaf is the hash of a row's fields, each `-` if null, else byte count, `:` and value. In every group the
leaves ascend by an id; while a level has several nodes, each run of `ARITY` becomes one node. The groups' roots,
in order of the group, are the leaves of the top tree. All hashes are lowercase hex SHA-256.

Built levels are stored as node rows that name their parent and hold the hashes left and right of
them in their run. `climb` ascends these links in a recursive query: each step appends the siblings
and folds the leaves' hashes into the parent's. Leaves of one run have the same way up, so a row of
the recursion is a run: it carries one string of siblings and the folded hash of each of its leaves.

Places come from a range shuffle of small rows and counts per partition and group, so a group that
holds most rows spans many tasks; texts are hashed where they are read and never shuffled.

Defined cases: null ids and groups come first; rows that repeat an id are ordered by their hashes;
an empty text is `0:`; texts may be of any length; an empty table gives empty results; a group of one row has
its leaf as root, one group alone has its root as the root of all; other columns are ignored.
"""
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.column import Column

from .common import saved

ARITY = 16
TOP = -1  # number of the top tree


@dataclass
class Manifest:
    runs: DataFrame      # tree, run, level, hash, members: array of (place, id, leaf, now)
    links: DataFrame     # tree, level, place -> up_tree, up_level, up_place, left, right
    subroots: DataFrame  # tree, subroot
    levels: int          # of both trees together
    root: tuple | None   # tree, level, place, hash of the root


def field(value: Column) -> Column:
    """A value as hashed: `-` if null, else its length in bytes, a colon and itself."""
    v = value.cast("string")
    return F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def placed(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df with the `place` of each row in its group by the order, the group's size `n`, and `tree`, a
    number that ascends with the group."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in [group, *order]]
    rows = saved(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("seq", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("part", F.shiftright("seq", 33))
    # One row per partition and group in it: at most partitions + groups rows.
    counts = rows.groupBy("part", F.col(group).alias("g")).agg(F.count("*").alias("c"), F.min("seq").alias("first"))
    all_ = Window.partitionBy("g")
    before = all_.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("part").alias("p"), "g", "first", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"),
                           F.sum("c").over(all_).alias("n"), F.min("first").over(all_).alias("tree"))
    counts = saved(counts, name + "-counts")
    return (rows.join(counts, (F.col("part") == F.col("p")) & F.col(group).eqNullSafe(F.col("g")))
            .withColumn("place", F.col("before") + F.col("seq") - F.col("first")).drop("part", "p", "g", "first", "before", "seq"))


def _children(rows: DataFrame, *more: str) -> DataFrame:
    """Runs of `rows` (tree, place, n, hash): their members in order and the hash over them."""
    member = F.struct("place", "hash", *more)
    runs = rows.groupBy("tree", "n", F.floor(F.col("place") / ARITY).alias("run")).agg(F.sort_array(F.collect_list(member)).alias("members"))
    joined = F.array_join(F.transform("members", lambda m: m["hash"]), "")
    return runs.withColumn("up", F.sha2(joined, 256))


def _levels(nodes: DataFrame, level: int, size: int, name: str):
    """Levels above `nodes` (tree, place, n, hash) of a level, until each tree has one node: links and roots."""
    links, roots = [], [nodes.filter("n = 1").select("tree", F.lit(level).alias("level"), "hash")]
    while size > 1:
        runs = saved(_children(nodes.filter("n > 1")), f"{name}-{level + 1}")
        hashes = F.transform("members", lambda m: m["hash"])
        each = runs.select("tree", "run", F.posexplode("members").alias("k", "m"), hashes.alias("hashes"))
        links.append(each.select(
            "tree", F.lit(level).alias("level"), F.col("m.place").alias("place"), F.col("tree").alias("up_tree"),
            F.lit(level + 1).alias("up_level"), F.col("run").alias("up_place"),
            F.array_join(F.slice("hashes", F.lit(1), F.col("k")), "").alias("left"),
            F.array_join(F.slice("hashes", F.col("k") + 2, F.lit(ARITY)), "").alias("right")))
        level, size = level + 1, -(-size // ARITY)
        nodes = runs.select("tree", F.col("run").alias("place"), F.ceil(F.col("n") / ARITY).alias("n"), F.col("up").alias("hash"))
        roots.append(nodes.filter("n = 1").select("tree", F.lit(level).alias("level"), "hash"))
    return links, roots, level


def _joined(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def build(leaves: DataFrame) -> Manifest:
    """The levels of rows (id, group, leaf, now); `now` is the hash to be checked, null where it is the leaf."""
    rows = placed(leaves, "group", ["id", "leaf", "now"], "leaves")
    first = _children(rows.select("tree", "place", "n", "id", F.col("leaf").alias("hash"), "now"), "id", "now")
    runs = saved(first.select("tree", "n", "run", F.when(F.col("n") == 1, 0).otherwise(1).alias("level"),
                              F.when(F.col("n") == 1, F.col("members")[0]["hash"]).otherwise(F.col("up")).alias("hash"), "members"), "runs")
    largest = runs.agg(F.max("n").alias("n")).first()["n"] or 0
    # A group of one row is its own root on level 0; the others have a node per run on level 1.
    nodes = runs.filter("level = 1").select("tree", F.col("run").alias("place"), F.ceil(F.col("n") / ARITY).alias("n"), "hash")
    links, roots, height = _levels(nodes, 1, -(-largest // ARITY), "level")
    alone = runs.filter("level = 0").select("tree", F.lit(0).alias("level"), "hash")
    tops = saved(_joined([alone, *roots]).withColumn("all", F.lit(TOP)), "subroots")
    subroots = tops.select("tree", F.col("hash").alias("subroot"))
    if not largest:
        return Manifest(runs, runs.select("tree").limit(0), subroots, 0, None)
    above = placed(tops.withColumnRenamed("tree", "below"), "all", ["below"], "top").withColumn("tree", F.lit(TOP).cast("long"))
    above = saved(above, "top-leaves")
    many = above.count()
    if many == 1:
        only = tops.first()
        root, top = (only["tree"], only["level"], 0, only["hash"]), []
    else:
        top, ends, level = _levels(above.select("tree", "place", "n", "hash"), 0, many, "top")
        root = (TOP, level, 0, _joined(ends).first()["hash"])
        # The leaves of the top tree are the roots below it, so links start from these.
        start = top[0].select(F.col("place").alias("at"), "up_tree", "up_level", "up_place", "left", "right")
        top[0] = above.select(F.col("below").alias("tree"), "level", F.lit(0).cast("long").alias("place"), F.col("place").alias("at")).join(
            start, "at").drop("at")
        height += level
    links = [*links, *top]
    links = links or [runs.sparkSession.createDataFrame([], LINK)]  # every leaf is a root
    return Manifest(runs, saved(_joined(links), "links"), subroots, height, root)


LINK = "tree long, level int, place long, up_tree long, up_level int, up_place long, left string, right string"


@contextmanager
def unlimited_recursion(spark: SparkSession):
    """A recursive query may give as many rows as it has; by default Spark stops it at a million."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


ASCENT = """
WITH RECURSIVE ascent (base, run, tree, level, place, siblings, folded) MAX RECURSION LEVEL {most} AS (
  SELECT tree, run, tree, level, run, CAST('' AS STRING), folded FROM {starts}
  UNION ALL
  SELECT a.base, a.run, l.up_tree, l.up_level, l.up_place, concat(a.siblings, l.left, l.right),
         transform(a.folded, h -> sha2(concat(l.left, h, l.right), 256))
  FROM ascent a JOIN {links} l ON a.tree = l.tree AND a.level = l.level AND a.place = l.place)
SELECT base, run, siblings, folded FROM ascent WHERE tree = {tree} AND level = {level} AND place = {place}
"""


def climb(manifest: Manifest) -> DataFrame:
    """id, leaf, subroot, root, siblings (hashes one after the other, from the leaf's run to the root) and
    folded_root, the root as it follows from each row's `now`."""
    runs, spark = manifest.runs, manifest.runs.sparkSession
    if manifest.root is None:
        return spark.createDataFrame([], "id long, leaf string, subroot string, root string, siblings string, folded_root string")
    hashes = F.transform("members", lambda m: m["hash"])
    now = F.transform("members", lambda m: F.coalesce(m["now"], m["hash"]))
    without = lambda k: F.array_join(F.filter(hashes, lambda h, i: i != k), "")
    fold = F.transform(now, lambda h, k: F.sha2(F.concat(
        F.array_join(F.slice(hashes, F.lit(1), k), ""), h, F.array_join(F.slice(hashes, k + 2, F.lit(ARITY)), "")), 256))
    starts = runs.select("tree", "run", "level", F.when(F.col("n") == 1, now).otherwise(fold).alias("folded"))
    tree, level, place, root = manifest.root
    with unlimited_recursion(spark):
        ways = saved(spark.sql(ASCENT, starts=starts, links=manifest.links, most=manifest.levels + 2, tree=tree, level=level, place=place),
                     "ways")
    ways = ways.select("base", F.col("run").alias("r"), F.col("siblings").alias("above"), "folded")
    rows = runs.join(ways, (F.col("tree") == F.col("base")) & (F.col("run") == F.col("r"))).join(manifest.subroots, "tree")
    own = F.transform(F.sequence(F.lit(0), F.size("members") - 1), lambda k: F.struct(
        F.col("members")[k]["id"].alias("id"), F.col("members")[k]["hash"].alias("leaf"),
        without(k).alias("beside"), F.col("folded")[k].alias("folded_root")))
    each = rows.select("subroot", "above", F.explode(own).alias("m"))
    return each.select("m.id", "m.leaf", "subroot", F.lit(root).alias("root"), F.concat("m.beside", "above").alias("siblings"), "m.folded_root")
