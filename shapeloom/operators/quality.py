"""Checks on prepared tables; every check returns the offending rows."""
from pyspark.sql import DataFrame, Window as W, functions as F

from shapeloom.schemas import EDGE_KEY, SEGMENT_KEY


def parameter_issues(segments: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Segments whose t-interval is bad or does not continue its predecessor's.

    Expects 0 at the start of an edge, 1 at its end and no gap in between.
    """
    w = W.partitionBy(*EDGE_KEY).orderBy("seg_ord")
    s = segments.select(*SEGMENT_KEY, "t0", "t1", F.lag("t1").over(w).alias("before"),
                        F.lead("t0").over(w).alias("after"))
    code = (F.when((F.col("t0") < 0) | (F.col("t1") > 1) | (F.col("t1") <= F.col("t0")), "bad_interval")
            .when(F.abs(F.col("t0") - F.coalesce("before", F.lit(0.0))) > tolerance, "gap_before")
            .when(F.col("after").isNull() & (F.abs(F.col("t1") - 1) > tolerance), "open_end"))
    return s.select(*SEGMENT_KEY, code.alias("code")).filter(F.col("code").isNotNull())


def normal_issues(segments: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Segments whose normal is not finite or not of length one."""
    size = F.hypot("nx", "ny")
    return segments.filter(F.isnan(size) | (F.abs(size - 1) > tolerance)).select(*SEGMENT_KEY)


def sequence_issues(segments: DataFrame) -> DataFrame:
    """Edges whose seg_ord values are not 0, 1, ..., n-1."""
    per = segments.groupBy(*EDGE_KEY).agg(
        F.count("*").alias("rows"), F.count_distinct("seg_ord").alias("values"),
        F.min("seg_ord").alias("low"), F.max("seg_ord").alias("high"))
    return per.filter((F.col("rows") != F.col("values")) | (F.col("low") != 0) |
                      (F.col("high") != F.col("rows") - 1)).select(*EDGE_KEY)


def owner_issues(segments: DataFrame, members: DataFrame, cores: int) -> DataFrame:
    """Owners out of range, and segments not exactly once in the context of their owner."""
    own = members.filter(F.col("core_id") == F.col("owner_id")).groupBy(*SEGMENT_KEY).agg(
        F.count("*").alias("n"))
    s = segments.select(*SEGMENT_KEY, "core_id").join(own.hint("merge"), SEGMENT_KEY, "left")
    code = (F.when((F.col("core_id") < -1) | (F.col("core_id") >= cores), "owner_range")
            .when((F.col("core_id") >= 0) & (F.coalesce("n", F.lit(0)) != 1), "owner_membership"))
    return s.select(*SEGMENT_KEY, code.alias("code")).filter(F.col("code").isNotNull())


def member_issues(members: DataFrame, cores: int) -> DataFrame:
    """Memberships of tiles that do not exist."""
    return members.filter((F.col("core_id") < 0) | (F.col("core_id") >= cores))


def repeated_members(members: DataFrame) -> DataFrame:
    """A segment listed twice for one tile; ordered lists are then strictly increasing."""
    return members.groupBy("core_id", *SEGMENT_KEY).count().filter("count > 1")


def double_writes(updates: DataFrame) -> DataFrame:
    """Segments written by more than one tile in a round."""
    return updates.groupBy(*SEGMENT_KEY).count().filter("count > 1").drop("count")


def context_issues(tiles: DataFrame) -> DataFrame:
    """Tiles whose context does not contain their ownership box."""
    return tiles.filter((F.col("cl") > F.col("l")) | (F.col("cb") > F.col("b")) |
                        (F.col("cr") < F.col("r")) | (F.col("ct") < F.col("t")))


def bound_issues(tiles: DataFrame, box) -> DataFrame:
    """Borders of a tiling (side, found) that are not those of the region it should fill."""
    l, b, r, t = box
    ends = tiles.agg(F.min("l").alias("l"), F.min("b").alias("b"), F.max("r").alias("r"), F.max("t").alias("t"))
    sides = F.array(*[F.struct(F.lit(n).alias("side"), F.col(n).alias("found"), F.lit(v).cast("long").alias("wanted"))
                      for n, v in (("l", l), ("b", b), ("r", r), ("t", t))])
    return ends.select(F.explode(sides).alias("s")).select("s.*").filter(~F.col("found").eqNullSafe(F.col("wanted"))).select("side", "found")


def cut_issues(cuts: DataFrame) -> DataFrame:
    """(axis, ord, cut) rows that do not increase, and axes with fewer than two cuts."""
    w = W.partitionBy("axis").orderBy("ord")
    flat = cuts.withColumn("_p", F.lag("cut").over(w)).filter(F.col("cut") <= F.col("_p")).select(
        "axis", F.lit("not_increasing").alias("code"))
    few = cuts.groupBy("axis").count().filter("count < 2").select("axis", F.lit("too_few").alias("code"))
    return flat.unionByName(few)


def macro_issues(assigned: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tiles that are in no macro or in several."""
    seen = assigned.groupBy("core_id").agg(F.count_distinct("macro_id").alias("n"))
    both = tiles.select("core_id").join(seen.hint("merge"), "core_id", "left")
    return both.filter(F.coalesce("n", F.lit(0)) != 1).select("core_id", F.coalesce(
        "n", F.lit(0)).alias("macros"))
