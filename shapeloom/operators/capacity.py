"""Admission control: what a preparation would produce, before it is expanded."""
from pyspark.sql import Column, DataFrame, functions as F

from shapeloom.operators import tiling
from shapeloom.operators.contours import with_length
from shapeloom.operators.segments import fragment_count

# Fixed values of the size model: bytes per item of each kind, and the 32-bit id limit.
PREPARE_BYTES = {"file": 8, "shape": 256, "vertex": 256, "segment": 128, "membership": 32}
SOLVER_BYTES = {"file": 2, "shape": 128, "vertex": 128, "segment": 128, "membership": 8}
INT32_MAX = 2147483647


def peak_bytes(model: dict, file_bytes: int, shapes, vertices, segments, memberships) -> Column:
    return (F.lit(file_bytes * model["file"]) + shapes * model["shape"] + vertices * model["vertex"]
            + segments * model["segment"] + memberships * model["membership"])


def preflight(edges: DataFrame, grid: tiling.Grid, corner: float, maximum: float, budget: int,
              file_bytes: int = 0) -> DataFrame:
    """One row of exact counts, an upper bound of memberships, byte estimates and a verdict.

    A single aggregate over ring_edges rows. Each edge contributes its pieces times the
    tiles its whole extent may touch.
    """
    if budget <= 0:
        raise ValueError("budget must be positive")
    e = with_length(edges).withColumn("pieces", F.when(
        F.col("len") > 0, fragment_count("len", corner, maximum)).otherwise(0).cast("long"))
    box = [F.least("x0", "x1"), F.least("y0", "y1"), F.greatest("x0", "x1"), F.greatest("y0", "y1")]
    e = e.select("*", *tiling.halo_span(grid, *box))
    span = (F.greatest(F.col("ix1") - F.col("ix0") + 1, F.lit(0)) *
            F.greatest(F.col("iy1") - F.col("iy0") + 1, F.lit(0)))
    first = (F.col("ring_id") == 0) & (F.col("ord") == 0)
    total = e.agg(F.count_if(first).alias("shapes"), F.count("*").alias("vertices"),
                  F.coalesce(F.sum("pieces"), F.lit(0)).alias("segments"),
                  F.coalesce(F.sum(F.col("pieces") * span), F.lit(0)).alias("memberships"))
    args = [F.col(c) for c in ("shapes", "vertices", "segments", "memberships")]
    total = total.select("*", peak_bytes(PREPARE_BYTES, file_bytes, *args).alias("prepare_bytes"),
                         peak_bytes(SOLVER_BYTES, file_bytes, *args).alias("solver_bytes"))
    return verdict(total, budget)


def verdict(total: DataFrame, budget: int) -> DataFrame:
    """Add accepted and reason, judged by bytes; ids are 64-bit, and whether 32 bits would do is told
    beside. Also used on the real counts after preparing."""
    small = (F.col("segments") <= INT32_MAX) & (F.col("memberships") <= INT32_MAX)
    memory_ok = F.greatest("prepare_bytes", "solver_bytes") <= budget
    return total.select("*", memory_ok.alias("accepted"),
                        F.when(~memory_ok, "too_many_bytes").otherwise("ok").alias("reason"),
                        F.lit(budget // 32).cast("long").alias("membership_limit"), small.alias("fits_32_bit_ids"))
