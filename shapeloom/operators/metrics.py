"""Image scores: binary mismatch, process band, edge probes, shots, continuous losses."""
from pyspark.sql import DataFrame, Window as W, functions as F

from shapeloom.functions.scalars import pin

IMAGE = ("image_id",)


def _both(first, second, keys):
    """Values a and c of two images per pixel of either; a pixel that one of them lacks is 0 there.

    One shuffle: both sides go into one aggregate per pixel.
    """
    on = [*keys, "y", "x"]
    tagged = first.select(*on, F.col("value").alias("a"), F.lit(None).cast("double").alias("c")).unionByName(
        second.select(*on, F.lit(None).cast("double").alias("a"), F.col("value").alias("c")))
    return tagged.groupBy(*on).agg(*[F.coalesce(F.max(v), F.lit(0.0)).alias(v) for v in ("a", "c")])


def binary_mismatch(target: DataFrame, nominal: DataFrame, threshold: float = 0.5, keys=IMAGE,
                    by=IMAGE) -> DataFrame:
    """Pixels printed differently from the target. Pass owned pixels to count each once."""
    differs = (F.col("a") >= threshold) != (F.col("c") >= threshold)
    return _both(target, nominal, keys).groupBy(*by).agg(F.count_if(differs).alias("l2"))


def process_band(printed: DataFrame, high: str, low: str, threshold: float = 0.5, keys=IMAGE,
                 by=IMAGE) -> DataFrame:
    """Pixels on which two conditions disagree after the threshold; one aggregate per pixel."""
    on = F.col("value") >= threshold
    both = printed.filter(F.col("condition").isin(high, low)).groupBy(*keys, "y", "x").agg(
        *[F.coalesce(F.max(F.when(F.col("condition") == c, on)), F.lit(0.0 >= threshold)).alias(n)
          for c, n in ((high, "h"), (low, "w"))])
    return both.groupBy(*by).agg(F.count_if(F.col("h") != F.col("w")).alias("pvband"))


def probe_values(probes: DataFrame, target: DataFrame, nominal: DataFrame, keys=IMAGE) -> DataFrame:
    """Look up target and nominal at the rounded inner and outer point of each probe.

    Both points go through one equi-join: a probe becomes two lookups and is put together
    again by its id. Points outside an image find nothing.
    """
    both = _both(target, nominal, keys)
    side = F.explode(F.array(
        *[F.struct(F.lit(s).alias("side"), F.rint(f"{s}_y").cast("int").alias("y"),
                   F.rint(f"{s}_x").cast("int").alias("x")) for s in ("inner", "outer")]))
    look = probes.select("probe_id", *keys, side.alias("p")).select("probe_id", *keys, "p.*")
    hit = look.join(both.hint("merge"), [*keys, "y", "x"], "left")

    def pick(c, s):
        return F.max(F.when(F.col("side") == s, F.col(c)))

    return hit.groupBy("probe_id", *keys).agg(
        pick("a", "inner").alias("target_inner"), pick("a", "outer").alias("target_outer"),
        pick("c", "inner").alias("printed_inner"), pick("c", "outer").alias("printed_outer"),
        (F.count_distinct("y", "x") > 1).alias("distinct"))


def edge_probes(probes: DataFrame, target: DataFrame, nominal: DataFrame,
                threshold: float = 0.499, keys=IMAGE) -> DataFrame:
    """Per probe: valid, inner/outer violation, ambiguous, and the direction to move in."""
    v = probe_values(probes, target, nominal, keys)
    known = F.col("target_inner").isNotNull() & F.col("target_outer").isNotNull()
    valid = (known & F.col("distinct") & (F.col("target_inner") >= threshold) &
             (F.col("target_outer") < threshold))
    v = v.withColumn("valid", F.coalesce(valid, F.lit(False)))
    v = v.withColumn("inner_violation", F.col("valid") & (F.col("printed_inner") < threshold))
    v = v.withColumn("outer_violation", F.col("valid") & (F.col("printed_outer") >= threshold))
    no = F.lit(False)
    v = v.withColumn("inner_violation", F.coalesce("inner_violation", no)).withColumn(
        "outer_violation", F.coalesce("outer_violation", no))
    i, o = F.col("inner_violation"), F.col("outer_violation")
    return v.select("probe_id", *keys, "valid", "inner_violation", "outer_violation",
                    (i & o).alias("ambiguous"),
                    F.when(i & ~o, 1).when(o & ~i, -1).otherwise(0).alias("direction"))


def _rows(pixels: DataFrame, keys) -> DataFrame:
    """One row per row of an image: its pixels (x, value) in order, from x0 to x1."""
    on = [*keys, "y"]
    one = pixels.select(*on, "x", "value").repartition(*on).groupBy(*on, "x").agg(F.max("value").alias("value"))
    return one.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("x", "value"))).alias("px"), F.min("x").alias("x0"), F.max("x").alias("x1"))


def _looked_up(probes: DataFrame, rows: DataFrame, keys, side: str) -> DataFrame:
    """Add `at`, the value at the rounded inner or outer point; null where the image has no pixel."""
    x = F.rint(f"{side}_x").cast("int")
    hit = probes.withColumn("y", F.rint(f"{side}_y").cast("int")).join(rows.hint("merge"), [*keys, "y"], "left")
    whole = F.get("px", x - F.col("x0"))["value"]
    some = F.get(F.filter("px", lambda p: p["x"] == x), F.lit(0))["value"]
    at = F.when(F.size("px") == F.col("x1") - F.col("x0") + 1, whole).otherwise(some)
    return hit.select(*[hit[c] for c in probes.columns], at.alias("at"))


def valid_probes(probes: DataFrame, target: DataFrame, threshold: float = 0.499, keys=IMAGE) -> DataFrame:
    """Probes that `edge_probes` calls valid; these depend on the target alone.

    A probe stays one row, which meets a row of pixels for each of its points; what the inner point rules out has no outer one looked up.
    """
    rows = _rows(target, keys)
    # Pinned as whole pixels, so that filters do not compute the points again.
    found = pin(probes, **{c: F.rint(c).cast("int") for c in ("inner_y", "inner_x", "outer_y", "outer_x")})
    found = found.filter("inner_y <> outer_y or inner_x <> outer_x")
    for side, hit in (("inner", F.col("at") >= threshold), ("outer", F.col("at") < threshold)):
        found = _looked_up(found, rows, keys, side).filter(hit).drop("at")
    return found


def valid_scores(valid: DataFrame, nominal: DataFrame, threshold: float = 0.499, keys=IMAGE) -> DataFrame:
    """What `edge_probes` gives for the probes of `valid_probes`, whose pixels the target has; pixels that are not printed are 0."""
    rows = _rows(nominal, keys)
    value = F.coalesce("at", F.lit(0.0))
    v = _looked_up(valid, rows, keys, "inner").withColumn("inner_violation", value < threshold).drop("at")
    v = _looked_up(v, rows, keys, "outer").withColumn("outer_violation", value >= threshold)
    i, o = F.col("inner_violation"), F.col("outer_violation")
    return v.select("probe_id", *keys, F.lit(True).alias("valid"), i, o, (i & o).alias("ambiguous"),
                    F.when(i & ~o, 1).when(o & ~i, -1).otherwise(0).alias("direction"))


def probe_totals(scored: DataFrame, by=()) -> DataFrame:
    aggs = [F.count_if(F.col("inner_violation") | F.col("outer_violation")).alias("epe"),
            F.count_if("valid").alias("valid"), F.count_if("ambiguous").alias("ambiguous")]
    return scored.groupBy(*by).agg(*aggs) if by else scored.agg(*aggs)


def pixel_runs(pixels: DataFrame, threshold: float = 0.5, keys=IMAGE) -> DataFrame:
    """Maximal horizontal runs of foreground: (y, x0, x1), ends included.

    A run starts where the left neighbour is not foreground; only rows of one image row
    are ordered together.
    """
    w = W.partitionBy(*keys, "y").orderBy("x")
    on = pixels.filter(F.col("value") >= threshold).select(
        *keys, "y", "x", (F.col("x") - F.row_number().over(w)).alias("island"))
    return on.groupBy(*keys, "y", "island").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1")).drop("island")


def shot_count(pixels: DataFrame, threshold: float = 0.5, keys=IMAGE) -> DataFrame:
    """Rectangles needed when a run continues only an identical run of the row below."""
    runs = pixel_runs(pixels, threshold, keys)
    below = runs.withColumn("y", F.col("y") + 1)
    fresh = runs.join(below.hint("merge"), [*keys, "y", "x0", "x1"], "left_anti")
    return fresh.groupBy(*keys).agg(F.count("*").alias("shots"))


def _with_target(per, target, on):
    """Per-pixel aggregates with the target value t; pixels that either side lacks are 0 there."""
    both = per.join(target.select(*on, F.col("value").alias("t")), on, "full_outer")
    return both.fillna(0.0, [c for c in both.columns if c not in on and c != "n"]).fillna(0, ["n"] if "n" in both.columns else [])


def loss_terms(target: DataFrame, printed: DataFrame, nominal: str, weights=(1.0, 1.0),
               keys=IMAGE) -> DataFrame:
    """Nominal and process squared errors, squared process spread, and the weighted total.

    All conditions of a pixel meet in one aggregate; without process conditions their
    terms are 0.
    """
    on = [*keys, "y", "x"]
    is_nominal = F.col("condition") == nominal
    other = F.when(~is_nominal, F.col("value"))
    per = printed.groupBy(*on).agg(
        F.max(F.when(is_nominal, F.col("value"))).alias("v"), F.sum(other * other).alias("q"),
        F.sum(other).alias("s"), F.count(other).alias("n"),
        (F.max(other) - F.min(other)).alias("spread"))
    both = _with_target(per, target, on)
    error = (F.col("v") - F.col("t")) * (F.col("v") - F.col("t"))
    # sum (p - t)^2 over conditions, from the sums over p.
    zero = F.lit(0.0)
    process = (F.coalesce("q", zero) - 2 * F.col("t") * F.coalesce("s", zero)
               + F.col("n") * F.col("t") * F.col("t"))
    out = both.groupBy(*keys).agg(
        F.sum(error).alias("nominal_l2"), F.sum(process).alias("process_l2"),
        F.coalesce(F.sum(F.col("spread") * F.col("spread")), zero).alias("pvband"))
    return out.withColumn("total", F.col("nominal_l2") + weights[0] * F.col("process_l2")
                          + weights[1] * F.col("pvband"))


def soft_probe_loss(samples: DataFrame, threshold: float, segments: int) -> DataFrame:
    """Sum of squared shortfalls of valid probes over twice the number of segments.

    `samples` has inner, outer (sampled values) and valid.
    """
    def pos(c):
        d = F.greatest(c, F.lit(0.0))
        return d * d
    term = pos(threshold - F.col("inner")) + pos(F.col("outer") - threshold)
    return samples.agg((F.coalesce(F.sum(F.when(F.col("valid"), term)), F.lit(0.0))
                        / F.lit(float(2 * max(segments, 1)))).alias("loss"))


def best_round(rounds: DataFrame, score: str = "epe", keys=()) -> DataFrame:
    """The round of the smallest score, the earliest among equals; with keys, of each."""
    return rounds.groupBy(*keys).agg(F.min(F.struct(score, "iteration")).alias("m")).select(*keys, "m.*")


def stop_reason(rounds: DataFrame, limit: int) -> DataFrame:
    """Why the sequence ended, from its last row."""
    last = rounds.agg(F.max_by(F.struct(*rounds.columns), "iteration").alias("m")).select("m.*")
    return last.select("iteration", F.when(F.col("epe") == 0, "zero_epe")
                       .when((F.col("iteration") < limit) & (F.col("moved") == 0), "no_legal_update")
                       .otherwise("iteration_limit").alias("reason"))


def stage_of_round(rounds: DataFrame, stages) -> DataFrame:
    """Add stage_index and stage_iteration from the caller's list of stage lengths."""
    ends, total = [], 0
    for n in stages:
        total += n
        ends.append(total)
    it = F.col("iteration")
    stage = F.lit(None).cast("int")
    for i in reversed(range(len(ends))):
        stage = F.when(it < ends[i], F.lit(i)).otherwise(stage)
    starts = F.array(*[F.lit(v) for v in [0, *ends[:-1]]])
    return rounds.withColumn("stage_index", stage).withColumn(
        "stage_iteration", it - F.get(starts, F.col("stage_index")))


def check_conditions(conditions: DataFrame, keys=()) -> DataFrame:
    """Names used more than once (with keys: for one key)."""
    return conditions.groupBy(*keys, "condition").count().filter("count > 1").select("condition").distinct()


def owned_loss(target: DataFrame, printed: DataFrame, high: str, low: str, nominal: str,
               keys=IMAGE) -> DataFrame:
    """Mean squared nominal error and mean squared high-low difference over the pixels given."""
    on = [*keys, "y", "x"]

    def pick(c):
        return F.max(F.when(F.col("condition") == c, F.col("value")))

    per = printed.groupBy(*on).agg(pick(nominal).alias("v"), pick(high).alias("h"), pick(low).alias("w"))
    both = _with_target(per, target, on)

    def sq(d):
        return F.sum(d * d)

    return both.agg((sq(F.col("v") - F.col("t")) / F.count("*")).alias("l2"),
                    (sq(F.col("h") - F.col("w")) / F.count("*")).alias("pvband"))
