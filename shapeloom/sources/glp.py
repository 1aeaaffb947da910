"""GLP text layouts: a corpus of files becomes shape rows and issue rows in one job.

A file is one record of the corpus. Its statements are numbered, so that every rule about
order ("after ENDMSG", "before EQUIV") compares positions: the first statement of a kind
per file is found by a window over the file, and the current CELL by a running one.
"""
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from shapeloom.functions.scalars import pin, trailing_layer
from shapeloom.operators.region import shuffle_partitions

INTEGER = r"^[+-]?[0-9]+(_[0-9]+)*$"
KNOWN = ("BEGIN", "EQUIV", "CNAME", "LEVEL", "CELL", "RECT", "PGON", "ENDMSG")


def read_text(spark: SparkSession, paths) -> DataFrame:
    """(file, text), one row per file."""
    return spark.read.text(paths, wholetext=True).select(
        F.input_file_name().alias("file"), F.col("value").alias("text"))


def statements(corpus: DataFrame) -> DataFrame:
    """Non-empty lines without comments: file, line (1-based), fields, keyword."""
    bare = F.regexp_replace("text", r"(?s)/\*.*?\*/", "")
    lines = corpus.select("file", F.posexplode(F.split(bare, r"\r\n|\n|\r")).alias("i", "raw"))
    fields = F.split(F.trim(F.regexp_replace("raw", r"\s+", " ")), " ")
    return (lines.filter(F.trim(F.regexp_replace("raw", r"\s+", " ")) != "")
            .select("file", (F.col("i") + 1).alias("line"), fields.alias("f"))
            .transform(pin, f=F.col("f")).withColumn("kw", F.upper(F.col("f")[0])))


def _field(i) -> Column:
    return F.get("f", F.lit(i))


def _integers(start: int) -> Column:
    """Trailing fields as BIGINT, or null when one of them is not an integer."""
    rest = F.slice("f", start + 1, F.greatest(F.size("f") - start, F.lit(0)))
    whole = F.forall(rest, lambda v: v.rlike(INTEGER))
    return F.when(whole, F.transform(rest, lambda v: F.replace(
        v, F.lit("_"), F.lit("")).try_cast("long")))


def _polygon_area2() -> Column:
    n = F.size("v") / 2
    pts = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.struct(
        F.get("v", i * 2).alias("x"), F.get("v", i * 2 + 1).alias("y")))
    from shapeloom.operators.contours import ring_area2
    return F.abs(F.when(F.size("v") >= 6, ring_area2(pts)))


def parse(corpus: DataFrame, layer_map: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """All statements with parsed values, resolved layer, current cell, and reason.

    `reason` is null for accepted statements. Statements after the first rejected one of a
    file are judged as if that one had been fine, so one run lists every fault.
    """
    # Dealt by file once, as texts; all that follows stays inside the file and needs no further shuffle. Texts
    # become many rows, so these tasks must not be merged by size.
    s = statements(corpus.repartition(shuffle_partitions(corpus), "file"))
    spec = F.lit(None).cast("struct<layer:int,datatype:int>")
    for name, (layer, datatype) in (layer_map or {}).items():
        spec = F.when(_field(2) == name, F.struct(
            F.lit(layer).alias("layer"), F.lit(datatype).alias("datatype"))).otherwise(spec)
    shape = F.col("kw").isin("RECT", "PGON")
    auto = F.when(trailing_layer(_field(2)).isNotNull(), F.struct(
        trailing_layer(_field(2)).alias("layer"), F.lit(0).alias("datatype")))
    # Pinned: the windows and rules below use these several times.
    s = pin(s, spec=F.when(shape, F.coalesce(spec, auto)), v=F.when(shape, _integers(3)).when(
        F.col("kw") == "EQUIV", F.transform(F.slice("f", 2, 2), lambda v: F.when(v.rlike(INTEGER), v.try_cast("long")))),
        lv=F.when(shape, _field(2)).when(F.col("kw") == "LEVEL", _field(1)), cn=F.when(F.col("kw") == "CELL", _field(1)))

    def first(condition, *within):
        return F.min(F.when(condition, F.col("line"))).over(W.partitionBy("file", *within))

    n = F.size("f")
    equiv_ok = ((F.col("kw") == "EQUIV") & n.isin(4, 5) & (F.upper(_field(3)) == "MICRON") &
                ((n == 4) | (F.upper(_field(4)) == "+X,+Y")) &
                (F.get("v", F.lit(0)) > 0) & (F.get("v", F.lit(1)) > 0))
    cell_ok = (F.col("kw") == "CELL") & ((n == 2) | ((n == 3) & (F.upper(_field(2)) == "PRIME")))
    level_ok = (F.col("kw") == "LEVEL") & (n == 2)
    end_ok = (F.col("kw") == "ENDMSG") & (n == 1)
    s = pin(s, area2=F.when(F.col("kw") == "PGON", _polygon_area2()), equiv_ok=equiv_ok, cell_ok=cell_ok, level_ok=level_ok, end_ok=end_ok)
    equiv_ok, cell_ok, level_ok, end_ok = (F.col(c) for c in ("equiv_ok", "cell_ok", "level_ok", "end_ok"))
    used = F.when(F.col("spec").isNotNull(), F.col("line"))
    # First statements of the file, first mention of each LEVEL and CELL name, first use of each target layer.
    s = s.withColumns({"start_at": first(F.lit(True)), "equiv_at": first(equiv_ok), "cell_at": first(cell_ok), "end_at": first(end_ok)})
    s = s.withColumn("level_at", first(level_ok, "lv")).withColumn("cell_named_at", first(cell_ok, "cn"))
    s = s.withColumn("spec_owner", F.min_by(_field(2), used).over(W.partitionBy("file", "spec")))
    minimum = F.when(F.col("kw") == "RECT", 7).otherwise(9)
    nv = F.size("v")
    rect = F.col("kw") == "RECT"
    reason = (
        F.when(F.col("end_at") < F.col("line"), "after_endmsg")
        .when(~F.col("kw").isin(*KNOWN), "unknown_statement")
        .when(F.col("kw") == "BEGIN", F.when(n != 1, "bad_begin"))
        .when(F.col("kw") == "EQUIV", F.when(
            (F.col("equiv_at") < F.col("line")) | ~F.coalesce(equiv_ok, F.lit(False)), "bad_equiv"))
        .when(F.col("kw") == "CNAME", F.when(n != 2, "bad_cname"))
        .when(F.col("kw") == "LEVEL", F.when(n != 2, "bad_level")
              .when(F.col("level_at") < F.col("line"), "duplicate_level"))
        .when(F.col("kw") == "CELL", F.when(~F.coalesce(cell_ok, F.lit(False)), "bad_cell")
              .when(F.col("cell_named_at") < F.col("line"), "duplicate_cell"))
        .when(F.col("kw") == "ENDMSG", F.when(n != 1, "bad_endmsg"))
        .when(F.col("equiv_at").isNull() | (F.col("equiv_at") > F.col("line")) |
              F.col("cell_at").isNull() | (F.col("cell_at") > F.col("line")), "shape_too_early")
        .when((n < minimum) | (F.upper(_field(1)) != "N"), "bad_shape")
        .when(F.col("level_at").isNull() | (F.col("level_at") > F.col("line")), "undeclared_level")
        .when(F.col("spec").isNull(), "unmapped_level")
        .when(F.col("spec_owner") != F.col("lv"), "shared_layer")
        .when(F.col("v").isNull() | F.exists("v", lambda x: x.isNull()), "not_integer")
        .when(rect & ((nv != 4) | (F.get("v", F.lit(2)) <= 0) | (F.get("v", F.lit(3)) <= 0)),
              "bad_rect_size")
        .when(~rect & ((nv < 6) | (nv % 2 != 0)), "bad_coordinates")
        .when(~rect & (F.col("area2") == 0), "zero_area"))
    s = s.withColumn("reason", reason).drop("equiv_ok", "cell_ok", "level_ok", "end_ok")
    return s.withColumn("cell", F.last("cn", ignorenulls=True).over(
        W.partitionBy("file").orderBy("line")))


def shapes(parsed: DataFrame) -> DataFrame:
    """Accepted shapes: file, cell, layer, datatype, line, kind, rings."""
    v = F.col("v")
    x, y, w, h = (F.get(v, F.lit(i)) for i in range(4))

    def pt(a, b):
        return F.struct(a.alias("x"), b.alias("y"))

    rect = F.array(pt(x, y), pt(x, y + h), pt(x + w, y + h), pt(x + w, y))
    poly = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1),
                       lambda i: pt(F.get(v, i * 2), F.get(v, i * 2 + 1)))
    ring = F.when(F.col("kw") == "RECT", rect).otherwise(poly)
    return parsed.filter(F.col("kw").isin("RECT", "PGON") & F.col("reason").isNull()).select(
        "file", "cell", "spec.layer", "spec.datatype", "line",
        F.when(F.col("kw") == "RECT", "box").otherwise("polygon").alias("kind"),
        F.array(ring).alias("rings"))


def units(parsed: DataFrame) -> DataFrame:
    """Database unit in micrometres per file."""
    return parsed.filter((F.col("kw") == "EQUIV") & F.col("reason").isNull()).select(
        "file", (F.get("v", F.lit(0)) / F.get("v", F.lit(1))).alias("dbu_um"))


def issues(parsed: DataFrame) -> DataFrame:
    """Rejected statements, and per file (line null) what is missing altogether."""
    start = F.col("line") == F.col("start_at")

    def issue(condition, line, code):
        return F.when(condition, F.struct(line.cast("int").alias("line"), code.alias("code")))

    # What a file lacks is told with its first statement.
    found = F.array_compact(F.array(issue(F.col("reason").isNotNull(), F.col("line"), F.col("reason")), *[
        issue(start & F.col(at).isNull(), F.lit(None), F.lit(code)) for at, code in (
            ("equiv_at", "missing_equiv"), ("cell_at", "missing_cell"), ("end_at", "missing_endmsg"))]))
    return parsed.select("file", F.explode(found).alias("i")).select("file", "i.line", "i.code")


def shape_text(boxes: DataFrame) -> DataFrame:
    """RECT lines for a text sink, one per box."""
    return boxes.select(F.concat_ws(
        " ", F.lit("RECT N"), F.concat(F.lit("L"), F.col("layer")), "l", "b",
        F.col("r") - F.col("l"), F.col("t") - F.col("b")).alias("value"))
