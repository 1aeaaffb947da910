"""Scalar expressions on boxes, points, parameters and pixel values.

Every function takes and returns Columns, so that the work stays inside generated code.
"""
from pyspark.sql import Column, functions as F


def col(c):
    return F.col(c) if isinstance(c, str) else c


def floor_div(value, n) -> Column:
    """Integer division rounding towards minus infinity."""
    value = col(value)
    n = F.lit(n) if isinstance(n, int) else n
    return F.call_function("div", value - F.pmod(value, n), n)


def ceil_div(value, n) -> Column:
    return -floor_div(-col(value), n)


# --- boxes ---------------------------------------------------------------------------

def box_width() -> Column:
    return F.col("r") - F.col("l")


def box_height() -> Column:
    return F.col("t") - F.col("b")


def box_area() -> Column:
    return box_width() * box_height()


def box_expand(margin: int) -> list[Column]:
    if margin < 0:
        raise ValueError("margin must not be negative")
    return [(F.col("l") - margin).alias("l"), (F.col("b") - margin).alias("b"),
            (F.col("r") + margin).alias("r"), (F.col("t") + margin).alias("t")]


def box_intersection(first, second) -> Column:
    """Struct (l, b, r, t) shared by two boxes, or null when they only touch.

    Each box is a 4-tuple of Columns or integers.
    """
    a = [F.lit(v) if isinstance(v, int) else v for v in first]
    c = [F.lit(v) if isinstance(v, int) else v for v in second]
    left, bottom = F.greatest(a[0], c[0]), F.greatest(a[1], c[1])
    right, top = F.least(a[2], c[2]), F.least(a[3], c[3])
    return F.when((left < right) & (bottom < top),
                  F.struct(left.alias("l"), bottom.alias("b"), right.alias("r"), top.alias("t")))


# --- exact unit conversion -------------------------------------------------------------

def nm_to_dbu(value_nm, dbu_um: float, *, allow_zero: bool = False) -> Column:
    """Whole database units, or null when the length is not exactly representable."""
    raw = col(value_nm) / F.lit(dbu_um * 1000.0)
    whole = F.rint(raw)
    lower = whole >= 0 if allow_zero else whole > 0
    finite = ~F.isnan(raw) & (F.abs(raw) < F.lit(9.0e15))
    return F.when(finite & lower & (F.abs(raw - whole) <= 1e-9), whole.cast("long"))


def segment_parameters(corner_nm, maximum_nm, displacement_nm, dbu_um: float) -> Column:
    """Struct of exact corner/max lengths and a possibly fractional displacement limit."""
    corner = nm_to_dbu(corner_nm, dbu_um)
    maximum = nm_to_dbu(maximum_nm, dbu_um)
    shift = col(displacement_nm) / F.lit(dbu_um * 1000.0)
    ok = corner.isNotNull() & maximum.isNotNull() & (shift >= 0)
    return F.when(ok, F.struct(corner.alias("corner"), maximum.alias("maximum"),
                               shift.alias("displacement")))


# --- text parameters ---------------------------------------------------------------------

def parse_layer(text) -> Column:
    """`L`, `L/D` or `L:D` as struct(layer, datatype); null when malformed."""
    parts = F.split(F.translate(F.trim(col(text)), ":", "/"), "/")
    layer = parts[0].try_cast("int")
    datatype = F.when(F.size(parts) == 1, F.lit(0)).otherwise(
        F.get(parts, F.lit(1)).try_cast("int"))
    return F.when((F.size(parts) <= 2) & (layer >= 0) & (datatype >= 0),
                  F.struct(layer.alias("layer"), datatype.alias("datatype")))


def parse_layer_map(text) -> Column:
    """`NAME=L/D` as struct(name, layer, datatype); null when malformed."""
    parts = F.split(col(text), "=", 2)
    spec = parse_layer(F.get(parts, F.lit(1)))
    name = F.trim(parts[0])
    return F.when((F.size(parts) == 2) & (F.length(name) > 0) & spec.isNotNull(),
                  F.struct(name.alias("name"), spec["layer"].alias("layer"),
                           spec["datatype"].alias("datatype")))


def trailing_layer(name) -> Column:
    """The full run of digits at the end of a symbolic layer name, or null."""
    digits = F.regexp_extract(col(name), r"(\d+)$", 1)
    return F.when(digits != "", digits.try_cast("int"))


# --- pixels --------------------------------------------------------------------------------

def pixel_index(position, origin, pixel) -> Column:
    """Nearest pixel centre, ties to the even index."""
    return F.rint((col(position) - origin) / pixel - 0.5).cast("int")


def quantise(value) -> Column:
    """Coverage in [0, 1] as 0..255, half to even."""
    return F.rint(F.least(F.greatest(col(value), F.lit(0.0)), F.lit(1.0)) * 255.0).cast("int")


def soft_step(value, steepness: float, offset: float = 0.0) -> Column:
    return 1.0 / (1.0 + F.exp(-steepness * (col(value) - offset)))


def blend(movable, fixed, weight) -> Column:
    """`movable*weight + fixed*(1-weight)`; null when the weight is outside [0, 1]."""
    w = col(weight)
    return F.when((w >= 0) & (w <= 1), col(movable) * w + col(fixed) * (1.0 - w))


def step_size(iteration, initial: float, decay_every: int) -> Column:
    """Step of a round; halves after every `decay_every` rounds."""
    return F.lit(initial) * F.pow(F.lit(0.5), floor_div(iteration, decay_every))


def clip_displacement(value, limit: float) -> Column:
    return F.greatest(F.least(col(value), F.lit(float(limit))), F.lit(-float(limit)))


# --- placement ------------------------------------------------------------------------------

def transform_x(x, y, rot, mirror, dx) -> Column:
    """x after an optional flip about the x axis, a quarter-turn rotation and a shift."""
    x, y, rot = col(x), col(y), col(rot)
    y = F.when(col(mirror) == 1, -y).otherwise(y)
    turned = F.when(rot == 0, x).when(rot == 1, -y).when(rot == 2, -x).otherwise(y)
    return turned + col(dx)


def transform_y(x, y, rot, mirror, dy) -> Column:
    x, y, rot = col(x), col(y), col(rot)
    y = F.when(col(mirror) == 1, -y).otherwise(y)
    turned = F.when(rot == 0, y).when(rot == 1, x).when(rot == 2, -y).otherwise(-x)
    return turned + col(dy)


def path_boxes(points, width: int) -> Column:
    """One box per leg of a Manhattan centre line; ends are cut square at the points.

    Inner corners are filled by lengthening each leg by half the width at shared points. Null
    where the result would be off the grid: for an odd width, or with a slanted leg (`path_issue`).
    """
    points = col(points)
    half = width // 2
    last = F.size(points) - 1

    def leg(i):
        p, q = F.get(points, i - 1), F.get(points, i)
        head = F.when(i > 1, half).otherwise(0)
        tail = F.when(i < last, half).otherwise(0)
        flat = p["y"] == q["y"]
        forward = F.when(flat, q["x"] >= p["x"]).otherwise(q["y"] >= p["y"])
        low = F.when(forward, head).otherwise(tail)
        high = F.when(forward, tail).otherwise(head)
        along = F.when(flat, F.least(p["x"], q["x"])).otherwise(F.least(p["y"], q["y"])) - low
        until = F.when(flat, F.greatest(p["x"], q["x"])).otherwise(
            F.greatest(p["y"], q["y"])) + high
        across = F.when(flat, p["y"]).otherwise(p["x"])
        return F.struct(
            F.when(flat, along).otherwise(across - half).alias("l"),
            F.when(flat, across - half).otherwise(along).alias("b"),
            F.when(flat, until).otherwise(across + half).alias("r"),
            F.when(flat, across + half).otherwise(until).alias("t"))

    return F.when(path_issue(points, width).isNull() & (last > 0), F.transform(F.sequence(F.lit(1), last), leg))


def path_issue(points, width: int) -> Column:
    """Why a path has no exact Manhattan outline; null if it has one."""
    points = col(points)
    legs = F.zip_with(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), points, lambda q, p: F.struct(p.alias("p"), q.alias("q")))
    slanted = F.exists(legs, lambda g: (g["q"]["x"] != g["p"]["x"]) & (g["q"]["y"] != g["p"]["y"]))
    return F.when(F.lit(width % 2 != 0), "odd_path_width").when(slanted, "slanted_path_leg")


def pin(df, **columns):
    """Add columns through a one-row generator, so that later filters stop there.

    The optimizer rewrites a filter on a computed column in terms of its inputs and moves
    it down; on a chain of computed columns that repeats the whole chain many times over.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.explode(F.array(row)).alias("_row")).select(*others, "_row.*")
