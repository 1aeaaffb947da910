"""Explicit schemas of the layout tables (nothing is ever inferred)."""
from pyspark.sql import types as T

L, I, D, S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()


def _struct(**fields):
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


POINT = _struct(x=L, y=L)
RING = T.ArrayType(POINT)
RINGS = T.ArrayType(RING)
BOX = _struct(l=L, b=L, r=L, t=L)

BOXES = _struct(layer=I, datatype=I, shape_id=L, l=L, b=L, r=L, t=L, kind=S,
                props=T.MapType(I, S))
SHAPES = _struct(layer=I, datatype=I, shape_id=L, rings=RINGS, props=T.MapType(I, S))
EDGES = _struct(polygon_id=L, ring_id=I, is_hole=T.BooleanType(), ord=I,
                x0=L, y0=L, x1=L, y1=L)
PIXELS = _struct(image_id=L, y=I, x=I, value=D)
CELLS = _struct(cell=S)
CELL_SHAPES = _struct(cell=S, layer=I, datatype=I, shape_id=L, kind=S, l=L, b=L, r=L, t=L)
# With true outlines (hull first, then holes; null: the box itself) and properties.
CELL_POLYGONS = T.StructType([*CELL_SHAPES.fields, T.StructField("rings", RINGS), T.StructField("props", T.MapType(I, S))])
CELL_INSTANCES = _struct(parent=S, child=S, dx=L, dy=L, rot=I, mirror=I,
                         ax=L, ay=L, bx=L, by=L, na=I, nb=I)
ISSUES = _struct(code=S, message=S, layer=I, datatype=I, indices=T.ArrayType(I))
ROUNDS = _struct(iteration=I, step=D, epe=L, l2=L, pvband=L, valid=L, ambiguous=L,
                 moved=L, rejected=L)

# One segment is one row; these four columns identify it.
SEGMENT_KEY = ["polygon_id", "ring_id", "ord", "seg_ord"]
EDGE_KEY = ["polygon_id", "ring_id", "ord"]
