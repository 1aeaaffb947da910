"""Set algebra on slanted polygons of the driver tables."""
from pyspark.sql import functions as F

from catalog import tables as T
from catalog.region_queries import sweep_sql
from catalog.registry import query
from shapeloom.operators import planar


def area2_sql(test):
    return "WITH " + sweep_sql(T.DIAMONDS, test) + """ SELECT layer,
 CAST(sum((r - l) * (t - b)) AS BIGINT) AS area2 FROM covered GROUP BY layer"""


def _pair(spark, sf_dir):
    d = T.diamonds(spark, sf_dir)
    return [planar.material_edges(d.filter(F.col("side") == k)) for k in (0, 1)]


@query(area2_sql("ca > 0 OR cb > 0"))
def slanted_union_area(spark, sf_dir):
    return planar.area2(planar.union(planar.material_edges(T.diamonds(spark, sf_dir))))


@query(area2_sql("ca > 0 AND cb > 0"))
def slanted_intersection_area(spark, sf_dir):
    return planar.area2(planar.intersection(*_pair(spark, sf_dir)))


@query(area2_sql("ca > 0 AND cb = 0"))
def slanted_difference_area(spark, sf_dir):
    return planar.area2(planar.difference(*_pair(spark, sf_dir)))


@query(area2_sql("(ca > 0) <> (cb > 0)"))
def slanted_symmetric_difference_area(spark, sf_dir):
    return planar.area2(planar.symmetric_difference(*_pair(spark, sf_dir)))
