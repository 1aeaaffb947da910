"""Set algebra on the driver tables."""

from catalog import tables as T
from catalog.registry import query
from shapeloom.operators import region


def sweep_sql(sides: str, test: str) -> str:
    """SQL for `covered(layer, l, b, r, t)` from `sides(layer, side, l, b, r, t)`.

    One sweep per 512-wide column strip: slabs between distinct x cuts, +1/-1 events on y.
    """
    return sides + """, pieces AS (SELECT layer, side, c, greatest(l, c * 512) AS l, b,
 least(r, (c + 1) * 512) AS r, t FROM (SELECT *, unnest(range(l // 512, (r - 1) // 512 + 1)) AS c
 FROM sides)),
cuts AS (SELECT DISTINCT layer, c, l AS x FROM pieces UNION SELECT DISTINCT layer, c, r FROM pieces),
slabs AS (SELECT layer, c, x AS x0, lead(x) OVER (PARTITION BY layer, c ORDER BY x) AS x1 FROM cuts),
hits AS (SELECT s.layer, x0, x1, side, b, t FROM slabs s JOIN pieces p
 ON s.layer = p.layer AND s.c = p.c AND p.l <= x0 AND p.r >= x1),
ev AS (SELECT layer, x0, x1, y, sum(da) AS da, sum(db) AS db FROM (
 SELECT layer, x0, x1, b AS y, CASE side WHEN 0 THEN 1 ELSE 0 END AS da,
  CASE side WHEN 1 THEN 1 ELSE 0 END AS db FROM hits
 UNION ALL SELECT layer, x0, x1, t, CASE side WHEN 0 THEN -1 ELSE 0 END,
  CASE side WHEN 1 THEN -1 ELSE 0 END FROM hits) GROUP BY ALL),
runs AS (SELECT layer, x0, x1, y, lead(y) OVER w AS y1, sum(da) OVER w AS ca, sum(db) OVER w AS cb
 FROM ev WINDOW w AS (PARTITION BY layer, x0 ORDER BY y)),
covered AS (SELECT layer, x0 AS l, y AS b, x1 AS r, y1 AS t FROM runs
 WHERE y1 IS NOT NULL AND (%s))""" % test


def area_sql(sides, test):
    return "WITH " + sweep_sql(sides, test) + """ SELECT layer,
 CAST(sum((r - l) * (t - b)) AS BIGINT) AS area FROM covered GROUP BY layer"""


ONE = T.BOXES + ", sides AS (SELECT *, 0 AS side FROM boxes)"
TWO = T.BOXES + ", " + T.SOLID + """, sides AS (SELECT layer, 0 AS side, l, b, r, t FROM boxes
 UNION ALL SELECT layer, 1, l, b, r, t FROM solid)"""


@query(area_sql(ONE, "ca > 0"))
def merged_area_by_layer(spark, sf_dir):
    return region.area(region.union(T.boxes(spark, sf_dir)))


def _pair(spark, sf_dir):
    return T.boxes(spark, sf_dir), T.solid(spark, sf_dir)


@query(area_sql(TWO, "ca > 0 AND cb > 0"))
def intersection_area(spark, sf_dir):
    return region.area(region.intersection(*_pair(spark, sf_dir)))


@query(area_sql(TWO, "ca > 0 AND cb = 0"))
def difference_area(spark, sf_dir):
    return region.area(region.difference(*_pair(spark, sf_dir)))


@query(area_sql(TWO, "(ca > 0) <> (cb > 0)"))
def symmetric_difference_area(spark, sf_dir):
    return region.area(region.symmetric_difference(*_pair(spark, sf_dir)))


EDGE_SQL = """, sidespan AS (
 SELECT layer, TRUE AS horizontal, b AS coord, l AS lo, r AS hi, 1 AS s FROM covered
 UNION ALL SELECT layer, TRUE, t, l, r, -1 FROM covered
 UNION ALL SELECT layer, FALSE, l, b, t, 1 FROM covered
 UNION ALL SELECT layer, FALSE, r, b, t, -1 FROM covered),
lev AS (SELECT layer, horizontal, coord, pos, sum(d) AS d FROM (
 SELECT layer, horizontal, coord, lo AS pos, s AS d FROM sidespan
 UNION ALL SELECT layer, horizontal, coord, hi, -s FROM sidespan) GROUP BY ALL),
lsum AS (SELECT *, sum(d) OVER (PARTITION BY layer, horizontal, coord ORDER BY pos) AS v FROM lev
 WHERE d <> 0),
boundary AS (SELECT layer, horizontal, coord, pos AS lo,
 lead(pos) OVER (PARTITION BY layer, horizontal, coord ORDER BY pos) AS hi, CAST(v AS BIGINT) AS s
 FROM lsum QUALIFY v <> 0)"""


@query("WITH " + sweep_sql(ONE, "ca > 0") + EDGE_SQL +
       " SELECT layer, horizontal, coord, lo, hi, s FROM boundary")
def boundary_edges(spark, sf_dir):
    return region.outline(T.boxes(spark, sf_dir))
