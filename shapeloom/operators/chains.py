"""Chains of boundary edges inside blocks of the plane, followed with whole arrays at a time.

A block holds the edges that start or end in it, so all edges of its vertices. Inside a block, edges fall
into closed rings and into open chains that enter from another block and leave to one. Only the chains' ends
are left for the steps over all blocks.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shapeloom.functions.scalars import floor_div
from shapeloom.operators.cells import ordered, whole_groups

LONG = T.LongType()
# Edges that a task takes at a time, in whole blocks.
ROWS = 1 << 15
# Of an edge: the first edge of its chain (of a ring: the smallest) and the number of edges from there;
# of a ring: its size. On a chain's first edge also: its length, its smallest edge and where that is, and its last edge, if that leaves the block.
CHAIN = ["hx0", "hy0", "hx1", "hy1", "pos", "n", "len", "lx0", "ly0", "lx1", "ly1", "low", "tx0", "ty0", "tx1", "ty1"]


def direction(dx, dy):
    """0 to 3 for right, up, left, down."""
    return np.where(dx > 0, 0, np.where(dy > 0, 1, np.where(dx < 0, 2, 3)))


def successors(arrives, leaves, into, out):
    """Place in `leaves` of the edge that follows each one of `arrives` (vertex numbers), or -1.

    `into` and `out` are directions. Where two regions touch at a corner, turning right (towards the covered
    side) keeps them apart; at most one edge leaves a vertex in each direction.
    """
    code = leaves * 4 + out
    (code, order), ends = ordered(code), np.sort(arrives)
    if not len(code):
        return np.full(len(arrives), -1)
    first, last = np.searchsorted(code, arrives * 4), np.searchsorted(code, arrives * 4 + 4)
    alone = (last - first == 1) & (np.searchsorted(ends, arrives, "right") - np.searchsorted(ends, arrives) == 1)
    wanted = arrives * 4 + (into + 3) % 4
    at = np.where(alone, first, np.searchsorted(code, wanted))
    at = np.minimum(at, len(code) - 1)
    return np.where(alone | (code[at] == wanted), order[at], -1)


def followed(after, rank):
    """For edges with successors `after` (-1: outside) and a rank: first edge, distance from it, ring size or 0."""
    n = len(after)
    before = np.arange(n)
    inner = np.flatnonzero(after >= 0)
    before[after[inner]] = inner
    first = np.ones(n, bool)
    first[after[inner]] = False
    head, dist = before.copy(), (~first).astype(np.int64)
    come = -1
    # As long as a chain is longer than the steps, each doubling brings more edges to their first one.
    while (now := np.count_nonzero(first[head])) > come:
        dist, head, come = dist + dist[head], head[head], now
    ring = ~first[head]  # never came to a first edge
    size = np.zeros(n, np.int64)
    if ring.any():
        low, gap, jump, hops = rank.copy(), np.zeros(n, np.int64), np.where(ring, after, np.arange(n)), 1
        # A window that holds nothing smaller than all those before it has seen the whole ring.
        while (less := low[jump] < low).any():
            gap, low = np.where(less, gap[jump] + hops, gap), np.minimum(low, low[jump])
            jump, hops = jump[jump], 2 * hops
        place = np.empty(n, np.int64)
        place[rank] = np.arange(n)
        head = np.where(ring, place[low], head)
        size = np.where(ring, np.bincount(head[ring], minlength=n)[head], 0)
        dist = np.where(ring, (size - gap) % np.maximum(size, 1), dist)
    return head, dist, size


def _solved(x0, y0, x1, y1, group, left, low, block: int):
    """Own edges (places), px, py and the CHAIN columns of whole blocks, numbered by `group`, with corners `left`, `low`."""
    own = (x0 >= left) & (x0 < left + block) & (y0 >= low) & (y0 < low + block)
    ends = (x1 >= left) & (x1 < left + block) & (y1 >= low) & (y1 < low + block)
    way, into, out = direction(x1 - x0, y1 - y0), np.flatnonzero(ends), np.flatnonzero(own)

    def vertex(x, y, of):
        return (group[of] * block + x[of] - left[of]) * block + y[of] - low[of]

    found = successors(vertex(x1, y1, into), vertex(x0, y0, out), way[into], way[out])
    some = found >= 0
    before = np.full(len(x0), -1)
    before[out[found[some]]] = into[some]
    before = before[out]
    px, py = (pa.array(v[before], mask=before < 0) for v in (x0, y0))
    # Chains are of own edges; one whose edge before starts elsewhere begins there.
    place = np.full(len(x0), -1)
    place[out] = np.arange(len(out))
    inner = np.flatnonzero((before >= 0) & (place[before] >= 0))
    after = np.full(len(out), -1)
    after[place[before[inner]]] = inner
    away = ~ends[out]
    x0, y0, x1, y1, group = (v[out] for v in (x0, y0, x1, y1, group))
    order = np.lexsort((y1, x1, y0, x0, group))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    head, dist, size = followed(after, rank)
    start = (dist == 0) & (size == 0)
    length = np.bincount(head, minlength=len(head))
    least = np.full(len(head), len(head), np.int64)
    np.minimum.at(least, head, rank)
    low = order[np.minimum(least, len(head) - 1)] if len(head) else order
    last = np.full(len(head), -1, np.int64)
    stops = np.flatnonzero((after < 0) & (size == 0))
    last[head[stops]] = stops
    columns = {c: v[head] for c, v in zip(CHAIN[:4], (x0, y0, x1, y1))}
    columns |= {"pos": dist, "n": pa.array(size, mask=size == 0), "len": pa.array(length, mask=~start)}
    columns |= {c: pa.array(v[low], mask=~start) for c, v in zip(CHAIN[7:11], (x0, y0, x1, y1))}
    columns["low"] = pa.array(dist[low], mask=~start)
    leaves = start & away[last]
    columns |= {c: pa.array(v[last], mask=~leaves) for c, v in zip(CHAIN[12:], (x0, y0, x1, y1))}
    return out, [px, py, *[columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c]) for c in CHAIN]]


def contracted(edges: DataFrame, keys, block: int, rows: int | None = None) -> DataFrame:
    """Edges (keys, x0, y0, x1, y1) with px, py and the CHAIN columns, by blocks of the plane: one shuffle."""
    where, names = [*keys, "_bx", "_by"], [*keys, "x0", "y0", "x1", "y1"]
    ends = [F.struct(floor_div(x, block).alias("x"), floor_div(y, block).alias("y")) for x, y in (("x0", "y0"), ("x1", "y1"))]
    placed = edges.select(*names, F.explode(F.array_distinct(F.array(*ends))).alias("_b")).select(
        *names, F.col("_b.x").alias("_bx"), F.col("_b.y").alias("_by"))
    placed = placed.repartition(*where).sortWithinPartitions(*where)
    schema = T.StructType([*[placed.schema[c] for c in names], *[T.StructField(c, LONG) for c in ["px", "py", *CHAIN]]])

    def task(batches):
        for t, g in whole_groups(batches, where, rows or ROWS):
            at = [t.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")]
            own, columns = _solved(*at, g, *[t.column(c).to_numpy() * block for c in ("_bx", "_by")], block)
            kept = t.select(names).take(pa.array(own))
            out = pa.Table.from_arrays([*kept.columns, *[c.cast(pa.int64()) for c in columns]], names=schema.names)
            yield from out.to_batches(max_chunksize=1 << 16)

    return placed.mapInArrow(task, schema)
