"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are rotated by three rounds of random signs and a Hadamard transform; the hash of a unit
vector is the nearest signed axis. `TABLES` tables hash by one such rotation, or by two once there
are more than `SECOND` vectors, the second over as many axes as the number of vectors asks for.
Queries look into their own bucket and, in each table, into the `probes` next likely ones, ordered by
the sum of their rotated coordinates. Candidates are ranked by inner product of the original vectors
in double precision.

Vectors of different length are searched as unit vectors after one more coordinate makes all norms
equal, so the nearest direction has the largest inner product. Equal vectors are one entry of the
index with its `k` + 1 smallest ids, which is all that any result can hold; every vector is indexed.
Buckets are dealt over blocks of bounded size; a bucket beyond `piece` entries is split over several
blocks and its queries go to each, so none is capped.

Defined cases: null or zero vectors, vectors holding null or non-finite components, and those of
another length than most vectors take no part; a null id takes no part; rows repeating id and vector are
one; with fewer than k candidates all are returned; an empty table gives an empty result.
"""
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import saved

TABLES, SECOND, PER_BLOCK, PIECE = 8, 5000, 100_000, 20_000
FOUND = "q long, v long, score double"


class Hashing:
    """Cross-polytope hash functions for n vectors of a dimension."""

    def __init__(self, dim, n, k=20, tables=TABLES, seed=17):
        self.width = 1 << max(1, int(dim).bit_length())  # one coordinate more, rounded up
        if self.width // 2 > dim:
            self.width //= 2
        self.axes = 0 if n < SECOND else min(self.width, 1 << max(0, int(np.log2(n / 2500))))
        self.buckets = 2 * self.width * max(1, 2 * self.axes)
        # Enough for recall, and for 8 (k + 1) entries on average: of few vectors all are looked at.
        self.probes = min(self.buckets, max(int(np.ceil(24 * (max(1, 2 * self.axes)) ** 0.45 * self.width / 64)),
                                            int(np.ceil(8 * (k + 1) * self.buckets / n))))
        rng = np.random.default_rng(seed)
        self.signs = rng.choice([-1.0, 1.0], (tables, 2, 3, self.width))

    def _turn(self, x, signs):
        for s in signs:
            x = x * s
            h = 1
            while h < self.width:  # fast Hadamard transform
                x = x.reshape(len(x), -1, 2, h)
                x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), self.width)
                h *= 2
            x = x / np.sqrt(self.width)
        return x

    def _axes(self, x, t):
        a = self._turn(x, self.signs[t, 0])
        a = np.concatenate([a, -a], axis=1)
        if not self.axes:
            return a, None
        b = self._turn(x, self.signs[t, 1])[:, :self.axes]
        return a, np.concatenate([b, -b], axis=1)

    def codes(self, x):
        """Bucket of every vector in every table."""
        out = np.empty((len(x), len(self.signs)), np.int32)
        for t in range(len(self.signs)):
            a, b = self._axes(x, t)
            out[:, t] = a.argmax(1) if b is None else a.argmax(1) * (2 * self.axes) + b.argmax(1)
        return out

    def probed(self, x):
        """The likely buckets of every query in every table."""
        out = np.empty((len(x), len(self.signs), self.probes), np.int32)
        for t in range(len(self.signs)):
            a, b = self._axes(x, t)
            v = a if b is None else (a[:, :, None] + b[:, None, :]).reshape(len(x), -1)
            out[:, t] = np.argpartition(-v, self.probes - 1, axis=1)[:, :self.probes] if self.probes < v.shape[1] \
                else np.arange(v.shape[1])
        return out


def matrix(column):
    """2-D float64 array of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def widened(x, width, top, query):
    """Unit vectors of the hash's width: queries by their own norm, entries by the largest one."""
    norm = np.linalg.norm(x, axis=1)
    out = np.zeros((len(x), width))
    out[:, :x.shape[1]] = x / (norm[:, None] if query else top)
    if not query and width > x.shape[1]:
        out[:, x.shape[1]] = np.sqrt(np.maximum(0, 1 - (norm / top) ** 2))
    return out


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, e) of the vectors that take part."""
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.filter("id is not null and e is not null").filter(fine & F.exists("e", lambda x: x != 0))
    # -0.0 and 0.0 are one value.
    return v.withColumn("e", F.transform("e", lambda x: x + F.lit(0.0)))


def search(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
           tables: int = TABLES, per_block: int = PER_BLOCK, piece: int = PIECE) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of every row where `is_query(id)` holds."""
    spark = vectors.sparkSession
    all_ = usable(vectors, vec_id, embedding)
    shape = (all_.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n"), F.max(
        F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).orderBy(F.desc("n"), "d").limit(1).collect())
    if not shape:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, top = shape[0]["d"], shape[0]["n"], float(np.sqrt(shape[0]["top"]))
    all_ = all_.filter(F.size("e") == dim)
    hashing = Hashing(dim, n, k, tables)
    # Ranking with a limit is cut per task before the shuffle, so a frequent vector sends k + 1 ids per task.
    least = W.partitionBy("e").orderBy("id")
    entries = (all_.withColumn("rn", F.dense_rank().over(least)).filter(F.col("rn") <= k + 1)
               .groupBy("e").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("v", F.get("ids", F.lit(0))))
    entries = saved(entries, "vectors")
    asks = all_.filter(is_query(F.col("id"))).select("id", "e").distinct()
    asks = saved(asks.join(entries.select("e", "v"), "e").select("id", "v"), "queries")
    whole = entries.join(asks.select("v").distinct(), "v", "left_semi").select("v", "e")

    def coded(batches, query):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512 if query else 4096):
                some = batch.slice(lo, 512 if query else 4096)
                x = widened(matrix(some.column("e")), hashing.width, top, query)
                c = hashing.probed(x) if query else hashing.codes(x)
                yield pa.RecordBatch.from_arrays([some.column("v"), some.column("e"), pa.array(
                    list(c.reshape(len(c), -1)), pa.list_(pa.int32()))], names=["v", "e", "codes"])

    kept = "v long, e array<double>, codes array<int>"
    stored = entries.select("v", "e").mapInArrow(lambda b: coded(b, False), kept)
    sought = whole.mapInArrow(lambda b: coded(b, True), kept)
    each = stored.select("v", "e", F.posexplode("codes").alias("t", "c"))
    sizes = saved(stored.select(F.posexplode("codes").alias("t", "c")).groupBy("t", "c").count()
                  .filter(F.col("count") > piece)
                  .select("t", "c", F.ceil(F.col("count") / piece).cast("int").alias("parts")), "large-buckets")
    blocks = max(1, -(-n * tables // per_block))

    def block(part):
        return F.pmod(F.xxhash64("t", "c", part), F.lit(blocks)).cast("int")

    entry = (each.join(sizes, ["t", "c"], "left").withColumn("part", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))))
             .select(block(F.col("part")).alias("block"), (F.col("t") * hashing.buckets + F.col("c")).alias("c"), "v", "e"))
    probe = (sought.select("v", "e", F.posexplode("codes").alias("i", "c"))
             .withColumn("t", F.floor(F.col("i") / hashing.probes).cast("int")).drop("e")
             .join(sizes, ["t", "c"], "left")
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1).cast("array<bigint>")))
             .groupBy(block(F.col("part")).alias("home"), "v")
             .agg(F.collect_set((F.col("t") * hashing.buckets + F.col("c"))).alias("cs"))
             .join(whole.withColumnRenamed("v", "w"), F.col("v") == F.col("w")).select("home", "v", "e", "cs"))

    def ranked(key, left, right):
        """The best k + 1 entries per query among the block's buckets that it probes."""
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        code, ids, x = left.column("c").to_numpy(), left.column("v").to_numpy(), matrix(left.column("e"))
        order = np.argsort(code, kind="stable")
        code, ids, x = code[order], ids[order], x[order]
        qs, y = right.column("v").to_numpy(), matrix(right.column("e"))
        out = []
        for i, cs in enumerate(right.column("cs").to_pylist()):
            cs = np.array(cs)
            lo, hi = np.searchsorted(code, cs), np.searchsorted(code, cs, "right")
            size = hi - lo
            at = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
            v, first = np.unique(ids[at], return_index=True)
            s = x[at[first]] @ y[i]
            if len(s) > k + 1:
                edge = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                more = s >= edge
                v, s = v[more], s[more]
                best = np.lexsort((v, -s))[:k + 1]
                v, s = v[best], s[best]
            out.append((np.full(len(v), qs[i]), v, s))
        return pa.table({"q": np.concatenate([o[0] for o in out]), "v": np.concatenate([o[1] for o in out]),
                         "score": np.concatenate([o[2] for o in out])})

    found = entry.groupBy("block").cogroup(probe.groupBy("home")).applyInArrow(ranked, FOUND)
    best = W.partitionBy("q").orderBy(F.desc("score"), "v")
    near = found.groupBy("q", "v").agg(F.max("score").alias("score"))
    near = near.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k + 1)
    # Equal vectors return here: at most k + 1 entries of k + 1 ids each per query.
    near = (near.select("q", "v", "score").join(entries.select("v", "ids"), "v")
            .select("q", "score", F.explode("ids").alias("vec_id")))
    last = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = near.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct(
        (-F.col("score")).alias("s"), "vec_id"))), 1, k + 1).alias("best"))
    return (asks.join(near, F.col("v") == F.col("q")).select(F.col("id").alias("query_id"), F.explode("best").alias("b"))
            .select("query_id", F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
            .filter("query_id <> vec_id").withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
