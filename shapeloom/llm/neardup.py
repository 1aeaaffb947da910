"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

Words are runs of non-blank characters, A-Z lower-cased; a document's set holds the distinct runs of five
words (all its words, if fewer). Equal sets are one class. A class has a signature of SYMBOLS
16-bit MinHash values in CHUNKS chunks. Two signatures that differ in at most 2 CHUNKS - 1 = 11
places have a chunk with at most one error (pigeonhole); the errors are enumerated by leaving out
each place of each chunk in turn, so both sides share a key. At similarity 0.85 more than 11 of 30
places differ in less than one of 1,000 pairs, and most of those share a key all the same.

Candidates within a key are not paired with each other: members are linked to two of them (the
smallest and one chosen by hash), then to the one with the fewest shingles of its own, links are confirmed on full sets and
joined to components; keys that lie within one component are done. In what is left, sets that are similar enough share
one of their rarest shingles, so members of such keys are paired under such a shingle only, where sizes
and places leave enough in common; so no link between different texts that share a key is lost.

Defined cases: a text without words (null, empty, blanks) and a null doc_id are linked with nothing;
rows that repeat a doc_id are documents of their own; equal texts are always linked; very long texts are whole; an
empty table gives an empty result; other columns are ignored.
"""
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words
from .common import saved
from .graph import components

SYMBOLS, CHUNKS, SLACK = 30, 6, 15
WIDTH = SYMBOLS // CHUNKS
LONGS = -(-SYMBOLS // 4)
ODD = words.mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x51ED270B9F3C5A77)) | np.uint64(1)
PLACE = (np.arange(SYMBOLS, dtype=np.uint64) + np.uint64(1)) << np.uint64(20)


def signatures(offs, hashes):
    """Rows with a set, and their MinHash symbols (uint16 [n, SYMBOLS])."""
    rows = np.flatnonzero(np.diff(offs))
    out = np.empty((len(rows), SYMBOLS), np.uint16)
    if len(rows):
        for k in range(SYMBOLS):
            least = np.minimum.reduceat(hashes * ODD[k], offs[:-1][rows])
            out[:, k] = (words.mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return rows, out


def keys(symbols):
    """Index keys of signatures: for each chunk, the hash of its symbols but one, for each one."""
    terms = words.mix(symbols.astype(np.uint64) + PLACE).reshape(len(symbols), CHUNKS, WIDTH)
    rest = terms.sum(axis=2, keepdims=True, dtype=np.uint64) - terms
    return words.mix(rest.reshape(len(symbols), SYMBOLS) + PLACE).astype(np.int64)


def described(docs: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null without words) and signature."""
    def task(batches):
        for batch in batches:
            for some in words.pieces(batch, "text"):
                offs, h = words.of(some, "text").sets(size)
                rows, sig = signatures(offs, h)
                wide = np.zeros((len(rows), LONGS * 4), np.uint16)
                wide[:, :SYMBOLS] = sig
                digest, longs = [None] * some.num_rows, [None] * some.num_rows
                for i, r in enumerate(rows):
                    digest[r] = hashlib.blake2b(h[offs[r]:offs[r + 1]].tobytes(), digest_size=16).digest()
                    longs[r] = wide[i].view(np.int64)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(np.diff(offs)), pa.array(digest, pa.binary()),
                                                  pa.array(longs, pa.list_(pa.int64()))],
                                                 names=["doc_id", "n_shingles", "digest", "sig"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id long, n_shingles long, digest binary, sig array<long>")


def distance(a, b):
    """Number of differing 16-bit symbols of two signatures."""
    total = F.lit(0)
    for i in range(LONGS):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for by in (8, 4, 2, 1):  # the lowest bit of a symbol becomes the or of its bits
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))
    return total


def _keyed(classes: DataFrame) -> DataFrame:
    def task(column: pa.Array) -> pa.Array:
        sig = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, LONGS).view(np.uint16)
        return pa.array(list(keys(sig[:, :SYMBOLS])), pa.list_(pa.int64()))

    return classes.select("node", F.explode(F.arrow_udf(task, "array<long>")("sig")).alias("key"))


def _sets(docs: DataFrame, wanted: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """The full sets of classes (node, doc_id, digest), sorted 64-bit hashes."""
    def task(batches):
        for batch in batches:
            for some in words.pieces(batch, "text"):
                offs, h = words.of(some, "text").sets(size)
                nodes, marks = some.column("node").to_pylist(), some.column("digest").to_pylist()
                keep = []
                for i, (a, b) in enumerate(zip(offs, offs[1:])):
                    raw = h[a:b].tobytes()
                    if hashlib.blake2b(raw, digest_size=16).digest() == marks[i]:
                        keep.append((nodes[i], raw))
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.int64()), pa.array([k[1] for k in keep], pa.binary())],
                                                 names=["node", "set"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return (rows.join(wanted, "doc_id").select("node", "digest", "text").mapInArrow(task, "node long, set binary")
            .dropDuplicates(["node"]))


def _ranked(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """For some nodes: size of their set, how many of its shingles another of them has too (`match`), and
    the shingles (`rare`) of which two sets that are similar enough must share one.

    In one order of all shingles, rarest first, sets of similarity p have a common one among the first
    size - ceil(p size) + 1 of each. Nodes with too many shingles of their own are left out: an
    intersection is never larger than `match`, so they are linked with nothing.
    """
    def listed(column: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(x.as_buffer(), np.int64) for x in column], pa.list_(pa.int64()))

    some = sets.join(nodes, "node", "left_semi")
    each = saved(some.select("node", F.explode(F.arrow_udf(listed, "array<bigint>")("set")).alias("s")), "shingles")
    often = each.groupBy(F.col("s").alias("t")).agg(F.count("*").alias("c")).filter("c > 1")
    shared = each.join(often, F.col("s") == F.col("t")).groupBy(F.col("node").alias("n")).agg(
        F.count("*").alias("match"), F.sort_array(F.collect_list(F.struct("c", "s"))).alias("order"))
    size = (F.octet_length("set") / 8).cast("long")
    rows = some.select("node", size.alias("size")).join(shared, F.col("node") == F.col("n")).filter(F.col("match") * 100 >= F.col("size") * percent)
    # Shingles that only one set has come first in the order and take up places of the prefix.
    alone, prefix = F.col("size") - F.col("match"), F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    rare = F.transform(F.slice("order", F.lit(1), F.greatest(prefix - alone, F.lit(0)).cast("int")),
                       lambda x, i: F.struct(x["s"].alias("s"), (i + alone).alias("place")))
    return rows.select("node", "size", "match", rare.alias("rare"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                out.append(False)
                continue
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            out.append(100 * common >= percent * (len(both) - common))
        return pa.array(out, pa.bool_())

    left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").filter(F.arrow_udf(linked, "boolean")("set_a", "set_b")).select("a", "b")


def _close(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct pairs whose signatures differ in at most SLACK places."""
    left = classes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    right = classes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    return (pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            .join(left, "a").join(right, "b").filter(distance(F.col("sig_a"), F.col("sig_b")) <= SLACK).select("a", "b"))


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (key, node, root) of the keys that still hold several components."""
    rooted = members.select("key", "node").join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
    rooted = saved(rooted.select("key", "node", F.coalesce("root", "node").alias("root")), "members")
    open_ = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y")
    # Not the grouping key, so that a frequent key can be split in the join.
    open_ = open_.select(F.col("key").bitwiseXOR(F.lit(1)).alias("k"))
    return saved(rooted.join(open_, F.col("key").bitwiseXOR(F.lit(1)) == F.col("k"), "left_semi"), "members")


def groups(docs: DataFrame, percent: int = 85, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest, component_id, kept of every document."""
    spark = docs.sparkSession
    rows = saved(described(docs, size, doc_id, text), "signatures")
    part = rows.filter("digest is not null and doc_id is not null")
    classes = saved(part.groupBy("digest").agg(F.first("sig").alias("sig"), F.min("doc_id").alias("doc_id"))
                    .withColumn("node", F.monotonically_increasing_id()), "classes")
    keyed = _keyed(classes)
    # Two centres for each key: the smallest member and one chosen by hash.
    shared = keyed.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.min_by("node", F.xxhash64("node", "key")).alias("z"))
    shared = saved(shared.filter("x <> y").select(F.col("key").alias("k"), F.array("x", "z").alias("centres")), "shared-keys")
    members = saved(keyed.join(shared, F.col("key") == F.col("k")).select("key", "node", "centres"), "members")
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "digest")
    sets = saved(_sets(docs, wanted, size, doc_id, text), "sets")

    pairs = members.select("node", F.explode("centres").alias("centre")).filter("node <> centre")
    tried = saved(_close(pairs.select(F.col("centre").alias("a"), F.col("node").alias("b")), classes), "pairs")
    links = saved(_confirmed(tried, sets, percent), "links")
    members = _mixed(members, components(links, rounds=1))
    # Members that could still be linked; as centre the one with the fewest shingles of its own, which
    # is the text that the others were edited from.
    ranked = saved(_ranked(sets, members.select("node").distinct(), percent), "ranked").withColumnRenamed("node", "n")
    common = ranked.select("n", (F.col("match") / F.col("size")).alias("common"))
    members = saved(members.join(common, F.col("node") == F.col("n")).drop("n"), "members")
    chosen = members.groupBy("key").agg(F.max_by(F.struct("node", "root"), F.struct("common", F.xxhash64("node"))).alias("c"))
    chosen = saved(chosen.select(F.col("key").alias("k"), F.col("c.node").alias("centre"), F.col("c.root").alias("of")), "centres")
    pairs = members.join(chosen, F.col("key") == F.col("k")).filter("root <> of").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    more = saved(_close(pairs, classes).join(tried, ["a", "b"], "left_anti"), "pairs")
    tried = tried.unionByName(more)
    links = links.unionByName(saved(_confirmed(more, sets, percent), "links"))
    members = _mixed(members, saved(components(links), "roots"))
    # The rest exactly: members of mixed keys in different components that share a rare shingle,
    # which may be the first they share, have close signatures and are not tried yet.
    left_over = members.select("node", "root").distinct().join(ranked, F.col("node") == F.col("n"))
    left_over = saved(left_over.select("node", "root", "size", "match", F.explode("rare").alias("rare"))
                      .select("node", "root", "size", "match", "rare.*"), "rare")
    left = left_over.toDF("a", "ra", "za", "ma", "s", "ia")
    right = left_over.toDF("b", "rb", "zb", "mb", "t", "ib")
    most = F.least("ma", "mb", F.col("za") - F.col("ia"), F.col("zb") - F.col("ib"))
    pairs = left.join(right, (F.col("s") == F.col("t")) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb"))
                      & (100 * most >= percent * (F.col("za") + F.col("zb") - most))).select("a", "b")
    rest = saved(_close(pairs, classes).join(tried, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(saved(_confirmed(rest, sets, percent), "links"))
    roots = saved(components(links), "roots")

    rooted = (classes.select("digest", "node", "doc_id").join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
              .select("digest", "doc_id", F.coalesce("root", "node").alias("root")))
    rooted = saved(rooted, "rooted")
    least = saved(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("root", "r"), "least")
    named = saved(rooted.join(least, F.col("root") == F.col("r")).select(F.col("digest").alias("d"), "component_id"), "named")
    joined = part.join(named, F.col("digest") == F.col("d")).select("doc_id", "n_shingles", "digest", "component_id")
    alone = rows.filter("digest is null or doc_id is null").select("doc_id", "n_shingles", "digest", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, percent: int = 85, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, one of each group: that with the smallest id, one of those that repeat it.

    Rows with a null id or without words are all kept.
    """
    found = groups(docs, percent, size, doc_id, text)
    chosen = found.filter("kept and digest is not null and doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    # Rows travel as one struct, so no column of theirs clashes with ours.
    words_ = F.coalesce(F.col(text).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), words_.alias("words"))
    linked = rows.filter("words and id is not null").join(chosen, "id", "left_semi").dropDuplicates(["id", "text"])
    return linked.unionByName(rows.filter("not words or id is null")).select("row.*")
