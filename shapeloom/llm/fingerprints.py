"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs (lines). Each paragraph is hashed to a wide vector,
and a fingerprint is the sum of these vectors modulo powers of two, so paragraphs can be inserted
and deleted by adding and subtracting, in any order. The vector has two parts:
* `LANES` words modulo 2^64, the paragraph's 256-bit digest: equal sums, equal multisets;
* `DIMS` words modulo 2^32, read as signed, each run of GRAM bytes of the paragraph adding or taking one
  in a hashed place: the cosine of two sums estimates the likeness of the documents (error about
  1/sqrt(DIMS)). A string has less than 2^31 bytes, so no count of one document wraps.

Defined cases: a null text is empty, and empty texts are alike (likeness 1); a paragraph shorter
than GRAM bytes is one run; texts may be of any length.
"""
import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words

LANES, DIMS, GRAM = 4, 256, 12
WIDTH = 4  # bytes of a likeness word
SIZE = LANES * 8 + DIMS * WIDTH
NO_ID = -(1 << 63)  # whose complement is the largest number, so no id overflows
COMPARED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
            "near_edited double, near_next double")


def vectors(data, offs):
    """Fingerprint vectors (uint64 [n, LANES], uint32 [n, DIMS]) of a buffer of texts."""
    n, rows = len(data), len(offs) - 1
    up, down = words.powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words.BYTE[data] * up[:n], out=sums[1:])
    # A paragraph ends before each line end and at the end of each text.
    lines = np.flatnonzero(data == 10)
    owner = np.searchsorted(offs, lines, "right") - 1
    start = np.concatenate([offs[:-1], lines + 1])
    end_of = np.concatenate([lines, offs[1:]])
    doc = np.concatenate([np.arange(rows), owner])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    end = end_of[np.lexsort((end_of, np.concatenate([owner, np.arange(rows)])))]
    view = memoryview(np.ascontiguousarray(data))
    digests = b"".join(hashlib.blake2b(view[a:b], digest_size=8 * LANES).digest() for a, b in zip(start.tolist(), end.tolist()))
    first = np.searchsorted(doc, np.arange(rows))
    strong = np.add.reduceat(np.frombuffer(digests, "<u8").reshape(-1, LANES), first, axis=0) if rows else np.zeros((0, LANES), np.uint64)
    # Runs of GRAM bytes inside a paragraph, or the whole of a shorter one.
    size = end - start
    runs = np.where(size >= GRAM, size - GRAM + 1, size > 0)
    total = int(runs.sum())
    which = np.repeat(np.arange(len(runs)), runs)
    at = np.arange(total) - np.repeat(np.cumsum(runs) - runs, runs) + start[which]
    stop = np.minimum(at + GRAM, end[which])
    g = words.mix((sums[stop] - sums[at]) * down[at])
    place = doc[which] * DIMS + (g >> np.uint64(40)).astype(np.int64) % DIMS
    sign = 1.0 - 2.0 * (g & np.uint64(1)).astype(np.float64)
    weak = np.bincount(place, sign, rows * DIMS).reshape(rows, DIMS).astype(np.int64).astype(np.uint32)
    return strong, weak


def pack(strong, weak):
    """Vectors as binary; the lowest bytes of all places stand before the next ones."""
    planes = weak.view(np.uint8).reshape(len(weak), DIMS, WIDTH).transpose(0, 2, 1).reshape(len(weak), DIMS * WIDTH)
    both = np.concatenate([strong.view(np.uint8).reshape(len(strong), LANES * 8), planes], axis=1)
    return [r.tobytes() for r in both]


def unpack(column):
    data, _ = words.buffer(column)
    both = data.reshape(-1, SIZE)
    strong = np.ascontiguousarray(both[:, :LANES * 8]).view(np.uint64)
    planes = both[:, LANES * 8:].reshape(-1, WIDTH, DIMS).transpose(0, 2, 1)
    return strong, np.ascontiguousarray(planes).reshape(-1, DIMS * WIDTH).view(np.uint32)


def insert(fingerprint, paragraphs):
    """Sum of two fingerprints: the union of both multisets."""
    return fingerprint[0] + paragraphs[0], fingerprint[1] + paragraphs[1]


def delete(fingerprint, paragraphs):
    return fingerprint[0] - paragraphs[0], fingerprint[1] - paragraphs[1]


def likeness(a, b):
    """0 to 1; 1 for equal fingerprints."""
    x, y = a[1].view(np.int32).astype(np.float64), b[1].view(np.int32).astype(np.float64)
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.clip((x * y).sum(1) / np.where(norm > 0, norm, 1), 0, 1)
    return np.where((a[0] == b[0]).all(1), 1.0, cosine)


def text_of(column, rows=500):
    """Fingerprints as text, `hex:base64`; so many rows at a time, as workers share an executor's memory."""
    out = []
    for lo in range(0, len(column), rows):
        strong, weak = unpack(column.slice(lo, rows))
        out.append(pa.array([f"{s.tobytes().hex()}:{base64.b64encode(w.tobytes()).decode()}" for s, w in zip(strong, weak)], pa.string()))
    pa.default_memory_pool().release_unused()
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def fingerprinted(docs: DataFrame, text: str = "text", column: str = "fingerprint") -> DataFrame:
    """Add the binary fingerprint of a text column."""
    def one(texts: pa.Array) -> pa.Array:
        out = []
        for some in words.pieces(pa.RecordBatch.from_arrays([texts], names=["t"]), "t"):
            out += pack(*vectors(*words.buffer(some.column("t"))))
        return pa.array(out, pa.binary())

    return docs.withColumn(column, F.arrow_udf(one, "binary")(F.col(text).cast("string")))


def revised(old, new):
    """Fingerprints of old texts and of new ones, given as (text, code points it shares with the old).

    The new fingerprints come from the old ones by deleting and inserting the paragraphs from the one
    of the first difference on.
    """
    tails = [(a[(at := a.rfind("\n", 0, same) + 1):], b[at:]) for a, (b, same) in zip(old, new)]
    was = _of(old)
    now = insert(delete(was, _of([t for t, _ in tails])), _of([t for _, t in tails]))
    return was, now


def _of(texts):
    return vectors(*words.buffer(pa.array(texts, pa.string())))


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = 3) -> DataFrame:
    """doc_id, n_chars, `edited_sha256` (of the text whose last 1/share is replaced by the head of the
    next document by descending id; after the last comes the first), fingerprints of text and edited
    text, and the likeness to the edited and to the next text.

    A null id comes last, with the lowest number; documents of one id follow each other by the hash of their texts; repeated
    rows are one document and get a row each. Texts are shuffled once, compressed, into ranges of ids
    whose bounds are quantiles; the first document of each range goes to the range before too.
    """
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("text"))
    base = base.withColumn("neg", F.bitwise_not(F.coalesce("doc_id", F.lit(NO_ID)))).withColumn("h", F.xxhash64("text"))
    # At most n numbers, and below one row per range.
    bounds = base.select("neg").agg(F.percentile_approx("neg", [i / n for i in range(1, n)], 1000 * n)).first()[0] or []
    cuts = np.unique(np.array(bounds, np.int64))

    def ranged(neg: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, neg.to_numpy(zero_copy_only=False), "left").astype(np.int32))

    def squeezed(texts: pa.Array) -> pa.Array:
        import zstandard
        z = zstandard.ZstdCompressor(level=5)
        return pa.array([z.compress(x.encode()) for x in texts.to_pylist()], pa.binary())

    base = base.withColumn("range", F.arrow_udf(ranged, "int")("neg"))
    tops = base.groupBy("range").agg(F.min(F.struct("neg", "h")).alias("top")).select("range", "top.*").collect()
    tops.sort()
    before = {r["range"]: tops[i - 1]["range"] for i, r in enumerate(tops)}
    first = spark.createDataFrame([(r["range"], r["neg"], r["h"], before[r["range"]]) for r in tops],
                                  "range int, neg long, h long, before int")
    own = F.struct(F.col("range"), F.lit(False).alias("guest"))
    both = F.when(F.col("before").isNotNull(), F.array(own, F.struct(F.col("before").alias("range"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    rows = base.join(F.broadcast(first), ["range", "neg", "h"], "left").select(
        F.explode(both).alias("to"), "neg", "h", "doc_id", F.arrow_udf(squeezed, "binary")("text").alias("packed"))
    rows = rows.select("to.range", "to.guest", "neg", "h", "doc_id", "packed").repartition(n // 4, "range")
    return rows.sortWithinPartitions("range", "guest", "neg", "h").mapInArrow(lambda b: _compared(b, share), COMPARED)


def _compared(batches, share, limit=words.CHUNK // 2):
    """Rows sorted by range: each distinct document with the one after it."""
    import hashlib
    import zstandard
    unpacked = zstandard.ZstdDecompressor().decompress
    held, pairs, size = None, [], 0  # held: range, key, ids, text

    def flush():
        nonlocal pairs, size
        old, nexts = [p[1] for p in pairs], [p[2] for p in pairs]
        cut = [len(t) - len(t) // share for t in old]
        edited = [t[:c] + x[:len(t) - c] for t, x, c in zip(old, nexts, cut)]
        was, now = revised(old, list(zip(edited, cut)))
        after = _of(nexts)
        near, beside = likeness(was, now), likeness(was, after)
        packed, packed_now = pack(*was), pack(*now)
        out = [(i, len(old[k]), hashlib.sha256(edited[k].encode()).hexdigest(), packed[k], packed_now[k], float(near[k]), float(beside[k]))
               for k, (ids, _, _) in enumerate(pairs) for i in ids]
        pairs, size = [], 0
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                          names=[x.split()[0] for x in COMPARED.split(", ")])

    for batch in batches:
        for place, guest, neg, h, key, packed in zip(*(batch.column(c).to_pylist() for c in ("range", "guest", "neg", "h", "doc_id", "packed"))):
            if held and held[0] == place and held[1] == (neg, h) and not guest:
                held[2].append(key)
                continue
            text = unpacked(packed).decode()
            if held and held[0] == place:
                pairs.append((held[2], held[3], text))
                size += 3 * len(held[3]) + len(text) + 2000 + 2 * SIZE
                if size >= limit:
                    yield flush()
                    pa.default_memory_pool().release_unused()
            held = None if guest else (place, (neg, h), [key], text)
    if pairs:
        yield flush()


def readable(column):
    return F.arrow_udf(lambda c: text_of(c), "string")(column)
