"""Byte-level BPE over distinct words, shuffled globally.

Each task splits its texts into pre-tokens. Texts of about `block` bytes form a block: its distinct
words are numbered, and the pre-tokens of all its texts become the numbers of their words in order
of position. The words are dealt over buckets by hash; a bucket gathers the words of all blocks and
encodes each distinct one once. The ids return to the blocks, and a block's texts are put together
by position. Words, positions and ids travel packed, a row per block and bucket, as one row for
each word and block took more than twice the disk. Decoding gathers from the token-byte table, which the
vocabulary bounds.

A word costs a block one entry, however often it stands there, so a frequent one is no hot key.
Blocks are numbered by task and stored, and later steps read the stored rows.

Defined cases: a null text is empty and has no ids; repeated rows and null ids stay as they are;
texts may be of any length; an empty table gives an empty result; other columns are ignored.
"""
import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import words
from .common import saved

BLOCK = 16 << 20
KINDS = "block long, bucket int, packed binary, doc_ids array<long>, counts array<int>, buckets binary"


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: always join the pair of lowest rank, the leftmost of equals.

    Pairs wait in a heap with a linked list of parts, so long words take n log n steps.
    """
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) <= 64:
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]
    import heapq
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive, heap = [True] * n, []

    def offer(i):
        j = after[i]
        if j < n and (r := ranks.get(word[i:end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != stop or end[i] == stop:
            continue
        j = after[i]
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = after[i]
    return out


def _squeezed(a) -> bytes:
    """Numbers, most of them small: one byte each, and the rest of those from 255 on in byte planes."""
    import zstandard
    a = np.asarray(a, np.int64)
    rest = (a[a >= 255] - 255).astype("<u4")
    planes = np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 4).T)
    low = zstandard.compress(np.minimum(a, 255).astype(np.uint8).tobytes(), 9)
    return len(low).to_bytes(4, "little") + low + zstandard.compress(planes.tobytes(), 9)


def _expanded(b: bytes):
    import zstandard
    n = 4 + int.from_bytes(b[:4], "little")
    a = np.frombuffer(zstandard.decompress(b[4:n]), np.uint8).astype(np.int64)
    planes = np.frombuffer(zstandard.decompress(b[n:]), np.uint8).reshape(4, -1)
    a[a == 255] += np.ascontiguousarray(planes.T).reshape(-1).view("<u4")
    return a


def _runs(parts: list[bytes]) -> bytes:
    """Byte strings as one: their lengths and their bytes."""
    import zstandard
    return (len(parts).to_bytes(4, "little") + zstandard.compress(
        np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts), 12))


def _unrun(packed: bytes):
    import zstandard
    n, data = int.from_bytes(packed[:4], "little"), zstandard.decompress(packed[4:])
    ends = np.cumsum(np.frombuffer(data[:4 * n], "<u4"))
    return data[4 * n:], ends


def _split(docs: DataFrame, pattern: str, block: int, buckets: int, doc_id: str, text: str) -> DataFrame:
    """A row per block (ids and lengths of its texts, numbers of their words, bucket of each word) and
    one per block and bucket (the words)."""
    def task(batches):
        from pyspark import TaskContext
        import regex
        find, part, serial = regex.compile(pattern).findall, TaskContext.get().partitionId(), 0

        def flush(ids, texts, numbers):
            nonlocal serial
            name = (part << 32) + serial
            serial += 1
            spelled = [w.encode() for w in numbers]
            all_ = np.concatenate(texts) if texts else np.zeros(0, np.int64)
            # Frequent words get the small numbers.
            order = np.argsort(-np.bincount(all_, minlength=len(spelled)), kind="stable")
            rank = np.empty(len(spelled), np.int64)
            rank[order] = np.arange(len(spelled))
            spelled = [spelled[i] for i in order]
            home = np.array([zlib.crc32(w) % buckets for w in spelled], np.int64)
            by = np.argsort(home, kind="stable")
            cuts = np.searchsorted(home[by], np.arange(buckets + 1))
            used = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
            n = len(used)
            return pa.RecordBatch.from_arrays([
                pa.array([name] * (n + 1), pa.int64()), pa.array([None, *used], pa.int32()),
                pa.array([_squeezed(rank[all_]), *(_runs([spelled[i] for i in by[cuts[k]:cuts[k + 1]]]) for k in used)], pa.binary()),
                pa.array([ids, *[None] * n], pa.list_(pa.int64())),
                pa.array([[len(t) for t in texts], *[None] * n], pa.list_(pa.int32())),
                pa.array([_squeezed(home), *[None] * n], pa.binary())], names=[x.split()[0] for x in KINDS.split(", ")])

        ids, texts, numbers, size = [], [], {}, 0
        for batch in batches:
            for some in words.pieces(batch, "text"):
                for key, t in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist()):
                    ids.append(key)
                    texts.append(np.array([numbers.setdefault(w, len(numbers)) for w in find(t)] if t else [], np.int32))
                    size += 16 + len(t or "")
                    if size >= block:
                        yield flush(ids, texts, numbers)
                        ids, texts, numbers, size = [], [], {}, 0
        if ids:
            yield flush(ids, texts, numbers)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(task, KINDS)


def encode(docs: DataFrame, ranks_path: str, pattern: str, block: int = BLOCK, doc_id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """doc_id and `ids`, little-endian unsigned 32-bit, of every text."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = saved(_split(docs, pattern, block, buckets, doc_id, text), "pretokens")

    def once(key, table):
        ranks, known, counts, out = ranks_of(ranks_path), {}, [], []
        for packed in table.column("packed").to_pylist():
            data, ends = _unrun(packed)
            found, at = [], 0
            for end in ends.tolist():
                w = data[at:end]
                at = end
                if (ids := known.get(w)) is None:
                    ids = known[w] = np.array(merge(w, ranks), "<u4").tobytes()
                found.append(ids)
            size = np.array([len(i) // 4 for i in found])
            counts.append(len(found))
            out.append(_squeezed(np.concatenate([size, np.frombuffer(b"".join(found), "<u4")])))
        return pa.table({"block": table.column("block").cast(pa.int64()), "bucket": table.column("bucket").cast(pa.int32()),
                         "n": pa.array(counts, pa.int32()),
                         "ids": pa.array(out, pa.binary())})

    spelled = rows.filter("bucket is not null").select("block", "bucket", "packed")
    back = spelled.groupBy("bucket").applyInArrow(once, "block long, bucket int, n int, ids binary")
    texts = rows.filter("bucket is null").select(F.col("block").alias("home"), "packed", "doc_ids", "counts", "buckets")

    def together(key, texts, back):
        names, out = [], []
        for t in texts.to_pylist():
            parts = [(_expanded(i), n) for _, n, i in sorted(zip(*(back.column(c).to_pylist() for c in ("bucket", "n", "ids"))))]
            home = _expanded(t["buckets"])
            size, first = np.zeros(len(home), np.int64), np.zeros(len(home), np.int64)
            order = np.argsort(home, kind="stable")  # words by bucket, as they were dealt
            got = np.concatenate([p[:n] for p, n in parts]) if parts else np.zeros(0, np.int64)
            flat = np.concatenate([p[n:] for p, n in parts]).astype("<u4") if parts else np.zeros(0, "<u4")
            size[order], first[order] = got, np.cumsum(got) - got
            numbers, ends = _expanded(t["packed"]), np.cumsum([0, *t["counts"]])
            for k, d in enumerate(t["doc_ids"]):
                names.append(d)
                out.append(gathered(flat, first, size, numbers[ends[k]:ends[k + 1]]).tobytes())
        return pa.table({"doc_id": pa.array(names, pa.int64()), "ids": pa.array(out, pa.binary())})

    return texts.groupBy("home").cogroup(back.groupBy("block")).applyInArrow(together, "doc_id long, ids binary")


def gathered(flat, first, size, numbers):
    """Runs flat[first[k]:first[k] + size[k]] for every k of numbers, one after the other."""
    n = size[numbers]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[numbers] - (ends - n), n)
    return flat[at]


def token_table(spark: SparkSession, ranks_path: str) -> DataFrame:
    """Token ids and their bytes."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in ranks_of(ranks_path).items()], "id long, bytes binary")


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """Add `decoded`, the bytes of each row's ids, by the token-byte table; unknown ids are refused."""
    names = [f"{k} {v}" for k, v in encoded.dtypes]

    def task(batches):
        ranks = ranks_of(ranks_path)
        size = np.full(max(ranks.values(), default=-1) + 1, -1, np.int64)
        spelled = [b""] * len(size)
        for b, i in ranks.items():
            spelled[i], size[i] = b, len(b)
        flat = np.frombuffer(b"".join(spelled), np.uint8)
        first = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])[:-1]
        for batch in batches:
            for some in words.pieces(batch, ids, 1 << 20):
                data, offs = words.buffer(some.column(ids))
                tokens = np.ascontiguousarray(data).view("<u4").astype(np.int64)
                if len(tokens) and (tokens.max() >= len(size) or (size[tokens] < 0).any()):
                    raise ValueError("an id outside the vocabulary")
                text = gathered(flat, first, size, tokens)
                ends = np.concatenate([[0], np.cumsum(size[tokens])])[offs // 4]
                out = [text[a:b].tobytes() for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(out, pa.binary())],
                                                 names=[*some.schema.names, "decoded"])

    return encoded.mapInArrow(task, ", ".join([*names, "decoded binary"]))
