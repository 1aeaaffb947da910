"""Exact removal of repeated strings with sharded, externally sorted suffix arrays.

Every byte covered by a `width`-byte string that starts anywhere else too is removed, judged on the
whole input. Texts are cut into pieces first: consecutive windows of `width` bytes whose smallest
hashed gram stands at the same place form a piece, and the gram's hash is its key. Equal windows
have equal keys, so shards by key lose no match, and a key that occurs once holds none. Of all
other pieces each different one goes to a shard once, with weight two if it occurs again. Pieces of one text that
follow each other and whose keys have no other content travel as one string. In each shard external induced
sorting (`induced`) gives suffix order and common prefixes; a window is repeated if the prefix it shares with a neighbour
is `width` long or its own weight is two. Spans return to all occurrences of their pieces.

Pieces are counted with partial aggregates of a few numbers each; a frequent passage is one piece. Strings
travel packed, many to a row. A shard is streamed into a file-backed string and sorted with bounded memory; that
file and the queue's belong to the task and go with it, and the task starts anew elsewhere if it is lost.

Defined cases: a null text is empty; matches never cross texts; repeated rows repeat each other, so
all are removed where `width` bytes or longer; equal windows all go, none of them is kept; a null doc_id is a
document like others; texts may be of any length; an empty table gives an empty result; other columns pass
through `cleaned`.
"""
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import induced, words
from .common import dropped, expanded, identified, saved, squeezed

WIDTH, GRAM, MEMORY = 200, 64, 128 << 20
SHARD = 2_000  # different pieces of a shard, about
PLACE = np.uint64((1 << 30) - 1)


def sliding_least(a, w):
    """min(a[i : i + w]) for every i."""
    n = len(a)
    padded = np.full(-(-n // w) * w + w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = a
    blocks = padded.reshape(-1, w)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    return np.minimum(after[:n], before[w - 1:w - 1 + n])


def grams_of(data, gram):
    """Hash of the `gram` bytes from each place on: of eight, then of twice as many from two halves."""
    n, size = len(data), min(gram, 8)
    v = words.eights(data)[:n] & (~np.uint64(0) >> np.uint64(64 - 8 * size))
    v = words.mix(v * words.STEP[1] + words.STEP[0])[:n - size + 1]
    while size < gram:
        step = min(size, gram - size)  # the halves overlap in the last round, if need be
        v = words.mix(v[:-step] * words.STEP[2] + (v[step:] ^ words.STEP[3]))
        size += step
    return v


def pieces_of(data, offs, width=WIDTH, gram=GRAM):
    """Pieces of a buffer of texts: row, start (in the buffer), number of windows, key, content hash."""
    rows = np.flatnonzero(np.diff(offs) >= width)
    if not len(rows):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    grams = grams_of(data, gram)
    # The place breaks ties towards the left, which equal windows do alike.
    least = sliding_least((grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64), width - gram + 1) & PLACE
    count = offs[rows + 1] - offs[rows] - width + 1
    at = np.arange(count.sum()) + np.repeat(offs[rows] - (np.cumsum(count) - count), count)
    owner, where = np.repeat(rows, count), least[at].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (owner[1:] != owner[:-1])]))
    windows = np.diff(np.append(first, len(at)))
    start = at[first]
    content = words.hashed(data, start, start + windows + width - 1)
    return owner[first], start, windows, words.mix(grams[where[first]]).view(np.int64), content.view(np.int64)


def _pieces(rows: DataFrame, width: int, gram: int) -> DataFrame:
    def task(batches):
        for batch in batches:
            for some in words.pieces(batch, "text"):
                data, offs = words.buffer(some.column("text"))
                row, start, windows, key, content = pieces_of(data, offs, width, gram)
                did, h = (some.column(c).to_numpy() for c in ("did", "h"))
                yield pa.RecordBatch.from_pydict({
                    "did": pa.array(did[row]), "h": pa.array(h[row]), "start": pa.array(start - offs[row]),
                    "windows": pa.array(windows.astype(np.int32)), "key": pa.array(key), "content": pa.array(content)})

    return rows.mapInArrow(task, "did long, h long, start long, windows int, key long, content long")


# A string: the pieces in it, from which window on each begins, how many windows it has, whether it occurs again.
STRING = pa.schema([("keys", pa.list_(pa.int64())), ("contents", pa.list_(pa.int64())), ("at", pa.list_(pa.int64())),
                    ("windows", pa.list_(pa.int64())), ("again", pa.bool_()), ("text", pa.binary())])


def _strings(rows: DataFrame, wanted: DataFrame, width: int, shards: int, limit: int = 8 << 20) -> DataFrame:
    """Rows (shard, packed): strings of wanted pieces (did, h, start, windows, key, content, again, mixed), packed by shard."""
    def runs_of(ps):
        """Lists of pieces that make a string: one of a mixed key, or all that follow each other."""
        out = []
        for p in sorted(ps, key=lambda p: p["start"]):
            last = out[-1][-1] if out else None
            if last and not p["mixed"] and not last["mixed"] and last["start"] + last["windows"] == p["start"]:
                out[-1].append(p)
            else:
                out.append([p])
        return out

    def task(batches):
        held, size = [], 0

        def packed():
            keys = np.array([h[0][0] for h in held], np.int64)
            shard = (words.mix(keys.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            ids, cuts = np.unique(shard[order], return_index=True)
            out = []
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                sink = pa.BufferOutputStream()
                columns = [pa.array(c, f.type) for c, f in zip(zip(*(held[i] for i in order[a:b])), STRING)]
                with pa.ipc.new_stream(sink, STRING, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
                    f.write_batch(pa.RecordBatch.from_arrays(columns, schema=STRING))
                out.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out, pa.binary())], names=["shard", "packed"])

        for batch in batches:
            for some in words.pieces(batch, "packed", words.CHUNK // 3):
                data, offs = words.buffer(expanded(some.column("packed")))
                for i, ps in enumerate(some.column("ps").to_pylist()):
                    for run in runs_of(ps):
                        a, z = run[0]["start"], run[-1]["start"] + run[-1]["windows"] + width - 1
                        held.append(([p["key"] for p in run], [p["content"] for p in run], [p["start"] - a for p in run],
                                     [p["windows"] for p in run], run[0]["again"], data[offs[i] + a:offs[i] + z].tobytes()))
                        size += z - a
                if size > limit:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    by = wanted.groupBy(F.col("did").alias("d"), F.col("h").alias("hh")).agg(
        F.collect_list(F.struct("start", "windows", "key", "content", "again", "mixed")).alias("ps"))
    rows = rows.select("did", "h", squeezed(F.col("text")).alias("packed"))
    return (rows.join(by, (F.col("did") == F.col("d")) & (F.col("h") == F.col("hh"))).select("ps", "packed")
            .mapInArrow(task, "shard long, packed binary"))


def repeated_windows(strings, width, memory):
    """Starts of the windows, over the joined strings, that occur more than once in a shard.

    `strings` yields the pieces; they are joined in a file, separated by 0, with bytes from 1 on.
    """
    with tempfile.TemporaryFile() as f:
        size, ends = 0, []
        for s in strings:
            f.write((np.frombuffer(s, np.uint8).astype(np.uint16) + 1).tobytes() + b"\0\0")
            size += len(s) + 1
            ends.append(size - 1)
        f.flush()
        if not size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        t = np.memmap(f, np.uint16, "r", shape=(size,)) if 2 * size > memory else np.fromfile(_rewound(f), np.uint16)
        order, shared = induced.sort_suffixes(t, width, memory)
    hit = shared >= width
    hit[:-1] |= hit[1:]
    at = np.sort(order[hit].astype(np.int64))
    ends = np.array(ends, np.int64)
    return at[at + width <= ends[np.searchsorted(ends, at)]], ends  # a window lies within one piece


def _rewound(f):
    f.seek(0)
    return f


def _repeats(strings: DataFrame, width: int, memory: int) -> DataFrame:
    """Repeated spans (k, c, spans) of the pieces of each shard, relative to the piece."""
    def of_shard(packed):
        tables = [pa.ipc.open_stream(p).read_all() for p in packed]
        t = pa.concat_tables(tables).combine_chunks()
        twice = np.flatnonzero(t.column("again").to_numpy())
        at, ends = repeated_windows((memoryview(x.as_buffer()) for x in t.column("text")), width, memory)
        begin = np.concatenate([[0], ends[:-1] + 1])
        # Weight two: all windows of the string occur in its copy too.
        count = ends[twice] - begin[twice] - width + 1
        weighted = np.arange(count.sum()) + np.repeat(begin[twice] - (np.cumsum(count) - count), count)
        at = np.union1d(at, weighted)
        column = lambda name: t.column(name).combine_chunks()
        lengths = column("keys").value_lengths().to_numpy()
        keys, contents, inner, windows = (column(c).flatten().to_numpy() for c in ("keys", "contents", "at", "windows"))
        start = np.repeat(begin, lengths) + inner
        piece = np.searchsorted(start, at, "right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1 if len(at) else first
        owner = piece[first]
        some, cuts = np.unique(owner, return_index=True)
        spans = pa.StructArray.from_arrays([pa.array((at[first] - start[owner]).astype(np.int64)), pa.array((at[last] - start[owner] + width).astype(np.int64))],
                                           names=["lo", "hi"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(owner)).astype(np.int32)), spans)
        return pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(contents[some]), lists], names=["k", "c", "spans"])

    def task(batches):
        shard, held = None, []
        for batch in batches:
            for s, p in zip(batch.column("shard").to_pylist(), batch.column("packed")):
                if s != shard and held:
                    yield of_shard(held)
                    held = []
                    words.give_back()
                shard = s
                held.append(p.as_py())
        if held:
            yield of_shard(held)

    # Sorting takes long, so its tasks are smaller than those of other steps.
    n = 4 * int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return strings.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(
        task, "k long, c long, spans array<struct<lo:bigint,hi:bigint>>")


def spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, memory: int = MEMORY, doc_id: str = "doc_id",
          text: str = "text", shard: int = SHARD) -> DataFrame:
    """Repeated spans [lo, hi) of bytes, overlapping still, per document (did, h)."""
    rows = identified(docs, doc_id, text)
    keys = saved(_pieces(rows, width, gram).groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n")).filter("n > 1").select("k"),
                 "keys", tidy=True)
    found = saved(_pieces(rows, width, gram).join(keys, F.col("key") == F.col("k"), "left_semi"), "pieces", tidy=True)
    dropped(keys)
    # A struct's maximum names one occurrence of each piece.
    per = saved(found.groupBy("key", "content").agg(F.count("*").alias("n"), F.max(F.struct("did", "h", "start", "windows")).alias("one")),
                "distinct-pieces", tidy=True)
    mixed = saved(per.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select(F.col("key").alias("k")), "mixed-keys")
    wanted = per.join(mixed, F.col("key") == F.col("k"), "left").select(
        "key", "content", (F.col("n") > 1).alias("again"), F.col("k").isNotNull().alias("mixed"), "one.*")
    strings = saved(_strings(rows, wanted, width, per.count() // shard + 1), "strings", tidy=True)
    dropped(per)
    dropped(mixed)
    repeats = saved(_repeats(strings, width, memory), "repeats", tidy=True)
    dropped(strings)
    each = found.join(repeats, (F.col("key") == F.col("k")) & (F.col("content") == F.col("c"))).select(
        "did", "h", F.explode(F.transform("spans", lambda s: F.struct(
            (F.col("start") + s["lo"]).alias("lo"), (F.col("start") + s["hi"]).alias("hi")))).alias("s"))
    out = saved(each.groupBy("did", "h").agg(F.collect_list("s").alias("spans")), "spans", tidy=True)
    dropped(found)
    dropped(repeats)
    return out


def cleaned(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, memory: int = MEMORY, doc_id: str = "doc_id",
            text: str = "text", shard: int = SHARD) -> DataFrame:
    """Each row of docs: its other columns as a struct `row`, whether the text `was_null`, the remaining
    bytes `kept`, n_bytes, n_removed, n_spans. Texts are shuffled once here, compressed."""
    by = spans(docs, width, gram, memory, doc_id, text, shard)
    rows = identified(docs, doc_id, text, F.struct(*[c for c in docs.columns if c != text]).alias("row"), F.col(text).isNull().alias("was_null"))
    rows = rows.withColumn("packed", squeezed(F.col("text"))).drop("text").join(by, ["did", "h"], "left")

    def cut(packed: pa.Array, spans_: pa.Array) -> pa.Array:
        kept, sizes, gone, runs = [], [], [], []
        data, offs = words.buffer(expanded(packed))
        texts = packed
        flat = spans_.flatten()
        lo, hi = (flat.field(k).to_numpy() for k in ("lo", "hi"))
        ends = np.concatenate([[0], np.cumsum(spans_.fill_null([]).value_lengths().to_numpy())])
        for i in range(len(texts)):
            one = data[offs[i]:offs[i + 1]]
            sizes.append(len(one))
            a, b = lo[ends[i]:ends[i + 1]], hi[ends[i]:ends[i + 1]]
            if not len(a):
                kept.append(one.tobytes())
                gone.append(0)
                runs.append(0)
                continue
            cover = np.zeros(len(one) + 1, np.int64)
            np.add.at(cover, a, 1)
            np.subtract.at(cover, b, 1)
            out = np.cumsum(cover[:-1]) > 0
            kept.append(one[~out].tobytes())
            gone.append(int(out.sum()))
            runs.append(int(out[0]) + int((out[1:] & ~out[:-1]).sum()))
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()),
                                           pa.array(runs, pa.int64())], names=["kept", "n_bytes", "n_removed", "n_spans"])

    made = F.arrow_udf(cut, "struct<kept:binary,n_bytes:bigint,n_removed:bigint,n_spans:bigint>")
    return rows.withColumn("c", made("packed", "spans")).select("row", "was_null", "c.*")


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with their texts cut; where a cut leaves broken characters, those bytes go too."""
    def whole(kept: pa.Array) -> pa.Array:
        return pa.array([b.decode("utf-8", "ignore") for b in kept.to_pylist()], pa.string())

    out = cleaned(docs, doc_id=doc_id, text=text, **options)
    new = F.when(~F.col("was_null"), F.arrow_udf(whole, "string")("kept"))
    return out.select(*[new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
