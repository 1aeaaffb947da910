"""Removal of repeated runs of words by relative Lempel-Ziv parsing.

Every word covered by a window of `width` words that starts anywhere else too is removed, judged on the whole
input. Texts are cut into pieces first: consecutive windows whose smallest hashed gram of `GRAM` words stands at
the same place form a piece, and the gram's hash is its key. Equal windows have equal keys. Pieces of a
key that occurs once hold no match and go no further. All others are dealt by key into reference
blocks, each different piece once with a flag whether it occurs again: a block holds all that its
pieces could match, so every text is factored against every block that could match it.

A block is indexed by its suffix order and common prefixes, over exact numbers of its words. Each piece is
parsed greedily: the longest prefix of the rest that occurs elsewhere in the block is a factor, or one
word if none does. Factors of `width` words or more are repeated spans; a window that crosses the end of a factor
could still occur elsewhere as a whole, so such windows are looked up in the index. Any other window lies in a
shorter factor and cannot occur again, as the factor would be longer. Spans return to all occurrences by key and content.

Pieces are shuffled a few numbers each; copies are counted before they are; the words of different pieces
travel packed, many to a row. The number of blocks follows the number of different pieces, so a block takes
bounded memory, unless the different pieces of one key are more than that: they stay together.

Defined cases: a null text has no words; matches never cross texts; repeated rows repeat each other, so all
their windows are removed; a null doc_id is a document like others; texts may be of any length and are whole; an empty
table gives an empty result; other columns are kept as a struct, so none can clash.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import induced, words
from .common import dropped, expanded, identified, saved, squeezed
from .suffixes import sliding_least

WIDTH, GRAM = 35, 4
PLACE = np.uint64((1 << 30) - 1)
BLOCK = 8_000  # different pieces of a reference block, about


def pieces_of(w: words.Words, width=WIDTH, gram=GRAM):
    """Pieces of a batch of texts: row, first word (in the batch), number of windows, key, content hash."""
    rows = np.flatnonzero(w.counts >= width)
    if not len(rows):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    n = len(w.hash)
    total = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        total = words.mix(total + w.hash[k:n - gram + 1 + k] * words.STEP[k])
    # The place breaks ties towards the left, which equal windows do alike.
    least = sliding_least((total & ~PLACE) | np.arange(len(total), dtype=np.uint64), width - gram + 1) & PLACE
    count = w.counts[rows] - width + 1
    at = np.arange(count.sum()) + np.repeat(w.first[rows] - (np.cumsum(count) - count), count)
    owner, where = np.repeat(rows, count), least[at].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (owner[1:] != owner[:-1])]))
    windows = np.diff(np.append(new, len(at)))
    start = at[new]
    content = words.mix(windows.astype(np.uint64))
    live, k = np.arange(len(start)), 0
    while len(live):
        content[live] = words.mix((content[live] ^ w.hash[start[live] + k]) * words.STEP[5] + words.STEP[6])
        k += 1
        live = live[windows[live] + width - 1 > k]
    return owner[new], start, windows, total[where[new]].view(np.int64), content.view(np.int64)


def _pieces(rows: DataFrame, width: int) -> DataFrame:
    def task(batches):
        for batch in batches:
            for some in words.pieces(batch, "text"):
                w = words.of(some, "text", lower=False)
                row, start, windows, key, content = pieces_of(w, width)
                did, h = (some.column(c).to_numpy() for c in ("did", "h"))
                yield pa.RecordBatch.from_pydict({
                    "did": pa.array(did[row]), "h": pa.array(h[row]), "start": pa.array((start - w.first[row]).astype(np.int32)),
                    "windows": pa.array(windows.astype(np.int32)), "key": pa.array(key), "content": pa.array(content)})

    return rows.mapInArrow(task, "did long, h long, start int, windows int, key long, content long")


PACKED = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("again", pa.bool_()), ("piece", pa.binary())])


def _dealt(rows: DataFrame, wanted: DataFrame, width: int, blocks: int, limit: int = 8 << 20) -> DataFrame:
    """Rows (block, packed): the words of wanted pieces (did, h, start, windows, key, content, again), packed by block."""
    def task(batches):
        held, size = [], 0

        def packed():
            t = pa.Table.from_batches(held)
            block = (words.mix(t.column("key").to_numpy().view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            ids, cuts = np.unique(block[order], return_index=True)
            out = []
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, PACKED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
                    f.write_table(t.take(pa.array(order[a:b])).combine_chunks())
                out.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out, pa.binary())], names=["block", "packed"])

        for batch in batches:
            for some in words.pieces(batch, "packed", words.CHUNK // 3):
                data, offs = words.buffer(expanded(some.column("packed")))
                w = words.Words(data, offs, lower=False)
                ps = some.column("ps")
                row = np.repeat(np.arange(len(ps)), ps.value_lengths().to_numpy(zero_copy_only=False))
                flat = ps.flatten()
                start = flat.field("start").to_numpy() + w.first[row]
                count = flat.field("windows").to_numpy().astype(np.int64) + width - 1
                which = np.repeat(np.arange(len(count)), count)
                at = np.arange(len(which)) + np.repeat(start - (np.cumsum(count) - count), count)
                piece = words.joined(data, w.start[at], w.end[at], which, len(count)).cast(pa.binary())
                held.append(pa.RecordBatch.from_arrays([flat.field("key"), flat.field("content"), flat.field("again"), piece], schema=PACKED))
                size += piece.nbytes
                if size > limit:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    by = wanted.groupBy(F.col("did").alias("d"), F.col("h").alias("hh")).agg(
        F.collect_list(F.struct("start", "windows", "key", "content", "again")).alias("ps"))
    rows = rows.select("did", "h", squeezed(F.col("text")).alias("packed"))
    return (rows.join(by, (F.col("did") == F.col("d")) & (F.col("h") == F.col("hh"))).select("ps", "packed")
            .mapInArrow(task, "block long, packed binary"))


def longest_elsewhere(ids, first, again, depth):
    """For each word of a block's pieces (ranges of `first`): how many words from there on, within its
    piece, occur elsewhere too, and where; `again` marks pieces that have copies outside the block."""
    count = np.diff(first)
    piece = np.repeat(np.arange(len(count)), count)
    n = len(ids) + len(count)
    t = np.empty(n, np.int64)
    own = np.arange(len(ids)) + piece
    t[own] = ids
    ends = first[1:] + np.arange(len(count))
    t[ends] = (ids.max() if len(ids) else 0) + 1 + np.arange(len(count))  # a mark of its own ends each piece
    order, shared = induced.doubled(t, depth)
    after = np.append(shared[1:], 0)
    length, source = np.empty(n, np.int64), np.empty(n, np.int64)
    length[order] = np.maximum(shared, after)
    source[order] = np.where(shared >= after, np.roll(order, 1), np.roll(order, -1))
    rest = first[piece + 1] - np.arange(len(ids))
    length, source = length[own], source[own]
    copied = again[piece]
    source[copied] = own[copied]  # the copy stands where the piece itself does, elsewhere
    return np.where(copied, rest, np.minimum(length, rest)), source


def parsed(length, first):
    """Greedy factors (start, length) of all pieces, each step one factor of every piece not yet done."""
    at, end = first[:-1].copy(), first[1:]
    starts, sizes = [], []
    while True:
        live = np.flatnonzero(at < end)
        if not len(live):
            break
        size = np.maximum(length[at[live]], 1)
        starts.append(at[live].copy())
        sizes.append(size)
        at[live] += size
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(sizes)


def repeated(length, first, width):
    """Spans (piece, lo, hi), relative to the piece, of windows that occur elsewhere too."""
    start, size = parsed(length, first)
    long = size >= width
    lo, hi = [start[long]], [start[long] + size[long]]
    piece_of = lambda at: np.searchsorted(first, at, "right") - 1
    # Windows that cross the end of a factor, looked up one by one.
    bound = start + size
    bound = bound[bound < first[piece_of(start) + 1]]
    begin = first[piece_of(bound)]
    for back in range(1, width):
        at = bound - back
        ok = at >= begin
        at = at[ok]
        hit = at[length[at] >= width]
        lo.append(hit)
        hi.append(hit + length[hit])
    lo, hi = np.concatenate(lo), np.concatenate(hi)
    both = np.unique(np.stack([lo, hi]), axis=1) if len(lo) else np.zeros((2, 0), np.int64)
    piece = piece_of(both[0])
    return piece, both[0] - first[piece], both[1] - first[piece]


def _factored(dealt: DataFrame, width: int) -> DataFrame:
    """Spans (key, content, spans) of the pieces of each block."""
    def of_block(packed):
        t = pa.concat_tables(pa.ipc.open_stream(p).read_all() for p in packed).combine_chunks()
        data, offs = words.buffer(t.column("piece"))
        w = words.Words(data, offs, lower=False)
        length, _ = longest_elsewhere(words.numbered(w, data), w.first, t.column("again").to_numpy(), 2 * width)
        piece, lo, hi = repeated(length, w.first, width)
        some, cuts = np.unique(piece, return_index=True)
        spans = pa.StructArray.from_arrays([pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["lo", "hi"])
        chosen = t.select(["key", "content"]).take(pa.array(some)).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [*(chosen.column(c).combine_chunks() if len(some) else pa.array([], pa.int64()) for c in ("key", "content")),
             pa.ListArray.from_arrays(pa.array(np.append(cuts, len(piece)).astype(np.int32)), spans)],
            names=["k", "c", "spans"])

    def task(batches):
        block, held = None, []
        for batch in batches:
            for b, p in zip(batch.column("block").to_pylist(), batch.column("packed")):
                if b != block and held:
                    yield of_block(held)
                    held = []
                    words.give_back()
                block = b
                held.append(p.as_py())
        if held:
            yield of_block(held)

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "block").sortWithinPartitions("block").mapInArrow(task, "k long, c long, spans array<struct<lo:int,hi:int>>")


def spans(docs: DataFrame, width: int = WIDTH, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Repeated spans [lo, hi) of words, overlapping still, per document (did, h)."""
    rows = identified(docs, doc_id, text)
    keys = saved(_pieces(rows, width).select("key").groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n")).filter("n > 1").select("k"),
                 "keys", tidy=True)
    found = saved(_pieces(rows, width).join(keys, F.col("key") == F.col("k"), "left_semi"), "pieces", tidy=True)
    dropped(keys)
    # A struct's maximum names one occurrence of each piece.
    per = saved(found.groupBy("key", "content").agg(F.count("*").alias("n"), F.max(F.struct("did", "h", "start", "windows")).alias("one"))
                .select("key", "content", (F.col("n") > 1).alias("again"), "one.*"), "distinct-pieces", tidy=True)
    blocks = per.count() // block + 1
    dealt = saved(_dealt(rows, per, width, blocks), "dealt", tidy=True)
    dropped(per)
    repeats = saved(_factored(dealt, width), "repeats", tidy=True)
    dropped(dealt)
    each = found.join(repeats, (F.col("key") == F.col("k")) & (F.col("content") == F.col("c"))).select(
        "did", "h", F.explode(F.transform("spans", lambda s: F.struct(
            (F.col("start") + s["lo"]).alias("lo"), (F.col("start") + s["hi"]).alias("hi")))).alias("s"))
    out = saved(each.groupBy("did", "h").agg(F.collect_list("s").alias("spans")), "spans", tidy=True)
    dropped(found)
    dropped(repeats)
    return out


def cleaned(docs: DataFrame, width: int = WIDTH, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of docs: its other columns as a struct `row`, whether the text `was_null`, the remaining words
    `kept` joined by one space, n_words, n_removed. Texts are shuffled once here, compressed."""
    by = spans(docs, width, block, doc_id, text)
    named = identified(docs, doc_id, text, F.struct(*[c for c in docs.columns if c != text]).alias("row"), F.col(text).isNull().alias("was_null"))
    rows = named.withColumn("packed", squeezed(F.col("text"))).drop("text").join(by, ["did", "h"], "left")

    def cut(packed: pa.Array, spans_: pa.Array) -> pa.Array:
        done, both = [], pa.RecordBatch.from_arrays([packed, spans_], names=["packed", "spans"])
        for some in words.pieces(both, "packed", words.CHUNK // 3):
            data, offs = words.buffer(expanded(some.column("packed")))
            w, lists = words.Words(data, offs, lower=False), some.column("spans")
            row = np.repeat(np.arange(len(lists)), lists.fill_null([]).value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            depth = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(depth, flat.field("lo").to_numpy() + w.first[row], 1)
            np.subtract.at(depth, flat.field("hi").to_numpy() + w.first[row], 1)
            kept = np.cumsum(depth[:-1]) == 0
            text_ = words.joined(data, w.start[kept], w.end[kept], w.doc[kept], w.rows)
            gone = np.bincount(w.doc[~kept], minlength=w.rows)
            done.append(pa.StructArray.from_arrays([text_, pa.array(w.counts.astype(np.int64)), pa.array(gone.astype(np.int64))],
                                                   names=["kept", "n_words", "n_removed"]))
        empty = pa.struct([("kept", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])
        return pa.concat_arrays(done) if done else pa.array([], empty)

    made = F.arrow_udf(cut, "struct<kept:string,n_words:bigint,n_removed:bigint>")
    return rows.withColumn("c", made("packed", "spans")).select("row", "was_null", "c.*")


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with their texts cut; null texts stay null."""
    out = cleaned(docs, doc_id=doc_id, text=text, **options)
    new = F.when(~F.col("was_null"), F.col("kept"))
    return out.select(*[new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
