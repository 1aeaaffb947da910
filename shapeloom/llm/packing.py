"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Bins are chosen on the histogram of piece lengths, which has at most `size` entries whatever the
corpus holds: a bin is filled greedily with the longest pieces that fit; then its smallest piece is
replaced by two unpacked pieces if they fill the widened gap better. The same bin is made as often
as the histogram allows before the next one is looked for. The plan says which run of each
length's pieces goes to which bins; pieces take their place in it by their rank among equals, which
comes from per-task counts. So nothing but the histogram and one count per task and length crosses
to the driver, and no length, however frequent, meets in one task.

Defined cases: a null text is empty and gives the end mark alone; a longer document is cut into
pieces of `size`, its first piece the shorter one; repeated rows are packed as rows of their own; a
null doc_id stays null; other columns are ignored; an empty table packs to an empty one.
"""
import json
import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from . import words
from .common import saved

PIECES = "doc_id long, piece int, start long, length long, ids binary, part long, row long"


def added_tokens(tokenizer: str) -> dict[str, int]:
    """Literals of the tokens that a tokenizer file adds to its vocabulary, with their ids."""
    with open(tokenizer, encoding="utf-8") as f:
        return {a["content"]: a["id"] for a in json.load(f).get("added_tokens") or []}


def byte_ranks(tokenizer: str) -> dict[bytes, int] | None:
    """Ranks of a tokenizer file, if it is plain byte-level BPE whose ids follow its merges and whose
    added tokens take nothing but themselves."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and not any(model.get(k) for k in (
        "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        and not spec.get("normalizer"))
    added = spec.get("added_tokens") or []
    if not plain or any(a.get(k) for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return None
    # Byte-level files write each byte as a printable character: itself, or one from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"]["".join(m)] for m in pairs]
    if ids != sorted(ids) or len(set(ids)) + 256 != len(model["vocab"]):
        return None
    return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()}


def encoder(tokenizer: str, pattern: str | None):
    """texts -> lists of ids, as the tokenizers library gives them without adding special tokens; where a
    text itself holds the literal of an added token, that is its id.

    Plain byte-level BPE runs in the tiktoken library with the file's own vocabulary, which gives
    the same ids five times faster; `pattern` is the split that such files imply. Any other file, or
    no pattern, runs in the tokenizers library.
    """
    if pattern and (ranks := byte_ranks(tokenizer)) is not None:
        import tiktoken
        added = added_tokens(tokenizer)
        made = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        plain = made.encode_ordinary  # knows no added tokens
        return lambda texts: [made.encode(t, allowed_special="all") if any(a in t for a in added) else plain(t) for t in texts]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(tokenizer)
    return lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]


def tokenised(docs: DataFrame, tokenizer: str, size: int, end: int = 0, doc_id: str = "doc_id",
              text: str = "text", pattern: str | None = None) -> DataFrame:
    """Pieces of at most `size` ids (little-endian unsigned 32-bit), numbered by task and row."""
    def task(batches):
        from pyspark import TaskContext
        encode, part, row = encoder(tokenizer, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in words.pieces(batch, "text", 1 << 20):
                keys, cols = some.column("doc_id").to_pylist(), [[] for _ in range(7)]
                for key, one in zip(keys, encode([t or "" for t in some.column("text").to_pylist()])):
                    ids = np.array([*one, end], "<u4")
                    first = (len(ids) - 1) % size + 1
                    cuts = [0, *range(first, len(ids) + 1, size)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        for c, v in zip(cols, (key, k, a, b - a, ids[a:b].tobytes(), part, row)):
                            c.append(v)
                        row += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(task, PIECES)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Runs (how often, lengths in the bin) that use up every piece of the histogram."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= size:
            raise ValueError(f"a piece of {length} does not fit a sequence of {size}")
        left[length] = n
    runs = []
    largest = size
    while True:
        while largest and not left[largest]:
            largest -= 1
        if not largest:
            return runs
        have = np.flatnonzero(left)  # lengths still there, ascending
        used, gap = {}, size
        while True:
            at = int(np.searchsorted(have, gap, "right")) - 1
            while at >= 0 and left[have[at]] <= used.get(int(have[at]), 0):
                at -= 1
            if at < 0:
                break
            one = int(have[at])
            take = min(gap // one, int(left[one]) - used.get(one, 0))
            used[one] = used.get(one, 0) + take
            gap -= take * one
        if gap and sum(used.values()) > 1:
            smallest = min(used)
            used[smallest] -= 1
            pair = best_two(left, used, have, gap + smallest, smallest)
            for one in pair or (smallest,):
                used[one] = used.get(one, 0) + 1
            used = {k: n for k, n in used.items() if n}
        times = min(int(left[k]) // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
        runs.append((times, [k for k in sorted(used, reverse=True) for _ in range(used[k])]))


def best_two(left, used, have, room, least):
    """Two unpacked lengths of the largest sum in (least, room], or None."""
    free = have[[left[k] > used.get(int(k), 0) for k in have]]
    if not len(free):
        return None
    mate = np.searchsorted(free, room - free, "right") - 1
    ok = mate >= 0
    total = np.where(ok, free + free[np.maximum(mate, 0)], -1)
    for i in np.argsort(-total, kind="stable"):
        a, b = int(free[i]), int(free[max(mate[i], 0)])
        if total[i] <= least:
            return None
        if a != b or left[a] - used.get(a, 0) >= 2:
            return a, b
    return None


def placements(runs) -> pd.DataFrame:
    """Per length and run: the ranks of the pieces it takes and where they go.

    The r-th piece of a length, with rank in [low, low + times * each), goes to bin
    bin + (rank - low) // each, at offset + ((rank - low) % each) * length.
    """
    rows, seen, bins = [], {}, 0
    for times, lengths in runs:
        offset = 0
        for length in dict.fromkeys(lengths):
            each = lengths.count(length)
            rows.append((length, seen.get(length, 0), each, bins, offset))
            seen[length] = seen.get(length, 0) + times * each
            offset += each * length
        bins += times
    return pd.DataFrame(rows, columns=["length", "low", "each", "bin", "offset"]).astype("int64")


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0, doc_id: str = "doc_id",
         text: str = "text", pattern: str | None = None) -> DataFrame:
    """Pieces with their ids, `sequence_id` and `offset`: doc_id, piece, start, length, ids, …"""
    pieces = saved(tokenised(docs, tokenizer, size, end, doc_id, text, pattern), "pieces")
    counts = saved(pieces.groupBy("part", "length").count(), "piece-counts")
    # At most `size` rows.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    where = placements(plan(histogram, size))
    before = counts.select("part", "length", F.coalesce(F.sum("count").over(
        W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # Rank within a task and length: tasks hold a bounded share of the input, and no ids travel.
    local = W.partitionBy("part", "length").orderBy("row")
    ranks = (pieces.select("part", "row", "length").withColumn("rank", F.row_number().over(local) - 1)
             .join(before.hint("merge"), ["part", "length"])
             .select("part", "row", F.col("length").alias("l"), (F.col("rank") + F.col("before")).alias("rank")))
    low, length = where["low"].to_numpy(), where["length"].to_numpy()
    order = np.lexsort((low, length))
    table = {k: where[k].to_numpy()[order] for k in where}
    firsts = np.searchsorted(table["length"], np.arange(size + 2))

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            l, rank = b.column("l").to_numpy(), b.column("rank").to_numpy()
            run = np.empty(len(l), np.int64)
            for one in np.unique(l):
                lo, hi, mine = firsts[one], firsts[one + 1], l == one
                run[mine] = lo + np.searchsorted(table["low"][lo:hi], rank[mine], "right") - 1
            past, each = rank - table["low"][run], table["each"][run]
            yield pa.RecordBatch.from_pydict({
                "part": b.column("part"), "row": b.column("row"),
                "sequence_id": pa.array(table["bin"][run] + past // each),
                "offset": pa.array(table["offset"][run] + past % each * l)})

    placed = ranks.mapInArrow(place, "part long, row long, sequence_id long, offset long")
    return pieces.join(placed, ["part", "row"]).select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ids, and where each document's piece begins."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(
        F.struct("offset", "length", "doc_id", "piece", "ids"))).alias("p"))
    return parts.select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> a || x.ids)").alias("ids"),
                        F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"),
                                                            x["offset"].alias("offset"), x["length"].alias("length"))).alias("pieces"))
