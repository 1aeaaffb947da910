"""Periodic runs of words in a text by block convolution, and texts without the repeats.

A run is a stretch of words with smallest period q (words q apart are the same) that no neighbouring word
extends, at least `LEAST` words and three periods long. Only runs of such length are sought.

Words are numbered exactly, by dictionary, within their text. At each dyadic scale the text is cut
into blocks of B words. A run with a period from B to 2B - 1 holds a whole block that occurs again one period
later, so the sums of squared differences between a block and the stretches B to 2B - 1 words
after it are taken for all distances at once, by a number-theoretic transform of 2B places; a sum of
0 is an occurrence. The transform is exact: it is taken modulo as many primes as it takes for their
product to be above the largest possible sum. (Periods below 8 are sought with blocks of 8 words.)
Blocks with a word that does not recur at such a distance cannot occur again and are left out.

An occurrence is a seed (block, distance). Seeds of the same distance in adjacent blocks are one
stretch; it goes on for less than a block at both ends, which is compared word by word. Seeds inside a known run
whose period divides their distance show that run again and are left out first; so a text of one
word makes no more work than its length times the number of scales.

Defined cases: null, empty and blank texts have no words, no runs and an empty collapsed text; texts may
be of any length and are whole; repeated rows give the same result each; an empty table gives an empty
result; other columns are kept as a struct, so none can clash.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words

LEAST, TIMES, FIRST = 24, 3, 8
# Primes c * 2 ** k + 1 below 2 ** 31, so that products fit 64 bits.
PRIMES = (2013265921, 1811939329, 469762049)
AREA = 1 << 18  # places of the transforms that are worked on at a time
_tables: dict = {}


def _twiddles(p, n):
    """Powers of a primitive n-th root of unity modulo p, and of its inverse, up to n // 2 each."""
    if (p, n) not in _tables:
        odd = p - 1
        while odd % 2 == 0:
            odd //= 2
        g = next(g for g in range(2, p) if pow(g, (p - 1) // 2, p) != 1)
        root = pow(pow(g, odd, p), ((p - 1) // odd) // n, p)  # a non-residue to the odd part has order 2 ** k
        out = []
        for r in (root, pow(root, -1, p)):
            t, step = np.ones(1, np.uint64), r
            while len(t) < max(1, n // 2):  # doubling: the second half is the first times a power
                t = np.concatenate([t, t * np.uint64(pow(r, len(t), p)) % np.uint64(p)])
            out.append(t)
        _tables[p, n] = out
    return _tables[p, n]


def transform(a, p):
    """Number-theoretic transform of each row, in bit-reversed order; rows are a power of two long."""
    rows, n = a.shape
    q, size = np.uint64(p), n
    while size > 1:
        half = size // 2
        v = a.reshape(rows, n // size, 2, half)
        low, high = v[:, :, 0], v[:, :, 1]
        total, less = low + high, (low + (q - high)) * _twiddles(p, size)[0]
        v[:, :, 0] = np.minimum(total, total - q)  # wraps to something larger if it is below q already
        v[:, :, 1] = less % q
        size = half
    return a


def inverse(a, p):
    """Rows from their transforms."""
    rows, n = a.shape
    q, size = np.uint64(p), 2
    while size <= n:
        half = size // 2
        v = a.reshape(rows, n // size, 2, half)
        low, high = v[:, :, 0].copy(), v[:, :, 1] * _twiddles(p, size)[1] % q
        total, less = low + high, low + (q - high)
        v[:, :, 0], v[:, :, 1] = np.minimum(total, total - q), np.minimum(less, less - q)
        size *= 2
    return a * np.uint64(pow(n, -1, p)) % q


def occurrences(x, blocks, size, low, largest):
    """Pairs (block start, distance) with x[b : b + size] == x[b + d : b + d + size], low <= d < low + size.

    x holds integers from 0 to `largest`, padded by 3 * size places.
    """
    n, bound, primes = 2 * size, size * largest * largest, []
    for p in PRIMES:
        primes.append(p)
        bound //= p
        if not bound:
            break
    else:
        raise ValueError("texts with so many different words need more primes")
    found = []
    for lo in range(0, len(blocks), max(1, AREA // n)):
        b = blocks[lo:lo + max(1, AREA // n)]
        at = b[:, None] + np.arange(n)
        later, block = x[at + low], np.zeros((len(b), n), np.uint64)
        later[:, -1] = 0  # distance low + size is no longer sought
        block[:, 0] = x[b]
        block[:, n - size + 1:] = x[at[:, 1:size]][:, ::-1]
        zero = np.ones((len(b), size), bool)
        for p in primes:
            q = np.uint64(p)
            sums = np.zeros((len(b), n + 1), np.uint64)
            np.cumsum(later * later % q, axis=1, out=sums[:, 1:])
            squares = sums[:, size:2 * size] - sums[:, :size] + (block * block % q).sum(axis=1, keepdims=True)
            both = inverse(transform(block % q, p) * transform(later % q, p) % q, p)[:, :size]
            zero &= squares % q == 2 * both % q
        row, k = np.nonzero(zero)
        d = k + low
        found.append(np.stack([b[row], d])[:, d > 0])
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)


def agreeing(x, a, b, most, step):
    """How many places from a and from b, by steps of `step`, hold the same, up to `most` each."""
    out, live, width = np.zeros(len(a), np.int64), np.flatnonzero(most > 0), 8
    while len(live):
        k = out[live, None] + np.arange(width)
        inside = k < most[live, None]
        k = np.minimum(k, most[live, None] - 1) * step
        same = inside & (x[a[live, None] + k] == x[b[live, None] + k])
        whole = same.all(axis=1)
        out[live] += np.where(whole, width, same.argmin(axis=1))
        live = live[whole]
        width = max(8, min(2 * width, AREA // max(1, len(live))))
    return out


class Known:
    """Runs of one scale, to tell whether a stretch lies in one of them."""

    def __init__(self, start, end, period):
        order = np.argsort(start, kind="stable")
        self.start, self.end, self.period = start[order], end[order], period[order]
        best = np.maximum.accumulate(self.end)
        # Of the runs from the left, the one that reaches furthest.
        self.furthest = np.maximum.accumulate(np.where(self.end == best, np.arange(len(best)), 0))

    def shows(self, start, end, distance):
        if not len(self.start):
            return np.zeros(len(start), bool)
        at = np.searchsorted(self.start, start, "right") - 1
        run = self.furthest[np.maximum(at, 0)]
        return (at >= 0) & (self.end[run] >= end) & (distance % self.period[run] == 0)


def find(label, first):
    """Runs (start, end, period) of texts whose words are the ranges of `first`; `label` numbers the
    different words of each text, apart from those of other texts, in ascending order of texts."""
    total = len(label)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    base = np.zeros(len(counts), np.int64)  # labels of a text start here
    some = counts > 0
    if total:
        base[some] = np.minimum.reduceat(label, first[:-1][some])
    x = np.zeros(total, np.uint64)
    x[:] = (label - base[doc]).astype(np.uint64)
    order = np.argsort(label, kind="stable")
    places = label[order] * (total + 1) + order
    end_of = first[1:]
    known, size, low = [], FIRST, 0
    while True:
        long = np.flatnonzero(counts >= max(LEAST, TIMES * max(low, 1)))
        if not len(long):
            break
        each = counts[long] // size
        owner = np.repeat(long, each)
        b = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)) * size
        b = b[b + size + max(low, 1) <= end_of[owner]]
        for j in range(min(size, 16)):  # the words of a block must recur, each at a distance that is sought
            key = label[b + j] * (total + 1) + b + j + max(low, 1)
            at = np.searchsorted(places, key)
            b = b[(at < total) & (places[np.minimum(at, total - 1)] < key + low + size - max(low, 1))]
            if not len(b):
                break
        if len(b):
            padded = np.concatenate([x, np.zeros(3 * size + 1, np.uint64)])
            seeds = occurrences(padded, b, size, low, int(x[np.isin(doc, np.unique(doc[b]))].max()))
            seeds = seeds[:, seeds.sum(axis=0) + size <= end_of[doc[seeds[0]]]]
            for k in known:
                seeds = seeds[:, ~k.shows(seeds[0], seeds.sum(axis=0) + size, seeds[1])]
            known.append(Known(*_stretches(label, seeds, size, doc, first)))
        size, low = (size if low == 0 else 2 * size), (size if low == 0 else 2 * size)
    if not known:
        return [np.zeros(0, np.int64)] * 3
    start, end, period = (np.concatenate([getattr(k, c) for k in known]) for c in ("start", "end", "period"))
    ok = end - start >= LEAST
    return _smallest(start[ok], end[ok], period[ok])


def _smallest(start, end, period):
    """Of equal stretches, that with the smallest period."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


def _stretches(label, seeds, size, doc, first):
    """Stretches of three periods or more that follow from seeds."""
    b, d = seeds[:, np.lexsort((seeds[0], seeds[1]))]
    begins = np.ones(len(b), bool)
    begins[1:] = (b[1:] != b[:-1] + size) | (d[1:] != d[:-1])
    a = b[begins]
    z = b[np.append(np.flatnonzero(begins)[1:], len(b)) - 1] + size if len(b) else b
    d = d[begins]
    left = agreeing(label, a - 1, a - 1 + d, np.minimum(size, a - first[doc[a]]), -1)
    right = agreeing(label, z, z + d, np.minimum(size, first[doc[a] + 1] - d - z), 1)
    start, end = a - left, z + right + d
    ok = end - start >= TIMES * d
    return _smallest(start[ok], end[ok], d[ok])


def labels(w: words.Words, data):
    """Numbers of the words of a batch, the same within a text for equal words only."""
    ids = words.numbered(w, data)
    return np.unique(w.doc * (len(ids) + 1) + ids, return_inverse=True)[1]


RESULT = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def described(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each row of docs as a struct `row`; n_words; runs (start, length, period) by start, then period;
    `collapsed`, the words but those that repeat within a run after its first period, joined by one space."""
    def task(column: pa.Array) -> pa.Array:
        done = []
        for some in words.pieces(pa.RecordBatch.from_arrays([column], names=["text"]), "text"):
            data, offs = words.buffer(some.column("text"))
            w = words.Words(data, offs, lower=False)
            start, end, period = find(labels(w, data), w.first)
            depth = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(depth, start + period, 1)
            np.subtract.at(depth, end, 1)
            kept = np.cumsum(depth[:-1]) == 0
            collapsed = words.joined(data, w.start[kept], w.end[kept], w.doc[kept], w.rows)
            owner = w.doc[start]
            order = np.lexsort((period, start))
            runs = pa.StructArray.from_arrays([pa.array(v[order]) for v in (start - w.first[owner], end - start, period)],
                                              names=["start", "length", "period"])
            cuts = np.searchsorted(owner[order], np.arange(w.rows + 1)).astype(np.int32)
            done.append(pa.StructArray.from_arrays([pa.array(w.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(cuts), runs), collapsed],
                                                   names=["n_words", "runs", "collapsed"]))
        empty = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
                           ("collapsed", pa.string())])
        return pa.concat_arrays(done) if done else pa.array([], empty)

    made = F.arrow_udf(task, RESULT)(F.col(text).cast("string"))
    return docs.select(F.struct("*").alias("row"), made.alias("r")).select("row", "r.*")


def strongest(runs):
    """The run with the greatest length / period, compared exactly; of equal ones the first, then the shortest period."""
    def better(x, y):
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        return (a > b) | ((a == b) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))

    return F.reduce(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, F.lit(0)),
                    lambda best, r: F.when(better(r, best), r).otherwise(best))
