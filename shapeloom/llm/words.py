"""Whole-batch word splitting and hashing with numpy.

Texts of an Arrow batch lie in one byte buffer; boundaries, hashes and shingles of all its words
are computed at once. Word separators are the ASCII blanks, so splitting bytes splits characters.
"""
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
# All ASCII characters but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
CHUNK = 1 << 18  # bytes of text at a time; the work arrays take about a hundred times as much
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h):
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
STEP = mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)


def powers(n):
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i up to n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((BASE, INVERSE)):
            p = np.full(max(n, CHUNK) + 1, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def eights(data):
    """The eight bytes from each place on as an integer; beyond the end they are 0."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hashed(data, start, end, seed=0):
    """64-bit hashes of the bytes in [start, end), eight at a time, each mixed in turn."""
    v, size = eights(data), (end - start).astype(np.int64)
    h = mix(size.astype(np.uint64) * STEP[0] + STEP[1] + np.uint64(seed) * STEP[2])
    live, at = np.flatnonzero(size > 0), start
    k = 0
    while len(live):
        left = size[live] - k
        some = v[at[live] + k]
        short = left < 8
        some[short] &= (np.uint64(1) << (np.uint64(8) * left[short].astype(np.uint64))) - np.uint64(1)
        h[live] = mix((h[live] ^ some) * STEP[3] + STEP[4])
        live = live[~short & (left > 8)]
        k += 8
    return h


def buffer(col):
    """Bytes and int64 offsets of a string or binary array; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    elif pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, pa.scalar(b"", col.type))
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    offs = np.frombuffer(col.buffers()[1], kind)[col.offset:col.offset + len(col) + 1].astype(np.int64) \
        if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def give_back():
    """Return free memory to the system: workers live on between tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def pieces(batch, name, limit=CHUNK):
    """Slices of a record batch with about `limit` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    _, offs = buffer(batch.column(name))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield batch.slice(lo, min(hi, batch.num_rows) - lo)
        lo = min(hi, batch.num_rows)
    give_back()


class Words:
    """Words of a batch of texts: `start`, `end` (bytes), `doc` (row) and a 64-bit `hash` each."""

    def __init__(self, data, offs, lower=True, blank=SEPARATOR):
        data = LOWER[data] if lower else data
        n = len(data)
        solid = np.empty(n + 2, bool)
        solid[0] = solid[-1] = False
        solid[1:-1] = ~blank[data]
        cut = np.zeros(n + 1, bool)
        cut[offs] = True
        inside = solid[1:-1]
        self.start = np.flatnonzero(inside & (~solid[:-2] | cut[:-1]))
        self.end = np.flatnonzero(inside & (~solid[2:] | cut[1:])) + 1
        self.doc = np.searchsorted(offs, self.start, "right") - 1
        self.data, self.sums = data, None
        self.hash = hashed(data, self.start, self.end)
        self.rows = len(offs) - 1
        self.counts = np.bincount(self.doc, minlength=self.rows)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def span(self, start, end):
        """Sum hash of the bytes in [start, end), wherever they stand; for buckets of a model, where
        collisions do no harm: some different strings have equal sums, so it cannot tell strings apart."""
        if self.sums is None:
            self.up, self.down = powers(len(self.data))
            self.sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(BYTE[self.data] * self.up[:len(self.data)], out=self.sums[1:])
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def shingles(self, size=5):
        """Rows and hashes of all runs of `size` words; a shorter text is one run of all its words."""
        h, doc, n = self.hash, self.doc, len(self.hash)
        full = max(0, n - size + 1)
        keep = doc[:full] == doc[size - 1:size - 1 + full] if full else np.zeros(0, bool)
        total = np.zeros(full, np.uint64)
        for k in range(size):
            total += h[k:k + full] * STEP[k]
        rows, out = doc[:full][keep], mix(total[keep])
        short = np.flatnonzero((self.counts > 0) & (self.counts < size))
        if len(short):
            part = np.zeros(len(short), np.uint64)
            for k in range(size - 1):
                has = self.counts[short] > k
                part[has] += h[self.first[short[has]] + k] * STEP[k]
            extra = mix(part + self.counts[short].astype(np.uint64) * STEP[6])
            rows, out = np.concatenate([rows, short]), np.concatenate([out, extra])
        return rows, out

    def sets(self, size=5):
        """Offsets per row and the sorted distinct shingles of each row."""
        rows, h = self.shingles(size)
        order = np.lexsort((h, rows))
        rows, h = rows[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        rows, h = rows[new], h[new]
        return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=self.rows))]).astype(np.int64), h


def of(batch, name, lower=True, blank=SEPARATOR):
    return Words(*buffer(batch.column(name)), lower=lower, blank=blank)


def joined(data, start, end, doc, rows):
    """Strings of the words [start, end) of each row, in order, joined by one space."""
    last = np.ones(len(start), bool)
    last[:-1] = doc[1:] != doc[:-1]
    size = end - start + ~last
    cuts = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    at = np.arange(int(cuts[-1])) + np.repeat(start - cuts[:-1], size)
    at[(cuts[1:] - 1)[~last]] = len(data)
    out = np.append(data, np.uint8(0x20))[at]
    offs = np.concatenate([[0], np.cumsum(np.bincount(doc, size, rows))]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(offs), pa.py_buffer(out)]).cast(pa.string())


def numbered(w, data):
    """A number for each word, the same for equal words only."""
    size = w.end - w.start
    offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    bytes_ = data[np.arange(int(offs[-1])) + np.repeat(w.start - offs[:-1], size)]
    column = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offs), pa.py_buffer(bytes_)])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
