"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words (runs of letters, digits and non-ASCII characters, A-Z lower-cased)
and their first 4, 5 and 6 bytes, hashed into `buckets`; a term counts once per text. The machine
    score = sigmoid(w0 + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2))
learns linear weights and k factors per term, so pairs of terms that are toxic only together count.

It is fitted on a bounded sample: at most `sample` labelled rows, those of the smallest hashes of
their ids, equal texts once. Terms are those that separate the labels on their own (at most `terms`, the
clearest), and of the `frequent` terms in most texts those that do in a pair: texts with both terms are toxic
clearly more, or clearly less, often than texts with either. Scoring reads whole texts of all documents; labels, lang, source and doc_id are no input.

Defined cases: a null or empty text has no terms and scores sigmoid(w0); without labels of both
kinds the score is the smoothed share of toxic rows; null labels are ignored, of repeated ones the
larger counts; other columns pass through.
"""
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words
from .common import saved

PREFIXES = (4, 5, 6)
KIND = words.mix(np.arange(11, 15, dtype=np.uint64))


@dataclass
class Model:
    buckets: int
    ids: np.ndarray      # buckets in use, ascending
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, rows, at, n):
        """Probabilities of n texts from pairs (text, place in ids)."""
        linear = self.bias + np.bincount(rows, self.weights[at], n)
        pair = np.zeros(n)
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            pair += np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n)
        return 1 / (1 + np.exp(-np.clip(linear + pair / 2, -30, 30)))


def terms_of(array, buckets):
    """Pairs (row, bucket) of a string array, each once."""
    w = words.Words(*words.buffer(array), blank=words.PUNCTUATION)
    rows, found = [w.doc], [w.span(w.start, w.end) + KIND[3]]
    size = w.end - w.start
    for k, n in enumerate(PREFIXES):
        long = size > n
        rows.append(w.doc[long])
        found.append(w.span(w.start[long], w.start[long] + n) + KIND[k])
    rows = np.concatenate(rows)
    bucket = (words.mix(np.concatenate(found)) % np.uint64(buckets)).astype(np.int64)
    both = np.unique(rows.astype(np.int64) * buckets + bucket)
    return both // buckets, both % buckets


def chosen(array, model_ids, buckets):
    """Pairs (row, place in model_ids) of the terms that the model knows."""
    rows, found = terms_of(array, buckets)
    if not len(model_ids):
        return rows[:0], rows[:0]
    at = np.minimum(np.searchsorted(model_ids, found), len(model_ids) - 1)
    ok = model_ids[at] == found
    return rows[ok], at[ok]


def sampled(docs: DataFrame, labels: DataFrame, learn, sample: int, doc_id="doc_id", text="text", label="toxic"):
    """At most `sample` labelled texts (text, y) among the rows where `learn` holds."""
    known = (labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).filter("y is not null and doc_id is not null")
             .filter(learn).groupBy("doc_id").agg(F.max("y").alias("y"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    # `known` has at most `sample` rows, a bound that does not grow.
    rows = texts.join(F.broadcast(known), "doc_id").filter("text is not null")
    return rows.groupBy(F.md5("text").alias("m")).agg(F.first("text").alias("text"), F.max("y").alias("y")).select("text", "y")


SIDE = 2048  # terms of one side of a grouped pair count


def _counts(y, a, b, m, step=1 << 20):
    """Texts with term i on the left and j on the right, and toxic ones among them: yields i from, i to, both [., m], bad.

    `y` says which texts are toxic; `a` and `b` are (text, term) pairs in ascending order of texts.
    """
    first = np.searchsorted(b[0], np.arange(len(y) + 1))
    for lo in range(0, m, 512):
        rows, left = a[0][chosen := (a[1] >= lo) & (a[1] < lo + 512)], a[1][chosen] - lo
        count = first[rows + 1] - first[rows]
        both, bad = np.zeros(512 * m, np.int64), np.zeros(512 * m, np.int64)
        ends = np.concatenate([[0], np.cumsum(count)])
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + step, "right")) - 1)
            n = count[at:to]
            right = np.arange(n.sum()) + np.repeat(first[rows[at:to]] - (np.cumsum(n) - n), n)
            code = np.repeat(left[at:to].astype(np.int64) * m, n) + b[1][right]
            both += np.bincount(code, minlength=len(both))
            bad += np.bincount(code[np.repeat(y[rows[at:to]], n)], minlength=len(both))
            at = to
        yield lo, min(lo + 512, m), both.reshape(512, m)[:min(512, m - lo)], bad.reshape(512, m)[:min(512, m - lo)]


def differs(both, bad, p, evidence):
    """1 or -1 where the share of toxic texts is above or below p, by chance only with a probability below
    exp(-evidence) by Chernoff's bound, which holds for small counts too."""
    q = bad / np.maximum(both, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.where(q > 0, q * np.log(q / p), 0) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - p)), 0)
    return np.where(both * far >= evidence, np.sign(q - p), 0)


def paired(marks: DataFrame, share, evidence: float = 20.0) -> DataFrame:
    """Places `at` of the terms that are in a pair that separates the labels, from texts (y, at: the
    places of its terms, ascending 32-bit integers in binary); `share` is each term's share of toxic texts.

    A pair counts if its share of toxic texts differs clearly from those of both terms to the same side. Pairs
    are counted in groups of two ranges of SIDE terms; a group holds the sample's terms of these ranges.
    """
    m = len(share)
    sides = range(-(-m // SIDE))

    def dealt(batches):
        for batch in batches:
            out = [[] for _ in range(4)]
            for y, at in zip(batch.column("y").to_pylist(), batch.column("at").to_pylist()):
                t = np.frombuffer(at, "<i4")
                cut = np.searchsorted(t, [SIDE * k for k in range(len(sides) + 1)])
                part = [t[x:z].tobytes() for x, z in zip(cut, cut[1:])]
                for i in sides:
                    for j in sides[i:]:
                        if part[i] and part[j]:
                            for c, v in zip(out, (i * len(sides) + j, y, part[i], part[j])):
                                c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                                             names=["pair", "y", "a", "b"])

    def verdicts(key, group):
        i, j = divmod(key[0].as_py(), len(sides))
        y = group.column("y").to_numpy() > 0

        def flat(name, side):
            parts = [np.frombuffer(x.as_buffer(), "<i4") for x in group.column(name)]
            rows = np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in parts])
            return rows, np.concatenate(parts) - np.int32(SIDE * side)

        left, right = share[SIDE * i:SIDE * (i + 1)], share[SIDE * j:SIDE * (j + 1)]
        found = np.zeros((2, SIDE), bool)
        for lo, hi, both, bad in _counts(y, flat("a", i), flat("b", j), max(len(left), len(right))):
            hi, both, bad = min(hi, len(left)), both[:len(left) - lo, :len(right)], bad[:len(left) - lo, :len(right)]
            if hi <= lo:
                break
            one = differs(both, bad, left[lo:hi, None], evidence)
            hit = (one != 0) & (one == differs(both, bad, right[None, :], evidence))
            found[0, lo:hi] |= hit.any(axis=1)
            found[1, :len(right)] |= hit.any(axis=0)
        at = np.union1d(np.flatnonzero(found[0]) + SIDE * i, np.flatnonzero(found[1]) + SIDE * j)
        words.give_back()
        return pa.table({"at": pa.array(at.astype(np.int64))})

    return marks.mapInArrow(dealt, "pair int, y int, a binary, b binary").groupBy("pair").applyInArrow(verdicts, "at long").distinct()


def fit(docs: DataFrame, labels: DataFrame, learn=None, sample: int = 20_000, terms: int = 4096, frequent: int = 8192, buckets: int = 1 << 20,
        factors: int = 4, epochs: int = 20, rate: float = 0.2, decay: float = 1e-3, seed: int = 7, doc_id="doc_id",
        text="text", label="toxic") -> Model:
    """Fit on the sample, which is saved once. Terms and pairs are counted on executors; the machine itself is
    fitted on the driver, from the kept terms of at most `sample` texts (a few hundred each)."""
    learn = F.lit(True) if learn is None else learn
    rows = saved(sampled(docs, labels, learn, sample, doc_id, text, label), "sample")

    def tally(batches):
        for batch in batches:
            for some in words.pieces(batch, "text"):
                r, b = terms_of(some.column("text"), buckets)
                y = some.column("y").to_numpy(zero_copy_only=False)[r] > 0
                seen, at = np.unique(b, return_inverse=True)
                pos = np.bincount(at, y, len(seen)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(seen), "pos": pa.array(pos),
                                                  "neg": pa.array(np.bincount(at, minlength=len(seen)) - pos)})

    total = rows.agg(F.sum("y").cast("long").alias("pos"), F.count("*").alias("n")).first()
    pos, n = total["pos"] or 0, total["n"]
    bias = float(np.log((pos + 0.5) / (n - pos + 1.5)))
    nothing = Model(buckets, np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, factors)))
    if not pos or pos == n:
        return nothing
    counts = rows.mapInArrow(tally, "bucket long, pos long, neg long").groupBy("bucket").agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("q")).filter("p + q >= 3")
    a, b = F.col("p") + 0.5, F.col("q") + 0.5
    c, d = F.lit(pos) - F.col("p") + 0.5, F.lit(n - pos) - F.col("q") + 0.5
    odds = F.log(a * d / (b * c))
    clear = F.abs(odds) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    counts = saved(counts.select("bucket", "p", (F.col("p") + F.col("q")).alias("n"), odds.alias("odds"), clear.alias("clear")), "terms")
    top = (counts.filter((F.abs("odds") >= float(np.log(3))) & (F.col("clear") >= 2.5))
           .orderBy(F.desc("clear"), "bucket").limit(terms).select("bucket").collect())
    most = counts.orderBy(F.desc("n"), "bucket").limit(frequent).select("bucket").collect()
    alone = np.array(sorted(r["bucket"] for r in top), np.int64)
    ids = np.union1d(alone, np.array([r["bucket"] for r in most], np.int64))
    if not len(ids):
        return nothing

    def marks(batches):
        for batch in batches:
            for some in words.pieces(batch, "text"):
                r, at = chosen(some.column("text"), ids, buckets)
                cuts = np.searchsorted(r, np.arange(some.num_rows + 1))
                yield pa.RecordBatch.from_pydict({
                    "y": some.column("y").cast(pa.int32()),
                    "at": pa.array([at[x:z].astype("<i4").tobytes() for x, z in zip(cuts, cuts[1:])], pa.binary())})

    marked = saved(rows.mapInArrow(marks, "y int, at binary"), "marks")
    # Shares of the terms in use: at most terms + frequent numbers.
    shares = {r["bucket"]: (r["p"] + 0.5) / (r["n"] + 1) for r in counts.join(
        F.broadcast(docs.sparkSession.createDataFrame([(int(i),) for i in ids], "b long")), F.col("bucket") == F.col("b")).select("bucket", "p", "n").collect()}
    share = np.array([shares[i] for i in ids.tolist()])
    keep = np.isin(ids, alone)
    keep[[r["at"] for r in paired(marked, share).collect()]] = True
    if not keep.any():
        return nothing
    place = (np.cumsum(keep) - 1).astype(np.int32)

    def chosen_only(batches):
        for batch in batches:
            t = [np.frombuffer(x.as_buffer(), "<i4") for x in batch.column("at")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([place[x[keep[x]]].tobytes() for x in t], pa.binary())], names=["y", "at"])

    got = marked.mapInArrow(chosen_only, "y int, at binary").toArrow()
    got = sorted(zip(got.column("y").to_pylist(), got.column("at").to_pylist()))
    y = np.array([r[0] > 0 for r in got], float)
    return train([np.frombuffer(r[1], "<i4") for r in got], y, ids[keep], buckets, factors, epochs, rate, decay, seed, bias)


def train(sets, y, ids, buckets, factors, epochs, rate, decay, seed, bias) -> Model:
    """Adaptive gradient steps on mini-batches of the logistic loss."""
    rng = np.random.default_rng(seed)
    m = len(ids)
    w, v = np.zeros(m), rng.normal(0, 0.05, (m, factors))
    sw, sv, sb = np.full(m, 1e-6), np.full((m, factors), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(sets))
        for lo in range(0, len(order), 256):
            some = order[lo:lo + 256]
            n, at = len(some), np.concatenate([sets[i] for i in some])
            rows = np.repeat(np.arange(n), [len(sets[i]) for i in some])
            model = Model(buckets, ids, bias, w, v)
            g = (model.score(rows, at, n) - y[some]) / n
            gb = g.sum()
            sb += gb * gb
            bias -= rate * gb / np.sqrt(sb)
            gw = np.bincount(at, g[rows], m)
            hit = np.bincount(at, minlength=m) > 0
            gw[hit] += decay * w[hit] / n
            sw += gw * gw
            w = w - rate * gw / np.sqrt(sw)
            for f in range(factors):
                one = v[at, f]
                total = np.bincount(rows, one, n)[rows]
                gf = np.bincount(at, g[rows] * (total - one), m)
                gf[hit] += decay * v[hit, f] / n
                sv[:, f] += gf * gf
                v[:, f] -= rate / 4 * gf / np.sqrt(sv[:, f])
    return Model(buckets, ids, float(bias), w, v)


def scores(model: Model, text):
    """Column of scores of a text column."""
    def score(column: pa.Array) -> pa.Array:
        out = []
        for some in words.pieces(pa.RecordBatch.from_arrays([column], names=["text"]), "text"):
            rows, at = chosen(some.column("text"), model.ids, model.buckets)
            out.append(model.score(rows, at, some.num_rows))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return F.arrow_udf(score, "double")(text)


def scored(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """docs with a column of scores, which takes the place of one of the same name."""
    return docs.withColumn(column, scores(model, F.col(text).cast("string")))
