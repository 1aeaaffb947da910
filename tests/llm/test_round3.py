"""Merkle manifest, periodic runs, factors, and strings that sum hashes confuse, against brute force."""
import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shapeloom.llm import factors, fingerprints, merkle, neardup, runs, suffixes, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, key string, did string, row string, spans string"


def docs_of(spark, rows):
    """Documents with columns whose names clash with inner ones; rows are (id, text) or (id, text, source)."""
    full = [(r[0], r[1], "en" if r[0] and r[0] % 2 else None, r[2] if len(r) > 2 else None, len(r[1]) if r[1] else None, "x", "y", "z", "w", "v")
            for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


# --- manifest ------------------------------------------------------------------------------------

def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """Levels of a tree, from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, place):
    """(left, right) siblings of a leaf on every level."""
    out = []
    for level in levels[:-1]:
        run = place // 16 * 16
        out.append(("".join(level[run:place]), "".join(level[place + 1:run + 16])))
        place //= 16
    return out


def manifest_by_hand(rows, tampered):
    """rows (id, source, leaf text fields...) sorted as the operator sorts them."""
    by = collections.defaultdict(list)
    for i, source, fields, low in rows:
        leaf = sha("".join(map(field, fields)))
        now = sha("".join(map(field, low))) if tampered(i) else None
        by[source].append(((i is not None, i or 0), leaf, (now is not None, now or ""), i, now))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: tree([r[1] for r in sorted(by[s])]) for s in sources}
    top = tree([levels[s][-1][0] for s in sources])
    out = collections.Counter()
    for k, s in enumerate(sources):
        for place, (_, leaf, _, i, now) in enumerate(sorted(by[s])):
            steps = way(levels[s], place) + way(top, k)
            h = now or leaf
            for left, right in steps:
                h = sha(left + h + right)
            out[i, leaf, levels[s][-1][0], top[-1][0], "".join(a + b for a, b in steps), h] += 1
    return out


def climbed(docs):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("group"), merkle.leaf_hash(*fields, F.col("text")).alias("leaf"),
                         F.when(hit, merkle.leaf_hash(*fields, F.lower("text"))).alias("now"))
    return merkle.climb(merkle.build(leaves))


@pytest.mark.parametrize("case", ["many", "one source", "lone rows", "one row"])
def test_manifest(spark, case):
    rng = random.Random(5)
    if case == "many":
        rows = [(i, f"Text {i} É", rng.choice(["a", "b", "ä", "a", None])) for i in range(700)] + [(10_000 + i, "x", f"s{i}") for i in range(20)]
        rows += [(3, "Again", "a"), (3, "Again", "a"), (3, None, "a"), (None, "No id", "a"), (None, None, None), (5, "", ""), (6, "B" * 50_000, "b")]
    else:
        rows = {"one source": [(i, "A", "s") for i in range(300)], "lone rows": [(i, "A", f"s{i}") for i in range(40)],
                "one row": [(4, "A", None)]}[case]
    docs = docs_of(spark, rows)
    hand = [(r.doc_id, r.source, [r.doc_id, r.source, r.lang, r.n_chars, r.text],
             [r.doc_id, r.source, r.lang, r.n_chars, r.text and r.text.lower()]) for r in docs.collect()]
    want = manifest_by_hand(hand, lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
    got = climbed(docs)
    assert got.columns == ["id", "leaf", "subroot", "root", "siblings", "folded_root"]
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert spark.conf.get("spark.sql.cteRecursionRowLimit", None) != "-1"


def test_manifest_of_nothing(spark):
    assert climbed(docs_of(spark, [])).collect() == []


# --- runs ----------------------------------------------------------------------------------------

def runs_by_hand(w):
    n, seen = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(24, 3 * q) and i > s:
                seen.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in seen.items())


def stretches(rng):
    out = []
    for _ in range(rng.randint(0, 7)):
        v = rng.choice([1, 2, 3, 50])
        block = [f"w{rng.randrange(v)}" for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 40, 64]))]
        out += (block * rng.randint(1, 6))[:rng.randint(1, 200)] if rng.random() < 0.7 else [f"w{rng.randrange(v)}" for _ in range(rng.randint(1, 60))]
    return out


def test_runs(spark):
    rng = random.Random(2)
    texts = [" ".join(stretches(rng)) for _ in range(250)] + [None, "", " \n\t ", "one", "a " * 24, "a " * 23, "B b " * 12, "é  " * 30]
    texts += ["x y z " * 20_000, " ".join(f"u{i}" for i in range(5000)), "same " * 50_000, " ".join(["r", "s"] * 30 + ["r", "r"] * 30)]
    docs = docs_of(spark, [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[3])])
    got = runs.described(docs).withColumn("best", runs.strongest(F.col("runs"))).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = r.row.text
        w = split(t)
        found = [tuple(x) for x in r.runs]
        if len(w) < 4000:
            assert found == runs_by_hand(w)
        drop = {i for s, n, q in found for i in range(s + q, s + n)}
        assert r.n_words == len(w) and r.collapsed == " ".join(x for i, x in enumerate(w) if i not in drop)
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if found else None
        assert (tuple(r.best) if r.best else None) == best
    assert {tuple(r.runs[0]) for r in got if r.row.text and r.row.text.startswith("same")} == {(0, 50_000, 1)}
    assert runs.described(docs.limit(0)).count() == 0


def test_transforms_are_exact():
    rng = np.random.default_rng(1)
    for p in runs.PRIMES:
        a, b = (rng.integers(0, p, (3, 32)).astype(np.uint64) for _ in range(2))
        got = runs.inverse(runs.transform(a.copy(), p) * runs.transform(b.copy(), p) % np.uint64(p), p)
        for row in range(3):
            want = [sum(int(a[row, i]) * int(b[row, (k - i) % 32]) for i in range(32)) % p for k in range(32)]
            assert got[row].tolist() == want
    # Differences whose squares add up to multiples of a prime are no occurrences.
    x = np.zeros(64, np.uint64)
    x[40] = 44870  # 44870 ** 2 is just above the first prime
    assert 12 not in runs.occurrences(x, np.array([0]), 8, 8, 2**30)[1].tolist() or (x[0:8] == x[12:20]).all()
    with pytest.raises(ValueError):
        runs.occurrences(x, np.array([0]), 8, 8, 2**60)


# --- factors -------------------------------------------------------------------------------------

def cut_by_hand(rows, width):
    ws = [split(t) for _, t in rows]
    count = collections.Counter(tuple(w[i:i + width]) for w in ws for i in range(len(w) - width + 1))
    out = collections.Counter()
    for (i, _), w in zip(rows, ws):
        drop = {k for j in range(len(w) - width + 1) if count[tuple(w[j:j + width])] > 1 for k in range(j, j + width)}
        out[i, len(w), len(drop), " ".join(x for k, x in enumerate(w) if k not in drop)] += 1
    return out


@pytest.mark.parametrize("width,block", [(35, 8000), (6, 5)])
def test_factors(spark, width, block):
    rng = random.Random(width)
    say = lambda n, v=3000: [f"w{rng.randrange(v)}" for _ in range(n)]
    shared, base = [say(90) for _ in range(4)], say(120)
    rows = [(1, None), (2, ""), (3, " \t"), (4, "few words"), (None, " ".join(say(50))), (None, None)]
    for i in range(60):
        t = say(rng.randint(0, 200))
        at = rng.randint(0, len(t))
        rows.append((10 + i, "  ".join(t[:at] + rng.choice(shared)[rng.randint(0, 20):] + t[at:])))
    for i in range(60):  # near copies: one key has many different pieces
        t = list(base)
        for _ in range(3):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10 ** 6)}"
        rows.append((100 + i, " ".join(t)))
    rows += [(200, " ".join(say(30_000))), (201, "again " * 500), (202, " ".join(say(40, 2)))]
    rows += [rows[10], rows[10], (300, rows[20][1]), (301, rows[8][1].upper())]
    docs = docs_of(spark, rows)
    got = factors.cleaned(docs, width=width, block=block).collect()
    assert collections.Counter((r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == cut_by_hand(rows, width)
    cut = factors.removed(docs, width=width)
    assert cut.columns == docs.columns and {r.doc_id for r in cut.filter("text is null").collect()} == {1, None}
    assert factors.cleaned(docs.limit(0)).count() == 0


def test_greedy_factors():
    first = np.array([0, 4, 9])
    length = np.array([2, 1, 0, 1, 5, 4, 3, 2, 1])
    start, size = factors.parsed(length, first)
    assert sorted(zip(start.tolist(), size.tolist())) == [(0, 2), (2, 1), (3, 1), (4, 5)]
    piece, lo, hi = factors.repeated(length, first, 3)
    covered = {(p, k) for p, a, b in zip(piece, lo, hi) for k in range(a, b)}
    assert covered == {(1, k) for k in range(5)}


# --- strings with equal sums ----------------------------------------------------------------------

def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_strings_that_sums_confuse(spark):
    other = str.maketrans("ab", "ba")
    pairs = [(thue_morse(n), thue_morse(n).translate(other)) for n in (256, 1024, 4096)]
    for x, y in pairs:
        w = words.Words(*words.buffer(pa.array([x, y])))
        assert w.hash[0] != w.hash[1]
        a, b = (fingerprints.vectors(*words.buffer(pa.array([t]))) for t in (x, y))
        assert (a[0] != b[0]).all() and fingerprints.likeness(a, b)[0] < 1
    texts = dict(enumerate(t for p in pairs for t in p))
    docs = docs_of(spark, texts.items())
    assert all(r.kept for r in neardup.groups(docs).collect())
    windows = collections.Counter(t[i:i + 200] for p in pairs for t in p for i in range(len(t) - 199))
    for r in suffixes.cleaned(docs).collect():
        t = texts[r.row.doc_id]
        drop = {k for i in range(len(t) - 199) if windows[t[i:i + 200]] > 1 for k in range(i, i + 200)}
        assert r.kept.decode() == "".join(c for k, c in enumerate(t) if k not in drop)


def test_large_group_whose_members_are_close_to_a_few(spark):
    """Three hundred edits of one text, pairwise below the threshold; most are linked to the text alone or to nothing."""
    rng, n = random.Random(9), 150
    base = [f"w{i}" for i in range(n)]
    rows = [(1000, " ".join(base))]
    for i in range(300):
        t = list(base)
        for _ in range(rng.choice([1, 2, 2, 3, 4])):
            t[rng.randrange(n)] = f"e{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(t)))
    sets = {i: frozenset(tuple(t.split()[k:k + 5]) for k in range(n - 4)) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in neardup.groups(docs_of(spark, rows)).collect()}
    assert got == {i: top(i) for i in sets}


def test_one_frequent_key_with_many_contents(spark):
    """A gram that stands in many different surroundings: equal strings still meet."""
    rng = random.Random(1)
    core = "".join(rng.choice("klmnop") for _ in range(150))
    side = [["".join(rng.choice("abcdef") for _ in range(120)) for _ in range(4)] for _ in range(2)]
    rows = [(i, rng.choice(side[0]) + str(i) * 3 + core + rng.choice(side[1]) + "".join(rng.choice("xyz") for _ in range(80))) for i in range(80)]
    windows = collections.Counter(t[i:i + 200] for _, t in rows for i in range(len(t) - 199))
    for r in suffixes.cleaned(docs_of(spark, rows), shard=3).collect():
        t = dict(rows)[r.row.doc_id]
        drop = {k for i in range(len(t) - 199) if windows[t[i:i + 200]] > 1 for k in range(i, i + 200)}
        assert r.kept.decode() == "".join(c for k, c in enumerate(t) if k not in drop) and r.n_removed == len(drop)


def test_fingerprints_of_the_lowest_id(spark):
    rows = [(-(1 << 63), "lowest"), ((1 << 63) - 1, "highest"), (0, "zero")]
    got = {r.doc_id: r for r in fingerprints.compare_with_next(docs_of(spark, rows)).collect()}
    order = ["highest", "zero", "lowest"]
    for (i, t), nxt in zip([(rows[1][0], "highest"), (0, "zero"), (rows[0][0], "lowest")], order[1:] + order[:1]):
        edited = t[:len(t) - len(t) // 3] + nxt[:len(t) // 3]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
