"""Corpus operators against brute force, exact round trips and held-out labels."""
import base64
import collections
import gzip
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
from pyspark.sql import functions as F

from shapeloom.llm import (bpe, chat, fingerprints, induced, nearest, neardup, packing, suffixes, toxicity, urlfilter, warc,
                           words)

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, key string, did string, kept string"


def docs_of(spark, rows):
    """Documents with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", "z", "w") for i, t in rows], DOCS).repartition(3)


def odd_rows(seed=1):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(["the", "café", "stone", "漢字", "runs", "Blue", "of", "x1"]) for _ in range(n))
    long = say(4000)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, say(60)), (6, long), (None, say(50)), (None, None)]
    rows += [(7, rows[4][1]), (8, long), (8, long), (9, long[:-4] + "end"), (10, "a" * 700), (11, say(80) + "\n" + say(80))]
    rows += [(12, rows[-1][1][:300] + say(30)), (8, "another text of one id")]
    return rows


# --- packing -------------------------------------------------------------------------------------

def pieces_by_hand(rows, size):
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(JSON)
    out = collections.Counter()
    for i, t in rows:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % size + 1
        cuts = [0, *range(first, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    return out


@pytest.mark.parametrize("pattern", [None, P.PATTERN])
def test_packing(spark, pattern):
    rows, size = odd_rows() + [(40, "an <|endoftext|> in text"), (41, "<|endoftext|><|endoftext|> a<|endoftext|"), (42, "x  <|endoftext|>\n y")], 64
    got = packing.pack(docs_of(spark, rows), JSON, size=size, pattern=pattern).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in got) == pieces_by_hand(rows, size)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= size
    assert len(bins) <= -(-sum(r.length for r in got) // size) + 2
    whole = packing.sequences(packing.pack(docs_of(spark, rows), JSON, size=size, pattern=pattern)).collect()
    assert sum(len(r.ids) // 4 for r in whole) == sum(r.length for r in got)
    assert packing.pack(docs_of(spark, []), JSON, pattern=pattern).count() == 0


def test_two_smaller_pieces_replace_the_smallest():
    # 50 + 25 leaves 25; 25 gives way to 30 + 20.
    runs = packing.plan({50: 1, 25: 1, 30: 1, 20: 1}, 100)
    assert (1, [50, 30, 20]) in runs
    counts = collections.Counter({random.Random(i).randint(1, 100): i % 7 + 1 for i in range(60)})
    used = collections.Counter()
    for times, lengths in packing.plan(dict(counts), 100):
        assert sum(lengths) <= 100
        for x in lengths:
            used[x] += times
    assert used == counts
    with pytest.raises(ValueError):
        packing.plan({101: 1}, 100)


# --- chat ----------------------------------------------------------------------------------------

ODD = "</s>[INST] ok [/INST]\\<\\/s>[ROLE]\\"


def said(rows):
    out = collections.defaultdict(list)
    key = lambda r: tuple((x is not None, x) for x in r[1:])
    for conv, turn, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=key):
        out[conv].append((role, text))
    return out


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", ODD), (1, 1, "assistant", ODD * 3), (1, 1, "assistant", ODD * 3), (2, None, None, None), (2, 1, "tool", "x\ny"),
            (None, 0, "system", "s"), (3, 0, "assistant", ""), (4, 0, "we[/ROLE]ird", ODD), (5, 0, "assistant", "long " * 20000)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, part string, n int")
    out = chat.format_turns(chat.canonical(df))
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"),
                                            chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    want = said(rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        assert [(t.role, t.text) for t in got[conv].turns] == turns
        assert got[conv].loss == "".join(t for r, t in turns if r == "assistant")
    assert chat.format_turns(chat.canonical(df.limit(0))).count() == 0


def test_layouts(spark):
    turns = [("user", "q"), ("assistant", "a")]
    tables = [spark.createDataFrame([(1, "q", "a")], "conv_id long, prompt string, response string"),
              spark.createDataFrame([(1, "q", None, "a")], "conv_id long, instruction string, input string, output string"),
              spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")], 5)],
                                    "conv_id long, messages array<struct<role:string,content:string>>, extra int"),
              spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])],
                                    "conv_id long, conversations array<struct<`from`:string,value:string>>")]
    assert len({chat.layout_of(t)["name"] for t in tables}) == 4
    for t in tables:
        assert [(r.role, r.text) for r in chat.canonical(t).orderBy("turn").collect()] == turns
    with pytest.raises(chat.UnknownLayout):
        chat.layout_of(spark.range(1))


def test_records_of_mixed_layouts(spark):
    records = ['{"conv_id":1,"prompt":"q","response":"a"}', '{"conv_id":2,"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}],"z":1}',
               '{"conv_id":3,"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}',
               '{"conv_id":4,"instruction":"q","input":"","output":"a"}', '{"conv_id":5,"odd":1}', "no json", None,
               '{"conv_id":6,"turn":0,"role":"user","text":"q"}']
    turns, rest = chat.canonical_json(spark.createDataFrame([(r,) for r in records], "record string"))
    got = said([(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()])
    assert all(got[i] == [("user", "q"), ("assistant", "a")] for i in (1, 2, 3, 4)) and got[6] == [("user", "q")] and len(got) == 5
    assert rest.count() == 3


# --- BPE -----------------------------------------------------------------------------------------

def tiktoken_encoding():
    import tiktoken
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(RANKS), special_tokens={})


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_bpe(spark, block):
    rows = odd_rows() + [(20, "x\x1c y\x85 z　 <|endoftext|> it's we'll"), (21, "zq" * 3000)]
    enc = tiktoken_encoding()
    out = bpe.decode(bpe.encode(docs_of(spark, rows), RANKS, P.PATTERN, block=block), RANKS).collect()
    want = collections.Counter((i, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    assert collections.Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in out) == want
    assert bpe.encode(docs_of(spark, []), RANKS, P.PATTERN).count() == 0


def test_merges_of_words_long_and_short():
    ranks, enc, rng = bpe.ranks_of(RANKS), tiktoken_encoding(), random.Random(4)
    for n in [1, 5, 40, 64, 65, 70, 200, 900]:
        for _ in range(15):
            w = "".join(rng.choice("abetionsré") for _ in range(n)).encode()
            assert bpe.merge(w, ranks) == enc._encode_single_piece(w)


def test_both_tokenizer_libraries_agree():
    rng = random.Random(2)
    texts = ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x3000, 0x30FF), 32, 10, 39, 115])) for _ in range(80)) for _ in range(2000)]
    assert packing.encoder(JSON, P.PATTERN)(texts) == packing.encoder(JSON, None)(texts)
    assert packing.byte_ranks(JSON) == bpe.ranks_of(RANKS)
    assert packing.byte_ranks(P.path("word_bpe_49k.json")) is None


# --- toxicity ------------------------------------------------------------------------------------

def test_toxicity_learns_pairs_and_holds_out(spark):
    rng, rows, labels = random.Random(3), [], []
    plain = [f"w{i}" for i in range(200)]
    for i in range(1500):
        insult, group = rng.random() < 0.5, rng.random() < 0.5  # toxic only together
        t = [rng.choice(plain) for _ in range(rng.randint(5, 30))] + ["Nitwit,"] * insult + ["(walruses)"] * group
        rng.shuffle(t)
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(insult and group)))
    rows += [(5000, None), (5001, ""), (5002, "nitwit walruses " * 3000), (None, "w1")]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame(labels + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    from shapeloom.llm.common import held_out
    model = toxicity.fit(docs, labels, learn=~held_out("doc_id"), epochs=40)
    got = {r.doc_id: r for r in toxicity.scored(docs, model).withColumn("out", held_out("doc_id")).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    held = [(got[i].score, truth[i]) for i in truth if i is not None and got[i].out]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.95 and len(held) > 200
    assert got[5002].score > 0.5 > got[5000].score == got[5001].score
    assert all(r.out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    for none in (labels.limit(0), labels.filter("toxic = 0")):
        assert max(r.score for r in toxicity.scored(docs, toxicity.fit(docs, none)).collect()) < 0.5
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_toxicity_learns_pairs_of_words_that_tell_nothing_alone(spark):
    rng, rows, labels = random.Random(8), [], []
    plain = [f"w{i}" for i in range(200)]
    for i in range(3000):
        mild, group = rng.random() < 0.5, rng.random() < 0.5  # half of the texts with either word are toxic
        t = [rng.choice(plain) for _ in range(rng.randint(5, 30))] + ["silly"] * mild + ["walruses"] * group
        rng.shuffle(t)
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(mild == group)))
    from shapeloom.llm.common import held_out
    docs = docs_of(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), learn=~held_out("doc_id"), epochs=40)
    held = [(r.score, labels[r.doc_id][2]) for r in toxicity.scored(docs, model).filter(held_out("doc_id")).collect()]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.95 and len(held) > 400


# --- WARC ----------------------------------------------------------------------------------------

def test_warc_round_trip(spark, tmp_path):
    same = "<p>é same</p>"
    rows = [(1, "http://a/x", same), (2, "http://b/\r\ny", same), (3, None, same), (4, "u", None), (5, "u", ""), (6, "u", "z" * 300000),
            (None, "n", same), (7, "d", "twice"), (7, "d", "twice"), (8, "u", "\r\n\r\nodd")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    for least in (0, 5):
        folder = f"file://{tmp_path}/w{least}"
        manifest = warc.write(df, folder, min_bytes=least, archive_bytes=2000)
        got = warc.read(spark, manifest).collect()
        want = collections.Counter()
        top = collections.defaultdict(lambda: None)
        for i, _, h in rows:
            b = (h or "").encode()
            top[b] = i if top[b] is None else max(top[b], i or -1)
        for i, u, h in rows:
            b = (h or "").encode()
            again = len(b) >= least and i != top[b]
            url = None if u is None else u.replace("\r", "%0D").replace("\n", "%0A")
            want[i, url, "revisit" if again else "response", base64.b32encode(hashlib.sha1(b).digest()).decode(), len(b),
                 top[b] if again else None, None if again else b] += 1
        assert collections.Counter((r.page_id, r.url, r.record_type, r.payload_digest, r.payload_bytes, r.refers_to,
                                    None if r.payload is None else bytes(r.payload)) for r in got) == want
        assert sum(r.records for r in manifest.collect()) == len(rows)
    for name in os.listdir(tmp_path / "w0"):
        assert gzip.open(tmp_path / "w0" / name).read().startswith(b"WARC/1.1\r\n")
    assert warc.read(spark, warc.write(df.limit(0), f"file://{tmp_path}/none")).count() == 0


def test_warc_refuses_damage():
    import io
    good = warc.record("response", 1, "u", b"abc", 3, warc.b32(hashlib.sha1(b"abc").digest()), None, b"HTTP/1.1 200 OK\r\n\r\nabc")
    rows = [warc.parsed(*r, "p") for r in warc.Reader(io.BytesIO(good * 3), step=7)]
    assert [r[6] for r in rows] == [b"abc"] * 3 and rows[1][8] == len(good)
    with pytest.raises(warc.WarcError):
        list(warc.Reader(io.BytesIO(good[:-3])))
    bad = zlib.compressobj(6, zlib.DEFLATED, 31)
    text = gzip.decompress(good).replace(b"abc", b"abd")
    with pytest.raises(warc.WarcError):
        [warc.parsed(*r, "p") for r in warc.Reader(io.BytesIO(bad.compress(text) + bad.flush()))]


# --- fingerprints --------------------------------------------------------------------------------

def vector(*texts):
    return fingerprints.vectors(*words.buffer(pa.array(texts, pa.string())))


def test_fingerprint_algebra():
    whole, parts = vector("one\ntwo words\n\nthree, much longer than a gram"), vector("three, much longer than a gram\ntwo words\none\n")
    assert all((a == b).all() for a, b in zip(whole, parts))
    a, b = vector("one\ntwo"), vector("three")
    both = fingerprints.insert(a, b)
    assert all((x == y).all() for x, y in zip(both, vector("three\ntwo\none")))
    assert all((x == y).all() for x, y in zip(fingerprints.delete(both, b), a))
    packed = pa.array(fingerprints.pack(*whole), pa.binary())
    assert all((x == y).all() for x, y in zip(fingerprints.unpack(packed), whole))
    assert fingerprints.likeness(vector("", "x"), vector("", "y")).tolist() == [1.0, 0.0]


def test_fingerprints_of_neighbours(spark):
    rows = [(i, t) for i, t in odd_rows() if not (i == 8 and t and t.startswith("another"))]
    rows += [(1000 + i, f"line {i}\nof many") for i in range(40)]
    got = fingerprints.compare_with_next(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    order = sorted({(-(1 << 63) if i is None else i, t or "") for i, t in rows}, key=lambda r: -r[0])
    ids = [i for i, _ in order]
    after = {(i, t): order[(k + 1) % len(order)][1] for k, (i, t) in enumerate(order) if ids.count(i) == 1}
    text = {(i, len(t or "")): t or "" for i, t in rows}
    checked = 0
    for r in got:
        key = (-(1 << 63) if r.doc_id is None else r.doc_id, text[r.doc_id, r.n_chars])
        if key not in after or ids.count(order[(order.index(key) + 1) % len(order)][0]) > 1:
            continue
        t, nxt = key[1], after[key]
        k = len(t) // 3
        edited = t[:len(t) - k] + nxt[:k]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert bytes(r.fingerprint) == fingerprints.pack(*vector(t))[0] and bytes(r.edited_fingerprint) == fingerprints.pack(*vector(edited))[0]
        assert r.near_next == pytest.approx(float(fingerprints.likeness(vector(t), vector(nxt))[0]))
        assert 0 <= r.near_edited <= 1
        checked += 1
    assert checked >= 45
    assert fingerprints.compare_with_next(docs_of(spark, [])).count() == 0
    assert fingerprints.compare_with_next(docs_of(spark, [(1, "alone in the table")])).first().near_next == 1.0


def test_counts_of_long_texts_do_not_wrap(spark):
    # One run repeated over 40,000 times: its counts pass 2^15, and for the last pair 2^16.
    rows = [(4, "word " * 40_000), (3, "other " * 5), (2, "word " * 41_000), (1, "word " * 70_000)]
    got = {r.doc_id: r for r in fingerprints.compare_with_next(docs_of(spark, rows)).collect()}
    assert np.abs(vector(rows[0][1])[1].view(np.int32)).max() > 39_990
    assert got[4].near_edited > 0.99 and got[4].near_next < 0.3
    assert got[2].near_edited > 0.99 and got[2].near_next > 0.99
    longer = pa.array(fingerprints.pack(*vector(rows[3][1])), pa.binary())
    assert (fingerprints.unpack(longer)[1] == vector(rows[3][1])[1]).all()


# --- nearest neighbours --------------------------------------------------------------------------

def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64)) * rng.uniform(0.9, 1.1, (3000, 1))
    x[100:900] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(4000, None), (4020, [0.0] * 64), (4040, [1.0] * 63 + [None]), (4060, [float("nan")] * 64), (4080, [1.0] * 3), (None, x[5].tolist()),
             (4100, [float("inf")] * 64), (3, x[3].tolist())]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, e int")
    x = x.astype(np.float32).astype(np.float64)
    for piece in (20_000, 50):
        got = collections.defaultdict(list)
        for r in nearest.search(df, lambda i: i % 20 == 0, k=20, piece=piece, per_block=4000).collect():
            got[r.query_id].append((r.rank, r.vec_id, r.score))
        hits = total = 0
        assert set(got) == set(range(0, 3000, 20))
        for q, found in got.items():
            found.sort()
            assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
            assert [(v, s) for _, v, s in found] == sorted([(v, s) for _, v, s in found], key=lambda p: (-p[1], p[0]))
            s = x @ x[q]
            assert all(abs(s[v] - t) < 1e-9 for _, v, t in found)
            s[q] = -np.inf
            if q in range(100, 900):
                assert [v for _, v, _ in found] == [v for v in range(100, 122) if v != q][:20]
            else:
                hits += len(set(np.lexsort((np.arange(3000), -s))[:20]) & {v for _, v, _ in found})
                total += 20
        # A query next to the copies has ties that only the smallest ids win.
        assert hits / total >= 0.9
    few = nearest.search(df.filter("vec_id < 5 or vec_id = 20"), lambda i: i % 20 == 0, k=20).collect()
    assert collections.Counter(r.query_id for r in few) == {0: 5, 20: 5}
    assert nearest.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


# --- near duplicates -----------------------------------------------------------------------------

def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups_by_hand(rows, percent):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return collections.Counter((d, len(sets[i]), min(least[find(i)]) if d is not None else None) for i, (d, _) in enumerate(rows))


def test_near_duplicates(spark):
    rng = random.Random(11)
    rows = odd_rows()
    say = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") + str(rng.randint(0, 40)) for _ in range(n)]
    for g in range(12):
        base = say(rng.randint(3, 120))
        for k in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(["new", "other", str(k)])
            rows.append((100 + len(rows), (" ".join(w)).upper() if k % 3 == 0 else "\t".join(w) + " \n"))
    chain = say(150)  # each links to the next only
    for k in range(20):
        chain = chain[2:] + say(2)
        rows.append((100 + len(rows), " ".join(chain)))
    docs = docs_of(spark, rows)
    got = neardup.groups(docs, 85).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == groups_by_hand(rows, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = neardup.representatives(docs, 85)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.filter("doc_id is not null").collect()]
    assert set(ids) == {c for _, n, c in groups_by_hand(rows, 85) if c is not None}
    assert neardup.groups(docs.limit(0)).count() == 0 == neardup.representatives(docs.limit(0)).count()


def test_pigeonhole_guarantee():
    rng = np.random.default_rng(8)
    a = rng.integers(0, 1 << 16, (300, neardup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(neardup.SYMBOLS, 2 * neardup.CHUNKS - 1, replace=False)] ^= 1
    assert (neardup.keys(a) == neardup.keys(b)).any(axis=1).all()


# --- suffix arrays -------------------------------------------------------------------------------

def order_by_hand(t, depth):
    order = sorted(range(len(t)), key=lambda i: t[i:])
    shared = [0] * len(t)
    for k in range(1, len(t)):
        a, b = order[k - 1], order[k]
        while shared[k] < depth and max(a, b) + shared[k] < len(t) and t[a + shared[k]] == t[b + shared[k]]:
            shared[k] += 1
    return order, shared


@pytest.mark.parametrize("memory", [1 << 20, 300])
def test_induced_order(memory):
    rng = random.Random(6)
    for _ in range(150):
        t = [rng.randint(0, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 90))]
        t = t * 2 if rng.random() < 0.4 else t
        order, shared = induced.sort_suffixes(np.array(t, np.int64), 300, memory)
        assert (list(order), list(map(int, shared))) == order_by_hand(t, 300)


def cut_by_hand(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    count = collections.Counter(b[i:i + width] for b in texts for i in range(len(b) - width + 1))
    out = collections.Counter()
    for (d, _), b in zip(rows, texts):
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if count[b[i:i + width]] > 1:
                gone[i:i + width] = [True] * width
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)] += 1
    return out


@pytest.mark.parametrize("memory", [1 << 27, 5000])
def test_repeated_strings(spark, memory):
    rng = random.Random(9)
    rows = odd_rows()
    passage = "".join(rng.choice("abcdefg hé") for _ in range(400))
    for k in range(12):
        own = "".join(rng.choice("abcdefg hé") for _ in range(rng.randint(0, 300)))
        a, b = sorted((rng.randint(0, 400), rng.randint(0, 400)))
        rows.append((100 + k, own + passage[a:b] + own[::-1] + passage[b:] + own[:150]))
    docs = docs_of(spark, rows)
    got = suffixes.cleaned(docs, memory=memory).collect()
    assert collections.Counter((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == cut_by_hand(rows, 200)
    cut = suffixes.removed(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert collections.Counter((r.doc_id, r.text) for r in cut.collect() if r.text is None) == {(1, None): 1, (None, None): 1}
    assert suffixes.cleaned(docs.limit(0)).count() == 0


# --- URL filters ---------------------------------------------------------------------------------

def glob_by_hand(pattern, text):
    return re.fullmatch("".join("(?s:.*)" if c == "*" else "[^|]" if c == "?" else re.escape(c) for c in pattern), text) is not None


def test_automaton_matches_globs():
    rng = random.Random(12)
    globs = ["".join(rng.choice("ab*?|c") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) + "|" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 8)))
             for _ in range(300)]
    machine = urlfilter.Automaton([urlfilter.glob(g) for g in globs])
    assert machine.words > 3
    hosts, paths = zip(*(t.split("|") for t in texts))
    got = machine.match(*urlfilter.codes(hosts, paths))  # codes put a dot before the host
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert got[i, j] == glob_by_hand(g, "." + t)


def test_url_rules(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    urls = ["http://a.NET/", "http://anet/", "http://net/x", "http://a.example.net/en/1?q", "http://example.net/en", "https://x.org/fr/",
            "https://x.com/a.net/", "http://example.com/de/#a", "http://example.com?/de/", "no url", None, "", "://b.net//c", "a://b.net?x://c.org/fr/",
            "http://long.net/" + "x" * 50000, "http://a.net/", "http://é.net/\n"]
    df = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(urls)], "page_id int, url string, host string, rule int").repartition(3)
    got = {r.page_id: r for r in urlfilter.judge(df, rules, globs=(("block", "*|*a.net*"),)).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        low = host.translate({c: c + 32 for c in range(65, 91)})
        fit = [(len(r), -k, r, v) for k, (v, r) in enumerate(rules)
               if (low == r.split("/")[0] or low.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        want = max(fit)[2:] if fit else (("*|*a.net*", "block") if "a.net" in path else (None, "allow"))
        assert (got[i].host, got[i].path, (got[i].rule, got[i].verdict)) == (low, path, want)
    assert urlfilter.judge(df.limit(0), rules).count() == 0
    assert {r.verdict for r in urlfilter.judge(df, [], default="block").collect()} == {"block"}
