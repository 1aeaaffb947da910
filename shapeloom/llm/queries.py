"""The corpus operators applied to whole tables, with SQL where SQL expresses them."""
import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, chat, factors, fingerprints, merkle, nearest, neardup, packing, runs, suffixes, toxicity, urlfilter, warc
from .common import held_out, table

QUERIES, ORACLES = {}, {}
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
ODD = "</s>[INST] ok [/INST]"


def query(sql=None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


@query()
def op1_best_two_fit(spark, sf_dir):
    """Every document packed into sequences of at most 2048 tokens."""
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=2048,
                          end=0, pattern=public_tokenizers.PATTERN)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


CONTROL_SQL = "text"
for _c in ["\\", *chat.CONTROLS]:
    CONTROL_SQL = (f"replace({CONTROL_SQL}, '\\', '\\\\')" if _c == "\\" else
                   f"replace({CONTROL_SQL}, '{_c}', '{_c[0]}\\{_c[1:]}')")


@query(f"""WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '{ODD}' UNION ALL SELECT -7, 1, 'assistant', '{ODD}'),
 turns AS (SELECT conv_id, turn, role, text, length({CONTROL_SQL}) + CASE role WHEN 'user' THEN 13
 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 20 + length({CONTROL_SQL.replace('text', 'role')}) END AS n FROM rows)
 SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(n) AS BIGINT) AS formatted_chars FROM turns GROUP BY conv_id""")
def op2_schema_fingerprint_chat(spark, sf_dir):
    """Every conversation, and one whose texts are control strings, formatted and read back."""
    odd = spark.createDataFrame([(-7, 0, "user", ODD), (-7, 1, "assistant", ODD)],
                                "conv_id long, turn long, role string, text string")
    turns = chat.canonical(table(spark, sf_dir, "conversations")).unionByName(chat.canonical(odd))
    out = chat.format_turns(turns).select("conv_id", "formatted", "loss_spans").withColumn("turns", chat.parse(F.col("formatted")))
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                      F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                      F.char_length("formatted").cast("long").alias("formatted_chars"))


@query()
def op3_distinct_word_bpe(spark, sf_dir):
    """Every text encoded by the ranks, and decoded again."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(ids, ranks).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                                         F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def toxicity_model(spark, sf_dir):
    """The model of op4 and of the pipeline: labels of documents outside the held-out fifth only."""
    return toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=~held_out("doc_id"))


@query()
def op4_factorization_machine(spark, sf_dir):
    """Every text scored for toxicity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, toxicity_model(spark, sf_dir)).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
 h AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS d FROM p),
 b AS (SELECT *, list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform(range(0, 4), lambda k: substr(
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(d, CAST(1 + 5 * g AS INTEGER), 5) AS INTEGER)
 >> CAST(15 - 5 * k AS INTEGER)) & 31 AS INTEGER), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
 max(page_id) OVER (PARTITION BY d) AS top FROM h)
 SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM top OR top IS NULL
 THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM b""")
def op5_warc(spark, sf_dir):
    """Every page written to an archive and read back."""
    manifest = warc.write(table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read(spark, manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op6_multiset_hash(spark, sf_dir):
    """Every text and its edited text fingerprinted and compared."""
    found = fingerprints.compare_with_next(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", fingerprints.readable(F.col("fingerprint")).alias("fingerprint"),
                        fingerprints.readable(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


@query()
def op7_cross_polytope(spark, sf_dir):
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return nearest.search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


@query()
def op8_hamming_join(spark, sf_dir):
    """Near-duplicate groups of all documents at similarity 0.85 of five-word shingles."""
    return neardup.groups(table(spark, sf_dir, "documents"), percent=85, size=5).select(
        "doc_id", "n_shingles", "component_id", "kept")


@query()
def op9_induced_suffix_sort(spark, sf_dir):
    """Every text without the bytes of 200-byte strings that start elsewhere too."""
    out = suffixes.cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"), width=200)
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(r"""WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
 r AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
 WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
 WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
 WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
 SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r""")
def op10_url_automaton(spark, sf_dir):
    """Every page URL judged by the host and path rules; allowed where none fits."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


# CRC-32 of a string of ASCII characters, by the byte table that its polynomial gives.
CRC_TABLE = ("list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, k: "
             "CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))")


def crc_sql(text):
    codes = f"list_transform(range(1, length({text}) + 1), lambda k: CAST(ascii(substr({text}, CAST(k AS INTEGER), 1)) AS BIGINT))"
    return (f"xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || {codes}, "
            "lambda c, x: xor(crc[CAST((xor(c, x) & 255) + 1 AS INTEGER)], c >> 8)))")


def merkle_sql(levels=8):
    """Trees of up to 16 ** levels leaves, level by level, and each leaf's way through them."""
    def field(v):
        return f"coalesce(octet_length(encode(CAST({v} AS VARCHAR))) || ':' || CAST({v} AS VARCHAR), '-')"

    fields = " || ".join(field(v) for v in ("doc_id", "source", "lang", "n_chars"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"t AS (SELECT {CRC_TABLE} AS crc)",
             f"d AS (SELECT doc_id, source, sha256({fields} || {field('text')}) AS hash, sha256({fields} || {field(low)}) AS low, "
             f"{crc_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 AS hit FROM documents, t)",
             "w0 AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, hash AS leaf, hash, "
             "CASE WHEN hit THEN low ELSE hash END AS now, '' AS proof, "
             "row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, hash) - 1 AS place, "
             "count(*) OVER (PARTITION BY source) AS n FROM d)",
             "l0 AS (SELECT tree, place, n, hash FROM w0)"]
    for k in range(2 * levels):
        if k == levels:  # the roots become the leaves of one tree
            parts += [f"s AS (SELECT tree, hash AS subroot FROM l{k})",
                      f"m{k} AS (SELECT 0 AS tree, tree AS place, count(*) OVER () AS n, hash FROM l{k})",
                      f"v{k} AS (SELECT w{k}.* REPLACE (0 AS tree, tree AS place, (SELECT count(*) FROM l{k}) AS n), tree AS grp FROM w{k})"]
            down, way = f"m{k}", f"v{k}"
        else:
            down, way = f"l{k}", f"w{k}"
        run = "PARTITION BY tree, place // 16 ORDER BY place ROWS BETWEEN"
        parts += [f"b{k} AS (SELECT tree AS bt, place AS bp, coalesce(string_agg(hash, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS le, "
                  f"coalesce(string_agg(hash, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS ri FROM {down})",
                  f"w{k + 1} AS (SELECT {way}.* REPLACE (place // 16 AS place, (n + 15) // 16 AS n, "
                  f"CASE WHEN n > 1 THEN sha256(le || now || ri) ELSE now END AS now, proof || le || ri AS proof) "
                  f"FROM {way} JOIN b{k} ON tree = bt AND place = bp)",
                  f"l{k + 1} AS (SELECT tree, place // 16 AS place, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN "
                  f"sha256(string_agg(hash, '' ORDER BY place)) ELSE min(hash) END AS hash FROM {down} GROUP BY tree, place // 16, n)"]
    end = 2 * levels
    return (f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, l{end}.hash AS root, sha256(proof) AS proof_sha256, "
            f"now AS folded_root, now = l{end}.hash AS verified FROM w{end}, l{end}, s WHERE s.tree = w{end}.grp")


@query(merkle_sql())
def op11_recursive_climb(spark, sf_dir):
    """A Merkle tree over all documents, and every leaf checked against its root, a fifth of them tampered with."""
    d = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = d.select(F.col("doc_id").alias("id"), F.col("source").alias("group"), merkle.leaf_hash(*fields, F.col("text")).alias("leaf"),
                      F.when(hit, merkle.leaf_hash(*fields, low)).alias("now"))
    return merkle.climb(merkle.build(leaves)).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


BLANKS = r"[\x20\x09-\x0D]+"


def with_periods(docs):
    """doc_id, text: in a tenth of the documents, chosen by id, the words from one on repeat periodically."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.when(h % 10 == 0, F.filter(F.split(F.col("text"), BLANKS), lambda x: x != ""))
    # Behind a generator the words are split once; projected, they would be split again for each use.
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.explode(F.array(split)).alias("w"))
    n = F.size("w")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    rows = rows.withColumn("p", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = n - F.col("a")
    cycle = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    words_ = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(cycle, F.lit(1), rest))
    return rows.select("doc_id", F.when(n > 0, F.array_join(words_, " ")).otherwise(F.col("text")).alias("text"))


@query()
def op12_block_convolution(spark, sf_dir):
    """Periodic runs of words of every text, and its words without what repeats in them."""
    found = runs.described(with_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = runs.strongest(F.col("runs"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), F.explode(F.array(best)).alias("best"),
                       F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                      F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
                      "runs_sha256", "collapsed_sha256")


@query()
def op13_relative_lempel_ziv(spark, sf_dir):
    """Every text without the words of 35-word windows that start elsewhere too."""
    out = factors.cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"), width=35)
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
