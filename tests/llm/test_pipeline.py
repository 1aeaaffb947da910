"""The pipeline's stages and the registered corpus queries on the driver tables."""
import collections
import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from shapeloom.llm import queries

from test_corpus import cut_by_hand, groups_by_hand, pieces_by_hand, shingles

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    from catalog.compare import compare, duck
    text, _, _, ok = compare(spark, duck(DATA), DATA, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, text


@needs_data
def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    clean = corpus_pipeline.nontoxic(spark, docs, DATA).checkpoint()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == columns and sum(i in left for i, y in labels.items() if y == 0) >= 0.9 * sum(y == 0 for y in labels.values())
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    one = corpus_pipeline.deduplicated(spark, clean, DATA).checkpoint()
    want = {d for d, _, c in groups_by_hand(rows, 80) if d == c}
    assert one.columns == columns and collections.Counter(r.doc_id for r in one.collect()) == dict.fromkeys(want, 1)
    rows = [(r.doc_id, r.text) for r in one.collect()]
    cut = corpus_pipeline.unrepeated(spark, one, DATA).checkpoint()
    assert cut.columns == columns
    assert {r.doc_id: r.text or "" for r in cut.collect()} == {d: b.decode("utf-8", "ignore") for d, _, _, _, b in cut_by_hand(rows, 200)}
    got = corpus_pipeline.packed(spark, cut, DATA).collect()
    import zlib
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in got) == pieces_by_hand(
        [(r.doc_id, r.text) for r in cut.collect()], 2048)
    assert corpus_pipeline.run(spark, DATA).count() == len(got)


@needs_data
def test_stages_with_nulls_and_nothing(spark):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    long = "word " * 30000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x y", None, None, 3), (3, long, None, None, 1), (3, long, None, None, 1),
            (4, "a fine day", "en", "s", 10), (None, None, None, None, None)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, DATA).checkpoint()
            assert docs.columns == schema.names
        out = corpus_pipeline.packed(spark, docs, DATA)
        assert (out.count() > 0) == bool(given)
        if given:
            assert sum(r.doc_id == 3 for r in docs.collect()) == 1 and docs.count() == 6


def test_contract():
    names = [f"op{i}_" for i in range(1, 11)]
    assert all(sum(q.startswith(n) for q in entry.queries()) == 1 for n in names) and "pipeline" in entry.queries()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert shingles("A b") == {("a", "b")}
