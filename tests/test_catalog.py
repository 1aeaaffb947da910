"""All queries of the layout catalog next to their SQL."""
import os

import pytest

import __spark_entry__ as entry
import catalog

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, name):
    from catalog.compare import compare, duck
    text, _, _, ok = compare(spark, duck(DATA), DATA, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, text


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_result_does_not_depend_on_cells(spark):
    from catalog import tables
    from shapeloom.operators import region
    b = tables.boxes(spark, DATA).checkpoint()
    got = [sorted(tuple(r) for r in region.area(region.union(b, cell=c, partitions=p)).collect())
           for c, p in ((256, 1), (2048, 8))]
    assert got[0] == got[1]
