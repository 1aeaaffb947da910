import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g")
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    yield session
    session.stop()


@pytest.fixture
def boxes(spark):
    """Boxes of layer 1 from (l, b, r, t) tuples."""
    def make(*rows, layer=1):
        return spark.createDataFrame([(layer, *r) for r in rows],
                                     "layer int, l long, b long, r long, t long")
    return make


@pytest.fixture
def polygons(spark):
    """Polygons from lists of rings; each ring is a list of points."""
    from shapeloom.schemas import RINGS
    from pyspark.sql import types as T

    def make(*shapes):
        schema = T.StructType([T.StructField("layer", T.IntegerType()),
                               T.StructField("polygon_id", T.LongType()), T.StructField("rings", RINGS)])
        return spark.createDataFrame([(1, i, rings) for i, rings in enumerate(shapes)], schema)
    return make
