"""Places for intermediate tables and helpers shared by the corpus operators."""
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder of the session.

    Without `spark.checkpoint.dir` it lies below the warehouse, which all executors share too.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write once, read back: cuts lineage, and later steps prune columns of the file.

    Shuffle files of a finished step go when the driver collects its plan; `tidy` asks for that at
    once, for steps that shuffle much.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if tidy:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table of `saved` that no later step reads.

    Only for tables whose readers have all been written themselves: what is lost with an executor is
    computed again from the tables of the step after, never from a deleted one.
    """
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


NO_ID = -(1 << 63)


def identified(docs: DataFrame, doc_id: str, text: str, *more) -> DataFrame:
    """Rows with their identity `did`, `h`: the id (the lowest number for null) and a hash of the text; and the text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(t).alias("h"), t.alias("text"), *more)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def squeezed(text):
    """Texts as compressed bytes, null staying null: long texts take half the disk in a shuffle."""
    def pack(column):
        import pyarrow as pa
        import zstandard
        from .words import pieces
        z, out = zstandard.ZstdCompressor(level=3), []
        for some in pieces(pa.RecordBatch.from_arrays([column], names=["text"]), "text"):
            out.append(pa.array([None if x is None else z.compress(x.encode()) for x in some.column("text").to_pylist()], pa.binary()))
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())

    return F.arrow_udf(pack, "binary")(text.cast("string"))


def expanded(column):
    """Texts of an Arrow column made by `squeezed`, as bytes; null is empty."""
    import pyarrow as pa
    import zstandard
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([b"" if x is None else unpack(x) for x in column.to_pylist()], pa.binary())


def held_out(doc_id):
    """Whether a document belongs to the fifth that no model may learn from."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by key over as many partitions as shuffles have."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
