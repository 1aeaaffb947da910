"""Versioned table archives, tile results with a manifest, and run summaries."""
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shapeloom.errors import LayoutError

_META = T.StructType([T.StructField("format", T.StringType()), T.StructField("version", T.IntegerType()),
                      T.StructField("metadata", T.StringType()),
                      T.StructField("counts", T.MapType(T.StringType(), T.LongType()))])


def _rename(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path(target)):
        raise LayoutError(f"{target} exists already")
    if not fs.rename(path(source), path(target)):
        raise LayoutError(f"cannot move {source} to {target}")


def write_archive(tables: dict[str, DataFrame], path: str, fmt: str, version: int,
                  metadata: str = "{}") -> None:
    """Write the tables beside `path`, then move them there in one rename.

    Row counts are taken from what was written. `metadata` is JSON text.
    """
    if not tables:
        raise LayoutError("an archive needs a table")
    spark = next(iter(tables.values())).sparkSession
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    counts = {}
    for name, df in tables.items():
        df.write.parquet(f"{staging}/{name}")
        counts[name] = spark.read.parquet(f"{staging}/{name}").count()
    spark.createDataFrame([(fmt, version, metadata, counts)], _META).coalesce(1).write.parquet(
        f"{staging}/_meta_table")
    _rename(spark, staging, path)


def read_archive(spark: SparkSession, path: str, fmt: str, versions,
                 schemas: dict[str, T.StructType]) -> tuple[dict[str, DataFrame], str]:
    """Tables and metadata; format and version are refused before anything else is read."""
    meta = spark.read.schema(_META).parquet(f"{path}/_meta_table").first()
    if meta is None or meta["format"] != fmt:
        raise LayoutError(f"{path} is not a {fmt} archive")
    if meta["version"] not in versions:
        raise LayoutError(f"version {meta['version']} of {fmt} is not supported")
    missing = sorted(set(schemas) - set(meta["counts"]))
    if missing:
        raise LayoutError(f"archive lacks the tables {', '.join(missing)}")
    tables = {}
    for name, schema in schemas.items():
        found = spark.read.parquet(f"{path}/{name}")
        lost = [f.name for f in schema if f.name not in found.columns
                or found.schema[f.name].dataType.simpleString() != f.dataType.simpleString()]
        if lost:
            raise LayoutError(f"table {name} lacks the fields {', '.join(lost)}")
        if found.count() != meta["counts"][name]:
            raise LayoutError(f"table {name} does not have its recorded number of rows")
        tables[name] = found
    return tables, meta["metadata"]


def write_tiles(pixels: DataFrame, tiles: DataFrame, path: str, pixel: int) -> DataFrame:
    """Owned pixels in ranges of core_id plus a manifest; returns the manifest.

    Files are sorted by tile, so a reader of one tile skips all row groups but its own, and the number of
    files follows the data and not the tiles.
    """
    from shapeloom.operators.raster import owned_pixels, tile_manifest
    owned = owned_pixels(pixels, tiles, pixel)
    (owned.repartitionByRange("core_id", "y").sortWithinPartitions("core_id", "y", "x")
     .write.mode("errorifexists").parquet(f"{path}/tiles"))
    spark = pixels.sparkSession
    manifest = tile_manifest(read_tiles(spark, path), tiles, pixel)
    manifest.write.mode("errorifexists").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_tiles(spark: SparkSession, path: str, core_id: int | None = None) -> DataFrame:
    """Pixels written by `write_tiles`, of all tiles or of one."""
    found = spark.read.parquet(f"{path}/tiles")
    return found if core_id is None else found.filter(F.col("core_id") == core_id)


def write_summary(summary: DataFrame, path: str) -> None:
    """One JSON row; `summary` is already a one-row aggregate."""
    summary.coalesce(1).write.mode("errorifexists").json(path)
