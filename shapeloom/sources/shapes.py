"""Shape tables: checked reads, clustered writes, and GLP text output."""
from pyspark.sql import DataFrame, SparkSession, functions as F

from shapeloom import schemas
from shapeloom.functions.scalars import floor_div
from shapeloom.operators import filters, hierarchy


def read_shapes(spark: SparkSession, path: str, schema=schemas.BOXES) -> DataFrame:
    """Parquet shapes under an explicit schema; filters and columns reach the scan."""
    return spark.read.schema(schema).parquet(path)


def write_shapes(shapes: DataFrame, path: str, tile: int = 4096) -> None:
    """Parquet partitioned by layer and range-clustered by tile, so that file statistics
    on l, b, r, t let a region query skip most files."""
    keyed = shapes.withColumn("_ty", floor_div("b", tile)).withColumn("_tx", floor_div("l", tile))
    (keyed.repartitionByRange("layer", "datatype", "_tx", "_ty")
     .sortWithinPartitions("layer", "datatype", "_tx", "_ty").drop("_tx", "_ty")
     .write.mode("overwrite").partitionBy("layer", "datatype").parquet(path))


class Layout:
    """Three tables of a hierarchical layout and one chosen top cell."""

    def __init__(self, cells, shapes, instances, top: str | None = None):
        self.cells, self.shapes, self.instances = cells, shapes, instances
        self.top = hierarchy.top_cell(cells, instances, top)

    @staticmethod
    def read(spark, path: str, top: str | None = None) -> "Layout":
        def table(name, schema):
            return spark.read.schema(schema).parquet(f"{path}/{name}")
        return Layout(table("cells", schemas.CELLS), table("cell_shapes", schemas.CELL_POLYGONS),
                      table("cell_instances", schemas.CELL_INSTANCES), top)

    def layers(self) -> DataFrame:
        return filters.layer_list(self.shapes)

    def children(self) -> DataFrame:
        return hierarchy.children(self.cells, self.instances)

    def bbox(self) -> DataFrame:
        """Box of the top cell with everything below it."""
        ext = hierarchy.cell_extents(self.shapes, self.instances)
        return ext.filter(F.col("cell") == self.top)

    def query(self, layers=None, box=None, clip: bool = True) -> DataFrame:
        """Flattened shapes of the layers that share area with the region, cut or whole.

        Shapes with `rings` are cut along their true outline, into disjoint rectangles; properties and
        all other columns stay.
        """
        shapes = self.shapes if layers is None else filters.select_layers(self.shapes, layers)
        flat = hierarchy.flatten(shapes, self.instances, self.top, box)
        if box is None:
            return flat.filter(F.col("kind").isin(*filters.POLYGON_KINDS))
        flat = filters.candidates(flat, box)
        if not clip:
            return flat
        return filters.clip_polygons(flat, box) if "rings" in flat.columns else filters.clip(flat, box)

    def stats(self, box=None) -> DataFrame:
        flat = hierarchy.flatten(self.shapes, self.instances, self.top, box)
        return filters.shape_stats(flat, box, ("layer", "datatype"))


def write_patches(patches: DataFrame, path: str) -> None:
    """Ownership-clipped shapes as one dataset per run, partitioned by layer."""
    patches.write.mode("errorifexists").partitionBy("layer", "datatype").parquet(path)


def write_pair(reference: DataFrame, rebuilt: DataFrame, path: str) -> None:
    """Reference and rebuilt shapes side by side, told apart by `kind_of`."""
    both = reference.withColumn("kind_of", F.lit("reference")).unionByName(
        rebuilt.withColumn("kind_of", F.lit("rebuilt")))
    both.write.mode("errorifexists").partitionBy("kind_of").parquet(path)
