"""A query function and its SQL are declared side by side."""
import functools
import uuid

QUERIES, ORACLES = {}, {}


def ready(spark):
    """Make sure checkpoints have a folder: the session's own, or one below its warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    context.setCheckpointDir(folder)


def scratch(spark, name: str) -> str:
    """A new folder for what a query writes and reads back, in the shared checkpoint folder."""
    ready(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def query(sql=None):
    """Register a `(spark, sf_dir) -> DataFrame` function under its own name."""
    def register(fn):
        if fn.__name__ in QUERIES:
            raise ValueError(f"query {fn.__name__} is registered twice")

        @functools.wraps(fn)
        def run(spark, sf_dir):
            ready(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return run
    return register
