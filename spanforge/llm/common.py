"""Helpers shared by the training-data operators: tables, shared storage, components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import components, shared_folder

#: A word is a run of anything but the six ASCII blanks; ``bytes.split()`` cuts the same words.
WORD = r"[^\x20\x09-\x0D]+"
#: Lower-cases A-Z only, on UTF-8 bytes.
LOWER_AZ = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent, a local master gets a temporary folder (tests); a cluster
    uses its warehouse if that names a store, and raises an error otherwise."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        global _local
        try:
            return _local
        except NameError:
            _local = tempfile.mkdtemp(prefix="spark-shared-")
            return _local
    return shared_folder(spark)


#: Bytes of a batch that goes to a Python worker; ten thousand whole texts stay in its memory, and in the executor's, otherwise.
BATCH_BYTES = 4 << 20


@contextmanager
def bounded_batches(spark: SparkSession):
    """What is run inside sends batches of at most BATCH_BYTES (or one row) to Python workers."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost
    executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with bounded_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a narrow table (a few numbers each) that may be sent to every task.
SMALL_ROWS = 500_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A stored narrow table, marked for a broadcast join if its counted rows are at most
    ``rows``; a larger one is joined through the shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def md5_number(key: Column) -> Column:
    """48 bits of md5 as a long; SQL engines without xxhash can compute it too."""
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node reached.

    An error is raised if ``max_rounds`` do not suffice."""
    return components(edges, a, b, max_rounds, lambda e: materialize(e, "edges"))
