"""Shared-folder helpers of the operators: written intermediate tables and bounded sums over partitions.

Intermediates go to the folder that the session names in ``spark.checkpoint.dir`` (a local session without
one gets its own scratch folder), so a lost executor never takes the only copy with it.  They are deleted
when the application ends.
"""
from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


class Scratch:
    """A folder of written tables for one run of an operator."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark, allow_local_default=True).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the written copy: the lineage ends there."""
        df.write.mode("error").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))


def plain(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, so that extra columns of the caller never clash with an operator's own."""
    return df.select(*(F.col(f"`{c}`") for c in cols))


FLAT_PARTS = 16                # so many sums go to the driver without a stage between


def tree_sum(df: DataFrame, column: str, dtype, add=np.add) -> np.ndarray | None:
    """Element-wise sum of the zlib-packed arrays of a column, in a tree over the executors if there are many parts;
    None without rows."""
    blank = zlib.compress(b"", 1)

    def merge(x: bytes, y: bytes) -> bytes:
        if blank in (x, y):
            return y if x == blank else x
        total = add(np.frombuffer(zlib.decompress(x), dtype), np.frombuffer(zlib.decompress(y), dtype))
        return zlib.compress(total.astype(dtype).tobytes(), 1)

    parts = df.select(column).rdd.map(lambda r: bytes(r[0]))
    total = parts.treeAggregate(blank, merge, merge, 2 if parts.getNumPartitions() > FLAT_PARTS else 1)
    return None if total == blank else np.frombuffer(zlib.decompress(total), dtype)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, unless their PYTHONPATH already has it, and
    hand rows to Python in batches of 4 MB, unless the application names a size: texts can be very long."""
    if not spark.sparkContext.getConf().contains(ARROW_BYTES):
        spark.conf.set(ARROW_BYTES, str(4 << 20))
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sc = spark.sparkContext
    if top in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_riskloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="riskloom-package-")  # of the driver; executors fetch the file from it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(f"{folder}/riskloom_package", "zip", top, "riskloom"))
    sc._riskloom_shipped = True
