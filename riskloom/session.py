"""Session helpers: a local session for tests and the bench, and lineage cuts."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
}


def local_session(cores: int | str = "*", app: str = "riskloom", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench.  On a cluster use the provided session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**_LOCAL_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, allow_local_default=True)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, allow_local_default: bool = False) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names a shared folder; it is read from the session.  Only a local
    test/bench session (``allow_local_default``) may create its own scratch folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not path:
        master = spark.sparkContext.master
        if not allow_local_default or not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder for lineage cuts")
        path = tempfile.mkdtemp(prefix="riskloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def keep(df: DataFrame) -> DataFrame:
    """Persist a frame reused by several actions; lost blocks are recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of an intermediate that several branches of one plan read (e.g. a
    (feature, value) histogram): it is computed once, written as compressed Parquet under the shared
    checkpoint folder (reliable: survives executor loss) and every branch reads the columns it needs."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark, allow_local_default=True)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
