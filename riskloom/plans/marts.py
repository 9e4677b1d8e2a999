"""Marts that are refreshed by month and looked up by contract.

A refresh writes the months that changed to folders of its own and then a manifest: a small table that says which folder
holds which month of which mart.  Files are never changed, so a write that dies leaves the manifest before it, and with
it the old marts, as they were; the marts of one manifest belong together.  Readers take the newest whole manifest.

The panel mart is dealt by month and by a hash bucket of credit_id, sorted by contract in each file, with a Parquet Bloom
filter: a lookup reads one bucket a month and skips row groups that do not hold the contract.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators import cleaning, portfolio, targets
from ..sources.tables import select_existing

BUCKETS = 8
NO_MONTH = 0                     # rows without a report date


def month_number(date_col: str = "report_date_as_of") -> F.Column:
    """yyyymm as an int, ``NO_MONTH`` for a missing date."""
    return F.coalesce(F.year(date_col) * 100 + F.month(date_col), F.lit(NO_MONTH)).cast("int")


def bucket_of(credit_id: F.Column, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(credit_id.cast("string")), F.lit(buckets)).cast("int")


def _whole_manifests(spark: SparkSession, out_dir: str) -> list[int]:
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{out_dir}/manifests")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [n for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{out_dir}/manifests/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in done)


def manifest(spark: SparkSession, out_dir: str) -> list:
    """Rows (mart, month, root, buckets, schema) of the newest whole manifest: a row a mart and calendar month."""
    done = _whole_manifests(spark, out_dir)
    return spark.read.parquet(f"{out_dir}/manifests/v{done[-1]}").collect() if done else []


def switch(spark: SparkSession, out_dir: str, rows: list[tuple]) -> None:
    """Write the next manifest: from here on readers see its marts."""
    done = _whole_manifests(spark, out_dir)
    table = spark.createDataFrame(rows, "mart string, month int, root string, buckets int, schema string")
    table.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/manifests/v{done[-1] + 1 if done else 0}")


def _write(df: DataFrame, root: str, by: list[str]) -> None:
    (df.write.partitionBy(*by).option("compression", "zstd").option("parquet.bloom.filter.enabled#credit_id", "true")
     .parquet(root))


def written_months(spark: SparkSession, root: str) -> list[int]:
    """The months a write gave files for, from its folder names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("report_month="))


def _shift(month: int, by: int) -> int:
    at = month // 100 * 12 + month % 100 - 1 + by
    return at // 12 * 100 + at % 12 + 1


def refresh_marts(raw: DataFrame, out_dir: str, months: list[int] | None = None, buckets: int = BUCKETS) -> list[int]:
    """Write the panel mart and the monthly series for ``months`` (yyyymm; all by default) and switch to them; gives the
    months written.

    A changed month also changes the forward label of the months before it, as many as the label looks ahead: those are
    written again too, from the raw rows of as many months after them.  A month that has no rows any more leaves the
    marts.  An empty ``raw`` gives a manifest without months, which has nothing to read.  The first call fixes the number of buckets."""
    spark, look = raw.sparkSession, config.FORWARD_HORIZON_MONTHS
    old = manifest(spark, out_dir)
    buckets = old[0]["buckets"] if old else buckets
    wanted = None
    if months is not None:
        wanted = sorted({_shift(m, -d) if m else m for m in months for d in range(look + 1)})
        read = sorted({_shift(m, d) if m else m for m in wanted for d in range(look + 1)})
        raw = raw.where(month_number().isin(read))
    panel = targets.forward_target_monthly(targets.default_flag(cleaning.prepare_panel(raw)))
    panel = panel.withColumn("report_month", month_number())
    if wanted is not None:
        panel = panel.where(F.col("report_month").isin(wanted))
    version = uuid.uuid4().hex
    roots = {mart: f"{out_dir}/data/{mart}/{version}" for mart in ("panel", "series")}
    rows = select_existing(panel, [*config.PANEL_MART_COLS, "report_month"]).withColumn("bucket", bucket_of(F.col("credit_id"), buckets))
    rows = rows.repartition("report_month", "bucket").sortWithinPartitions("report_month", "bucket", "credit_id", "report_date_as_of")
    _write(rows, roots["panel"], ["report_month", "bucket"])
    # the series is read off the mart just written: no second pass over the raw panel
    written = spark.read.schema(rows.schema).parquet(roots["panel"])
    series = portfolio.default_rate_over_time(written)
    series = series.withColumn("report_month", month_number()).coalesce(1)
    _write(series, roots["series"], ["report_month"])
    schemas = {"panel": rows.schema.json(), "series": series.schema.json()}
    kept = [tuple(r) for r in old if wanted is not None and r["month"] not in wanted]
    new = [(mart, m, roots[mart], buckets, schemas[mart]) for mart in roots for m in written_months(spark, roots[mart])]
    switch(spark, out_dir, kept + new)
    return sorted({m for mart, m, *_ in new if mart == "panel"})


def read_mart(spark: SparkSession, out_dir: str, mart: str) -> DataFrame:
    """A mart as the newest manifest has it: the union of its folders, each limited to the months it still holds."""
    from pyspark.sql.types import StructType
    import json
    folders: dict[str, list] = {}
    for r in manifest(spark, out_dir):
        if r["mart"] == mart:
            folders.setdefault(r["root"], []).append(r)
    if not folders:
        raise FileNotFoundError(f"no {mart} mart under {out_dir}")
    out = None
    for root, rows in sorted(folders.items()):
        schema = StructType.fromJson(json.loads(rows[0]["schema"]))
        part = spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/report_month={r['month']}" for r in rows])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def client_lookup(spark: SparkSession, out_dir: str, credit_ids: list) -> DataFrame:
    """The panel rows of some contracts, without scanning the panel: one bucket a contract, and in it the row
    groups whose statistics and Bloom filter do not rule the contract out.  An unknown contract gives no rows."""
    panel = read_mart(spark, out_dir, "panel")
    buckets = manifest(spark, out_dir)[0]["buckets"]
    kind = panel.schema["credit_id"].dataType
    ids = [F.lit(i).cast(kind) for i in credit_ids]
    if not ids:
        return panel.limit(0)
    return panel.where(F.col("bucket").isin([bucket_of(i, buckets) for i in ids]) & F.col("credit_id").isin(ids)).drop("bucket")
