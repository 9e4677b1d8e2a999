"""Drift against a stored reference (X1, X2, X3, X5, X7): the reference side is counted once and kept.

A profile holds ``drift.value_counts`` of the reference by report month, in folders that a manifest names (see ``marts``).
Counts of months add up, so a profile built month by month equals one built at once, a month can be written again alone,
and a comparison may take any of its months.  A drift run then reads the profile and the current side only: no row of
the reference panel.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators import drift
from . import marts

PROFILE = "profile"


def save_profile(side: DataFrame, out_dir: str, num_features: list[str], cat_features: list[str],
                 label: str = config.TARGET_COL, score: str = "risk_score", months: list[int] | None = None,
                 replace: bool = False) -> list[int]:
    """Count ``side`` (prepared and scored rows) by month, keep the counts and switch to them; gives the months written.

    The months of ``side``, and those named in ``months`` that have no rows any more, take the place of their former
    counts; other months stay, unless ``replace`` asks for a profile of ``side`` alone (a last slice, whose rows are not
    those of its months).  Rows without a report date are a month of their own.  Features missing from ``side`` are left
    out, and an empty ``side`` adds nothing."""
    spark = side.sparkSession
    num = [c for c in num_features if c in side.columns]
    cat = [c for c in cat_features if c in side.columns]
    counts = drift.value_counts(side.withColumn("report_month", marts.month_number()), num, cat, label, score, ["report_month"])
    root = f"{out_dir}/data/{PROFILE}/{uuid.uuid4().hex}"
    # kind and feature lead the sort, so that row groups can be skipped by them
    counts = counts.repartition("report_month", "feature").sortWithinPartitions("report_month", "kind", "feature", "value")
    counts.write.partitionBy("report_month").option("compression", "zstd").parquet(root)
    written = marts.written_months(spark, root)
    gone = set(written) | set(months or [])
    old = [] if replace else [tuple(r) for r in marts.manifest(spark, out_dir) if r["month"] not in gone]
    marts.switch(spark, out_dir, old + [(PROFILE, m, root, 0, counts.schema.json()) for m in written])
    return written


def read_profile(spark: SparkSession, out_dir: str, months: list[int] | None = None) -> DataFrame:
    """The stored counts, of some months if named; FileNotFoundError without any."""
    found = marts.read_mart(spark, out_dir, PROFILE)
    return found if months is None else found.where(F.col("report_month").isin(months))


def compare(spark: SparkSession, out_dir: str, current: DataFrame, num_features: list[str], cat_features: list[str],
            label: str | None = None, score: str | None = None, months: list[int] | None = None) -> DataFrame:
    """``drift.side_counts`` of the stored reference and of ``current``, which is read once."""
    wanted = F.col("feature").isin([*num_features, *cat_features, *([score] if score else [])])
    now = drift.value_counts(current, num_features, cat_features, label, score)
    return drift.side_counts(read_profile(spark, out_dir, months).where(wanted), now)


def score_histogram(counts: DataFrame) -> DataFrame:
    """The score rows of one side's counts as the histogram (value, pos, neg) that ``metrics`` reads."""
    return counts.where("kind = 'score'").select("value", "pos", (F.col("n") - F.col("pos")).alias("neg"))
