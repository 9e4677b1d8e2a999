"""Default labels."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.columns import MONTH_COL, month_index, with_month_index
from . import ranks


def default_flag(df: DataFrame, target_col: str = config.TARGET_COL,
                 pdn_threshold: float = config.PDN_DEFAULT_THRESHOLD) -> DataFrame:
    """1 if dpd > 90 or pdn_current > threshold or quality in IV/V/4/5 or bankrupt; nulls never fire."""
    present = set(df.columns)
    dpd = F.coalesce(F.col("dpd").cast("double"), F.lit(0.0)) if "dpd" in present else F.lit(0.0)
    pdn = F.coalesce(F.col("pdn_current").cast("double"), F.lit(0.0)) if "pdn_current" in present else F.lit(0.0)
    quality = (F.coalesce(F.col("quality_category").cast("string").isin(*config.QUALITY_BAD_CATEGORIES), F.lit(False))
               if "quality_category" in present else F.lit(False))
    bankrupt = (F.coalesce(F.col("is_bankrupt") == 1, F.lit(False)) if "is_bankrupt" in present else F.lit(False))
    flag = (dpd > config.DEFAULT_DPD_THRESHOLD) | (pdn > pdn_threshold) | quality | bankrupt
    return df.withColumn(target_col, flag.cast("int"))


def _contract_month_window(key: str, date_col: str):
    # ascending month, missing dates last: a prefix of the rolling-feature order, so both
    # windows share one exchange and one sort
    return Window.partitionBy(key).orderBy(F.col(MONTH_COL).asc_nulls_last())


def forward_target(df: DataFrame, horizon_months: int = config.FORWARD_HORIZON_MONTHS,
                   target_col: str = config.FORWARD_TARGET_COL,
                   valid_mask_col: str = config.VALID_MASK_COL,
                   key: str = "credit_id", date_col: str = "report_date_as_of") -> DataFrame:
    """T2 + T3: max of the current-default flag over the contract's rows whose calendar month lies
    in [t+1, t+h] (gaps respected, same-month rows excluded), and whether any such row exists.

    A range frame over the integer month index; it shares the (contract) partitioning with the
    other per-contract windows, so Catalyst plans one exchange for all of them.
    """
    if key not in df.columns or date_col not in df.columns:
        raise ValueError(f"forward_target needs {key} and {date_col}")
    if config.TARGET_COL not in df.columns:
        df = default_flag(df)
    df = with_month_index(df, date_col)
    w = _contract_month_window(key, date_col).rangeBetween(1, horizon_months)
    has_month = F.col(date_col).isNotNull()
    fut_max = F.max(F.col(config.TARGET_COL)).over(w)
    fut_n = F.count(F.lit(1)).over(w)
    return df.withColumns({
        target_col: F.when(has_month, F.coalesce(fut_max, F.lit(0))).otherwise(F.lit(0)).cast("int"),
        valid_mask_col: F.when(has_month, fut_n > 0).otherwise(F.lit(False)),
    })


def pre_default_trajectory(df: DataFrame, feature: str = "total_debt", months_before: int = 6,
                           key: str = "credit_id", date_col: str = "report_date_as_of") -> DataFrame:
    """T4: align every defaulting contract on its first default month (t = 0) and describe
    ``feature`` for t in [-months_before, 0]: mean, median, count of non-null values.

    The first default month is a grouped minimum over the defaulting rows (combined map-side: one
    row a contract, however many rows it has) joined back; the final grouping is by t only.
    """
    need = {key, date_col, feature, config.TARGET_COL}
    if not need <= set(df.columns):
        return df.sparkSession.createDataFrame([], "t long, mean double, median double, count long")
    ym = month_index(F.col(date_col))
    first = df.filter(F.col(config.TARGET_COL) == 1).groupBy(key).agg(F.min(ym).alias("_first"))
    aligned = (df.select(key, date_col, feature).join(first, key)
               .withColumn("_t", (ym - F.col("_first")).cast("long"))
               .filter(F.col("_t").between(-months_before, 0)))
    stats = aligned.groupBy(F.col("_t").alias("t")).agg(
        F.avg(feature).alias("mean"),
        F.count(feature).alias("count"),
    )
    med = ranks.exact_quantiles(aligned.withColumnRenamed("_t", "t"), ["t"], feature, [0.5],
                                n_groups_bound=months_before + 1)
    return stats.join(med, "t", "left").select("t", "mean", F.col("quantiles")[0].alias("median"), "count")


def forward_target_monthly(df: DataFrame, horizon_months: int = config.FORWARD_HORIZON_MONTHS,
                           target_col: str = config.FORWARD_TARGET_COL,
                           valid_mask_col: str = config.VALID_MASK_COL,
                           key: str = "credit_id", date_col: str = "report_date_as_of") -> DataFrame:
    """T2 + T3 with the same results as ``forward_target`` for panels with hot contracts: the flag
    is first reduced to one row per (contract, calendar month) - combined map-side, at most one
    row per month of a contract's life however many rows it has - the range window runs on that,
    and the result is joined back on (contract, month)."""
    if key not in df.columns or date_col not in df.columns:
        raise ValueError(f"forward_target needs {key} and {date_col}")
    if config.TARGET_COL not in df.columns:
        df = default_flag(df)
    df = with_month_index(df, date_col)
    monthly = (df.filter(F.col(MONTH_COL).isNotNull())
               .groupBy(key, MONTH_COL).agg(F.max(config.TARGET_COL).alias("_ymax"), F.count(F.lit(1)).alias("_n")))
    w = Window.partitionBy(key).orderBy(F.col(MONTH_COL)).rangeBetween(1, horizon_months)
    fwd = monthly.select(key, MONTH_COL, F.max("_ymax").over(w).alias("_fmax"), F.sum("_n").over(w).alias("_fn"))
    out = df.join(fwd, [key, MONTH_COL], "left")
    return out.withColumns({
        target_col: F.coalesce(F.col("_fmax"), F.lit(0)).cast("int"),
        valid_mask_col: F.coalesce(F.col("_fn") > 0, F.lit(False)),
    }).drop("_fmax", "_fn")
