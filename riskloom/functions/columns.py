"""Null-safe column helpers (pandas-compatible missing-value semantics on Spark)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_or_null(c: Column) -> Column:
    """NaN and +-inf become NULL (Spark orders NaN above every number and sums propagate it)."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(c)


def clip(c: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """pandas ``clip``: a missing value stays missing (``greatest``/``least`` would skip it)."""
    out = c
    if lower is not None:
        out = F.greatest(out, F.lit(lower))
    if upper is not None:
        out = F.least(out, F.lit(upper))
    return F.when(c.isNotNull(), out)


def truth(pred: Column) -> Column:
    """A comparison with a missing value is false, as in pandas masks."""
    return F.coalesce(pred, F.lit(False))


def col_or(df_cols, name: str, default) -> Column:
    """Column if present, else a literal default (operators tolerate absent columns)."""
    return F.col(name) if name in df_cols else F.lit(default)


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days of a time difference, floored (pandas ``Timedelta.days``)."""
    micros = F.timestamp_diff("MICROSECOND", earlier.cast("timestamp_ntz"), later.cast("timestamp_ntz"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("double")


def month_index(ts: Column) -> Column:
    """Calendar month as an integer (year * 12 + month - 1)."""
    return F.year(ts) * 12 + F.month(ts) - 1


MONTH_COL = "report_month_idx"


def with_month_index(df, date_col: str = "report_date_as_of"):
    """Add the calendar-month index once as a column: every per-contract window then orders by
    the same attribute, so Spark sorts the exchanged panel once for all of them."""
    if MONTH_COL in df.columns:
        return df
    return df.withColumn(MONTH_COL, month_index(df[date_col]))
