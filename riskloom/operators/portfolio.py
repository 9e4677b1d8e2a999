"""Portfolio aggregates: KPI, by-dimension, monthly series, schema and numeric profiles,
histograms, client card (A1-A3, A6-A8, V3-V4)."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from . import ranks


def _sum0(c: str) -> F.Column:
    """pandas sums skip missing values and give 0 for an all-missing group."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def portfolio_kpi(df: DataFrame, target_col: str = config.TARGET_COL) -> DataFrame:
    """A1: one row of KPIs; a measure whose column is absent is NULL."""
    present = set(df.columns)

    def pick(col, expr, dtype="double"):
        return (expr if col in present else F.lit(None).cast(dtype))

    return df.agg(
        (F.count_distinct("credit_id") if "credit_id" in present else F.count(F.lit(1))).alias("n_contracts"),
        pick("borrower_id", F.count_distinct("borrower_id"), "bigint").alias("n_borrowers"),
        pick("total_debt", _sum0("total_debt")).alias("total_debt"),
        pick("available_limit", _sum0("available_limit")).alias("available_limit"),
        pick("pdn_current", F.avg("pdn_current")).alias("avg_pdn_current"),
        pick("dpd", F.avg("dpd")).alias("avg_dpd"),
        pick(target_col, F.avg(target_col)).alias("default_rate"),
        pick("total_debt_reserve", _sum0("total_debt_reserve")).alias("reserve_amount"),
    )


def aggregate_by(df: DataFrame, by: str, target_col: str = config.TARGET_COL) -> DataFrame:
    """A2: by one dimension (NULL group kept): distinct contracts, sums, means, default rate;
    most contracts first (the dimension value breaks ties)."""
    if by not in df.columns:
        raise KeyError(by)
    present = set(df.columns)
    aggs = [F.count_distinct("credit_id").alias("n_contracts")]
    aggs += [_sum0(c).alias(c) for c in ["total_debt", "available_limit", "total_debt_reserve", "payment_sum_1m"]
             if c in present]
    aggs += [F.avg(c).alias(c) for c in ["pdn_current", "dpd", "utilization"] if c in present]
    if target_col in present:
        aggs.append(F.avg(target_col).alias("default_rate"))
    return df.groupBy(by).agg(*aggs).orderBy(F.desc("n_contracts"), F.asc_nulls_first(by))


def default_rate_over_time(df: DataFrame, target_col: str = config.TARGET_COL) -> DataFrame:
    """A3: per calendar month (rows without a date dropped): distinct contracts, debt sum (row
    count if there is no debt column), default rate, mean DPD; the month is its first day."""
    if "report_date_as_of" not in df.columns:
        return df.sparkSession.createDataFrame([], "report_date_as_of date")
    present = set(df.columns)
    aggs = [F.count_distinct("credit_id").alias("n_contracts"),
            (_sum0("total_debt") if "total_debt" in present else F.count("credit_id").cast("double")).alias(
                "total_debt")]
    if target_col in present:
        aggs.append(F.avg(target_col).alias("default_rate"))
    if "dpd" in present:
        aggs.append(F.avg("dpd").alias("avg_dpd"))
    month = F.date_trunc("month", F.col("report_date_as_of")).cast("timestamp_ntz")
    return (df.filter(F.col("report_date_as_of").isNotNull())
            .groupBy(month.alias("report_date_as_of")).agg(*aggs)
            .orderBy("report_date_as_of"))


def _as_string(c: str, dtype: T.DataType) -> F.Column:
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.col(c))
    return F.col(c).cast("string")


def _key_of(f: T.StructField) -> F.Column:
    """A value that is equal for two values of the column exactly if their strings are: a double, a long or a string."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return c.cast("double")
    if isinstance(f.dataType, (T.IntegralType, T.BooleanType)):
        return c.cast("long")
    if isinstance(f.dataType, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(f.dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    return F.hex(c) if isinstance(f.dataType, T.BinaryType) else _as_string(f"`{f.name}`", f.dataType)


def distinct_counts(keys: DataFrame, range_values: int = 1 << 20) -> DataFrame:
    """(i, n_unique): exact number of different non-null values of the i-th column, of doubles, longs and strings.

    Rows are never unpivoted: a task takes the different values of its part of each column and deals them by a hash to
    ranges, sent as arrays; a range holds the values of about ``range_values`` rows.  -0.0 and 0.0 are two values, all
    NaN are one."""
    ranges = max(1, -(-keys.count() // range_values))

    def spread(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 1 << 18:
                yield from deal(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from deal(pa.Table.from_batches(held))

    def deal(table):
        for i, column in enumerate(table.columns):
            column = column.drop_null().combine_chunks()
            if not len(column):
                continue
            if pa.types.is_string(column.type):
                found = pc.unique(column)
                at = pd.util.hash_array(found.to_numpy(zero_copy_only=False), categorize=False) if ranges > 1 else np.zeros(len(found), np.uint64)
            else:
                x = column.to_numpy()
                if x.dtype == np.float64:
                    x = np.where(np.isnan(x), np.nan, x).view(np.int64)          # one NaN
                found = np.unique(x)
                at = found.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
            at = (at % np.uint64(ranges)).astype(np.int32)
            order = np.argsort(at, kind="stable")
            at = at[order]
            ends = np.append(np.flatnonzero(np.diff(at)) + 1, len(at))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)),
                                             found.take(pa.array(order)) if pa.types.is_string(column.type) else pa.array(found[order]))
            none = pa.nulls(len(ends), pa.list_(pa.int64() if pa.types.is_string(column.type) else pa.string()))
            both = [none, lists] if pa.types.is_string(column.type) else [lists, none]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), i, np.int32)), pa.array(at[ends - 1]), *both],
                                             ["i", "r", "longs", "texts"])

    def count(table):
        n = sum(pc.count_distinct(pc.list_flatten(table.column(c))).as_py() for c in ("longs", "texts"))
        return pa.table([pa.array([table.column("i")[0].as_py()], pa.int32()), pa.array([n], pa.int64())], ["i", "n_unique"])

    sent = keys.mapInArrow(spread, "i int, r int, longs array<long>, texts array<string>")
    return sent.groupBy("i", "r").applyInArrow(count, "i int, n_unique long").groupBy("i").agg(F.sum("n_unique").alias("n_unique"))


def schema_profile(df: DataFrame, exact: bool = True, with_sample: bool = True,
                   order_cols: tuple[str, ...] = ("credit_id", "report_date_as_of")) -> DataFrame:
    """Per column type, missing count and %, distinct non-missing values and a sample
    (the first non-missing value in ``order_cols`` order); most-missing first.

    Counts and samples of all columns come from one pass each; distinct counts from the different values that each
    task finds (``distinct_counts``; ``exact=False`` uses HyperLogLog instead)."""
    from ..session import materialize
    fields = df.schema.fields
    order = [F.col(c) for c in order_cols if c in df.columns]
    text = [_as_string(f"`{f.name}`", f.dataType) for f in fields]
    keys = materialize(df.select(*[_key_of(f).alias(f"k{i}") for i, f in enumerate(fields)])) if exact else None

    def by_column(table, one):
        """The row of an aggregate over all rows as a row a column."""
        row = table.agg(F.count(F.lit(1)).alias("_n"), *[one(i).alias(f"v{i}") for i in range(len(fields))]).where("_n > 0")
        cells = [F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("v")) for i in range(len(fields))]
        return row.select("_n", F.explode(F.array(*cells)).alias("c")).select("_n", "c.i", "c.v")

    known = (lambda i: F.count(f"k{i}")) if exact else lambda i: F.count(text[i])
    base = by_column(keys if exact else df, known).select("i", "_n", (F.col("_n") - F.col("v")).alias("n_missing"))
    unique = (distinct_counts(keys) if exact else
              by_column(df, lambda i: F.approx_count_distinct(text[i])).select("i", F.col("v").alias("n_unique")))
    base = base.join(ranks.small_broadcast(unique, len(fields)), "i", "left").fillna(0, ["n_unique"])
    if with_sample:
        def first(i):
            return F.min_by(text[i], F.when(text[i].isNotNull(), F.struct(*order))) if order else F.first(text[i], ignorenulls=True)
        base = base.join(ranks.small_broadcast(by_column(df, first).select("i", F.col("v").alias("sample")), len(fields)), "i", "left")
    out = base.select(
        F.array(*[F.lit(f.name) for f in fields])[F.col("i")].alias("column"),
        F.array(*[F.lit(f.dataType.simpleString()) for f in fields])[F.col("i")].alias("dtype"),
        F.col("n_missing"),
        F.bround(F.col("n_missing") / F.col("_n") * 100, 2).alias("pct_missing"),
        F.col("n_unique").cast("long").alias("n_unique"),
        *(["sample"] if with_sample else []),
    )
    return out.orderBy(F.desc("pct_missing"), "column")


NUMERIC_PROBS = [0.01, 0.05, 0.5, 0.95, 0.99]


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per numeric column count, mean, sample std, min, p1, p5, p50, p95, p99, max, missing
    count and %.  One (column, value) histogram, written once to the checkpoint folder, feeds the
    moments (two-pass std over the histogram) and, by its running counts, the exact percentiles."""
    from ..session import materialize
    cols = columns or [c for c in config.NUMERIC_COLS if c in df.columns]
    wide = materialize(df.select(*[F.col(c).cast("double").alias(c) for c in cols]))
    vals = ranks.running_histogram(wide, cols, stored=True)
    # a row a column, also for one without values
    rows = (wide.agg(F.count(F.lit(1)).alias("_n")).where("_n > 0")
            .select("_n", F.explode(F.array(*map(F.lit, cols))).alias("feature")))
    known = vals.groupBy("feature").agg(
        F.sum("n").alias("count"), F.try_divide(F.sum(F.col("n") * F.col("value")), F.sum("n")).alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    first = (rows.join(known, "feature", "left").fillna(0, ["count"])
             .select("feature", "count", (F.col("_n") - F.col("count")).alias("n_missing"), "_n", "mean", "min", "max"))
    first = ranks.small_broadcast(first, len(cols))
    dev = (vals.join(first.select("feature", "mean", "count"), "feature")
           .groupBy("feature").agg(
               F.when(F.first("count") > 1, F.sqrt(F.sum(F.col("n") * (F.col("value") - F.col("mean"))
                                                         * (F.col("value") - F.col("mean")))
                                              / (F.first("count") - 1))).alias("std")))
    q = ranks.quantiles_from_histogram(vals, ["feature"], NUMERIC_PROBS, n_groups_bound=len(cols))
    names = ["p1", "p5", "p50", "p95", "p99"]
    return (first.join(dev, "feature", "left").join(q, "feature", "left")
            .select("feature", "count", "mean", "std", "min",
                    *[F.col("quantiles")[i].alias(n) for i, n in enumerate(names)],
                    "max", "n_missing",
                    F.bround(F.col("n_missing") / F.col("_n") * 100, 2).alias("pct_missing")))


def histogram(df: DataFrame, column: str, bins: int = 60, by: str | None = None) -> DataFrame:
    """Equal-width histogram of ``column`` (optionally split by ``by``); the last edge is
    closed.  The range is a one-row scalar subquery; binning and counting stay distributed
    and are combined map-side."""
    from ..session import materialize
    x = F.col(column).cast("double")
    vals = materialize(df.select(x.alias("x"), *([F.col(by)] if by else [])).filter(F.col("x").isNotNull()))
    rng = vals.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    lo, hi = rng["lo"], rng["hi"]
    width = (hi - lo) / bins
    b = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)))
    grouped = vals.withColumn("bin", b.cast("int")).groupBy(*([by] if by else []), "bin").agg(
        F.count(F.lit(1)).alias("count"))
    return grouped.select(
        *([by] if by else []), "bin",
        (lo + F.col("bin") * width).alias("bin_start"),
        (lo + (F.col("bin") + 1) * width).alias("bin_end"),
        "count")


HISTORY_COLS = ("dpd", "total_debt", "pdn_current", "payment_sum_1m")


def client_card(panel: DataFrame, scored: DataFrame | None = None, credit_id=None) -> DataFrame:
    """V4: per contract the latest snapshot, the number of history rows, the first report date and
    ``history``, an array of (date, ``HISTORY_COLS``) ordered by date; with ``scored`` also score,
    zone, fired rules, recommendations and priority.  With ``credit_id`` the scan is filtered first
    (parquet row groups are pruned).  A card holds one contract's history: its months on book."""
    from .cleaning import last_slice
    fields = [c for c in HISTORY_COLS if c in panel.columns]
    if credit_id is not None:
        panel = panel.filter(F.col("credit_id") == credit_id)
        scored = scored.filter(F.col("credit_id") == credit_id) if scored is not None else None
    span = panel.groupBy("credit_id").agg(F.count(F.lit(1)).alias("n_history"),
                                          F.min("report_date_as_of").alias("first_report_date"),
                                          F.sort_array(F.collect_list(F.struct("report_date_as_of", *fields))).alias("history"))
    card = last_slice(panel).join(span, "credit_id")
    if scored is not None:
        keep = [c for c in ["credit_id", "risk_score", "zone", "rules_triggered", "recommendations", "priority"]
                if c in scored.columns]
        card = card.join(scored.select(*keep), "credit_id", "left")
    return card


def client_history(panel: DataFrame, credit_id, cols: tuple[str, ...] = ("report_date_as_of", *HISTORY_COLS)) -> DataFrame:
    """V4: the history rows of one contract ordered by date (kept as rows, never collected)."""
    keep = ["credit_id"] + [c for c in cols if c in panel.columns]
    return panel.filter(F.col("credit_id") == credit_id).select(*keep).orderBy("report_date_as_of")
