"""Feature engineering.

Row-wise features are plain column arithmetic inside whole-stage codegen.  Rolling features
use one per-contract window specification ordered by (calendar month, report date); the
forward target (T2) orders by the month alone, which is a prefix of that order, so the whole
panel needs one exchange on ``credit_id`` and one sort.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.columns import MONTH_COL, with_month_index


HOT_ROWS = 100_000             # rows of one contract that a task takes whole


def contract_window(key: str = "credit_id", date_col: str = "report_date_as_of", ties: list[str] | None = None):
    """Per-contract row order: calendar month, then the date itself (missing dates last), then the
    columns in ``ties``: rows that repeat a date come in the same order however they are stored."""
    return Window.partitionBy(key).orderBy(F.col(MONTH_COL).asc_nulls_last(), F.col(date_col).asc_nulls_last(),
                                           *[F.col(c).asc_nulls_last() for c in ties or []])


def pdn_features(df: DataFrame) -> DataFrame:
    """F5 + F6: PDN delta and ratio; PSK bucket with right-closed bins at 10 / 20 / 30."""
    present = set(df.columns)
    out = {}
    if {"pdn_initial", "pdn_current"} <= present:
        out["pdn_delta"] = F.col("pdn_current") - F.col("pdn_initial")
        out["pdn_ratio"] = F.col("pdn_current") / (F.abs(F.col("pdn_initial")) + config.EPS)
    if "psk_current" in present:
        p = F.col("psk_current")
        e1, e2, e3 = config.PSK_EDGES
        l1, l2, l3, l4 = config.PSK_LABELS
        out["psk_bucket"] = (F.when(p <= e1, F.lit(l1)).when(p <= e2, F.lit(l2))
                             .when(p <= e3, F.lit(l3)).when(p > e3, F.lit(l4)))
    return df.withColumns(out) if out else df


def _row_mean_std(cols: list[Column]) -> tuple[Column, Column]:
    """Mean and sample std across a fixed list of values, skipping missing ones (pandas axis=1):
    two-pass formula in a fixed order, so every engine gets the same bits."""
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    mean = F.when(n > 0, total / n)
    ss = sum((F.when(c.isNotNull(), (mean - c) * (mean - c)).otherwise(F.lit(0.0)) for c in cols), F.lit(0.0))
    std = F.when(n > 1, F.sqrt(ss / (n - 1)))
    return mean, std


def payment_features(df: DataFrame) -> DataFrame:
    """F7 + F8: mean / std / trend of the three payment sums; payments per month on book."""
    present = set(df.columns)
    out = {}
    pays = ["payment_sum_1m", "payment_sum_2m", "payment_sum_3m"]
    if set(pays) <= present:
        mean, std = _row_mean_std([F.col(c) for c in pays])
        out["payment_mean_3m"] = mean
        out["payment_std_3m"] = std
        out["payment_trend"] = F.col("payment_sum_1m") - F.col("payment_sum_3m")
    if {"cnt_all_payments", "months_on_book"} <= present:
        out["payments_per_month"] = F.try_divide(F.col("cnt_all_payments"), F.col("months_on_book") + config.EPS)
    return df.withColumns(out) if out else df


def dpd_features(df: DataFrame) -> DataFrame:
    """F9 + F10: DPD bucket (missing DPD counts as 0; right-closed bins, outside -> NULL) and
    overdue density."""
    present = set(df.columns)
    out = {}
    if "dpd" in present:
        d = F.coalesce(F.col("dpd"), F.lit(0.0))
        edges, labels = config.DPD_EDGES, config.DPD_LABELS
        expr = None
        for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
            cond = (d > lo) & (d <= hi)
            expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
        out["dpd_bucket"] = expr
    if {"expired_actual_days_count", "months_on_book"} <= present:
        out["overdue_density"] = F.try_divide(F.col("expired_actual_days_count"),
                                              F.col("months_on_book") * 30 + config.EPS)
    return df.withColumns(out) if out else df


def _with_stds(staged: DataFrame, base: list[str], windows: tuple[int, ...]) -> DataFrame:
    """Rolling sample std from the columns and their lags ``_<column>_lag<i>``: two passes over the
    values of the frame, newest first."""
    stats = {}
    for n in windows:
        if n >= 2:
            for c in base:
                vals = [F.col(c)] + [F.col(f"_{c}_lag{i}") for i in range(1, n)]
                stats[f"_{c}_n{n}"] = sum((v.isNotNull().cast("int") for v in vals), F.lit(0))
                total = sum((F.coalesce(v, F.lit(0.0)) for v in vals), F.lit(0.0))
                stats[f"_{c}_m{n}"] = F.when(stats[f"_{c}_n{n}"] > 0, total / stats[f"_{c}_n{n}"])
    staged = staged.withColumns(stats) if stats else staged
    stds = {}
    for n in windows:
        if n >= 2:
            for c in base:
                vals = [F.col(c)] + [F.col(f"_{c}_lag{i}") for i in range(1, n)]
                cnt, mean = F.col(f"_{c}_n{n}"), F.col(f"_{c}_m{n}")
                ss = sum((F.when(v.isNotNull(), (mean - v) * (mean - v)).otherwise(F.lit(0.0)) for v in vals),
                         F.lit(0.0))
                stds[f"{c}_std_{n}m"] = F.when(cnt > 1, F.sqrt(ss / (cnt - 1)))
    return (staged.withColumns(stds) if stds else staged).drop(*stats.keys())


def rolling_features(df: DataFrame, windows: tuple[int, ...] = config.ROLLING_WINDOWS,
                     key: str = "credit_id", date_col: str = "report_date_as_of") -> DataFrame:
    """F1-F4 for total_debt, available_limit, pdn_current, dpd, payment_sum_1m: diff and pct
    change to the previous row of the contract (inf -> NULL), rolling mean over 1/3/6 rows
    (at least one value) and rolling sample std over 3/6 rows (NULL below two values).

    The std is the two-pass formula over the frame's values taken with ``lag`` (newest first),
    so it is reproducible bit for bit; all offsets share the one window specification."""
    if not {key, date_col} <= set(df.columns):
        return df
    base = [c for c in config.ROLLING_BASE_COLS if c in df.columns]
    if not base:
        return df
    df = with_month_index(df, date_col)
    w = contract_window(key, date_col, base)
    out, lags = {}, {}
    max_lag = max(windows) - 1
    for c in base:
        for i in range(1, max(max_lag, 1) + 1):
            lags[f"_{c}_lag{i}"] = F.lag(F.col(c), i).over(w)
    for c in base:
        prev = F.lag(F.col(c), 1).over(w)
        out[f"{c}_diff_1m"] = F.col(c) - prev
        out[f"{c}_pct_change_1m"] = F.try_divide(F.col(c), prev) - 1
    for n in windows:
        frame = w.rowsBetween(-(n - 1), Window.currentRow)
        for c in base:
            out[f"{c}_mean_{n}m"] = F.avg(F.col(c)).over(frame)
    # the lags are computed once by one Window operator; the std arithmetic reads them
    staged = df.withColumns({**lags, **out})
    return _with_stds(staged, base, windows).drop(*lags.keys())


def feature_set(df: DataFrame, include_rolling: bool = True, split_hot: bool = False) -> DataFrame:
    """F5-F10, then optionally F1-F4; with ``split_hot`` by the plan that splits a contract with
    very many rows over several tasks (same results; jobs over whole panels use it)."""
    df = df.transform(pdn_features).transform(payment_features).transform(dpd_features)
    if not include_rolling:
        return df
    return df.transform(rolling_features_ranged if split_hot else rolling_features)


def rolling_features_ranged(df: DataFrame, windows: tuple[int, ...] = config.ROLLING_WINDOWS,
                            key: str = "credit_id", date_col: str = "report_date_as_of",
                            buckets: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """F1-F4 with the same results as ``rolling_features``, for panels where one contract may hold
    a large share of all rows.

    The rows are written once.  Contracts of at most ``hot_rows`` rows (``HOT_ROWS``, or a thousandth of the table if
    that is more) share windows by contract: one exchange.  The rows of the others, at most a thousand contracts, are
    ordered by (contract, month, date, row hash) and cut into ``buckets`` balanced ranges
    at sampled key tuples (like Spark's range partitioner), so a hot contract spans many ranges.
    Every range also receives, as read-only context, the ``max(windows) - 1`` rows that precede it
    in the global order (found from global row positions, so they are right even when a range is
    small); windows then run per (range, contract) and the context rows are dropped.  Work per
    task is bounded by the range size instead of the largest contract.  With ``buckets`` and no ``hot_rows`` every
    contract is cut so."""
    from . import ranks
    if not {key, date_col} <= set(df.columns):
        return df
    base = [c for c in config.ROLLING_BASE_COLS if c in df.columns]
    if not base:
        return df
    halo = max(max(windows) - 1, 1)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    df = with_month_index(df, date_col)
    by_date = ["_m_null", MONTH_COL, "_d_null", "_d_us", "_tie"]
    from ..session import materialize
    keyed = materialize(df.withColumns({
        "_m_null": F.col(MONTH_COL).isNull(),
        "_d_null": F.col(date_col).isNull(),
        "_d_us": F.timestamp_diff("MICROSECOND", epoch, F.col(date_col).cast("timestamp_ntz")),
        "_tie": F.xxhash64(*[F.col(c) for c in df.columns]),
    }))

    def rolled(rows, w):
        out, lags = {}, {}
        for c in base:
            for i in range(1, halo + 1):
                lags[f"_{c}_lag{i}"] = F.lag(F.col(c), i).over(w)
            prev = F.lag(F.col(c), 1).over(w)
            out[f"{c}_diff_1m"] = F.col(c) - prev
            out[f"{c}_pct_change_1m"] = F.try_divide(F.col(c), prev) - 1
        for n in windows:
            for c in base:
                out[f"{c}_mean_{n}m"] = F.avg(F.col(c)).over(w.rowsBetween(-(n - 1), Window.currentRow))
        staged = rows.withColumns({**lags, **out})
        staged = staged.filter(~F.col("_halo")) if "_halo" in rows.columns else staged
        return _with_stds(staged, base, windows).drop(*lags.keys(), "_m_null", "_d_null", "_d_us", "_tie", "_gpos",
                                                      "_bucket", "_halo")

    if hot_rows is None:
        hot_rows = 0 if buckets else max(HOT_ROWS, keyed.count() // 1000)
    parts, hot = [], keyed
    if hot_rows:
        found = [r[0] for r in keyed.groupBy(key).count().where(F.col("count") > hot_rows).select(key).collect()]
        known = [k for k in found if k is not None]
        is_hot = F.col(key).isNull() if len(known) < len(found) else F.lit(False)
        if known:
            is_hot = is_hot | F.coalesce(F.col(key).isin(known), F.lit(False))
        plain = rolled(keyed.filter(~is_hot) if found else keyed, Window.partitionBy(key).orderBy(*by_date))
        if not found:
            return plain
        parts, hot = [plain], keyed.filter(is_hot)
    order = [(c, False) for c in [key, *by_date]]
    pos = materialize(ranks.row_positions(hot, order, buckets=buckets, pos_col="_gpos", keep_bucket=True))
    starts = sorted((r["_bucket"], r["_start"]) for r in
                    pos.groupBy("_bucket").agg(F.min("_gpos").alias("_start")).collect())
    both = pos.withColumn("_halo", F.lit(False))
    if len(starts) > 1:
        before = sorted({s - i for _, s in starts for i in range(1, halo + 1)})
        arr = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(s).alias("s")) for b, s in starts])
        targets = F.filter(arr, lambda t: (t["s"] > F.col("_gpos")) & (t["s"] <= F.col("_gpos") + halo))
        ctx = (pos.filter(F.col("_gpos").isin(before)).withColumn("_t", F.explode(targets))
               .withColumn("_bucket", F.col("_t")["b"]).drop("_t").withColumn("_halo", F.lit(True)))
        both = both.unionByName(ctx)
    out = rolled(both, Window.partitionBy("_bucket", key).orderBy("_gpos"))
    return parts[0].unionByName(out) if parts else out
