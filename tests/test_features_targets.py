import datetime as dt
import math

import numpy as np
import pandas as pd

from riskloom.operators import features, targets


def test_psk_bucket_bounds(spark):
    df = spark.createDataFrame([(None,), (10.0,), (10.01,), (20.0,), (30.0,), (31.0,)], "psk_current double")
    out = [r.psk_bucket for r in features.pdn_features(df).collect()]
    assert out == [None, "low", "mid", "mid", "high", "extreme"]


def test_dpd_bucket_bounds(spark):
    vals = [None, -1.0, -0.5, 0.0, 0.5, 5.0, 30.0, 60.0, 90.0, 180.0, 10000.0, 10001.0]
    df = spark.createDataFrame([(v,) for v in vals], "dpd double")
    out = [r.dpd_bucket for r in features.dpd_features(df).collect()]
    assert out == ["current", None, "current", "current", "1-5", "1-5", "6-30", "31-60", "61-90", "91-180",
                   "180+", None]


def test_payment_row_stats_skip_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0, 6.0), (None, 4.0, None), (None, None, None)],
                               "payment_sum_1m double, payment_sum_2m double, payment_sum_3m double")
    out = features.payment_features(df).collect()
    ref = pd.DataFrame([(1.0, 2.0, 6.0), (None, 4.0, None), (None, None, None)], dtype=float)
    assert out[0].payment_mean_3m == ref.mean(axis=1)[0]
    assert math.isclose(out[0].payment_std_3m, ref.std(axis=1)[0], rel_tol=1e-15)
    assert out[1].payment_mean_3m == 4.0 and out[1].payment_std_3m is None
    assert out[2].payment_mean_3m is None


def _history(spark):
    d = dt.datetime
    rows = [(1, d(2020, 1, 1), 10.0, 0.0), (1, d(2020, 2, 1), None, 0.0), (1, d(2020, 4, 1), 30.0, 95.0),
            (1, d(2020, 8, 1), 0.0, 0.0), (1, d(2020, 9, 1), 50.0, 0.0), (1, d(2020, 10, 1), 60.0, 0.0),
            (1, d(2020, 11, 1), 70.0, 0.0), (2, d(2021, 5, 1), 5.0, 100.0),
            (3, d(2020, 1, 15), 1.0, 0.0), (3, d(2020, 2, 10), 2.0, 91.0), (3, d(2020, 5, 1), 3.0, 0.0)]
    return spark.createDataFrame(rows, "credit_id long, report_date_as_of timestamp_ntz, total_debt double, "
                                       "dpd double"), rows


def test_rolling_matches_pandas_groupby_rolling(spark):
    df, rows = _history(spark)
    out = features.rolling_features(df).orderBy("credit_id", "report_date_as_of").toPandas()
    pdf = pd.DataFrame(rows, columns=["credit_id", "report_date_as_of", "total_debt", "dpd"]).sort_values(
        ["credit_id", "report_date_as_of"]).reset_index(drop=True)
    g = pdf.groupby("credit_id")["total_debt"]
    exp = {
        "total_debt_diff_1m": g.diff(1),
        "total_debt_pct_change_1m": g.pct_change(1, fill_method=None).replace([np.inf, -np.inf], np.nan),
        "total_debt_mean_3m": g.rolling(3, min_periods=1).mean().reset_index(level=0, drop=True),
        "total_debt_std_3m": g.rolling(3, min_periods=1).std().reset_index(level=0, drop=True),
        "total_debt_mean_6m": g.rolling(6, min_periods=1).mean().reset_index(level=0, drop=True),
        "total_debt_std_6m": g.rolling(6, min_periods=1).std().reset_index(level=0, drop=True),
    }
    for col, e in exp.items():
        np.testing.assert_allclose(out[col].astype(float).to_numpy(), e.astype(float).to_numpy(), rtol=1e-12,
                                   equal_nan=True, err_msg=col)


def _brute_forward(rows, h=3):
    out = {}
    by = {}
    for cid, date, _, dpd in rows:
        by.setdefault(cid, []).append((date, 1 if dpd > 90 else 0))
    for cid, items in by.items():
        for date, _ in items:
            m = date.year * 12 + date.month
            fut = [y for d2, y in items if 1 <= (d2.year * 12 + d2.month) - m <= h]
            out[(cid, date)] = (max(fut) if fut else 0, bool(fut))
    return out


def test_forward_target_gaps_and_horizon(spark):
    df, rows = _history(spark)
    got = {(r.credit_id, r.report_date_as_of): (r.default_future, r.has_future_obs)
           for r in targets.forward_target(df).collect()}
    assert got == _brute_forward(rows)
    # a forward label implies a future observation
    assert all(h for y, h in got.values() if y == 1)


def test_forward_target_null_date_has_no_future(spark):
    df = spark.createDataFrame([(1, None, 100.0), (1, dt.datetime(2020, 1, 1), 0.0)],
                               "credit_id long, report_date_as_of timestamp_ntz, dpd double")
    got = {r.report_date_as_of: (r.default_future, r.has_future_obs) for r in targets.forward_target(df).collect()}
    assert got[None] == (0, False)
    assert got[dt.datetime(2020, 1, 1)] == (0, False)


def test_pre_default_trajectory_brute_force(spark):
    df, rows = _history(spark)
    df = targets.default_flag(df)
    got = {r.t: (r.mean, r.median, r["count"]) for r in targets.pre_default_trajectory(df, "total_debt", 6).collect()}
    pdf = pd.DataFrame(rows, columns=["credit_id", "date", "total_debt", "dpd"])
    pdf["ym"] = pdf.date.dt.year * 12 + pdf.date.dt.month
    first = pdf[pdf.dpd > 90].groupby("credit_id").ym.min()
    pdf = pdf.join(first.rename("f"), on="credit_id").dropna(subset=["f"])
    pdf["t"] = pdf.ym - pdf.f
    pdf = pdf[(pdf.t <= 0) & (pdf.t >= -6)]
    exp = pdf.groupby("t").total_debt.agg(["mean", "median", "count"])
    assert set(got) == set(int(t) for t in exp.index)
    for t, row in exp.iterrows():
        m, med, c = got[int(t)]
        assert c == row["count"]
        if row["count"]:
            assert math.isclose(m, row["mean"]) and math.isclose(med, row["median"])


def test_one_exchange_for_all_contract_windows(spark):
    df, _ = _history(spark)
    out = targets.forward_target(features.feature_set(df))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(credit_id") == 1
    assert plan.count("Sort [credit_id") == 1


def test_ranged_rolling_equals_contract_windows_with_hot_contract(spark):
    from pyspark.sql import functions as F
    from conftest import SF001
    from riskloom.operators import cleaning
    from riskloom.sources.fixture import raw_panel
    panel = cleaning.prepare_panel(raw_panel(spark, SF001))
    # make one contract hot: replicate its history many times (distinct rows via a date shift)
    hot = panel.filter(F.col("credit_id") == panel.select(F.min("credit_id")).first()[0])
    copies = hot.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn(
        "report_date_as_of", F.col("report_date_as_of") + F.expr("make_interval(0, 0, 0, 0, 0, 0, _k)")).drop("_k")
    df = panel.unionByName(copies)
    cols = [c for c in features.rolling_features(df).columns]
    a = features.rolling_features(df).select(*cols)
    b = features.rolling_features_ranged(df, buckets=9).select(*cols)
    assert b.count() == df.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_monthly_forward_target_equals_window_version(spark):
    from pyspark.sql import functions as F
    df, rows = _history(spark)
    # duplicate rows inside months (a hot contract) and a missing date
    extra = spark.createDataFrame([(1, dt.datetime(2020, 4, 20), 1.0, 99.0), (1, None, 1.0, 99.0)],
                                  "credit_id long, report_date_as_of timestamp_ntz, total_debt double, dpd double")
    df = df.unionByName(extra).unionByName(df.filter(F.col("credit_id") == 1))
    cols = ["credit_id", "report_date_as_of", "total_debt", "dpd", "default_future", "has_future_obs"]
    a = targets.forward_target(df).select(*cols)
    b = targets.forward_target_monthly(df).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
