import datetime as dt
import math

from pyspark.sql import functions as F

from riskloom import config
from riskloom.operators import cleaning


def test_cast_types_nan_inf_unparsable(spark):
    df = spark.createDataFrame(
        [("1", float("nan"), "2020-01-31", None, None),
         ("x", float("inf"), "not a date", "1", "A"),
         ("2.5", -float("inf"), None, "0", None)],
        "dpd string, total_debt double, report_date_as_of string, sold_flg string, sex string")
    rows = cleaning.cast_types(df).collect()
    assert [r.dpd for r in rows] == [1.0, None, 2.5]
    assert [r.total_debt for r in rows] == [None, None, None]
    assert rows[0].report_date_as_of == dt.datetime(2020, 1, 31)
    assert rows[1].report_date_as_of is None
    assert [r.sold_flg for r in rows] == [0, 1, 0]
    assert [r.sex for r in rows] == [config.UNKNOWN, "A", config.UNKNOWN]


def test_filter_and_drop(spark):
    df = spark.createDataFrame([(1, 0, 0, "a"), (2, 1, 0, "b"), (3, 0, 1, "c"), (4, 0, 0, "d")],
                               "credit_id long, sold_flg int, forgiven_flg int, education string")
    out = cleaning.filter_portfolio(cleaning.drop_noisy(df))
    assert "education" not in out.columns
    assert sorted(r.credit_id for r in out.collect()) == [1, 4]
    # absent flag columns count as 0
    assert cleaning.filter_portfolio(df.select("credit_id")).count() == 4


def test_derived_fields_ratios_and_clip(spark):
    rows = [
        # ia, al, p1, p2, td, bankruptcy
        (100.0, 50.0, 0.0, 0.0, 10.0, "UNKNOWN"),
        (100.0, -100.0, 5.0, 0.0, -10.0, "stage1"),
        (0.0, 10.0, None, 1.0, None, None),
        (None, 10.0, 1.0, 1.0, 0.0, "UNKNOWN"),
    ]
    df = spark.createDataFrame(rows, "initial_amount double, available_limit double, payment_sum_1m double, "
                                     "payment_sum_2m double, total_debt double, bankruptcy_stage string")
    out = cleaning.derived_fields(df).collect()
    assert out[0].utilization == 50.0 / (100.0 + 1e-6)
    assert out[1].utilization == 1.5          # clipped
    assert out[2].utilization == 0.0          # negative clipped to 0
    assert out[3].utilization is None         # missing stays missing
    assert out[0].payment_ratio_mom == 0.0    # 0 / (0 + eps)
    assert out[1].payment_ratio_mom == 5.0 / 1e-6
    assert [r.is_bankrupt for r in out] == [0, 1, 0, 0]


def test_days_are_floored_time_differences(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 2, 1, 0), dt.datetime(2020, 1, 1, 23, 0)),
                                (dt.datetime(2020, 1, 1, 0, 0), dt.datetime(2020, 1, 1, 0, 0, 1))],
                               "report_date_as_of timestamp_ntz, last_payment_date timestamp_ntz")
    out = cleaning.derived_fields(df).collect()
    assert [r.days_since_last_payment for r in out] == [0.0, -1.0]


def test_last_slice_null_date_is_latest_and_ids_unique(spark):
    d = dt.datetime
    df = spark.createDataFrame([(1, d(2020, 1, 1), 1.0), (1, d(2020, 3, 1), 2.0), (1, None, 3.0),
                                (2, d(2020, 2, 1), 4.0), (2, d(2019, 2, 1), 5.0)],
                               "credit_id long, report_date_as_of timestamp_ntz, v double")
    out = {r.credit_id: r.v for r in cleaning.last_slice(df).collect()}
    assert out == {1: 3.0, 2: 4.0}


def test_feature_columns_44_numeric_4_categorical(spark):
    from riskloom.operators import features, targets
    from pyspark.sql import types as T
    # a one-row panel with every raw column of the reference schema
    fields = [T.StructField(c, T.LongType()) for c in config.ID_COLS]
    fields += [T.StructField(c, T.TimestampNTZType()) for c in config.DATE_COLS]
    fields += [T.StructField(c, T.StringType()) for c in config.CATEGORICAL_COLS]
    fields += [T.StructField(c, T.DoubleType()) for c in config.NUMERIC_COLS]
    fields += [T.StructField(c, T.IntegerType()) for c in config.FLAG_COLS]
    fields += [T.StructField(c, T.StringType()) for c in config.DROP_COLS]
    df = spark.createDataFrame([], T.StructType(fields))
    panel = targets.forward_target(features.feature_set(cleaning.prepare_panel(df)))
    num, cat = cleaning.feature_columns(panel)
    assert (len(num), len(cat)) == (44, 4)
    assert set(cat) == {"sex", "loan_program", "region_from_address", "psk_bucket"}


def test_is_leaky():
    assert cleaning.is_leaky("dpd") and cleaning.is_leaky("dpd_bucket") and cleaning.is_leaky("pdn_current_mean_3m")
    assert not cleaning.is_leaky("pdn_delta") and not cleaning.is_leaky("dpdx")
