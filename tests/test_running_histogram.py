"""Histograms with running sums by ranges, and cuts of an order without moving rows."""
from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from riskloom.operators import drift, modeling, portfolio, ranks, screening

NAN = float("nan")


def plan(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("range_values", [1 << 20, 16])
def test_running_histogram_is_the_grouped_count(spark, range_values):
    rows = [(None if i % 7 == 0 else NAN if i % 11 == 0 else -0.0 if i % 5 == 0 else float(i * 37 % 50), i % 9, None, float(i % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b int, c double, y double").repartition(5)
    got = ranks.running_histogram(df, ["a", "b", "c"], {"sy": F.col("y")}, range_values=range_values).collect()
    want: dict = {}
    for a, b, _, y in rows:
        for f, x in (("a", a), ("b", float(b))):
            if x is not None:
                cell = want.setdefault((f, "nan" if math.isnan(x) else x + 0.0), [0, 0.0])
                cell[0] += 1
                cell[1] += y
    assert {(r.feature, "nan" if math.isnan(r.value) else r.value): [r.n, r.sy] for r in got} == want
    for f in ("a", "b"):
        n = sy = 0
        for r in sorted((r for r in got if r.feature == f), key=lambda r: (math.isnan(r.value), r.value)):
            n, sy = n + r.n, sy + r.sy
            assert (r.cum_n, r.cum_sy) == (n, sy)
    assert ranks.running_histogram(df.where("false"), ["a"]).count() == 0


def test_histograms_do_not_unpivot_rows(spark):
    df = spark.createDataFrame([(float(i % 17), i % 2) for i in range(200)], "x double, default_target int")
    hist = screening.target_histogram(df, ["x"])
    assert "Generate" not in plan(hist) and ranks.prefix_sums(hist, ["feature"], "value", ["n"]) is hist
    sides = drift.side_histogram(df, df, ["x"])
    assert "Generate" not in plan(sides) and {"cum_nr", "cum_nc"} <= set(sides.columns)


def test_numeric_profile_keeps_a_column_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    got = {r.feature: r for r in portfolio.numeric_profile(df, ["a", "b"]).collect()}
    assert (got["a"]["count"], got["a"].n_missing, got["a"].mean, got["a"].p50) == (2, 1, 2.0, 2.0)
    assert (got["b"]["count"], got["b"].n_missing, got["b"].mean, got["b"].p50) == (0, 3, None, None)
    assert portfolio.numeric_profile(df.where("false"), ["a"]).count() == 0


@pytest.mark.parametrize("share", [0.2, 0.35, 1.0, 0.0])
def test_cut_at_with_ties_and_nulls(spark, share):
    rows = [(None if i % 10 == 0 else i % 4, i % 3) for i in range(97)] + [(1, 1)] * 40
    df = spark.createDataFrame(rows, "t int, k int")
    before, after = ranks.cut_at(df, [F.col("t"), F.col("k")], share, buckets=5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    cut = int(len(rows) * (1 - share))
    assert sorted(map(str, (tuple(r) for r in before.collect()))) == sorted(map(str, order[:cut]))
    assert sorted(map(str, (tuple(r) for r in after.collect()))) == sorted(map(str, order[cut:]))


def test_time_split_of_distinct_rows_is_a_filter(spark):
    df = spark.createDataFrame([(i % 12, i, float(i)) for i in range(300)], "report_date_as_of int, credit_id int, x double")
    train, test = modeling.time_split(df)
    assert train.count() == 240 and test.count() == 60
    assert "Window" not in plan(train) and "Join" not in plan(train)
