"""Steps that keep their rows once instead of computing them for every reader, against plain results."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.operators import features, portfolio, segments
from riskloom.plans import catalog


def _panel(spark, sizes):
    rows = [(k, dt.datetime(2020, 1, 1) + dt.timedelta(days=9 * i), float(i * i % 7) if i % 5 else None, float(i % 3), float(i), float(i % 11), 1.0)
            for k, n in sizes for i in range(n)]
    rows += rows[:20] + [(sizes[0][0], None, 1.0, 2.0, 3.0, 4.0, 5.0)]
    return spark.createDataFrame(rows, "credit_id long, report_date_as_of timestamp_ntz, total_debt double, available_limit double, pdn_current double, dpd double, payment_sum_1m double")




@pytest.mark.parametrize("hot_rows", [1, 30, 1000])
def test_hot_contracts_alone_are_cut_into_ranges(spark, monkeypatch, hot_rows):
    from riskloom.operators import ranks
    df = _panel(spark, [(1, 90), (2, 7), (3, 40), (None, 35), (5, 2)])
    given, real = [], ranks.row_positions
    monkeypatch.setattr(ranks, "row_positions", lambda rows, *a, **k: given.append(rows.count()) or real(rows, *a, **k))
    plain = features.rolling_features(df)
    got = features.rolling_features_ranged(df, hot_rows=hot_rows).select(*plain.columns)
    assert given == {1: [195], 30: [186], 1000: []}[hot_rows]
    assert got.count() == df.count() and plain.exceptAll(got).isEmpty() and got.exceptAll(plain).isEmpty()


def test_rows_of_ranged_features_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def tap(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    df = _panel(spark, [(1, 90), (2, 7)])
    features.rolling_features_ranged(df.mapInArrow(tap, df.schema), hot_rows=30).count()
    assert seen.value == df.count()


def test_rows_of_a_clustering_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def tap(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    df = spark.createDataFrame([(i, float(i % 9), float(i % 4)) for i in range(60)], "credit_id long, dpd double, utilization double")
    assert segments.kmeans_segment(df.mapInArrow(tap, df.schema), 2).count() == 60
    assert seen.value == 60


SCHEMA = "a double, b string, c date, d int, e timestamp_ntz, f boolean, g binary, h array<int>, z string"


@pytest.mark.parametrize("range_values", [3, 1 << 20])
def test_distinct_counts_are_those_of_the_strings(spark, range_values):
    nan = float("nan")
    rows = [([0.0, -0.0, nan, nan, 1.5, None, 1e300][i % 7], ["x", "", None, "é", "y" * i][i % 5], dt.date(2020, 1, 1 + i % 9) if i % 4 else None,
             i % 6, dt.datetime(2020, 1, 1, 0, 0, 0, i % 8), [True, None][i % 2], [b"\xff", b"\xfe", None][i % 3], [i % 3], None) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    keys = df.select(*[portfolio._key_of(f).alias(f"k{i}") for i, f in enumerate(df.schema.fields)])
    got = {df.columns[r["i"]]: r["n_unique"] for r in portfolio.distinct_counts(keys, range_values).collect()}
    as_text = [F.to_json(c).alias(c) if c == "h" else F.hex(c).alias(c) if c == "g" else F.col(c).cast("string").alias(c) for c in df.columns]
    want = df.select(*as_text).agg(*[F.count_distinct(c).alias(c) for c in df.columns]).first().asDict()
    assert {**dict.fromkeys(df.columns, 0), **got} == want
    whole = {r["column"]: r for r in portfolio.schema_profile(df, order_cols=("d", "e")).collect()}
    assert {c: r["n_unique"] for c, r in whole.items()} == want
    assert whole["z"]["n_missing"] == 80 and whole["z"]["sample"] is None and whole["a"]["dtype"] == "double" and whole["d"]["sample"] == "0"
    assert portfolio.schema_profile(df.limit(0)).count() == 0
    assert {r["column"]: r["n_missing"] for r in portfolio.schema_profile(df, exact=False).collect()} == {c: r["n_missing"] for c, r in whole.items()}


@pytest.mark.parametrize("query", ["drift_verdict", "stored_psi_drift", "stored_chi_square_drift", "dashboard_marts"])
def test_the_raw_panel_is_read_once(spark, monkeypatch, query):
    from conftest import SF001
    seen, real = spark.sparkContext.accumulator(0), catalog.raw_panel

    def tap(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def tapped(spark, sf_dir):
        df = real(spark, sf_dir)
        return df.mapInArrow(tap, df.schema)
    monkeypatch.setattr(catalog, "raw_panel", tapped)
    catalog.QUERIES[query](spark, SF001).collect()
    assert seen.value == real(spark, SF001).count()
