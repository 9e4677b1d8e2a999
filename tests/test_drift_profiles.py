import os

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from riskloom.operators import drift
from riskloom.plans import jobs, marts, profiles
from riskloom.sources.fixture import raw_panel

NUM, CAT = ["a", "b", "risk_score"], ["c"]


def _side(spark, rows):
    return spark.createDataFrame(rows, "report_date_as_of date, a double, b double, c string, default_target int, risk_score double")


def _rows(spark, seed, n=120):
    import datetime as dt
    import random
    r = random.Random(seed)
    return [(dt.date(2020, 1 + i % 3, 1 + i % 20) if i % 11 else None, r.choice([None, float("nan"), 1.0, r.random() + seed]),
             float(i % 7), r.choice([None, "nan", "x", f"y{seed}"]), r.choice([None, 0, 1]), r.choice([None, round(r.random(), 1)]))
            for i in range(n)]


def _table(df):
    return {r["feature"]: tuple("nan" if x != x else x if not isinstance(x, float) else round(x, 10) for x in r[1:]) for r in df.collect()}


def test_a_stored_reference_gives_the_table_of_both_sides(spark, tmp_path):
    ref, cur, out = _side(spark, _rows(spark, 0)), _side(spark, _rows(spark, 1, 90)), str(tmp_path / "p")
    expected = _table(drift.data_drift(ref, cur, NUM, CAT))
    assert profiles.save_profile(ref, out, NUM, CAT) == [0, 202001, 202002, 202003]
    assert _table(drift.data_drift_of_counts(profiles.compare(spark, out, cur, NUM, CAT), NUM, CAT)) == expected


def test_months_add_up_and_are_replaced_alone(spark, tmp_path):
    ref, whole, parts = _side(spark, _rows(spark, 0)), str(tmp_path / "whole"), str(tmp_path / "parts")
    month = marts.month_number()
    profiles.save_profile(ref, whole, NUM, CAT)
    for m in (202003, 0, 202001, 202002):
        assert profiles.save_profile(ref.where(month == m), parts, NUM, CAT) == [m]
    cols = ["report_month", "kind", "feature", "value", "level", "n", "pos"]
    read = lambda folder: sorted(map(str, profiles.read_profile(spark, folder).select(*cols).collect()))
    assert read(parts) == read(whole)
    profiles.save_profile(ref.where(month == 202001).limit(3), parts, NUM, CAT)
    total = profiles.read_profile(spark, parts, [202001]).where("kind = 'cat'").agg(F.sum("n")).first()[0]
    assert total == 3
    assert profiles.save_profile(ref.limit(0), parts, NUM, CAT, months=[202002]) == []
    assert {r[0] for r in profiles.read_profile(spark, parts).select("report_month").distinct().collect()} == {0, 202001, 202003}
    profiles.save_profile(ref.limit(0), parts, NUM, CAT, replace=True)
    with pytest.raises(FileNotFoundError):
        profiles.read_profile(spark, parts)


def test_job_equals_the_job_on_both_sides(spark, tmp_path):
    raw = raw_panel(spark, SF001)
    cut = F.lit("1998-01-01").cast("date")
    ref, cur = raw.filter(F.col("report_date_as_of") < cut), raw.filter(F.col("report_date_as_of") >= cut)
    num, cat = ["utilization", "dpd", "pdn_current"], ["sex", "dpd_bucket"]
    both = jobs.drift_job(ref, cur, num, cat)
    jobs.save_drift_reference(ref, str(tmp_path / "p"), num, cat)
    stored = jobs.drift_job_stored(str(tmp_path / "p"), cur, num, cat, out_dir=str(tmp_path / "out"))
    assert stored.keys() == both.keys() and stored["summary"] == both["summary"] and stored["needs_retrain"] == both["needs_retrain"]
    for k in ("score_psi", "auc_reference", "auc_current"):
        assert stored[k] == pytest.approx(both[k], abs=1e-12)
    for k in ("metrics_reference", "metrics_current"):
        assert {c: pytest.approx(v, abs=1e-9) for c, v in both[k].items()} == stored[k]
    assert os.path.exists(tmp_path / "out" / "verdict")
