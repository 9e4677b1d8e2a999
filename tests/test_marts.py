import os

from pyspark.sql import functions as F

from conftest import SF001
from riskloom.operators import cleaning, targets
from riskloom.plans import marts
from riskloom.sources.fixture import raw_panel


def _files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(folder) for f in fs}


def _rows(df, cols):
    return sorted(map(str, df.select(*cols).collect()))


def test_refresh_of_one_month_equals_a_full_build(spark, tmp_path):
    raw = raw_panel(spark, SF001).where("report_date_as_of < '1996-01-01'").cache()
    out, full = str(tmp_path / "marts"), str(tmp_path / "full")
    every = marts.refresh_marts(raw, out, buckets=4)
    before = _files(out)
    changed = raw.withColumn("dpd", F.when(marts.month_number() == 199507, 400).otherwise(F.col("dpd")))
    again = marts.refresh_marts(changed, out, months=[199507])
    assert set(again) <= {199504, 199505, 199506, 199507} and set(again) < set(every)
    assert all(_files(out)[f] == t for f, t in before.items())              # files of before are untouched
    marts.refresh_marts(changed, full, buckets=4)
    for mart in ("panel", "series"):
        a, b = marts.read_mart(spark, out, mart), marts.read_mart(spark, full, mart)
        assert _rows(a, a.columns) == _rows(b, a.columns)
    # a refresh that died before its manifest was whole changes nothing
    os.makedirs(f"{out}/manifests/v7")
    assert _rows(marts.read_mart(spark, out, "series"), ["total_debt"]) == _rows(marts.read_mart(spark, full, "series"), ["total_debt"])

    panel = targets.default_flag(cleaning.prepare_panel(changed))
    ids = [r.credit_id for r in panel.select("credit_id").distinct().orderBy("credit_id").limit(2).collect()]
    found = marts.client_lookup(spark, out, ids)
    cols = ["credit_id", "report_date_as_of", "dpd", "default_target"]
    assert _rows(found, cols) == _rows(panel.where(F.col("credit_id").isin(ids)), cols)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    read = {r.f for r in found.select(F.input_file_name().alias("f")).distinct().collect()}
    assert 0 < len(read) < len(marts.read_mart(spark, out, "panel").inputFiles())
    assert marts.client_lookup(spark, out, [-1]).count() == 0 and marts.client_lookup(spark, out, []).count() == 0
    raw.unpersist()
