"""Odd input that once broke operators: one class, NaN flags, rules outside the known language, a stream started twice."""
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom import config
from riskloom.functions import rules as R
from riskloom.operators import cleaning, explain, metrics, modeling, screening
from riskloom.plans import catalog
from riskloom.sources.fixture import raw_panel
from riskloom.streaming import scoring

SF001 = "/root/testdata/sf0.001"


def test_one_class_metrics(spark):
    for label in (0, 1):
        df = spark.createDataFrame([(label, 0.2), (label, 0.7)], "y int, score double")
        row = metrics.binary_report(df).first()
        assert row.n == 2 and row.roc_auc is None and row.positive_rate == label and row.brier is not None
        assert metrics.pr_table(df).count() == 3
    empty = spark.createDataFrame([], "y int, score double")
    assert metrics.binary_report(empty).first().roc_auc is None


def test_nan_flags_count_as_zero(spark):
    df = spark.createDataFrame([("nan",), ("1",), (None,), ("1e300",), ("x",)], "sold_flg string")
    assert [r[0] for r in cleaning.cast_types(df).collect()] == [0, 1, 0, 0, 0]


RULES = [("(dpd > 30) & (z < 1)", [True, False, False]), ("dpd > 30 AND z < 1", [True, False, False]), ("~(dpd > 30) | (s == 'a')", [True, True, True]),
         ("dpd / z > 3", [False, True, False]), ("s IN ('a', 'b') and not dpd <= 30", [True, False, False]), ("s.isin(['a'])", [True, False, False]),
         ("z IS NULL", [False, False, True]), ("z.notna()", [True, True, False]), ("-5 < z <= 0 or dpd == 7", [True, False, True]), ("abs(z - 2) >= 2", [True, False, False]),
         ("s > 3", [False, False, False]), ("missing > 3", [False, False, False]), ("flag", [True, False, False]), ("s = 'a OR b'", [False, False, False])]


@pytest.mark.parametrize("text,want", RULES)
def test_rules(spark, text, want):
    df = spark.createDataFrame([(40.0, 0, "a", True), (10.0, 3, "b", False), (7.0, None, None, None)], "dpd double, z int, s string, flag boolean")
    assert [r[0] for r in df.select(R.rule_column(df, text)).collect()] == want


@pytest.mark.parametrize("text", ["reflect('java.lang.System', 'exit', 1)", "dpd > (SELECT 1)", "java_method('x')", "dpd.map(len)", "__import__('os')", "dpd ** 2 > 1",
                                  "[x for x in dpd]", "dpd > 30;", "dpd if dpd else z", ""])
def test_text_that_is_no_rule_is_refused(spark, text):
    df = spark.createDataFrame([(1.0, 2)], "dpd double, z int")
    with pytest.raises(ValueError):
        R.rule_column(df, text)


def test_screened_features_are_all_candidates(spark):
    assert sorted(catalog.SCREEN_FEATURES) == sorted(screening.numeric_candidates(catalog.featured(spark, SF001)))
    ref, _ = catalog.drift_sides(spark, SF001)
    num, cat = cleaning.feature_columns(ref)
    assert set(num) - {"risk_score"} <= set(catalog.DRIFT_NUM) and set(cat) <= set(catalog.DRIFT_CAT)


def test_pearson_on_incomplete_and_constant_columns(spark):
    rows = [(float(i), float(i * i) if i % 3 else None, 5.0, 1e9 + i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3)
    got = {(r.feature_a, r.feature_b): r["corr"] for r in screening.pearson_matrix(df, ["a", "b", "c", "d"]).collect()}
    assert len(got) == 6
    for (x, y), corr in got.items():
        pairs = np.array([(r["abcd".index(x)], r["abcd".index(y)]) for r in rows if r["abcd".index(x)] is not None and r["abcd".index(y)] is not None])
        if "c" in (x, y):
            assert corr is None
        else:
            assert abs(corr - np.corrcoef(pairs.T - pairs.mean(0)[:, None])[0, 1]) < 1e-12


def test_explanations_are_of_the_newest_rows(spark):
    rows = catalog.newest_rows(spark, SF001)
    want = {(r.credit_id, r.d) for r in catalog.featured(spark, SF001).groupBy("credit_id").agg(F.max("report_date_as_of").alias("d")).collect()}
    assert {(r.credit_id, r.report_date_as_of) for r in rows.select("credit_id", "report_date_as_of").collect()} == want


def test_contributions_of_given_coefficients(spark):
    df = spark.createDataFrame([(1, 1.0, "u", 0), (2, 3.0, "v", 1), (3, None, "u", 0), (4, 8.0, "v", 1), (5, 2.0, "u", 1), (6, 9.0, "v", 0)] * 20, "credit_id long, a double, s string, y int")
    model = modeling._fit(df, ["a"], ["s"], "y", "logreg", {"maxIter": 20})
    scaler, coef = model.pipeline.stages[-2], model.pipeline.stages[-1].coefficients
    one = df.limit(6)
    got = {(r.credit_id, r.feature): r for r in explain.contributions(model, one).collect()}
    filled = {1: 1.0, 2: 3.0, 3: 3.0, 4: 8.0, 5: 2.0, 6: 9.0}     # 3 is the median of 1, 2, 3, 8, 9
    assert model.medians == {"a": 3.0}
    mean = sum(filled.values()) / 6
    for i, v in filled.items():
        assert abs(got[i, "a"].contribution - coef[0] * (v - mean) / scaler.std[0]) < 1e-9
    assert got[3, "a"].value is None and got[2, "a"].value == "3.0" and got[1, "s_u"].value == "u"
    top = explain.explain_top(model, one, 2).where("credit_id = 4").collect()
    assert [r.rank for r in top] == [1, 2] and abs(top[0].contribution) >= abs(top[1].contribution)


def test_an_input_without_values_is_left_out(spark):
    df = spark.createDataFrame([(float(i % 5), None, i % 2) for i in range(40)], "a double, b double, y int")
    assert modeling._fit(df, ["a", "b"], [], "y", "logreg", {"maxIter": 5}).numeric_features == ["a"]


def test_a_stream_started_twice_scores_each_row_once(spark):
    root = tempfile.mkdtemp(prefix="riskloom-stream-")
    raw = raw_panel(spark, SF001).cache()
    src, sink = os.path.join(root, "src"), os.path.join(root, "sink")
    half = F.pmod(F.xxhash64("credit_id", "report_date_as_of"), F.lit(2))
    for part in (0, 1):
        raw.where(half == part).coalesce(1).write.mode("append").parquet(src)
        scoring.run_scoring_stream(spark, src, raw.schema, sink)
    got = spark.read.parquet(sink)
    assert got.count() == raw.count() and got.select("credit_id", "report_date_as_of").exceptAll(raw.select("credit_id", F.col("report_date_as_of").cast("timestamp_ntz"))).isEmpty()


def test_client_card_holds_the_history_by_date(spark):
    from riskloom.operators import portfolio
    panel = catalog.labelled(spark, SF001)
    card = portfolio.client_card(panel).first()
    dates = [h.report_date_as_of for h in card.history]
    assert len(dates) == card.n_history and dates == sorted(dates) and dates[0] == card.first_report_date


def test_rules_file_round_trip_keeps_defaults():
    path = os.path.join(tempfile.mkdtemp(), "r.yaml")
    R.save_rules(config.EWS_RULES, path)
    assert [r["name"] for r in R.load_rules(path)[0]] == [r["name"] for r in config.EWS_RULES]


def test_training_run_and_serving_with_the_model(spark):
    from riskloom.operators.modeling import CreditModel
    from riskloom.plans import jobs
    root = tempfile.mkdtemp(prefix="riskloom-run-")
    raw = raw_panel(spark, SF001)
    out = jobs.run_training(spark, raw, root, params={"maxIter": 20})
    for name in ("panel_profile", "iv", "segment_profile", "ews_summary", "ews_top500", "kpi", "importance", "metrics_json", "rules"):
        assert os.listdir(out[name])
    assert spark.read.option("header", True).csv(out["importance"]).count() <= 40
    panel = catalog.targets.forward_target(catalog.features.feature_set(cleaning.prepare_panel(raw)))
    rows = panel.filter(F.col("has_future_obs"))
    want = screening.target_correlation(rows, cleaning.feature_columns(panel)[0], "default_future").limit(30)
    assert {r.feature for r in spark.read.json(out["iv"]).collect()} <= {r.feature for r in want.collect()}
    model = CreditModel.load(spark, os.path.join(root, "model"))
    batch = scoring.score_records(raw, model)
    src, sink = os.path.join(root, "src"), os.path.join(root, "sink")
    raw.write.parquet(src)
    scoring.run_scoring_stream(spark, src, raw.schema, sink, model=model)
    stream = spark.read.parquet(sink)
    assert stream.count() == batch.count() and stream.exceptAll(batch.select(stream.columns)).isEmpty()
    marts = jobs.build_marts(raw, os.path.join(root, "marts"), model)
    scored = spark.read.parquet(marts["scored"])
    assert scored.where("risk_score IS NULL OR risk_score < 0 OR risk_score > 1").isEmpty() and scored.select("risk_score").distinct().count() > 50
    assert jobs.score_batch(raw, model=model).where("risk_score IS NULL").isEmpty()
    cut = F.lit("1998-07-01").cast("date")
    v = jobs.drift_job(raw.filter(F.col("report_date_as_of") < cut), raw.filter(F.col("report_date_as_of") >= cut), ["total_debt"], ["sex"], model=model)
    assert v["metrics_reference"]["n"] > 0 and 0 <= v["auc_reference"] <= 1


def test_split_without_dates_is_stratified(spark):
    df = spark.createDataFrame([(i, float(i), i % 5 == 0) for i in range(100)], "credit_id long, x double, y boolean").withColumn("_label", F.col("y").cast("double"))
    train, test = modeling.time_split(df)
    assert train.groupBy("y").count().orderBy("y").collect()[0][1] == 64 and train.count() == 80 and test.where("y").count() == 4
    assert train.select("credit_id").intersect(test.select("credit_id")).isEmpty()


def test_a_hot_contract_is_split_in_the_jobs(spark):
    """A third of the rows belong to one contract: marts and training frame give the rows of the plain plan."""
    from riskloom.operators import features, targets
    from riskloom.plans import jobs
    raw = raw_panel(spark, SF001)
    some = raw.limit(400).withColumn("credit_id", F.lit(77).cast(dict(raw.dtypes)["credit_id"]))
    raw = raw.unionByName(some).cache()
    prepared = cleaning.prepare_panel(raw)
    plain = targets.forward_target(features.feature_set(prepared))
    split = targets.forward_target_monthly(features.feature_set(prepared, split_hot=True))
    keys = ["credit_id", "report_date_as_of", "default_future", "has_future_obs"]
    assert sorted(map(str, plain.select(keys).collect())) == sorted(map(str, split.select(keys).collect()))
    paths = jobs.build_marts(raw, tempfile.mkdtemp(prefix="riskloom-hot-"))
    assert spark.read.parquet(paths["panel"]).count() == prepared.count()
