import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from riskloom.operators import cleaning, ews, features, modeling, segments, targets
from riskloom.plans import jobs
from riskloom.sources.fixture import raw_panel


def _model_frame(spark):
    df = targets.forward_target(features.feature_set(cleaning.prepare_panel(raw_panel(spark, SF001))))
    return df.filter(F.col("has_future_obs"))


def test_model_train_save_load_predicts_identically(spark):
    df = _model_frame(spark).cache()
    num, cat = cleaning.feature_columns(df)
    m = modeling.train_model(df, num, cat, label="default_future", model_type="logreg", params={"maxIter": 20},
                             n_folds=2)
    assert 0.0 <= m.metrics_test["roc_auc"] <= 1.0
    assert m.metrics_train["tp"] + m.metrics_train["fp"] + m.metrics_train["tn"] + m.metrics_train["fn"] \
        == m.metrics_train["n"]
    assert "cv_roc_auc_mean" in m.cv_metrics
    path = tempfile.mkdtemp(prefix="riskloom-model-")
    m.save(path)
    m2 = modeling.CreditModel.load(spark, path)
    a = modeling.predict_proba(m, df).select("credit_id", "report_date_as_of", "risk_score")
    b = modeling.predict_proba(m2, df).select("credit_id", "report_date_as_of", "risk_score")
    assert a.exceptAll(b).count() == 0
    # model columns missing from the input are filled and imputed
    assert modeling.predict_proba(m, df.drop("utilization")).count() == df.count()
    imp = modeling.feature_importance(m)
    assert len(imp) == len(modeling.encoded_feature_names(m))
    df.unpersist()


def test_unseen_category_encodes_to_zeros(spark):
    df = spark.createDataFrame([(float(i), "A" if i % 2 else "B", i % 2) for i in range(200)],
                               "x double, cat string, y int")
    df = df.withColumn("report_date_as_of", F.lit("2020-01-01").cast("timestamp_ntz")).withColumn(
        "credit_id", F.monotonically_increasing_id())
    m = modeling.train_model(df, ["x"], ["cat"], label="y", params={"maxIter": 5}, cv=False)
    new = spark.createDataFrame([(1.0, "Z", 0)], "x double, cat string, y int")
    assert modeling.predict_proba(m, new).first().risk_score is not None


def test_marts_sinks_and_batch_scoring(spark):
    raw = raw_panel(spark, SF001)
    out = tempfile.mkdtemp(prefix="riskloom-marts-")
    paths = jobs.build_marts(raw, out)
    assert spark.read.parquet(paths["panel"]).select("report_month").distinct().count() > 1
    scored = spark.read.parquet(paths["scored"])
    assert scored.select("credit_id").distinct().count() == scored.count()
    assert {"zone", "recommendations", "segment", "priority"} <= set(scored.columns)
    csv = jobs.write_csv(ews.ews_scored(ews.formula_score(cleaning.last_slice(
        targets.default_flag(cleaning.prepare_panel(raw))))), os.path.join(out, "ews_csv"))
    back = spark.read.option("header", "true").csv(csv)
    assert back.count() > 0 and dict(back.dtypes)["rules_triggered"] == "string"
    # batch scoring keeps sold / forgiven contracts
    batch = jobs.score_batch(raw)
    assert batch.count() == raw.select("credit_id").distinct().count()


def test_kmeans_segments_cover_all_rows(spark):
    last = cleaning.last_slice(cleaning.prepare_panel(raw_panel(spark, SF001)))
    seg = segments.kmeans_segment(last, 3)
    assert seg.count() == last.count()
    assert seg.select("cluster").distinct().count() <= 3
    search = segments.kmeans_k_search(last, (2, 3)).collect()
    assert [r.k for r in search] == [2, 3] and all(r.inertia >= 0 for r in search)


def test_tree_metrics_fit_the_whole_model(monkeypatch):
    from riskloom.plans import catalog

    seen = []
    monkeypatch.setattr(catalog, "trained", lambda spark, sf_dir, *how, **more: seen.append((how, more)))
    monkeypatch.setattr(catalog, "_metrics_rows", lambda spark, m: None)
    catalog.QUERIES["model_metrics_gbt"](None, "")
    catalog.QUERIES["model_metrics_leafwise"](None, "")
    assert seen == [(("gbt",), {}), (("leafwise",), {})]         # the default number of trees, with folds
