"""Batch jobs: dashboard marts (S3), report sinks (S6), drift job (X7), batch scoring (V6) and
the training run that chains them (SURVEY 3.1).

Outputs go to the folder the caller names (a shared file system on a cluster); parquet is
written with zstd, partitioned by report month where the table is a panel.
"""
from __future__ import annotations

import json
import os

import yaml

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators import cleaning, drift, ews, features, metrics, portfolio, segments, targets
from ..session import keep, materialize
from ..sources.tables import select_existing


def _parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    w = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def csv_ready(df: DataFrame) -> DataFrame:
    """Arrays joined with '|' (CSV has no array type)."""
    arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    return df.withColumns({c: F.array_join(F.col(c), "|") for c in arrays}) if arrays else df


def write_csv(df: DataFrame, path: str) -> str:
    csv_ready(df).write.mode("overwrite").option("header", "true").csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


MONTH_FILES = 4


def build_marts(raw: DataFrame, out_dir: str, model=None) -> dict:
    """S3: panel mart (21 columns, partitioned by report month), scored last slice (panel columns
    + score, zone, rules, recommendations, segment, priority), monthly series."""
    panel = targets.forward_target_monthly(features.feature_set(cleaning.prepare_panel(raw), split_hot=True))
    # not cached: the features' rows are stored, and each mart reads of them the columns that it needs
    panel = segments.rule_segment(panel)
    last = cleaning.last_slice(panel)
    # a month's rows go to a few tasks, so that a mart holds a few files a month
    month_first = F.pmod(F.xxhash64("credit_id"), F.lit(MONTH_FILES))
    if model is not None:
        from ..operators.modeling import predict_proba
        last = predict_proba(model, last)
    else:
        last = ews.formula_score(last)
    scored = ews.score_and_zone(last)
    month = F.date_format("report_date_as_of", "yyyy-MM").alias("report_month")
    rows = select_existing(panel, config.PANEL_MART_COLS).withColumn("report_month", month)
    paths = {
        "panel": _parquet(rows.repartition("report_month", month_first), os.path.join(out_dir, "panel"), ["report_month"]),
        "scored": _parquet(select_existing(scored, config.PANEL_MART_COLS + config.SCORED_EXTRA_COLS),
                           os.path.join(out_dir, "scored")),
    }
    # the series is read off the mart just written
    written = panel.sparkSession.read.schema(rows.schema).parquet(paths["panel"])
    paths["timeseries"] = _parquet(portfolio.default_rate_over_time(written), os.path.join(out_dir, "timeseries"))
    return paths


def prepare_side(raw: DataFrame, filter_sold_forgiven: bool = True) -> DataFrame:
    """X7 / V6 preparation: clean, last slice, row-wise features (no rolling), default flag."""
    last = cleaning.prepare_panel(raw, last_slice_only=True, filter_sold_forgiven=filter_sold_forgiven)
    return targets.default_flag(features.feature_set(last, include_rolling=False))


def drift_job(reference_raw: DataFrame, current_raw: DataFrame, num_features: list[str], cat_features: list[str],
              out_dir: str | None = None, model=None) -> dict:
    """Both sides prepared alike, per-feature drift, score PSI, the full metric report of both sides, verdict."""
    from ..operators.modeling import predict_proba
    ref, cur = prepare_side(reference_raw), prepare_side(current_raw)
    score = (lambda d: predict_proba(model, d)) if model is not None else ews.formula_score
    ref, cur = keep(score(ref)), keep(score(cur))
    feat = keep(drift.data_drift(ref, cur, num_features, cat_features))
    score_psi = drift.score_drift(ref, cur).first()["score_psi"]
    verdict = _verdict(feat, score_psi, [metrics.binary_report(side, config.TARGET_COL, "risk_score") for side in (ref, cur)], out_dir)
    for d in (ref, cur, feat):
        d.unpersist()
    return verdict


def _verdict(feat: DataFrame, score_psi: float | None, reports: list[DataFrame], out_dir: str | None) -> dict:
    """X6 with the metric reports of the reference and the current side, written if ``out_dir`` is given."""
    reports = [r.first().asDict() for r in reports]
    auc_ref, auc_cur = (r["roc_auc"] for r in reports)
    verdict = drift.drift_verdict(feat, score_psi, auc_ref, auc_cur)
    verdict["metrics_reference"], verdict["metrics_current"] = reports
    verdict["auc_reference"], verdict["auc_current"] = auc_ref, auc_cur
    if out_dir:
        write_json(feat, os.path.join(out_dir, "features"))
        write_json(feat.sparkSession.createDataFrame([(json.dumps(verdict),)], "report string"), os.path.join(out_dir, "verdict"))
    return verdict


def save_drift_reference(reference_raw: DataFrame, profile_dir: str, num_features: list[str], cat_features: list[str], model=None) -> list[int]:
    """Prepare, score and count the reference once, in place of the profile before."""
    from ..operators.modeling import predict_proba
    from . import profiles
    ref = prepare_side(reference_raw)
    ref = predict_proba(model, ref) if model is not None else ews.formula_score(ref)
    return profiles.save_profile(ref, profile_dir, num_features, cat_features, replace=True)


def drift_job_stored(profile_dir: str, current_raw: DataFrame, num_features: list[str], cat_features: list[str],
                     out_dir: str | None = None, model=None) -> dict:
    """X7 against a stored reference: the report of ``drift_job``, from the profile and one count of the current side.
    ``model`` must be the one that scored the reference."""
    from ..operators.modeling import predict_proba
    from . import profiles
    spark, score = current_raw.sparkSession, "risk_score"
    cur = prepare_side(current_raw)
    cur = predict_proba(model, cur) if model is not None else ews.formula_score(cur)
    num, cat = ([c for c in cols if c in cur.columns] for cols in (num_features, cat_features))
    stored = profiles.read_profile(spark, profile_dir)
    now = materialize(drift.value_counts(cur, num, cat, config.TARGET_COL, score))
    counts = drift.side_counts(stored.where(F.col("feature").isin([*num, *cat, score])), now)
    feat = keep(drift.data_drift_of_counts(counts, num, cat))
    scores = drift.numeric_sides(counts, "score")
    score_psi = drift.psi(scores, scores, [score], hist=scores).first()["psi"]
    merged = stored.groupBy("kind", "value").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    reports = [metrics.report_of_histogram(profiles.score_histogram(side)) for side in (merged, now)]
    verdict = _verdict(feat, score_psi, reports, out_dir)
    feat.unpersist()
    return verdict


def score_batch(raw: DataFrame, out_path: str | None = None, model=None) -> DataFrame:
    """V6: keep sold / forgiven debts, last slice, row-wise features, score, rules, zones,
    recommendations; optionally written as CSV."""
    from ..operators.modeling import predict_proba
    side = prepare_side(raw, filter_sold_forgiven=False)
    scored = predict_proba(model, side) if model is not None else ews.formula_score(side)
    out = ews.ews_scored(scored, with_recommendations=True)
    if out_path:
        write_csv(out, out_path)
    return out


def run_training(spark: SparkSession, raw: DataFrame, out_dir: str, model_type: str = "logreg",
                 params: dict | None = None) -> dict:
    """Training run: prepare -> features -> labels -> panel profile -> screening ->
    segment profiles -> model -> EWS -> KPI, each result written under ``out_dir``.  Screening,
    segments and model use the forward label on rows with a future observation.  The labelled panel
    is persisted once and every stage reads it."""
    from ..operators import modeling, screening
    panel = keep(targets.forward_target_monthly(features.feature_set(cleaning.prepare_panel(raw), split_hot=True)))
    num, cat = cleaning.feature_columns(panel)
    label = config.FORWARD_TARGET_COL
    train_rows = panel.filter(F.col(config.VALID_MASK_COL))
    out = {"panel_profile": write_json(portfolio.numeric_profile(panel), os.path.join(out_dir, "panel_profile"))}
    sp = screening.target_correlation(train_rows, num, label).limit(30)
    top30 = [r["feature"] for r in sp.collect()]
    out["iv"] = write_json(screening.iv_ranking(train_rows, top30, None, label).limit(25), os.path.join(out_dir, "iv_ranking"))
    seg = segments.rule_segment(train_rows)
    out["segment_profile"] = write_json(segments.segment_profile(seg, target_col=label), os.path.join(out_dir, "segment_profile"))
    model = modeling.train_model(train_rows, num, cat, label=config.FORWARD_TARGET_COL, model_type=model_type,
                                 params=params)
    model.save(os.path.join(out_dir, "model"))
    last = cleaning.last_slice(panel)
    scored = ews.ews_scored(modeling.predict_proba(model, last), with_recommendations=True, sort=True)
    out["ews_summary"] = write_csv(ews.ews_summary(scored), os.path.join(out_dir, "ews_summary"))
    out["ews_top500"] = write_csv(scored.limit(500), os.path.join(out_dir, "ews_top500"))
    out["kpi"] = write_json(portfolio.portfolio_kpi(last), os.path.join(out_dir, "portfolio_kpi"))
    out["metrics"] = {"train": model.metrics_train, "test": model.metrics_test, "cv": model.cv_metrics}
    important = spark.createDataFrame(modeling.feature_importance(model)[:40], "feature string, importance double")
    out["importance"] = write_csv(important.coalesce(1), os.path.join(out_dir, "feature_importance"))
    for name, text in (("metrics_json", json.dumps(out["metrics"])), ("rules", yaml.safe_dump({"rules": config.EWS_RULES, "zones": config.EWS_ZONES}, allow_unicode=True, sort_keys=False))):
        path = os.path.join(out_dir, name)
        spark.createDataFrame([(text,)], "text string").coalesce(1).write.mode("overwrite").text(path)
        out[name] = path
    panel.unpersist()
    return out
