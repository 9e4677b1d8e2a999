"""Registered queries: ``(spark, sf_dir) -> DataFrame`` over the driver tables, and their
DuckDB oracles.  Doubles that come out of order-dependent float aggregation are rounded
to a fixed number of decimals on both sides; arrays are joined with '|' as in the CSV sink.
"""
from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators import cleaning, ews, targets
from ..session import materialize
from ..sources.fixture import raw_panel
from . import marts, profiles
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


def joined(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.array_join(F.col(c), "|") for c in cols})


# --------------------------------------------------------------------------- shared steps

def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.prepare_panel(raw_panel(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.default_flag(prepared(spark, sf_dir))


def last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.last_slice(labelled(spark, sf_dir))


def scored_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ews.ews_scored(ews.formula_score(last(spark, sf_dir)), with_recommendations=True)


# --------------------------------------------------------------------------- panel and slice

PREPARED_COLS = """report_date_as_of, credit_id, borrower_id, sex, loan_program, region_from_address, employer,
  bankruptcy_stage, quality_category, reserve_rate, initial_amount, total_debt, available_limit, total_debt_reserve,
  dpd, expired_actual_days_count, pdn_current, pdn_initial, psk_current, payment_sum_1m, payment_sum_2m,
  payment_sum_3m, cnt_all_payments, last_payment_date, date_issued, date_borrower_birthday, sold_flg, forgiven_flg,
  age, months_on_book, days_since_last_payment, utilization, payment_ratio_1m, payment_ratio_mom, is_bankrupt"""


@register("prepared_panel", O.base(f"SELECT {PREPARED_COLS} FROM prepared"))
def q_prepared_panel(spark, sf_dir):
    """Typed, cleaned, filtered panel with the seven derived fields."""
    return prepared(spark, sf_dir)


@register("labelled_last_slice", O.base(f"SELECT {PREPARED_COLS}, default_target FROM last_slice"))
def q_last_slice(spark, sf_dir):
    """P5 + T1: current-default flag, then the newest row per contract."""
    return last(spark, sf_dir)


# --------------------------------------------------------------------------- early warning

@register("ews_summary", O.scored("last_slice", """
SELECT k.zone, a.n_contracts, round(a.sum_debt, 2) AS sum_debt, round(a.avg_score, 8) AS avg_score
FROM (VALUES ('green', 0), ('yellow', 1), ('red', 2)) AS k(zone, zone_order)
LEFT JOIN (SELECT zone, COUNT(DISTINCT credit_id) AS n_contracts, COALESCE(SUM(total_debt), 0.0) AS sum_debt,
                  AVG(risk_score) AS avg_score
           FROM recommended WHERE zone IS NOT NULL GROUP BY zone) a ON a.zone = k.zone
"""))
def q_ews_summary(spark, sf_dir):
    """Flagship: panel -> clean -> T1 -> last slice -> formula score -> rules/zones -> E7 summary."""
    return rounded(ews.ews_summary(scored_last(spark, sf_dir)), {"sum_debt": 2, "avg_score": 8})


EWS_COLS = """credit_id, borrower_id, report_date_as_of, risk_score, total_debt,
  array_to_string(rules_triggered, '|') AS rules_triggered, rules_weight_sum, zone, priority,
  array_to_string(recommendations, '|') AS recommendations"""


@register("ews_scored", O.scored("last_slice", f"SELECT {EWS_COLS} FROM recommended"))
def q_ews_scored(spark, sf_dir):
    """E6 + R2: scored last slice with fired rules, zone, priority and recommendations."""
    return joined(scored_last(spark, sf_dir), "rules_triggered", "recommendations")


@register("ews_top_red", O.scored("last_slice", f"""
SELECT {EWS_COLS} FROM recommended WHERE zone = 'red'
ORDER BY priority DESC NULLS LAST, credit_id LIMIT 100"""))
def q_ews_top_red(spark, sf_dir):
    """L1 / V2: top 100 red-zone contracts by priority."""
    return joined(ews.ews_top(scored_last(spark, sf_dir), zone="red", limit=100), "rules_triggered",
                  "recommendations")


@register("ews_top_all", O.scored("last_slice", f"""
SELECT {EWS_COLS} FROM recommended ORDER BY priority DESC NULLS LAST, credit_id LIMIT 500"""))
def q_ews_top_all(spark, sf_dir):
    """L2: the first 500 rows of the recommendation table by priority."""
    return joined(ews.ews_top(scored_last(spark, sf_dir), limit=500), "rules_triggered", "recommendations")


@register("zone_counts", O.scored("last_slice", """
SELECT k.zone, CAST(COALESCE(a.n, 0) AS BIGINT) AS n_contracts
FROM (VALUES ('green', 0), ('yellow', 1), ('red', 2)) AS k(zone, zone_order)
LEFT JOIN (SELECT zone, COUNT(*) AS n FROM recommended GROUP BY zone) a ON a.zone = k.zone
"""))
def q_zone_counts(spark, sf_dir):
    """Contracts per zone, missing zones as 0."""
    return ews.zone_counts(scored_last(spark, sf_dir))


@register("panel_rules", O.scored("labelled", """
SELECT credit_id, report_date_as_of, risk_score, rule_high_dpd, rule_bad_quality, rule_pdn_spike,
       rule_no_recent_payment, rule_payments_drop, rule_utilization_high, rule_bankruptcy_trigger,
       rules_weight_sum, array_to_string(rules_triggered, '|') AS rules_triggered, zone
FROM recommended"""))
def q_panel_rules(spark, sf_dir):
    """E1-E4 on every panel row: per-rule flags, weight sum, fired names, escalated zone."""
    df = ews.score_and_zone(ews.formula_score(labelled(spark, sf_dir)))
    return joined(df.select("credit_id", "report_date_as_of", "risk_score", *[f"rule_{r['name']}" for r in config.EWS_RULES],
                            "rules_weight_sum", "rules_triggered", "zone"), "rules_triggered")


# --------------------------------------------------------------------------- portfolio

from ..operators import features, portfolio, segments  # noqa: E402

MONEY = 3     # sums of 2-3 decimal amounts are exact on the 0.001 grid
MEAN = 6      # means of large amounts
RATE = 8      # rates and means of small values


@register("portfolio_kpi", O.base(f"""
SELECT COUNT(DISTINCT credit_id) AS n_contracts, COUNT(DISTINCT borrower_id) AS n_borrowers,
       round(COALESCE(SUM(total_debt), 0), {MONEY}) AS total_debt,
       round(COALESCE(SUM(available_limit), 0), {MONEY}) AS available_limit,
       round(AVG(pdn_current), {RATE}) AS avg_pdn_current, round(AVG(dpd), {RATE}) AS avg_dpd,
       round(AVG(default_target), {RATE}) AS default_rate,
       round(COALESCE(SUM(total_debt_reserve), 0), {MONEY}) AS reserve_amount
FROM last_slice"""))
def q_portfolio_kpi(spark, sf_dir):
    """A1 / V3: portfolio KPIs of the last slice."""
    return rounded(portfolio.portfolio_kpi(last(spark, sf_dir)),
                   {"total_debt": MONEY, "available_limit": MONEY, "reserve_amount": MONEY,
                    "avg_pdn_current": RATE, "avg_dpd": RATE, "default_rate": RATE})


def _agg_by_sql(dim: str, src: str, limit: str = "") -> str:
    return f"""
SELECT {dim}, COUNT(DISTINCT credit_id) AS n_contracts,
       round(COALESCE(SUM(total_debt), 0), {MONEY}) AS total_debt,
       round(COALESCE(SUM(available_limit), 0), {MONEY}) AS available_limit,
       round(COALESCE(SUM(total_debt_reserve), 0), {MONEY}) AS total_debt_reserve,
       round(COALESCE(SUM(payment_sum_1m), 0), 4) AS payment_sum_1m,
       round(AVG(pdn_current), {RATE}) AS pdn_current, round(AVG(dpd), {RATE}) AS dpd,
       round(AVG(utilization), {RATE}) AS utilization, round(AVG(default_target), {RATE}) AS default_rate
FROM {src} GROUP BY {dim} ORDER BY n_contracts DESC, {dim} NULLS FIRST {limit}"""


def _agg_by_rounding():
    return {"total_debt": MONEY, "available_limit": MONEY, "total_debt_reserve": MONEY, "payment_sum_1m": 4,
            "pdn_current": RATE, "dpd": RATE, "utilization": RATE, "default_rate": RATE}


@register("aggregate_by_region", O.base(_agg_by_sql("region_from_address", "last_slice", "LIMIT 100")))
def q_aggregate_by_region(spark, sf_dir):
    """A2 / L3 / V3: last slice by region, top 100 by contracts."""
    return rounded(portfolio.aggregate_by(last(spark, sf_dir), "region_from_address").limit(100),
                   _agg_by_rounding())


@register("aggregate_by_program_panel", O.base(_agg_by_sql("loan_program", "labelled")))
def q_aggregate_by_program(spark, sf_dir):
    """A2 on the whole panel by loan program."""
    return rounded(portfolio.aggregate_by(labelled(spark, sf_dir), "loan_program"), _agg_by_rounding())


@register("aggregate_by_employer", O.base(_agg_by_sql("employer", "last_slice", "LIMIT 20")))
def q_aggregate_by_employer(spark, sf_dir):
    """A2 / L3: top 20 employers of the last slice ('UNKNOWN' fills missing employers)."""
    return rounded(portfolio.aggregate_by(last(spark, sf_dir), "employer").limit(20), _agg_by_rounding())


@register("default_rate_over_time", O.base(f"""
SELECT CAST(date_trunc('month', report_date_as_of) AS TIMESTAMP) AS report_date_as_of,
       COUNT(DISTINCT credit_id) AS n_contracts, round(COALESCE(SUM(total_debt), 0), {MONEY}) AS total_debt,
       round(AVG(default_target), {RATE}) AS default_rate, round(AVG(dpd), {RATE}) AS avg_dpd
FROM labelled WHERE report_date_as_of IS NOT NULL GROUP BY 1"""))
def q_default_rate_over_time(spark, sf_dir):
    """A3 / V3: monthly series over the whole panel."""
    return rounded(portfolio.default_rate_over_time(labelled(spark, sf_dir)),
                   {"total_debt": MONEY, "default_rate": RATE, "avg_dpd": RATE})


_PREP_COL_LIST = [c.strip() for c in PREPARED_COLS.replace("\n", " ").split(",")]


@register("schema_profile", O.base("""
SELECT "column", n_missing, round_even(n_missing / n * 100, 2) AS pct_missing, n_unique
FROM (
  SELECT "column", COUNT(*) AS n, COUNT(*) - COUNT(value) AS n_missing, COUNT(DISTINCT value) AS n_unique
  FROM (""" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM prepared"
                                  for c in _PREP_COL_LIST) + """)
  GROUP BY "column")"""))
def q_schema_profile(spark, sf_dir):
    """Missing and distinct counts of every column of the prepared panel."""
    return portfolio.schema_profile(prepared(spark, sf_dir), with_sample=False).drop("dtype")


NUM_PROFILE_COLS = ["total_debt", "available_limit", "dpd", "pdn_current", "psk_current", "payment_sum_1m",
                    "payment_sum_2m", "payment_sum_3m", "cnt_all_payments", "initial_amount",
                    "expired_actual_days_count", "reserve_rate", "total_debt_reserve", "pdn_initial"]


NUM_LONG_SQL = "num_long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS x FROM prepared" for c in NUM_PROFILE_COLS) + ")"


@register("numeric_profile", O.with_ctes(O.RAW_PANEL_SQL, O.PREPARED_SQL, NUM_LONG_SQL,
                                         O.quantiles_sql("nq", "num_long", "feature", "x",
                                                         portfolio.NUMERIC_PROBS), body=f"""
SELECT m.feature, count, mean, std, min, p1.q AS p1, p5.q AS p5, p50.q AS p50, p95.q AS p95, p99.q AS p99,
       max, n_missing, pct_missing
FROM (SELECT feature, COUNT(x) AS count, round(AVG(x), {MEAN}) AS mean, round(STDDEV_SAMP(x), {MEAN}) AS std,
             MIN(x) AS min, MAX(x) AS max, COUNT(*) - COUNT(x) AS n_missing,
             round_even((COUNT(*) - COUNT(x)) / COUNT(*) * 100, 2) AS pct_missing
      FROM num_long GROUP BY feature) m
LEFT JOIN nq p1 ON p1.g = m.feature AND p1.i = 0 LEFT JOIN nq p5 ON p5.g = m.feature AND p5.i = 1
LEFT JOIN nq p50 ON p50.g = m.feature AND p50.i = 2 LEFT JOIN nq p95 ON p95.g = m.feature AND p95.i = 3
LEFT JOIN nq p99 ON p99.g = m.feature AND p99.i = 4"""))
def q_numeric_profile(spark, sf_dir):
    """describe() of the numeric columns with exact percentiles."""
    return rounded(portfolio.numeric_profile(prepared(spark, sf_dir), NUM_PROFILE_COLS), {"mean": MEAN, "std": MEAN})


@register("histogram_utilization", O.base("""
SELECT bin, lo + bin * w AS bin_start, lo + (bin + 1) * w AS bin_end, COUNT(*) AS count
FROM (
  SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((utilization - lo) / w), 59) END AS INTEGER) AS bin, lo, w
  FROM labelled, (SELECT MIN(utilization) AS lo, MAX(utilization) AS hi, (MAX(utilization) - MIN(utilization)) / 60 AS w
                  FROM labelled)
  WHERE utilization IS NOT NULL)
GROUP BY bin, lo, w"""))
def q_histogram_utilization(spark, sf_dir):
    """60 equal-width bins of utilisation over the panel."""
    return portfolio.histogram(labelled(spark, sf_dir), "utilization", 60)


@register("histogram_dpd_by_zone", O.scored("last_slice", """
SELECT zone, bin, lo + bin * w AS bin_start, lo + (bin + 1) * w AS bin_end, COUNT(*) AS count
FROM (
  SELECT zone, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((dpd - lo) / w), 59) END AS INTEGER) AS bin, lo, w
  FROM recommended, (SELECT MIN(dpd) AS lo, MAX(dpd) AS hi, (MAX(dpd) - MIN(dpd)) / 60 AS w FROM recommended)
  WHERE dpd IS NOT NULL)
GROUP BY zone, bin, lo, w"""))
def q_histogram_dpd_by_zone(spark, sf_dir):
    """A8 split by zone (dashboard distribution screen)."""
    sc = ews.score_and_zone(ews.formula_score(last(spark, sf_dir)))
    return portfolio.histogram(sc, "dpd", 60, by="zone")


# --------------------------------------------------------------------------- segments

SEGMENT_SQL = """CASE WHEN COALESCE(dpd > 30, false) OR COALESCE(is_bankrupt = 1, false) THEN 'delinquent'
     WHEN COALESCE(payment_ratio_mom < 0.5, false) OR COALESCE(days_since_last_payment > 45, false) THEN 'stress'
     WHEN COALESCE(utilization > 0.6, false) AND COALESCE(dpd <= 5, false) THEN 'growing'
     ELSE 'stable' END"""

PROFILE_RAW_SQL = f"""
SELECT segment, COUNT(DISTINCT credit_id) AS n_contracts, COALESCE(SUM(total_debt), 0) AS total_debt,
       COALESCE(SUM(available_limit), 0) AS available_limit, COALESCE(SUM(payment_sum_1m), 0) AS payment_sum_1m,
       AVG(pdn_current) AS pdn_current, AVG(dpd) AS dpd, AVG(utilization) AS utilization,
       AVG(default_target) AS default_rate
FROM (SELECT *, {SEGMENT_SQL} AS segment FROM last_slice) GROUP BY segment"""

PROFILE_SQL = f"""
SELECT segment, n_contracts, round(total_debt, {MONEY}) AS total_debt, round(available_limit, {MONEY}) AS available_limit,
       round(payment_sum_1m, 4) AS payment_sum_1m, round(pdn_current, {RATE}) AS pdn_current,
       round(dpd, {RATE}) AS dpd, round(utilization, {RATE}) AS utilization, round(default_rate, {RATE}) AS default_rate
FROM ({PROFILE_RAW_SQL})"""

PROFILE_ROUND = {"total_debt": MONEY, "available_limit": MONEY, "payment_sum_1m": 4, "pdn_current": RATE,
                 "dpd": RATE, "utilization": RATE, "default_rate": RATE}


def _profile(spark, sf_dir):
    return segments.segment_profile(segments.rule_segment(labelled(spark, sf_dir)))


@register("panel_segments", O.base(f"SELECT credit_id, report_date_as_of, {SEGMENT_SQL} AS segment FROM labelled"))
def q_panel_segments(spark, sf_dir):
    """G1: rule segment of every panel row."""
    return segments.rule_segment(labelled(spark, sf_dir)).select("credit_id", "report_date_as_of", "segment")


@register("segment_profile", O.base(PROFILE_SQL))
def q_segment_profile(spark, sf_dir):
    """G1 + A4: rule segments, profiled on each contract's latest row with the current-default flag."""
    return rounded(_profile(spark, sf_dir), PROFILE_ROUND)


@register("segment_share", O.base(f"""
SELECT segment, round_even(n_contracts / SUM(n_contracts) OVER () * 100, 1) AS share_pct, n_contracts,
       round_even(total_debt / 1e9, 3) AS debt_bn, round_even(utilization * 100, 0) AS util_pct,
       round_even(default_rate * 100, 2) AS default_pct
FROM ({PROFILE_RAW_SQL})
WHERE segment IN ('stable', 'growing', 'stress', 'delinquent')"""))
def q_segment_share(spark, sf_dir):
    """A5: dashboard segment table (shares, debt in billions, utilisation and default in %)."""
    return segments.segment_share(_profile(spark, sf_dir))


@register("segment_policy", O.base(f"""
SELECT *, CASE WHEN COALESCE(default_rate > 0.10, false) THEN '{config.POLICY_TIGHTEN}'
               WHEN COALESCE(default_rate < 0.02, false) THEN '{config.POLICY_LOOSEN}'
               ELSE '{config.POLICY_MONITOR}' END AS policy_recommendation
FROM ({PROFILE_SQL})"""))
def q_segment_policy(spark, sf_dir):
    """Policy per rule segment from its default rate."""
    return segments.segment_policy(rounded(_profile(spark, sf_dir), PROFILE_ROUND))


# --------------------------------------------------------------------------- panel windows

def _month_sql(c: str = "report_date_as_of") -> str:
    return f"(year({c}) * 12 + month({c}) - 1)"


def _feature_sql() -> tuple[str, list[str]]:
    cols = ["pdn_current - pdn_initial AS pdn_delta",
            "pdn_current / (abs(pdn_initial) + 1e-6) AS pdn_ratio",
            "CASE WHEN psk_current <= 10 THEN 'low' WHEN psk_current <= 20 THEN 'mid' WHEN psk_current <= 30 "
            "THEN 'high' WHEN psk_current > 30 THEN 'extreme' END AS psk_bucket",
            "CASE WHEN pay_n > 0 THEN pay_total / pay_n END AS payment_mean_3m",
            "CASE WHEN pay_n > 1 THEN sqrt(("
            + " + ".join(f"CASE WHEN {p} IS NOT NULL THEN (pay_total / pay_n - {p}) * (pay_total / pay_n - {p}) "
                         f"ELSE 0.0 END" for p in ["payment_sum_1m", "payment_sum_2m", "payment_sum_3m"])
            + ") / (pay_n - 1)) END AS payment_std_3m",
            "payment_sum_1m - payment_sum_3m AS payment_trend",
            "cnt_all_payments / NULLIF(months_on_book + 1e-6, 0) AS payments_per_month",
            "CASE " + " ".join(f"WHEN COALESCE(dpd, 0) > {lo} AND COALESCE(dpd, 0) <= {hi} THEN '{lab}'" for lo, hi, lab in
                               zip(config.DPD_EDGES[:-1], config.DPD_EDGES[1:], config.DPD_LABELS)) + " END AS dpd_bucket",
            "expired_actual_days_count / NULLIF(months_on_book * 30 + 1e-6, 0) AS overdue_density"]
    names = ["pdn_delta", "pdn_ratio", "psk_bucket", "payment_mean_3m", "payment_std_3m", "payment_trend",
             "payments_per_month", "dpd_bucket", "overdue_density"]
    for c in config.ROLLING_BASE_COLS:
        cols.append(f"{c} - lag({c}) OVER w AS {c}_diff_1m")
        cols.append(f"CASE WHEN lag({c}) OVER w <> 0 THEN {c} / lag({c}) OVER w END - 1 AS {c}_pct_change_1m")
        names += [f"{c}_diff_1m", f"{c}_pct_change_1m"]
    for n in config.ROLLING_WINDOWS:
        for c in config.ROLLING_BASE_COLS:
            cols.append(f"AVG({c}) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS {c}_mean_{n}m")
            names.append(f"{c}_mean_{n}m")
        if n >= 2:
            for c in config.ROLLING_BASE_COLS:
                xs = [c] + [f"lag({c}, {i}) OVER w" for i in range(1, n)]
                cnt = " + ".join(f"CAST({x} IS NOT NULL AS INTEGER)" for x in xs)
                mean = "(" + "0.0 + " + " + ".join(f"COALESCE({x}, 0.0)" for x in xs) + f") / ({cnt})"
                ss = "0.0 + " + " + ".join(f"CASE WHEN {x} IS NOT NULL THEN ({mean} - {x}) * ({mean} - {x}) ELSE 0.0 END"
                                           for x in xs)
                cols.append(f"CASE WHEN ({cnt}) > 1 THEN sqrt(({ss}) / (({cnt}) - 1)) END AS {c}_std_{n}m")
                names.append(f"{c}_std_{n}m")
    sql = f"""
features AS (
  SELECT *, {", ".join(cols)}
  FROM (SELECT *,
               CAST(payment_sum_1m IS NOT NULL AS INTEGER) + CAST(payment_sum_2m IS NOT NULL AS INTEGER)
                 + CAST(payment_sum_3m IS NOT NULL AS INTEGER) AS pay_n,
               0.0 + COALESCE(payment_sum_1m, 0.0) + COALESCE(payment_sum_2m, 0.0) + COALESCE(payment_sum_3m, 0.0)
                 AS pay_total
        FROM labelled)
  WINDOW w AS (PARTITION BY credit_id ORDER BY {_month_sql()} ASC NULLS LAST, report_date_as_of ASC NULLS LAST)
)"""
    return sql, names


FEATURE_SQL, FEATURE_NAMES = _feature_sql()


@register("feature_set", O.with_ctes(O.RAW_PANEL_SQL, O.PREPARED_SQL, FEATURE_SQL,
                                     body=f"SELECT credit_id, report_date_as_of, {', '.join(FEATURE_NAMES)} FROM features"))
def q_feature_set(spark, sf_dir):
    """PDN, payment, DPD and rolling features (F1-F10) over the whole panel."""
    return features.feature_set(labelled(spark, sf_dir)).select("credit_id", "report_date_as_of", *FEATURE_NAMES)


@register("feature_set_ranged", O.with_ctes(O.RAW_PANEL_SQL, O.PREPARED_SQL, FEATURE_SQL,
                                            body=f"SELECT credit_id, report_date_as_of, {', '.join(FEATURE_NAMES)} FROM features"))
def q_feature_set_ranged(spark, sf_dir):
    """F11 with the skew-safe plan: rolling features over balanced key ranges with halo rows, so a
    contract holding a large share of the rows is split across tasks (same results as feature_set)."""
    df = features.pdn_features(labelled(spark, sf_dir)).transform(features.payment_features).transform(
        features.dpd_features)
    return features.rolling_features_ranged(df).select("credit_id", "report_date_as_of", *FEATURE_NAMES)


FORWARD_SQL = f"""
forward AS (
  SELECT *,
         CAST(CASE WHEN report_date_as_of IS NULL THEN 0 ELSE COALESCE(MAX(default_target) OVER fw, 0) END AS INTEGER)
           AS default_future,
         CASE WHEN report_date_as_of IS NULL THEN false ELSE COUNT(*) OVER fw > 0 END AS has_future_obs
  FROM labelled
  WINDOW fw AS (PARTITION BY credit_id ORDER BY {_month_sql()} ASC NULLS LAST RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING)
)"""


@register("forward_target", O.with_ctes(O.RAW_PANEL_SQL, O.PREPARED_SQL, FORWARD_SQL, body="""
SELECT credit_id, report_date_as_of, default_target, default_future, has_future_obs FROM forward"""))
def q_forward_target(spark, sf_dir):
    """T1 + T2 + T3: current default, 3-month forward default and the validity mask."""
    return targets.forward_target(labelled(spark, sf_dir)).select(
        "credit_id", "report_date_as_of", "default_target", "default_future", "has_future_obs")


@register("forward_target_monthly", O.with_ctes(O.RAW_PANEL_SQL, O.PREPARED_SQL, FORWARD_SQL, body="""
SELECT credit_id, report_date_as_of, default_target, default_future, has_future_obs FROM forward"""))
def q_forward_target_monthly(spark, sf_dir):
    """T2 + T3 via the per-(contract, month) reduction (skew-safe plan; same results as forward_target)."""
    return targets.forward_target_monthly(labelled(spark, sf_dir)).select(
        "credit_id", "report_date_as_of", "default_target", "default_future", "has_future_obs")


TRAJ_SQL = f"""
traj_rows AS (
  SELECT t, total_debt FROM (
    SELECT total_debt, {_month_sql()} - MIN(CASE WHEN default_target = 1 THEN {_month_sql()} END)
                                          OVER (PARTITION BY credit_id) AS t
    FROM labelled)
  WHERE t BETWEEN -6 AND 0
)"""


@register("pre_default_trajectory", O.with_ctes(
    O.RAW_PANEL_SQL, O.PREPARED_SQL, TRAJ_SQL, O.quantiles_sql("tq", "traj_rows", "t", "total_debt", [0.5]), body=f"""
SELECT a.t, a.mean, m.q AS median, a.count
FROM (SELECT CAST(t AS BIGINT) AS t, round(AVG(total_debt), {MEAN}) AS mean, COUNT(total_debt) AS count
      FROM traj_rows GROUP BY t) a
LEFT JOIN tq m ON m.g = a.t"""))
def q_pre_default_trajectory(spark, sf_dir):
    """T4: total debt in the six months before and at the first default month."""
    return rounded(targets.pre_default_trajectory(labelled(spark, sf_dir), "total_debt", 6), {"mean": MEAN})


# --------------------------------------------------------------------------- metrics

from ..operators import metrics  # noqa: E402

CURVE = 10  # AUC / AP / Brier are sums of doubles in engine-dependent order


def eval_rows(spark, sf_dir):
    """Panel rows with a future observation: label = forward default, score = formula score."""
    fwd = targets.forward_target(labelled(spark, sf_dir))
    return ews.formula_score(fwd.filter(F.col("has_future_obs")))


EVAL_SQL = f"""
eval_rows AS (
  SELECT credit_id, report_date_as_of, default_future AS y,
         round(least(1.0::DOUBLE, COALESCE(dpd, 0.0) / 300.0::DOUBLE
                                  + CAST(credit_id % 100 AS DOUBLE) / 250.0::DOUBLE), 4) AS s
  FROM forward WHERE has_future_obs
),
hist AS (SELECT s AS value, SUM(y) AS pos, SUM(1 - y) AS neg FROM eval_rows GROUP BY s),
cum AS (
  SELECT *, SUM(pos) OVER (ORDER BY value DESC ROWS UNBOUNDED PRECEDING) AS cum_pos,
         SUM(neg) OVER (ORDER BY value DESC ROWS UNBOUNDED PRECEDING) AS cum_neg,
         SUM(pos) OVER () AS P, SUM(neg) OVER () AS N
  FROM hist
)"""


def _eval_sql(body: str) -> str:
    return O.with_ctes(O.RAW_PANEL_SQL, O.PREPARED_SQL, FORWARD_SQL, EVAL_SQL, body=body)


@register("binary_report", _eval_sql(f"""
SELECT p.n, round(p.positive_rate, {CURVE}) AS positive_rate, round(c.roc_auc, {CURVE}) AS roc_auc,
       round(c.pr_auc, {CURVE}) AS pr_auc, round(c.roc_auc * 2 - 1, {CURVE}) AS gini, c.ks,
       round(p.brier, {CURVE}) AS brier,
       CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision_at_thr,
       CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall_at_thr,
       CASE WHEN tp * 2 + fp + fn > 0 THEN tp * 2 / (tp * 2 + fp + fn) ELSE 0.0 END AS f1_at_thr,
       tp, fp, tn, fn, 0.5::DOUBLE AS threshold
FROM (SELECT COUNT(*) AS n, AVG(y) AS positive_rate, AVG((s - y) * (s - y)) AS brier,
             CAST(SUM(CASE WHEN s >= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
             CAST(SUM(CASE WHEN s >= 0.5 AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
             CAST(SUM(CASE WHEN s < 0.5 AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
             CAST(SUM(CASE WHEN s < 0.5 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn
      FROM eval_rows) p,
     (SELECT SUM(neg * ((cum_pos - pos) + pos / 2.0)) / (MAX(P) * MAX(N)) AS roc_auc,
             SUM(pos / P * (cum_pos / (cum_pos + cum_neg))) AS pr_auc,
             MAX(abs(cum_pos / greatest(P, 1) - cum_neg / greatest(N, 1))) AS ks
      FROM cum) c"""))
def q_binary_report(spark, sf_dir):
    """M1-M5: ROC-AUC, average precision, Gini, KS, Brier and threshold metrics of the formula
    score against the 3-month forward default."""
    return rounded(metrics.binary_report(eval_rows(spark, sf_dir), "default_future", "risk_score"),
                   {c: CURVE for c in ["positive_rate", "roc_auc", "pr_auc", "gini", "brier"]})


@register("pr_table", _eval_sql("""
SELECT value AS threshold, CASE WHEN cum_pos + cum_neg > 0 THEN cum_pos / (cum_pos + cum_neg) ELSE 0.0 END AS precision,
       cum_pos / P AS recall
FROM cum
UNION ALL SELECT 1.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE"""))
def q_pr_table(spark, sf_dir):
    """M6: precision / recall per distinct score threshold."""
    return metrics.pr_table(eval_rows(spark, sf_dir), "default_future", "risk_score")


@register("decile_report", _eval_sql(f"""
SELECT bucket, n, n_bad, round(avg_score, {CURVE}) AS avg_score, n_bad / n AS bad_rate,
       CAST(SUM(n_bad) OVER (ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_bad,
       SUM(n_bad) OVER (ORDER BY bucket ROWS UNBOUNDED PRECEDING) / SUM(n_bad) OVER () AS cum_bad_pct,
       (n_bad / n) / greatest(base, 1e-9) AS lift
FROM (
  SELECT bucket, COUNT(*) AS n, CAST(SUM(y) AS BIGINT) AS n_bad, AVG(s) AS avg_score, MAX(base) AS base
  FROM (
    SELECT y, s, base,
           CASE WHEN n_all - 1 <= 0 THEN 1 ELSE greatest(1, (pos * 10 + n_all - 2) // (n_all - 1)) END AS bucket
    FROM (SELECT y, s, row_number() OVER (ORDER BY s DESC, credit_id) - 1 AS pos, COUNT(*) OVER () AS n_all,
                 AVG(y) OVER () AS base
          FROM eval_rows))
  GROUP BY bucket)"""))
def q_decile_report(spark, sf_dir):
    """M7: lift / gain table over score deciles."""
    return rounded(metrics.decile_report(eval_rows(spark, sf_dir), "default_future", "risk_score"),
                   {"avg_score": CURVE})


# --------------------------------------------------------------------------- screening

from ..operators import ranks as _ranks, screening  # noqa: E402
from ..streaming import scoring  # noqa: E402

#: Every numeric model input of the panel: numeric columns and numeric features, technical and leaky ones left out
#: (a test compares the list with ``screening.numeric_candidates``).
_TEXT_FEATURES = ("psk_bucket", "dpd_bucket")
_NUMERIC = ([c for c in PREPARED_COLS.replace("\n", " ").replace(",", " ").split()
             if c in config.NUMERIC_COLS or c in scoring.DERIVED] + [c for c in FEATURE_NAMES if c not in _TEXT_FEATURES])
SCREEN_FEATURES = [c for c in _NUMERIC if c not in config.TECHNICAL_COLS and not cleaning.is_leaky(c)]
STAT = 10


def featured(spark, sf_dir):
    return features.feature_set(labelled(spark, sf_dir))


def _feat_sql(*ctes: str, body: str) -> str:
    return O.with_ctes(O.RAW_PANEL_SQL, O.PREPARED_SQL, FEATURE_SQL, *ctes, body=body)


def _nan_null(expr: str) -> str:
    return f"CASE WHEN isnan({expr}) THEN NULL ELSE {expr} END"


_PAIRS = [(a, b) for i, a in enumerate(SCREEN_FEATURES) for b in SCREEN_FEATURES[i + 1:]]
PEARSON_SQL = """pearson AS (SELECT p.feature_a, p.feature_b, CASE WHEN isnan(p.corr) THEN NULL ELSE p.corr END AS corr FROM (SELECT unnest([
""" + ",\n".join(f"{{'feature_a': '{a}', 'feature_b': '{b}', 'corr': corr({a}, {b})}}" for a, b in _PAIRS) + "]) AS p FROM features))"


@register("pearson_matrix", _feat_sql(PEARSON_SQL, body=f"SELECT feature_a, feature_b, round(corr, {STAT}) AS corr FROM pearson"))
def q_pearson_matrix(spark, sf_dir):
    """A10: pairwise Pearson correlations of the screened features in one aggregate pass."""
    return rounded(screening.pearson_matrix(featured(spark, sf_dir), SCREEN_FEATURES), {"corr": STAT})


@register("multicollinear_pairs", _feat_sql(PEARSON_SQL, body=f"""
SELECT feature_a, feature_b, round(abs(corr), {STAT}) AS abs_corr FROM pearson WHERE abs(corr) > 0.9"""))
def q_multicollinear_pairs(spark, sf_dir):
    """Feature pairs with |r| > 0.9."""
    return rounded(screening.multicollinear_pairs(featured(spark, sf_dir), SCREEN_FEATURES), {"abs_corr": STAT})


LONG_SQL = "scr_long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, CAST(default_target AS DOUBLE) AS y FROM features "
    f"WHERE {c} IS NOT NULL AND default_target IS NOT NULL" for c in SCREEN_FEATURES) + ")"


@register("target_correlation", _feat_sql(LONG_SQL, body=f"""
SELECT feature, round({_nan_null('corr(r, y)')}, {STAT}) AS corr, round(abs({_nan_null('corr(r, y)')}), {STAT}) AS abs_corr
FROM (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY x)
                         + (COUNT(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS r
      FROM scr_long)
GROUP BY feature"""))
def q_target_correlation(spark, sf_dir):
    """H1: Spearman correlation of each screened feature with the current-default flag."""
    return rounded(screening.target_correlation(featured(spark, sf_dir), SCREEN_FEATURES), {"corr": STAT,
                                                                                          "abs_corr": STAT})


WOE_SQL = """
iv_edges AS (SELECT DISTINCT g AS feature, q AS edge FROM ivq),
iv_ne AS (SELECT feature, COUNT(*) AS ne FROM iv_edges GROUP BY feature),
iv_binned AS (
  SELECT l.feature, l.y,
         greatest(1, (SELECT COUNT(*) FROM iv_edges e WHERE e.feature = l.feature AND e.edge < l.x)) AS bin
  FROM scr_long l JOIN iv_ne n ON n.feature = l.feature WHERE n.ne >= 2
),
iv_counts AS (SELECT feature, bin, SUM(y) AS bad, COUNT(*) AS total FROM iv_binned GROUP BY feature, bin),
iv_allbins AS (SELECT feature, CAST(unnest(range(1, ne)) AS INTEGER) AS bin FROM iv_ne WHERE ne >= 2),
woe AS (
  SELECT *, SUM(iv_part) OVER (PARTITION BY feature) AS iv FROM (
    SELECT *, (dist_good - dist_bad) * woe_raw AS iv_part FROM (
      SELECT *, ln((dist_good + 1e-9) / (dist_bad + 1e-9)) AS woe_raw FROM (
        SELECT *, good / (SUM(good) OVER (PARTITION BY feature) + 1e-9) AS dist_good,
                  bad / (SUM(bad) OVER (PARTITION BY feature) + 1e-9) AS dist_bad
        FROM (SELECT a.feature, a.bin, COALESCE(c.bad, 0.0) AS bad, COALESCE(c.total, 0) AS total,
                     COALESCE(c.total, 0) - COALESCE(c.bad, 0.0) AS good
              FROM iv_allbins a LEFT JOIN iv_counts c ON c.feature = a.feature AND c.bin = a.bin)))))
"""


def _woe_ctes():
    return [LONG_SQL, O.quantiles_sql("ivq", "scr_long", "feature", "x", _ranks.numpy_linspace(10)), WOE_SQL]


@register("woe_iv_table", _feat_sql(*_woe_ctes(), body=f"""
SELECT w.feature, w.bin, lo.edge AS bin_low, hi.edge AS bin_high, w.bad, w.total, w.good,
       w.dist_good, w.dist_bad, round(w.woe_raw, {STAT}) AS woe, round(w.iv_part, {STAT}) AS iv_part,
       round(w.iv, {STAT}) AS iv
FROM woe w
JOIN (SELECT feature, edge, row_number() OVER (PARTITION BY feature ORDER BY edge) AS k FROM iv_edges) lo
  ON lo.feature = w.feature AND lo.k = w.bin
JOIN (SELECT feature, edge, row_number() OVER (PARTITION BY feature ORDER BY edge) AS k FROM iv_edges) hi
  ON hi.feature = w.feature AND hi.k = w.bin + 1"""))
def q_woe_iv_table(spark, sf_dir):
    """H2: WoE / IV tables of all screened features by exact decile bins."""
    t = screening.woe_iv(featured(spark, sf_dir), SCREEN_FEATURES)
    return rounded(t, {"woe": STAT, "iv_part": STAT, "iv": STAT})


@register("iv_ranking", _feat_sql(*_woe_ctes(), body=f"""
SELECT feature, round(iv, {STAT}) AS iv,
       CASE WHEN iv <= 0.02 THEN 'unpredictive' WHEN iv <= 0.1 THEN 'weak' WHEN iv <= 0.3 THEN 'medium'
            WHEN iv <= 0.5 THEN 'strong' WHEN iv > 0.5 THEN 'suspicious' END AS strength
FROM (SELECT DISTINCT feature, iv FROM woe) WHERE iv IS NOT NULL AND NOT isnan(iv)"""))
def q_iv_ranking(spark, sf_dir):
    """H3: IV ranking with strength classes (numeric screened features)."""
    return rounded(screening.iv_ranking(featured(spark, sf_dir), SCREEN_FEATURES), {"iv": STAT})


@register("iv_ranking_categorical", _feat_sql(body=f"""
SELECT feature, round(iv, {STAT}) AS iv,
       CASE WHEN iv <= 0.02 THEN 'unpredictive' WHEN iv <= 0.1 THEN 'weak' WHEN iv <= 0.3 THEN 'medium'
            WHEN iv <= 0.5 THEN 'strong' WHEN iv > 0.5 THEN 'suspicious' END AS strength
FROM (
  SELECT DISTINCT feature, SUM(iv_part) OVER (PARTITION BY feature) AS iv FROM (
    SELECT *, (dist_good - dist_bad) * ln((dist_good + 1e-9) / (dist_bad + 1e-9)) AS iv_part FROM (
      SELECT *, good / (SUM(good) OVER (PARTITION BY feature) + 1e-9) AS dist_good,
                bad / (SUM(bad) OVER (PARTITION BY feature) + 1e-9) AS dist_bad FROM (
        SELECT feature, bin, SUM(y) AS bad, COUNT(*) AS total, COUNT(*) - SUM(y) AS good FROM (
          """ + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS bin, "
                                   f"CAST(default_target AS DOUBLE) AS y FROM features WHERE {c} IS NOT NULL"
                                   for c in ["sex", "loan_program", "region_from_address", "psk_bucket"]) + """)
        GROUP BY feature, bin))))"""))
def q_iv_ranking_categorical(spark, sf_dir):
    """H3 for the categorical model features (one bin per value)."""
    return rounded(screening.iv_ranking(featured(spark, sf_dir), [], ["sex", "loan_program", "region_from_address",
                                                                      "psk_bucket"]), {"iv": STAT})


@register("key_indicators")
def q_key_indicators(spark, sf_dir):
    """H4: greedy pick of up to 15 key indicators by IV and Spearman rank, suppressing |r| > 0.85
    (the statistics run on Spark; the pick loops over at most one row per feature)."""
    df = featured(spark, sf_dir)
    chosen = screening.key_indicators(df, SCREEN_FEATURES)
    return spark.createDataFrame([(i + 1, f) for i, f in enumerate(chosen)], "rank int, feature string")


# --------------------------------------------------------------------------- drift

from ..operators import drift  # noqa: E402

DRIFT_CUTOFF = "1998-07-01"
#: All numeric model inputs that need no history, and the three fields that define the label.
DRIFT_NUM = [c for c in SCREEN_FEATURES if not c.endswith(tuple(f"_{k}" for k in ("diff_1m", "pct_change_1m", *(f"{f}_{n}m" for f in ("mean", "std") for n in config.ROLLING_WINDOWS))))
             or c in ("payment_mean_3m", "payment_std_3m")] + ["pdn_current", "dpd"]
DRIFT_CAT = ["sex", "loan_program", "region_from_address", "quality_category", "psk_bucket", "dpd_bucket"]


def drift_sides(spark, sf_dir, stored=False):
    """Reference = panel months before the cut-off, current = from the cut-off; each side gets
    the non-rolling features and the formula score."""
    df = ews.formula_score(features.feature_set(labelled(spark, sf_dir), include_rolling=False))
    df = materialize(df) if stored else df
    cut = F.lit(DRIFT_CUTOFF).cast("timestamp_ntz")
    return df.filter(F.col("report_date_as_of") < cut), df.filter(F.col("report_date_as_of") >= cut)


DRIFT_SRC_SQL = f"""
drift_src AS (
  SELECT *, CASE WHEN report_date_as_of < TIMESTAMP '{DRIFT_CUTOFF}' THEN 0 ELSE 1 END AS side,
         round(least(1.0::DOUBLE, COALESCE(dpd, 0.0) / 300.0::DOUBLE
                                  + CAST(credit_id % 100 AS DOUBLE) / 250.0::DOUBLE), 4) AS risk_score
  FROM features WHERE report_date_as_of IS NOT NULL
)"""


def _drift_long_sql(cols: list[str]) -> str:
    return "d_long AS (" + " UNION ALL ".join(
        f"SELECT side, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM drift_src WHERE {c} IS NOT NULL"
        for c in cols) + "), d_ref AS (SELECT * FROM d_long WHERE side = 0)"


def _psi_sql(cols: list[str]) -> list[str]:
    feats = ", ".join(f"('{c}')" for c in cols)
    return [_drift_long_sql(cols), O.quantiles_sql("dq", "d_ref", "feature", "x", _ranks.numpy_linspace(10)), f"""
d_edges AS (SELECT DISTINCT g AS feature, q AS edge FROM dq),
d_ne AS (SELECT feature, COUNT(*) AS ne, MIN(edge) AS lo, MAX(edge) AS hi FROM d_edges GROUP BY feature),
d_binned AS (
  SELECT l.side, l.feature,
         least((SELECT COUNT(*) FROM d_edges e WHERE e.feature = l.feature AND e.edge <= l.x) - 1, n.ne - 2) AS bin
  FROM d_long l JOIN d_ne n ON n.feature = l.feature
  WHERE n.ne >= 3 AND l.x >= n.lo AND l.x <= n.hi
),
d_counts AS (SELECT feature, bin, SUM(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS r,
                    SUM(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS c FROM d_binned GROUP BY feature, bin),
d_full AS (
  SELECT a.feature, COALESCE(c.r, 0) AS r, COALESCE(c.c, 0) AS c
  FROM (SELECT feature, unnest(range(0, ne - 1)) AS bin FROM d_ne WHERE ne >= 3) a
  LEFT JOIN d_counts c ON c.feature = a.feature AND c.bin = a.bin
),
d_psi AS (
  SELECT feature, SUM((cp - rp) * ln(cp / rp)) AS psi FROM (
    SELECT feature, r / greatest(SUM(r) OVER (PARTITION BY feature), 1) + 1e-6 AS rp,
           c / greatest(SUM(c) OVER (PARTITION BY feature), 1) + 1e-6 AS cp FROM d_full)
  GROUP BY feature
),
d_sides AS (SELECT feature, SUM(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS n_ref,
                   SUM(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS n_cur FROM d_long GROUP BY feature),
psi_out AS (
  SELECT f.feature,
         CASE WHEN COALESCE(s.n_ref, 0) = 0 OR COALESCE(s.n_cur, 0) = 0 THEN NULL
              WHEN COALESCE(n.ne, 0) < 3 THEN 0.0 ELSE p.psi END AS psi
  FROM (VALUES {feats}) f(feature)
  LEFT JOIN d_sides s ON s.feature = f.feature LEFT JOIN d_ne n ON n.feature = f.feature
  LEFT JOIN d_psi p ON p.feature = f.feature
)"""]


def _drift_sql(*ctes, body):
    return O.with_ctes(O.RAW_PANEL_SQL, O.PREPARED_SQL, FEATURE_SQL, DRIFT_SRC_SQL, *ctes, body=body)


@register("psi_drift", _drift_sql(*_psi_sql(DRIFT_NUM), body=f"SELECT feature, round(psi, {STAT}) AS psi FROM psi_out"))
def q_psi_drift(spark, sf_dir):
    """PSI of numeric features between the two periods."""
    ref, cur = drift_sides(spark, sf_dir)
    return rounded(drift.psi(ref, cur, DRIFT_NUM), {"psi": STAT})


@register("score_psi", _drift_sql(*_psi_sql(["risk_score"]), body=f"SELECT round(psi, {STAT}) AS score_psi FROM psi_out"))
def q_score_psi(spark, sf_dir):
    """PSI of the (formula) model score between the two periods."""
    ref, cur = drift_sides(spark, sf_dir)
    return rounded(drift.score_drift(ref, cur), {"score_psi": STAT})


@register("ks_drift", _drift_sql(_drift_long_sql(DRIFT_NUM), body=f"""
SELECT feature, CASE WHEN n1 >= 2 AND n2 >= 2 THEN d END AS ks_stat,
       CASE WHEN n1 >= 2 AND n2 >= 2 THEN round(
         CASE WHEN lam < 1e-3 THEN 1.0 ELSE least(1.0, greatest(0.0,
           2 * (SELECT SUM(pow(-1.0, k - 1) * exp(-2.0 * k * k * lam * lam)) FROM range(1, 101) t(k)))) END, 8) END AS p_value
FROM (
  SELECT feature, d, n1, n2, d * sqrt(CAST(n1 AS DOUBLE) * n2 / (n1 + n2)) AS lam FROM (
    SELECT feature, MAX(abs(cr / n1 - cc / n2)) AS d, MAX(n1) AS n1, MAX(n2) AS n2 FROM (
      SELECT feature, SUM(nr) OVER w AS cr, SUM(nc) OVER w AS cc,
             SUM(nr) OVER (PARTITION BY feature) AS n1, SUM(nc) OVER (PARTITION BY feature) AS n2
      FROM (SELECT feature, x, SUM(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS nr,
                   SUM(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS nc FROM d_long GROUP BY feature, x)
      WINDOW w AS (PARTITION BY feature ORDER BY x ROWS UNBOUNDED PRECEDING))
    GROUP BY feature))"""))
def q_ks_drift(spark, sf_dir):
    """Two-sample KS statistic and asymptotic p-value per numeric feature."""
    ref, cur = drift_sides(spark, sf_dir)
    return rounded(drift.ks_two_sample(ref, cur, DRIFT_NUM, exact=False), {"p_value": 8})


@register("chi_square_drift", _drift_sql(body=f"""
SELECT feature, round(SUM(tr + tc), 8) AS chi2 FROM (
  SELECT feature, (orr - er) * (orr - er) / er AS tr, (occ - ec) * (occ - ec) / ec AS tc FROM (
    SELECT feature, er, ec,
           o_r + CASE WHEN k = 2 THEN sign(er - o_r) * least(0.5, abs(er - o_r)) ELSE 0.0 END AS orr,
           o_c + CASE WHEN k = 2 THEN sign(ec - o_c) * least(0.5, abs(ec - o_c)) ELSE 0.0 END AS occ
    FROM (
      SELECT feature, o_r, o_c, k, (o_r + o_c) * R / (R + C) AS er, (o_r + o_c) * C / (R + C) AS ec FROM (
        SELECT feature, o_r, o_c, SUM(o_r) OVER (PARTITION BY feature) AS R, SUM(o_c) OVER (PARTITION BY feature) AS C,
               COUNT(*) OVER (PARTITION BY feature) AS k
        FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS v, SUM(CASE WHEN side = 0 THEN 1 ELSE 0 END) + 1 AS o_r, "
    f"SUM(CASE WHEN side = 1 THEN 1 ELSE 0 END) + 1 AS o_c FROM drift_src GROUP BY 2" for c in DRIFT_CAT) + """)))))
GROUP BY feature"""))
def q_chi_square_drift(spark, sf_dir):
    """Chi-square statistic (Laplace +1, Yates for two categories) per categorical feature."""
    ref, cur = drift_sides(spark, sf_dir)
    return rounded(drift.chi_square(ref, cur, DRIFT_CAT).select("feature", "chi2"), {"chi2": 8})


@register("data_drift")
def q_data_drift(spark, sf_dir):
    """Per-feature drift table (PSI, KS / chi-square, p-value, drift flag) between the periods."""
    ref, cur = drift_sides(spark, sf_dir)
    return drift.data_drift(ref, cur, DRIFT_NUM, DRIFT_CAT)


# --------------------------------------------------------------------------- modelling

from ..operators import explain, modeling  # noqa: E402

_MODELS: dict = {}
_FRAMES: dict = {}


def model_frame(spark, sf_dir):
    """Training rows: the featured panel with the forward label, rows with a future observation.
    Written once per session and scale: every fit, score and permutation reads it."""
    from ..session import materialize
    k = (spark.sparkContext.applicationId, sf_dir)
    if k not in _FRAMES:
        df = targets.forward_target_monthly(features.feature_set(labelled(spark, sf_dir), split_hot=True))
        _FRAMES[k] = materialize(df.filter(F.col("has_future_obs")))
    return _FRAMES[k]


def newest_rows(spark, sf_dir):
    """Each contract's newest row, with rolling features from its history."""
    return cleaning.last_slice(featured(spark, sf_dir))


def model_inputs(df):
    return cleaning.feature_columns(df)


def trained(spark, sf_dir, model_type="logreg", params=None, cv=True):
    """Fit once per (data, model) in this driver process; the fitted model object is reused by
    the scoring and interpretation queries."""
    key = (spark.sparkContext.applicationId, sf_dir, model_type, tuple(sorted((params or {}).items())), cv)
    if key not in _MODELS:
        df = model_frame(spark, sf_dir)
        num, cat = model_inputs(df)
        _MODELS[key] = modeling.train_model(df, num, cat, label="default_future", model_type=model_type,
                                            params=params, cv=cv, stored=True)
    return _MODELS[key]


def _metrics_rows(spark, m):
    rows = []
    for split, d in (("train", m.metrics_train), ("test", m.metrics_test)):
        rows.append((split, int(d["n"]), float(d["positive_rate"]), float(d["roc_auc"]), float(d["pr_auc"]),
                     float(d["gini"]), float(d["ks"]), float(d["brier"]), float(d["precision_at_thr"]),
                     float(d["recall_at_thr"]), float(d["f1_at_thr"]),
                     float(m.cv_metrics.get("cv_roc_auc_mean", float("nan"))),
                     float(m.cv_metrics.get("cv_roc_auc_std", float("nan")))))
    return spark.createDataFrame(rows, "split string, n long, positive_rate double, roc_auc double, pr_auc double, "
                                       "gini double, ks double, brier double, precision_at_thr double, "
                                       "recall_at_thr double, f1_at_thr double, cv_roc_auc_mean double, "
                                       "cv_roc_auc_std double")


@register("model_metrics_logreg")
def q_model_metrics_logreg(spark, sf_dir):
    """Logistic regression on the 3-month forward label with a time-ordered 80/20 split and
    5 expanding CV folds; train / test metrics."""
    return _metrics_rows(spark, trained(spark, sf_dir, "logreg"))


@register("model_metrics_gbt")
def q_model_metrics_gbt(spark, sf_dir):
    """D4 + D7: gradient-boosted trees (600 trees of depth 6, step 0.05) with 5 expanding CV folds; train / test metrics."""
    return _metrics_rows(spark, trained(spark, sf_dir, "gbt"))


@register("model_metrics_leafwise")
def q_model_metrics_leafwise(spark, sf_dir):
    """D4 + D7: leaf-wise boosted trees with the published settings (600 trees) and 5 expanding CV folds; train / test metrics."""
    return _metrics_rows(spark, trained(spark, sf_dir, "leafwise"))


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    """|coefficient| per encoded feature of the logistic model, highest first."""
    pairs = modeling.feature_importance(trained(spark, sf_dir, "logreg"))
    return spark.createDataFrame(pairs, "feature string, importance double")


@register("class_weights", O.with_ctes(O.RAW_PANEL_SQL, O.PREPARED_SQL, FORWARD_SQL, body="""
SELECT CAST(default_future AS INTEGER) AS label, COUNT(*) AS n,
       (SELECT COUNT(*) FROM forward WHERE has_future_obs) / (2.0 * COUNT(*)) AS weight
FROM forward WHERE has_future_obs GROUP BY 1"""))
def q_class_weights(spark, sf_dir):
    """Balanced class weights n / (2 n_class) of the forward label."""
    df = targets.forward_target_monthly(labelled(spark, sf_dir)).filter(F.col("has_future_obs"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return (df.groupBy(F.col("default_future").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("weight", total / (F.lit(2.0) * F.col("n"))))


@register("time_split", O.with_ctes(O.RAW_PANEL_SQL, O.PREPARED_SQL, FORWARD_SQL, body="""
SELECT split, COUNT(*) AS n, MIN(report_date_as_of) AS first_date, MAX(report_date_as_of) AS last_date,
       CAST(SUM(default_future) AS BIGINT) AS n_pos
FROM (SELECT *, CASE WHEN row_number() OVER (ORDER BY report_date_as_of, credit_id) - 1
                          < CAST(floor(COUNT(*) OVER () * 0.8) AS BIGINT) THEN 'train' ELSE 'test' END AS split
      FROM forward WHERE has_future_obs)
GROUP BY split"""))
def q_time_split(spark, sf_dir):
    """Time-ordered 80/20 split (credit_id breaks ties), summarised per part."""
    from ..session import materialize
    df = materialize(targets.forward_target_monthly(labelled(spark, sf_dir)).filter(F.col("has_future_obs")))
    train, test = modeling.time_split(df)

    def summary(part, name):
        return part.agg(F.lit(name).alias("split"), F.count(F.lit(1)).alias("n"),
                        F.min("report_date_as_of").alias("first_date"), F.max("report_date_as_of").alias("last_date"),
                        F.sum("default_future").cast("long").alias("n_pos"))
    return summary(train, "train").unionByName(summary(test, "test"))


@register("model_scores_last_slice")
def q_model_scores_last_slice(spark, sf_dir):
    """D9 + E2-E7: logistic-model probabilities on each contract's latest row (with rolling
    features from its history), rules, zones and recommendations."""
    m = trained(spark, sf_dir, "logreg")
    return joined(ews.ews_scored(modeling.predict_proba(m, newest_rows(spark, sf_dir)), with_recommendations=True),
                  "rules_triggered", "recommendations")


@register("permutation_importance")
def q_permutation_importance(spark, sf_dir):
    """Permutation importance (5 repeats) of every raw input on the test rows of the time split."""
    m = trained(spark, sf_dir, "logreg")
    _, test = modeling.time_split(model_frame(spark, sf_dir))
    return explain.permutation_importance(m, test, "default_future")


@register("linear_contributions")
def q_linear_contributions(spark, sf_dir):
    """Per contract (its newest row) and encoded feature coef * (x - mean)."""
    return explain.contributions(trained(spark, sf_dir, "logreg"), newest_rows(spark, sf_dir))


@register("tree_contributions")
def q_tree_contributions(spark, sf_dir):
    """Per contract (its newest row) and encoded feature the Shapley value of the leaf-wise trees' log odds."""
    return explain.contributions(trained(spark, sf_dir, "leafwise", {"n_estimators": 60}, cv=False), newest_rows(spark, sf_dir))


@register("explain_top5_trees")
def q_explain_top5_trees(spark, sf_dir):
    """Top five reasons per contract (its newest row) under the leaf-wise trees."""
    return explain.explain_top(trained(spark, sf_dir, "leafwise", {"n_estimators": 60}, cv=False), newest_rows(spark, sf_dir), 5)


@register("explain_top5")
def q_explain_top5(spark, sf_dir):
    """Top five reasons per contract (its newest row) by |contribution|, with the raw value."""
    return explain.explain_top(trained(spark, sf_dir, "logreg"), newest_rows(spark, sf_dir), 5)


@register("top_contributions")
def q_top_contributions(spark, sf_dir):
    """I4: global top 20 features by mean |contribution|."""
    m = trained(spark, sf_dir, "logreg")
    return explain.top_contributions(m, model_frame(spark, sf_dir), 20)


@register("kmeans_segments")
def q_kmeans_segments(spark, sf_dir):
    """G2 + G3 + A4: k-means (k = 4, seed 42) on the behaviour features of the last slice, then
    the segment profile of the clusters."""
    seg = segments.kmeans_segment(last(spark, sf_dir), 4).withColumn("segment", F.col("cluster").cast("string"))
    return segments.segment_profile(seg, dedupe_last_obs=False)


@register("kmeans_k_search")
def q_kmeans_k_search(spark, sf_dir):
    """Inertia and silhouette for k = 2..7 on the last slice."""
    return segments.kmeans_k_search(last(spark, sf_dir))


# --------------------------------------------------------------------------- jobs and streaming

from ..plans import jobs  # noqa: E402


@register("batch_scoring", O.scored("last_slice", f"SELECT {EWS_COLS} FROM recommended", all_rows=True))
def q_batch_scoring(spark, sf_dir):
    """V6: batch scoring of every contract's latest row, sold and forgiven debts included."""
    return joined(jobs.score_batch(raw_panel(spark, sf_dir)), "rules_triggered", "recommendations")


@register("stream_scoring", O.scored("prepared", """
SELECT credit_id, report_date_as_of, risk_score, zone, array_to_string(rules_triggered, '|') AS rules_triggered,
       array_to_string(recommendations, '|') AS recommendations, rules_weight_sum, priority
FROM recommended""", all_rows=True))
def q_stream_scoring(spark, sf_dir):
    """V1: the raw panel is written as monthly parquet files, read back as a file stream,
    scored record by record (availableNow trigger) into a parquet sink, and the sink is returned."""
    import uuid
    from ..session import ensure_checkpoint_dir
    root = os.path.join(ensure_checkpoint_dir(spark, allow_local_default=True), f"stream-{uuid.uuid4().hex}")
    raw = raw_panel(spark, sf_dir)
    raw.withColumn("m", F.date_format("report_date_as_of", "yyyyMM")).write.partitionBy("m").parquet(
        os.path.join(root, "src"))
    scoring.run_scoring_stream(spark, os.path.join(root, "src"), raw.schema, os.path.join(root, "sink"),
                               os.path.join(root, "ckpt"))
    return joined(spark.read.parquet(os.path.join(root, "sink")), "rules_triggered", "recommendations")


@register("client_card", O.scored("last_slice", """
SELECT r.credit_id, r.report_date_as_of, r.total_debt, r.dpd, r.pdn_current, h.n_history, h.first_report_date, h.history,
       r.risk_score, r.zone, array_to_string(r.rules_triggered, '|') AS rules_triggered,
       array_to_string(r.recommendations, '|') AS recommendations
FROM recommended r
JOIN (SELECT credit_id, COUNT(*) AS n_history, MIN(report_date_as_of) AS first_report_date,
             coalesce(string_agg(strftime(report_date_as_of, '%Y-%m-%d') || ':' || CAST(CAST(dpd AS INTEGER) AS VARCHAR), '|'
                                 ORDER BY report_date_as_of, dpd), '') AS history
      FROM labelled GROUP BY credit_id) h ON h.credit_id = r.credit_id"""))
def q_client_card(spark, sf_dir):
    """V4: every contract's card - latest snapshot, history by date, score, zone, fired rules and recommendations.  The
    history array is put out as text, date:dpd joined by '|'."""
    panel = labelled(spark, sf_dir)
    scored = ews.score_and_zone(ews.formula_score(cleaning.last_slice(panel)))
    card = portfolio.client_card(panel, scored)
    days = F.transform("history", lambda h: F.concat(F.date_format(h["report_date_as_of"], "yyyy-MM-dd"), F.lit(":"), h["dpd"].cast("int").cast("string")))
    card = card.withColumn("history", F.array_join(F.array_compact(days), "|"))
    return joined(card.select("credit_id", "report_date_as_of", "total_debt", "dpd", "pdn_current", "n_history", "first_report_date",
                              "history", "risk_score", "zone", "rules_triggered", "recommendations"), "rules_triggered", "recommendations")


@register("screening_shortlist", _feat_sql(*_woe_ctes(), body=f"""
SELECT w.feature, round(w.iv, {STAT}) AS iv,
       CASE WHEN w.iv <= 0.02 THEN 'unpredictive' WHEN w.iv <= 0.1 THEN 'weak' WHEN w.iv <= 0.3 THEN 'medium'
            WHEN w.iv <= 0.5 THEN 'strong' WHEN w.iv > 0.5 THEN 'suspicious' END AS strength
FROM (SELECT DISTINCT feature, iv FROM woe) w
JOIN (SELECT feature FROM (
        SELECT feature, abs(corr(r, y)) AS a FROM (
          SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY x)
                             + (COUNT(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS r FROM scr_long)
        GROUP BY feature)
      ORDER BY a DESC NULLS LAST, feature LIMIT 30) t ON t.feature = w.feature
ORDER BY w.iv DESC, w.feature LIMIT 25"""))
def q_screening_shortlist(spark, sf_dir):
    """L4: top 30 screened features by |Spearman|, then the top 25 of them by IV."""
    return rounded(screening.shortlist(featured(spark, sf_dir), SCREEN_FEATURES), {"iv": STAT})


@register("drift_verdict")
def q_drift_verdict(spark, sf_dir):
    """X6 + X7: drift job between the two periods (last slice of each side, no rolling features,
    current default flag, formula score): feature drift, score PSI, AUC on both sides, verdict."""
    raw = materialize(raw_panel(spark, sf_dir))          # both sides read it
    cut = F.lit(DRIFT_CUTOFF).cast("date")
    v = jobs.drift_job(raw.filter(F.col("report_date_as_of") < cut), raw.filter(F.col("report_date_as_of") >= cut),
                       DRIFT_NUM, DRIFT_CAT)
    s = v["summary"]
    return spark.createDataFrame(
        [(bool(v["needs_retrain"]), v["score_psi"], v["auc_reference"], v["auc_current"], s["features_drifted"],
          s["features_total"], s["pct_drifted"])],
        "needs_retrain boolean, score_psi double, auc_reference double, auc_current double, features_drifted long, "
        "features_total long, pct_drifted double")


@register("dashboard_marts", O.scored("fwd_last", f"""
SELECT {', '.join(config.PANEL_MART_COLS)}, risk_score, zone, array_to_string(rules_triggered, '|') AS rules_triggered,
       rules_weight_sum, array_to_string(recommendations, '|') AS recommendations, segment, priority
FROM recommended""", FORWARD_SQL, """fwd_last AS (
  SELECT *, CASE WHEN COALESCE(dpd > 30, false) OR COALESCE(is_bankrupt = 1, false) THEN 'delinquent'
                 WHEN COALESCE(payment_ratio_mom < 0.5, false) OR COALESCE(days_since_last_payment > 45, false) THEN 'stress'
                 WHEN COALESCE(utilization > 0.6, false) AND COALESCE(dpd <= 5, false) THEN 'growing' ELSE 'stable' END AS segment
  FROM forward
  QUALIFY row_number() OVER (PARTITION BY credit_id ORDER BY report_date_as_of DESC NULLS FIRST) = 1)"""))
def q_dashboard_marts(spark, sf_dir):
    """S3: the three dashboard marts are written (zstd parquet, panel partitioned by month) under
    the checkpoint folder; the scored mart is read back."""
    import uuid
    from ..session import ensure_checkpoint_dir
    out = os.path.join(ensure_checkpoint_dir(spark, allow_local_default=True), f"marts-{uuid.uuid4().hex}")
    paths = jobs.build_marts(raw_panel(spark, sf_dir), out)
    return joined(spark.read.parquet(paths["scored"]), "rules_triggered", "recommendations")


@register("panel_sample", O.with_ctes(O.RAW_PANEL_SQL, O.PREPARED_SQL, body=f"""
SELECT credit_id, report_date_as_of, total_debt, dpd, utilization FROM prepared
ORDER BY md5(concat_ws('|', '{config.RANDOM_STATE}', CAST(credit_id AS VARCHAR), CAST(report_date_as_of AS VARCHAR)))
LIMIT 1000"""))
def q_panel_sample(spark, sf_dir):
    """1,000 rows of the prepared panel, those with the smallest keyed hash (the sampling operator)."""
    some = cleaning.sample_rows(prepared(spark, sf_dir), 1000, ["credit_id", "report_date_as_of"])
    return some.select("credit_id", "report_date_as_of", "total_debt", "dpd", "utilization")


def _fresh_marts(spark, sf_dir) -> str:
    import uuid
    from ..session import ensure_checkpoint_dir
    out = os.path.join(ensure_checkpoint_dir(spark, allow_local_default=True), f"monthly-{uuid.uuid4().hex}")
    marts.refresh_marts(raw_panel(spark, sf_dir), out)
    return out


@register("panel_mart", O.with_ctes(O.RAW_PANEL_SQL, O.PREPARED_SQL, FORWARD_SQL, body=f"""
SELECT {', '.join(config.PANEL_MART_COLS)}, COALESCE(CAST(strftime(report_date_as_of, '%Y%m') AS INTEGER), 0) AS report_month FROM forward"""))
def q_panel_mart(spark, sf_dir):
    """S3: the panel mart by month and bucket, written and read back through its manifest."""
    return marts.read_mart(spark, _fresh_marts(spark, sf_dir), "panel").select(*config.PANEL_MART_COLS, "report_month")


@register("monthly_mart", ORACLE["default_rate_over_time"])
def q_monthly_mart(spark, sf_dir):
    """S3: the monthly series, written and read back through the manifest."""
    series = marts.read_mart(spark, _fresh_marts(spark, sf_dir), "series").drop("report_month")
    return rounded(series, {"total_debt": MONEY, "default_rate": RATE, "avg_dpd": RATE})


@register("client_lookup", O.base("""
SELECT credit_id, report_date_as_of, total_debt, dpd, pdn_current, payment_sum_1m, default_target FROM labelled
WHERE credit_id IN (SELECT credit_id FROM last_slice ORDER BY total_debt DESC NULLS LAST, credit_id LIMIT 20)"""))
def q_client_lookup(spark, sf_dir):
    """The history of the 20 contracts with the largest debt, looked up by id in the bucketed mart."""
    out = _fresh_marts(spark, sf_dir)
    top = cleaning.last_slice(marts.read_mart(spark, out, "panel")).orderBy(F.desc_nulls_last("total_debt"), "credit_id").limit(20)
    ids = [r["credit_id"] for r in top.select("credit_id").collect()]
    return marts.client_lookup(spark, out, ids).select("credit_id", "report_date_as_of", "total_debt", "dpd", "pdn_current",
                                                       "payment_sum_1m", "default_target")


def _stored_sides(spark, sf_dir, num, cat):
    """The reference months saved in two parts as a profile, whose counts of some features are compared with the current
    period.  The rows of the three are computed and written once."""
    import uuid
    from ..session import ensure_checkpoint_dir
    ref, cur = drift_sides(spark, sf_dir, stored=True)
    out = os.path.join(ensure_checkpoint_dir(spark, allow_local_default=True), f"profile-{uuid.uuid4().hex}")
    half = F.lit("1995-01-01").cast("timestamp_ntz")
    for part in (ref.filter(F.col("report_date_as_of") < half), ref.filter(F.col("report_date_as_of") >= half)):
        profiles.save_profile(part, out, DRIFT_NUM, DRIFT_CAT, label="default_target")
    return profiles.compare(spark, out, cur, num, cat)


@register("stored_psi_drift", ORACLE["psi_drift"])
def q_stored_psi_drift(spark, sf_dir):
    """X1 against a stored reference: PSI from the months of a profile and the current rows."""
    hist = drift.numeric_sides(_stored_sides(spark, sf_dir, DRIFT_NUM, []))
    return rounded(drift.psi(hist, hist, DRIFT_NUM, hist=hist), {"psi": STAT})


@register("stored_chi_square_drift", ORACLE["chi_square_drift"])
def q_stored_chi_square_drift(spark, sf_dir):
    """X3 against a stored reference: chi-square from the level counts of a profile and the current rows."""
    out = drift.data_drift_of_counts(_stored_sides(spark, sf_dir, [], DRIFT_CAT), [], DRIFT_CAT)
    return rounded(out.select("feature", F.col("ks_stat").alias("chi2")), {"chi2": 8})
