"""Independent DuckDB SQL for every query with an exact oracle.

The SQL is written from the operator semantics, not generated from the Spark plans.  The
CTE chain mirrors the steps: raw panel (fixture mapping) -> typed and cleaned panel ->
labels -> last slice -> formula score + rules + zones.
"""
from __future__ import annotations

from ..sources.fixture import RAW_PANEL_SQL

PREPARED_SQL = """
typed AS (
  SELECT CAST(report_date_as_of AS TIMESTAMP) AS report_date_as_of,
         credit_id, borrower_id,
         COALESCE(CAST(sex AS VARCHAR), 'UNKNOWN') AS sex,
         COALESCE(CAST(loan_program AS VARCHAR), 'UNKNOWN') AS loan_program,
         COALESCE(CAST(region_from_address AS VARCHAR), 'UNKNOWN') AS region_from_address,
         COALESCE(CAST(employer AS VARCHAR), 'UNKNOWN') AS employer,
         COALESCE(CAST(bankruptcy_stage AS VARCHAR), 'UNKNOWN') AS bankruptcy_stage,
         COALESCE(CAST(quality_category AS VARCHAR), 'UNKNOWN') AS quality_category,
         CAST(reserve_rate AS DOUBLE) AS reserve_rate,
         CAST(initial_amount AS DOUBLE) AS initial_amount,
         CAST(total_debt AS DOUBLE) AS total_debt,
         CAST(available_limit AS DOUBLE) AS available_limit,
         CAST(total_debt_reserve AS DOUBLE) AS total_debt_reserve,
         CAST(dpd AS DOUBLE) AS dpd,
         CAST(expired_actual_days_count AS DOUBLE) AS expired_actual_days_count,
         CAST(pdn_current AS DOUBLE) AS pdn_current,
         CAST(pdn_initial AS DOUBLE) AS pdn_initial,
         CAST(psk_current AS DOUBLE) AS psk_current,
         CAST(payment_sum_1m AS DOUBLE) AS payment_sum_1m,
         CAST(payment_sum_2m AS DOUBLE) AS payment_sum_2m,
         CAST(payment_sum_3m AS DOUBLE) AS payment_sum_3m,
         CAST(cnt_all_payments AS DOUBLE) AS cnt_all_payments,
         CAST(last_payment_date AS TIMESTAMP) AS last_payment_date,
         CAST(date_issued AS TIMESTAMP) AS date_issued,
         CAST(date_borrower_birthday AS TIMESTAMP) AS date_borrower_birthday,
         COALESCE(CAST(sold_flg AS INTEGER), 0) AS sold_flg,
         COALESCE(CAST(forgiven_flg AS INTEGER), 0) AS forgiven_flg
  FROM raw_panel
),
prepared AS (
  SELECT *,
         round_even(floor((epoch_us(report_date_as_of) - epoch_us(date_borrower_birthday)) / 86400000000) / 365.25, 1) AS age,
         round_even(floor((epoch_us(report_date_as_of) - epoch_us(date_issued)) / 86400000000) / 30.44, 1) AS months_on_book,
         CAST(floor((epoch_us(report_date_as_of) - epoch_us(last_payment_date)) / 86400000000) AS DOUBLE) AS days_since_last_payment,
         CASE WHEN (initial_amount - available_limit) / (abs(initial_amount) + 1e-6) IS NOT NULL
              THEN least(greatest((initial_amount - available_limit) / (abs(initial_amount) + 1e-6), 0.0::DOUBLE), 1.5::DOUBLE) END AS utilization,
         payment_sum_1m / (abs(total_debt) + 1e-6) AS payment_ratio_1m,
         payment_sum_1m / (abs(payment_sum_2m) + 1e-6) AS payment_ratio_mom,
         CAST(bankruptcy_stage IS NOT NULL AND bankruptcy_stage <> 'UNKNOWN' AS INTEGER) AS is_bankrupt
  FROM typed
  WHERE sold_flg <> 1 AND forgiven_flg <> 1
),
labelled AS (
  SELECT *,
         CAST((COALESCE(dpd, 0) > 90) OR (COALESCE(pdn_current, 0) > 80.0)
              OR COALESCE(quality_category IN ('IV','V','4','5'), false)
              OR COALESCE(is_bankrupt = 1, false) AS INTEGER) AS default_target
  FROM prepared
),
last_slice AS (
  SELECT * FROM labelled
  QUALIFY row_number() OVER (PARTITION BY credit_id ORDER BY report_date_as_of DESC NULLS FIRST) = 1
)
"""

RULES_SQL = """
ruled AS (
  SELECT *,
         CAST(r1 AS INTEGER) AS rule_high_dpd, CAST(r2 AS INTEGER) AS rule_bad_quality,
         CAST(r3 AS INTEGER) AS rule_pdn_spike, CAST(r4 AS INTEGER) AS rule_no_recent_payment,
         CAST(r5 AS INTEGER) AS rule_payments_drop, CAST(r6 AS INTEGER) AS rule_utilization_high,
         CAST(r7 AS INTEGER) AS rule_bankruptcy_trigger,
         (CASE WHEN r1 THEN 2.0 ELSE 0.0 END) + (CASE WHEN r2 THEN 1.0 ELSE 0.0 END)
           + (CASE WHEN r3 THEN 1.0 ELSE 0.0 END) + (CASE WHEN r4 THEN 2.0 ELSE 0.0 END)
           + (CASE WHEN r5 THEN 1.0 ELSE 0.0 END) + (CASE WHEN r6 THEN 1.0 ELSE 0.0 END)
           + (CASE WHEN r7 THEN 3.0 ELSE 0.0 END) AS rules_weight_sum,
         list_filter([CASE WHEN r1 THEN 'high_dpd' END, CASE WHEN r2 THEN 'bad_quality' END,
                      CASE WHEN r3 THEN 'pdn_spike' END, CASE WHEN r4 THEN 'no_recent_payment' END,
                      CASE WHEN r5 THEN 'payments_drop' END, CASE WHEN r6 THEN 'utilization_high' END,
                      CASE WHEN r7 THEN 'bankruptcy_trigger' END], lambda x: x IS NOT NULL) AS rules_triggered
  FROM (
    SELECT *,
           COALESCE(dpd > 30, false) AS r1,
           COALESCE(quality_category IN ('III','IV','V','3','4','5'), false) AS r2,
           COALESCE(pdn_current > 60, false) AS r3,
           COALESCE(days_since_last_payment > 60, false) AS r4,
           COALESCE(payment_ratio_mom < 0.3, false) AS r5,
           COALESCE(utilization > 0.9, false) AS r6,
           COALESCE(is_bankrupt = 1, false) AS r7
    FROM {src}
  )
),
zoned AS (
  SELECT *,
         CASE WHEN rules_weight_sum >= 5 THEN 'red'
              WHEN rules_weight_sum >= 3 AND base_zone = 'green' THEN 'yellow'
              ELSE base_zone END AS zone,
         risk_score * CASE WHEN total_debt IS NOT NULL THEN greatest(total_debt, 0.0::DOUBLE) END AS priority
  FROM (
    SELECT *, CASE WHEN risk_score < 0.15 THEN 'green' WHEN risk_score < 0.40 THEN 'yellow' ELSE 'red' END AS base_zone
    FROM ruled
  )
),
recommended AS (
  SELECT *,
         CASE WHEN zone = 'red' THEN
                [CASE WHEN list_contains(rules_triggered, 'no_recent_payment') OR list_contains(rules_triggered, 'high_dpd')
                           OR list_contains(rules_triggered, 'bankruptcy_trigger')
                      THEN '{collections}' ELSE '{restructure}' END, '{block}']
              WHEN zone = 'yellow' THEN
                CASE WHEN len(ylist) > 0 THEN ylist ELSE ['{watch}'] END
              ELSE ['{keep}'] END AS recommendations
  FROM (
    SELECT *, list_filter([CASE WHEN list_contains(rules_triggered, 'utilization_high') THEN '{lower}' END,
                           CASE WHEN list_contains(rules_triggered, 'pdn_spike') THEN '{refin}' END,
                           CASE WHEN list_contains(rules_triggered, 'payments_drop') THEN '{remind}' END],
                          lambda x: x IS NOT NULL) AS ylist
    FROM zoned
  )
)
"""

SCORE_SQL = """
scored_src AS (
  SELECT *, round(least(1.0::DOUBLE, COALESCE(dpd, 0.0) / 300.0::DOUBLE
                                     + CAST(credit_id % 100 AS DOUBLE) / 250.0::DOUBLE), 4) AS risk_score
  FROM {src}
)
"""


def _rules_sql(src: str) -> str:
    from .. import config as c
    return RULES_SQL.format(
        src=src, collections=c.REC_COLLECTIONS, restructure=c.REC_RESTRUCTURE, block=c.REC_BLOCK_LIMIT,
        lower=c.REC_LOWER_LIMIT, refin=c.REC_REFINANCE, remind=c.REC_REMINDER, watch=c.REC_WATCHLIST,
        keep=c.REC_KEEP_TERMS)


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n" + body


def base(body: str) -> str:
    """Raw panel + prepared/labelled/last-slice CTEs, then ``body``."""
    return with_ctes(RAW_PANEL_SQL, PREPARED_SQL, body=body)


PORTFOLIO_FILTER = "WHERE sold_flg <> 1 AND forgiven_flg <> 1"


def scored(src: str, body: str, *extra: str, all_rows: bool = False) -> str:
    """Base CTEs + formula score over ``src`` + rules, zones, recommendations, then ``body``
    (which reads ``recommended``).  ``extra`` CTEs come before the score; with ``all_rows`` sold
    and forgiven debts stay in."""
    base_sql = PREPARED_SQL.replace(PORTFOLIO_FILTER, "") if all_rows else PREPARED_SQL
    return with_ctes(RAW_PANEL_SQL, base_sql, *extra, SCORE_SQL.format(src=src), _rules_sql("scored_src"), body=body)


def quantiles_sql(name: str, src: str, group: str, value: str, probs: list[float]) -> str:
    """CTE ``name``(group, i, q): exact quantiles of ``value`` per ``group`` by order statistics
    and numpy's linear interpolation (position (n-1)p)."""
    pv = ", ".join(f"({i}, CAST({p!r} AS DOUBLE))" for i, p in enumerate(probs))
    return f"""
{name}_ranked AS (
  SELECT {group} AS g, {value} AS x, row_number() OVER (PARTITION BY {group} ORDER BY {value}) - 1 AS r,
         COUNT(*) OVER (PARTITION BY {group}) AS n
  FROM {src} WHERE {value} IS NOT NULL
),
{name}_pos AS (
  SELECT DISTINCT g, n, pr.i, (n - 1) * pr.p AS pos
  FROM {name}_ranked, (VALUES {pv}) AS pr(i, p)
),
{name} AS (
  SELECT ps.g, ps.i,
         CASE WHEN ps.pos - floor(ps.pos) >= 0.5 THEN b.x - (b.x - a.x) * (1 - (ps.pos - floor(ps.pos)))
              ELSE a.x + (b.x - a.x) * (ps.pos - floor(ps.pos)) END AS q
  FROM {name}_pos ps
  JOIN {name}_ranked a ON a.g = ps.g AND a.r = CAST(floor(ps.pos) AS BIGINT)
  JOIN {name}_ranked b ON b.g = ps.g AND b.r = CAST(ceil(ps.pos) AS BIGINT)
)"""
