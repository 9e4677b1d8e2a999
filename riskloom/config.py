"""Column lists, thresholds, rule set and texts of the credit-portfolio engine.

Everything in the block marked FIXED VALUES must equal the values the reference
engine uses, otherwise results differ; it is stated plainly and in its natural
order.  The rest are settings of this build.
"""
from __future__ import annotations

# --------------------------------------------------------------------------
# FIXED VALUES (must match the reference semantics)
# --------------------------------------------------------------------------

ID_COLS = ["credit_id", "borrower_id"]

DATE_COLS = [
    "report_date_as_of",
    "date_borrower_birthday",
    "date_return",
    "date_issued",
    "date_signing",
    "last_payment_date",
]

CATEGORICAL_COLS = [
    "sex",
    "loan_program",
    "bankruptcy_stage",
    "employer",
    "quality_category",
    "region_from_address",
]

DROP_COLS = ["position", "attested_income", "education"]

NUMERIC_COLS = [
    "initial_amount",
    "total_debt",
    "available_limit",
    "reserve_rate",
    "expired_actual_days_count",
    "percent_expired_actual_days_count",
    "dpd",
    "card_commission_expired_days",
    "limit_conversion_ratio",
    "total_debt_reserve",
    "available_limit_reserve",
    "pdn_initial",
    "pdn_current",
    "psk_current",
    "ifrs_provision_rate",
    "total_debt_provision",
    "available_limit_provision",
    "payment_sum_1m",
    "payment_sum_2m",
    "payment_sum_3m",
    "cnt_all_payments",
]

FLAG_COLS = ["sold_flg", "forgiven_flg"]

UNKNOWN = "UNKNOWN"

TARGET_COL = "default_target"
FORWARD_TARGET_COL = "default_future"
VALID_MASK_COL = "has_future_obs"
FORWARD_HORIZON_MONTHS = 3
DEFAULT_DPD_THRESHOLD = 90
PDN_DEFAULT_THRESHOLD = 80.0
QUALITY_BAD_CATEGORIES = ("IV", "V", "4", "5")

# zone thresholds: green < 0.15 <= yellow < 0.40 <= red
EWS_ZONES = {
    "green": {"score_max": 0.15},
    "yellow": {"score_min": 0.15, "score_max": 0.40},
    "red": {"score_min": 0.40},
}
ZONE_ORDER = ("green", "yellow", "red")
ESCALATE_TO_YELLOW_WEIGHT = 3.0
ESCALATE_TO_RED_WEIGHT = 5.0

# default rule set, as (name, Spark SQL boolean expression, weight), in rule order
EWS_RULES = [
    {"name": "high_dpd", "expr": "dpd > 30", "weight": 2},
    {"name": "bad_quality", "expr": "quality_category IN ('III','IV','V','3','4','5')", "weight": 1},
    {"name": "pdn_spike", "expr": "pdn_current > 60", "weight": 1},
    {"name": "no_recent_payment", "expr": "days_since_last_payment > 60", "weight": 2},
    {"name": "payments_drop", "expr": "payment_ratio_mom < 0.3", "weight": 1},
    {"name": "utilization_high", "expr": "utilization > 0.9", "weight": 1},
    {"name": "bankruptcy_trigger", "expr": "is_bankrupt = 1", "weight": 3},
]

# recommendation texts, in the order they are emitted
REC_COLLECTIONS = "Передать в коллекшн с высоким приоритетом"
REC_RESTRUCTURE = "Персональная коммуникация: предложить реструктуризацию"
REC_BLOCK_LIMIT = "Заблокировать/снизить кредитный лимит"
REC_LOWER_LIMIT = "Снизить доступный лимит по карте"
REC_REFINANCE = "Предложить рефинансирование с меньшей ставкой"
REC_REMINDER = "Отправить напоминание о платеже + льготные условия"
REC_WATCHLIST = "Мониторинг: включить в еженедельный watch-list"
REC_KEEP_TERMS = "Оставить текущие условия; возможен upsell / повышение лимита"

# segment policy texts and thresholds
POLICY_TIGHTEN = "ужесточить cut-off, усилить верификацию, сократить средний лимит"
POLICY_LOOSEN = "смягчить cut-off; возможен кросс-продукт и upsell"
POLICY_MONITOR = "оставить текущую политику; расширенный мониторинг"
POLICY_HIGH = 0.10
POLICY_LOW = 0.02

# rule-based segments and their display order
SEGMENT_ORDER = ("stable", "growing", "stress", "delinquent")

# behaviour features of the k-means segmentation
BEHAVIOR_FEATURES = [
    "utilization",
    "payment_ratio_1m",
    "payment_ratio_mom",
    "dpd",
    "pdn_current",
    "days_since_last_payment",
    "cnt_all_payments",
]

# rolling features
ROLLING_BASE_COLS = ["total_debt", "available_limit", "pdn_current", "dpd", "payment_sum_1m"]
ROLLING_WINDOWS = (1, 3, 6)

# bins
PSK_EDGES = (10.0, 20.0, 30.0)
PSK_LABELS = ("low", "mid", "high", "extreme")
DPD_EDGES = (-1.0, 0.0, 5.0, 30.0, 60.0, 90.0, 180.0, 10000.0)
DPD_LABELS = ("current", "1-5", "6-30", "31-60", "61-90", "91-180", "180+")
IV_STRENGTH_EDGES = (0.02, 0.1, 0.3, 0.5)
IV_STRENGTH_LABELS = ("unpredictive", "weak", "medium", "strong", "suspicious")

# columns that are never model inputs
TECHNICAL_COLS = (
    "credit_id",
    "borrower_id",
    "report_date_as_of",
    "date_borrower_birthday",
    "date_return",
    "date_issued",
    "date_signing",
    "last_payment_date",
    "employer",
    "default_target",
    "default_future",
    "has_future_obs",
    "segment",
    "cluster",
    "sold_flg",
    "forgiven_flg",
    "report_month_idx",
)

# columns the target is built from (a feature is leaky if it equals a prefix
# or starts with prefix + "_")
LEAKY_COL_PREFIXES = (
    "dpd",
    "pdn_current",
    "quality_category",
    "bankruptcy_stage",
    "is_bankrupt",
    "expired_actual_days_count",
    "percent_expired_actual_days_count",
    "reserve_rate",
    "ifrs_provision_rate",
    "total_debt_reserve",
    "total_debt_provision",
    "available_limit_reserve",
    "available_limit_provision",
    "overdue_density",
)

# columns of the dashboard panel mart
PANEL_MART_COLS = [
    "credit_id",
    "borrower_id",
    "report_date_as_of",
    "total_debt",
    "available_limit",
    "dpd",
    "pdn_current",
    "payment_sum_1m",
    "quality_category",
    "is_bankrupt",
    "sex",
    "loan_program",
    "region_from_address",
    "age",
    "months_on_book",
    "utilization",
    "payment_ratio_mom",
    "days_since_last_payment",
    "default_target",
    "default_future",
    "total_debt_reserve",
]
SCORED_EXTRA_COLS = [
    "risk_score",
    "zone",
    "rules_triggered",
    "rules_weight_sum",
    "recommendations",
    "segment",
    "priority",
]

# model and drift settings
RANDOM_STATE = 42
SILHOUETTE_SAMPLE = 10_000
TEST_SIZE = 0.2
N_FOLDS = 5
CV_PARALLELISM = 5
RARE_CATEGORY_SHARE = 0.01
DRIFT_PSI_THRESHOLD = 0.25
DRIFT_KS_PVALUE = 0.01
MODEL_METRIC_DROP_PCT = 0.10
DRIFTED_SHARE_RETRAIN = 0.3
EPS = 1e-6

# --------------------------------------------------------------------------
# settings of this build
# --------------------------------------------------------------------------

# Columns that decide between rows of one contract and date, in this order.
TIE_COLS = ("total_debt", "available_limit", "payment_sum_1m", "dpd", "borrower_id")

# Size bound for broadcasting a derived side (bytes); every broadcast of a
# data-dependent side is checked against it.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
