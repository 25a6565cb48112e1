"""Fixed values, series specifications and tuning parameters."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# --------------------------------------------------------------------------
# Contract and naming facts the results depend on.
# --------------------------------------------------------------------------

# Credits per hour of compute, by warehouse; every other name uses the default.
WAREHOUSE_CREDITS_PER_HOUR = {
    "TRANSFORM_L": 8,
    "TRANSFORM_XS": 1,
    "ANALYST_XS": 1,
    "REPORTING_M": 4,
}
DEFAULT_CREDITS_PER_HOUR = 1

# Contract price of one credit.
MONEY_PER_CREDIT = 2.58

# Statement-log filter of the spend report.
LOG_DATABASE = "ANALYTICS"
LOG_EXCLUDED_QUERY_TYPES = ("SELECT",)
LOG_EXCLUDED_WAREHOUSE = "STITCH"
LOG_SINCE = date(2020, 12, 1)
TABLE_BUILD_QUERY_TYPE = "CREATE_TABLE_AS_SELECT"

# Patterns that find a data-model name in statement text.  The label accepts the
# quoted database name only, the grouping key also the bare one.
MODEL_LABEL_PATTERN = r'"ANALYTICS".{1}[A-Za-z_]{0,100}.{1}[A-Za-z_]{0,100}'
MODEL_KEY_PATTERN = r'("ANALYTICS"|ANALYTICS|analytics).{1}[A-Za-z_]{0,100}.{1}[A-Za-z_]{0,100}'
BUILD_SUFFIX = "__dbt_tmp"

# Workspace counters carried from the workspace fact table into the feature table.
WORKSPACE_COUNTERS = (
    "max_registered_users",
    "max_registered_deactivated_users",
    "posts_events_alltime",
    "invite_members_alltime",
    "signup_email_events_alltime",
    "admin_events_alltime",
    "tutorial_events_alltime",
    "signup_events_alltime",
    "slash_commands",
    "direct_message_channels",
    "public_channels",
    "private_channels",
    "incoming_webhooks",
    "outgoing_webhooks",
    "bot_accounts",
    "guest_accounts",
    "teams",
    "mobile_events_alltime",
    "events_alltime",
)

# Columns that identify a workspace, date it or leak the label.
NON_FEATURE_COLUMNS = (
    "server_id",
    "first_active_date",
    "last_telemetry_date",
    "pct_active",
    "email_domain",
)

MIN_REGISTERED_USERS = 3
MIN_DAYS_OBSERVED = 3
PREINSTALLED_PLUGINS = 3
ACTIVE_SHARE = 0.8
POSTS_TARGET = 1000

SPLIT_SEED = 8675309
FOLD_SEED = 90210
TEST_PERCENT = 25
FOLDS = 5

# First day of the budget sums, and first predicted day shown by each forecast chart.
SPEND_CUTOFF = date(2020, 12, 1)
PREDICTION_CUTOFFS = {"year_ahead": date(2020, 11, 19), "fiscal_year": date(2020, 12, 14)}
# Last day (exclusive) of the budget forecast, days of the year-ahead outlook.
SPEND_UNTIL = date(2022, 1, 28)
OUTLOOK_DAYS = 365


# --------------------------------------------------------------------------
# Daily series
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class SeriesSpec:
    """One daily series: an aggregate of a source table by calendar day.

    ``ts`` is a column name or SQL expression giving a date or timestamp, ``where`` an
    optional SQL predicate.  ``inclusive`` keeps the ``as_of`` day itself.
    """

    name: str
    source: str
    ts: str
    measure: str = "count"  # count | sum | avg | distinct | approx_distinct
    column: str | None = None
    lower: date | None = date(2018, 2, 1)
    inclusive: bool = False
    where: str | None = None


_WEB_SINCE = date(2020, 5, 1)

SERIES_SPECS = (
    SeriesSpec("warehouse_spend", "warehouse_cost", "usage_day", "sum", "dollars_spent"),
    SeriesSpec("usage_event_volume", "usage_events", "event_ts"),
    SeriesSpec("usage_active_users", "usage_events", "event_ts", "sum", "active_users"),
    SeriesSpec("invoice_updates", "invoices_version", "updated_at", inclusive=True),
    SeriesSpec("invoice_creations", "invoices", "created_at"),
    SeriesSpec("server_details_ext", "server_daily_details_ext", "day"),
    SeriesSpec("server_details", "server_daily_details", "day"),
    SeriesSpec("server_security_details", "server_security_details", "day"),
    SeriesSpec("server_server_details", "server_server_details", "day", inclusive=True),
    SeriesSpec(
        "mobile_events", "telemetry", "event_ts",
        where="source_relation IN ('MOBILE_EVENTS', 'SEGMENT_MOBILE_EVENTS')",
    ),
    SeriesSpec(
        "webapp_events_rudder", "telemetry", "event_ts", lower=_WEB_SINCE,
        where="source_relation IN ('RUDDER_WEBAPP_EVENTS')",
    ),
    SeriesSpec(
        "webapp_events_segment", "telemetry", "event_ts", lower=_WEB_SINCE,
        where="source_relation IN ('SEGMENT_WEBAPP_EVENTS')",
    ),
    SeriesSpec(
        "unique_visitors", "human_visits", "event_ts", "distinct", "anonymous_id", lower=_WEB_SINCE
    ),
    SeriesSpec("pageviews", "daily_website_traffic", "event_ts", lower=_WEB_SINCE),
    SeriesSpec(
        "nps_user_score", "nps_user_daily_score", "day", "avg", "score", lower=None,
        where="user_role = 'user'",
    ),
    SeriesSpec(
        "portal_events", "telemetry", "event_ts", where="source_relation IN ('PORTAL_EVENTS')"
    ),
    SeriesSpec("server_telemetry", "server_telemetry", "event_ts", lower=_WEB_SINCE),
    SeriesSpec("marketing_pages", "marketing_pages", "event_ts", lower=_WEB_SINCE),
    SeriesSpec("portal_pages", "portal_pages", "event_ts", lower=_WEB_SINCE),
    SeriesSpec("downloads", "log_entries", "to_date(concat_ws(' ', logdate, logtime))"),
    SeriesSpec("nps_feedback", "nps_feedback", "event_ts", lower=date(2017, 2, 1)),
)


# --------------------------------------------------------------------------
# Trend model
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class TrendConfig:
    """Additive trend-plus-seasonality model (Taylor & Letham 2018).

    Priors follow the paper's published defaults: Laplace(``changepoint_prior``) on slope
    changes, Normal(``seasonality_prior``) on Fourier terms, Normal(5) on offset and
    growth, half-Normal(0.5) on the noise of the scaled series.
    """

    interval_width: float = 0.8
    changepoint_range: float = 0.8
    n_changepoints: int = 25
    changepoint_prior: float = 0.05
    seasonality_prior: float = 10.0
    weekly_order: int = 3
    yearly_order: int = 0
    draws: int = 1000
    seed: int = 20181


# History scoring for anomaly detection: weekly term only.
ANOMALY_TREND = TrendConfig(interval_width=0.8)
# Year-ahead spend outlook.
YEAR_AHEAD_TREND = TrendConfig(interval_width=0.7, yearly_order=10)
# Budget forecast up to a fixed date.
BUDGET_TREND = TrendConfig(interval_width=0.95, yearly_order=10, changepoint_prior=0.11)
# A straight line with its noise band.
LINE_TREND = TrendConfig(n_changepoints=0, weekly_order=0)
# Stiffer trend, tried as an alternative.
STIFF_TREND = TrendConfig(n_changepoints=10, changepoint_prior=0.01, yearly_order=10)


@dataclass(frozen=True)
class SpendConfig:
    """Parameters of the data-model cost report."""

    since: date = LOG_SINCE
    database: str = LOG_DATABASE
    excluded_query_types: tuple[str, ...] = LOG_EXCLUDED_QUERY_TYPES
    excluded_warehouse: str = LOG_EXCLUDED_WAREHOUSE
    label_pattern: str = MODEL_LABEL_PATTERN
    key_pattern: str = MODEL_KEY_PATTERN
    rates: dict[str, int] = field(default_factory=lambda: dict(WAREHOUSE_CREDITS_PER_HOUR))
    default_rate: int = DEFAULT_CREDITS_PER_HOUR
    money_per_credit: float = MONEY_PER_CREDIT


@dataclass(frozen=True)
class ModelSettings:
    """Classifier parameters of the model comparison."""

    logistic_iterations: int = 100
    logistic_c: float = 1.0
    trees: int = 100
    tree_depth: int = 30  # Spark's limit; trees otherwise grow until leaves are pure
    neighbours: int = 5
    svm_c: float = 1.0
    svm_features: int = 256  # landmarks at most; 0 trains a linear classifier on the plain features
    svm_candidates: int = 4096  # rows among which landmarks are chosen
    svm_tolerance: float = 1e-4  # kernel error at which no more landmarks are taken
    svm_iterations: int = 100
    boosting_rounds: int = 100
    boosting_depth: int = 6
    boosting_step: float = 0.3
    parallelism: int = 8
    seed: int = FOLD_SEED
