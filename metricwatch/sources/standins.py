"""The analytics tables as views over the TPC-H-like test tables.

Table names stand in braces.  The same text runs on Spark and on the SQL checker.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from metricwatch.config import SERIES_SPECS, SeriesSpec, SpendConfig

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

EVENTS_AS_OF = date(2024, 1, 31)
ORDERS_AS_OF = date(2001, 8, 2)

STAND_IN_SQL: dict[str, str] = {
    # NULL key (line 7), quoted and bare names, build suffix, NULL and excluded warehouses.
    "query_history": """
SELECT l_shipdate AS start_time, l_shipdate AS end_time,
  CASE WHEN l_linenumber = 7 THEN 'call housekeeping()'
       ELSE concat('create table ', CASE WHEN l_linenumber % 2 = 0 THEN '"ANALYTICS"' ELSE 'analytics' END,
                   '.', lower(p_type), '.', replace(p_name, ' ', '_'),
                   CASE WHEN l_linenumber <= 2 THEN '__dbt_tmp' ELSE '' END, ' as select 1') END AS query_text,
  CASE l_returnflag WHEN 'A' THEN 'CREATE_TABLE_AS_SELECT' WHEN 'N' THEN 'MERGE' ELSE 'SELECT' END AS query_type,
  CASE l_suppkey % 6 WHEN 0 THEN 'TRANSFORM_L' WHEN 1 THEN 'TRANSFORM_XS' WHEN 2 THEN 'ANALYST_XS'
       WHEN 3 THEN 'REPORTING_M' WHEN 4 THEN 'STITCH' ELSE NULL END AS warehouse_name,
  CASE WHEN l_linestatus = 'O' THEN 'ANALYTICS' ELSE 'RAW' END AS database_name,
  l_tax AS credits_used_cloud_services, CAST(floor(l_extendedprice * 60) AS BIGINT) AS total_elapsed_time,
  CAST(l_quantity AS BIGINT) AS rows_produced, CAST(l_quantity AS BIGINT) % 3 AS rows_unloaded,
  CAST(l_quantity AS BIGINT) % 5 AS rows_inserted, CAST(l_quantity AS BIGINT) % 7 AS rows_updated,
  CAST(l_quantity AS BIGINT) % 11 AS rows_deleted, l_partkey * 1000003 AS bytes_scanned
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    # The join key stands in one of three columns, padded with blanks.
    "telemetry": """
SELECT event_id AS id, ts AS event_ts, event_id % 7 AS user_actual_id,
  CASE WHEN event_id % 3 = 0 THEN concat(' ', CAST(user_id AS STRING), ' ') END AS user_id,
  CASE WHEN event_id % 3 = 1 THEN CAST(user_id AS STRING) END AS context_server,
  CAST(user_id AS STRING) AS context_traits_server, event_type AS source_relation
FROM {events}""",
    "usage_events": "SELECT ts AS event_ts, value AS active_users FROM {events}",
    # No snapshot for every 13th workspace.
    "server_daily_details_ext": """
SELECT CAST(user_id AS STRING) AS server_id, CAST(ts AS DATE) AS day,
  CAST(sum(count(*)) OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS BIGINT) AS registered_users,
  CAST(count(CASE WHEN event_type = 'click' THEN 1 END) + 2 AS BIGINT) AS enabled_plugins,
  CAST(count(CASE WHEN event_type = 'error' THEN 1 END) AS BIGINT) AS disabled_plugins
FROM {events} WHERE user_id % 13 <> 0 GROUP BY user_id, CAST(ts AS DATE)""",
    "server_daily_details": """
SELECT DISTINCT CAST(user_id AS STRING) AS server_id, CAST(ts AS DATE) AS day FROM {events}""",
    "server_security_details": """
SELECT CAST(user_id AS STRING) AS server_id, CAST(ts AS DATE) AS day FROM {events} WHERE event_type = 'error'""",
    "server_server_details": """
SELECT CAST(user_id AS STRING) AS server_id, CAST(ts AS DATE) AS day FROM {events} WHERE event_type <> 'view'""",
    # NULL installation for every 11th workspace.
    "server_fact": """
SELECT CAST(user_id AS STRING) AS server_id, CAST(min(ts) AS DATE) AS first_active_date,
  CAST(max(ts) AS DATE) AS last_telemetry_date,
  count(DISTINCT CAST(ts AS DATE)) AS days_active, 30 - count(DISTINCT CAST(ts AS DATE)) AS days_inactive,
  CASE WHEN user_id % 11 = 0 THEN NULL ELSE concat('i', CAST(user_id AS STRING)) END AS installation_id,
  count(DISTINCT event_id % 7) AS max_active_user_count,
  count(*) AS max_registered_users,
  count(CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 1 END) AS max_registered_deactivated_users,
  count(CASE WHEN event_type = 'view' THEN 1 END) AS posts_events_alltime,
  count(CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 1 END) AS invite_members_alltime,
  count(CASE WHEN event_type = 'signup' AND event_id % 2 = 1 THEN 1 END) AS signup_email_events_alltime,
  count(CASE WHEN event_type = 'error' THEN 1 END) AS admin_events_alltime,
  count(CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN 1 END) AS tutorial_events_alltime,
  count(CASE WHEN event_type = 'signup' THEN 1 END) AS signup_events_alltime,
  count(CASE WHEN event_type = 'click' AND event_id % 3 = 1 THEN 1 END) AS slash_commands,
  count(CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN 1 END) AS direct_message_channels,
  count(CASE WHEN event_type = 'view' AND event_id % 5 = 1 THEN 1 END) AS public_channels,
  count(CASE WHEN event_type = 'view' AND event_id % 5 = 2 THEN 1 END) AS private_channels,
  count(CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 1 END) AS incoming_webhooks,
  count(CASE WHEN event_type = 'purchase' AND event_id % 3 = 1 THEN 1 END) AS outgoing_webhooks,
  count(CASE WHEN value > 100 THEN 1 END) AS bot_accounts,
  count(CASE WHEN value < 5 THEN 1 END) AS guest_accounts,
  count(DISTINCT event_type) AS teams,
  count(CASE WHEN event_type = 'click' THEN 1 END) AS mobile_events_alltime,
  count(*) AS events_alltime
FROM {events} GROUP BY user_id""",
    # Retired licences, missing licences, two live licences for some (fan-out).
    "license_server_fact": """
SELECT CAST(c_custkey AS STRING) AS server_id, concat('u@', lower(c_mktsegment), '.example') AS license_email,
  CASE WHEN c_custkey % 5 = 0 THEN DATE '2024-01-15' ELSE DATE '2024-06-30' END AS license_retired_date
FROM {customer} WHERE c_custkey % 4 <> 0
UNION ALL
SELECT CAST(c_custkey AS STRING), 'second@other.example', DATE '2024-07-31' FROM {customer} WHERE c_custkey % 10 = 1""",
    # Some listed with a NULL reason: they stay.
    "excludable_servers": """
SELECT CAST(s_suppkey AS STRING) AS server_id, CASE WHEN s_suppkey % 2 = 0 THEN 'internal' END AS reason
FROM {supplier} WHERE s_suppkey % 5 = 0""",
    # A padded name and a plain one, taken from the segments in use.
    "public_domains": """
SELECT DISTINCT CASE WHEN c_mktsegment = 'BUILDING' THEN concat(' ', lower(c_mktsegment), '.example ')
                     ELSE concat(lower(c_mktsegment), '.example') END AS domain_name
FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""",
    "incident_events": """
SELECT event_id AS id, CAST(user_id AS STRING) AS user_id FROM {events}
WHERE event_type = 'error' AND user_id % 3 = 0""",
    "plugin_events": """
SELECT event_id AS id, CAST(user_id AS STRING) AS user_id FROM {events}
WHERE event_type = 'purchase' AND user_id % 2 = 0""",
    "daily_website_traffic": """
SELECT ts AS event_ts, user_id AS anonymous_id, event_type AS context_useragent FROM {events}""",
    # A NULL device, a spider, one agent (purchase) missing.
    "user_agent_registry": """
SELECT DISTINCT event_type AS context_useragent,
  CASE event_type WHEN 'click' THEN 'Desktop' WHEN 'error' THEN 'Spider' WHEN 'signup' THEN 'Mobile' END AS device_type
FROM {events} WHERE event_type <> 'purchase'""",
    "warehouse_cost": "SELECT o_orderdate AS usage_day, o_totalprice AS dollars_spent FROM {orders}",
    "nps_user_daily_score": """
SELECT CAST(ts AS DATE) AS day, value AS score, CASE WHEN user_id % 2 = 0 THEN 'user' ELSE 'admin' END AS user_role
FROM {events}""",
    "invoices": "SELECT o_orderkey AS invoice_id, o_orderdate AS created_at FROM {orders}",
    "invoices_version": "SELECT o_orderkey AS invoice_id, o_orderdate AS updated_at FROM {orders}",
    "log_entries": "SELECT CAST(CAST(ts AS DATE) AS STRING) AS logdate, '03:04:05' AS logtime FROM {events}",
    "server_telemetry": "SELECT ts AS event_ts FROM {events}",
    "marketing_pages": "SELECT ts AS event_ts FROM {events} WHERE event_type = 'view'",
    "portal_pages": "SELECT ts AS event_ts FROM {events} WHERE event_type = 'click'",
    "nps_feedback": "SELECT ts AS event_ts FROM {events} WHERE event_type = 'signup'",
}

_SOURCE_PREDICATES = {
    "mobile_events": "source_relation IN ('click', 'view')",
    "webapp_events_rudder": "source_relation IN ('purchase')",
    "webapp_events_segment": "source_relation IN ('signup')",
    "portal_events": "source_relation IN ('error')",
}
_ORDER_BASED = {"warehouse_spend", "invoice_updates", "invoice_creations"}


def _stand_in(spec: SeriesSpec) -> SeriesSpec:
    if spec.name in _ORDER_BASED:
        spec = replace(spec, lower=date(1995, 2, 1))
    return replace(spec, where=_SOURCE_PREDICATES.get(spec.name, spec.where))


# The series of the configuration, with predicates and first days that fit the test tables.
STAND_IN_SERIES = tuple(_stand_in(s) for s in SERIES_SPECS)
STAND_IN_SPEND = SpendConfig(since=date(1996, 1, 1))


def as_of_for(spec: SeriesSpec) -> date:
    return ORDERS_AS_OF if spec.name in _ORDER_BASED else EVENTS_AS_OF


def oracle_view(name: str) -> str:
    """Text of a stand-in with plain table names, for the SQL checker."""
    return STAND_IN_SQL[name].format(**{t: t for t in DRIVER_TABLES})
