"""Column contracts of the source tables and of the frames between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricwatch.config import WORKSPACE_COUNTERS

_TYPES = {
    "string": T.StringType(),
    "date": T.DateType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    # Timestamps keep the zone handling of the source.
    "timestamp": None,
}

SOURCE_CONTRACTS: dict[str, dict[str, str]] = {
    "warehouse_cost": {"usage_day": "timestamp", "dollars_spent": "double"},
    "usage_events": {"event_ts": "timestamp", "active_users": "double"},
    "invoices_version": {"updated_at": "timestamp"},
    "invoices": {"created_at": "timestamp"},
    "server_daily_details_ext": {
        "server_id": "string",
        "day": "date",
        "registered_users": "bigint",
        "enabled_plugins": "bigint",
        "disabled_plugins": "bigint",
    },
    "server_daily_details": {"day": "date"},
    "server_security_details": {"day": "date"},
    "server_server_details": {"day": "date"},
    "telemetry": {
        "id": "bigint",
        "event_ts": "timestamp",
        "source_relation": "string",
        "user_actual_id": "bigint",
        "user_id": "string",
        "context_server": "string",
        "context_traits_server": "string",
    },
    "daily_website_traffic": {
        "event_ts": "timestamp",
        "anonymous_id": "bigint",
        "context_useragent": "string",
    },
    "user_agent_registry": {"context_useragent": "string", "device_type": "string"},
    "nps_user_daily_score": {"day": "date", "score": "double", "user_role": "string"},
    "query_history": {
        "start_time": "timestamp",
        "end_time": "timestamp",
        "query_text": "string",
        "query_type": "string",
        "warehouse_name": "string",
        "database_name": "string",
        "credits_used_cloud_services": "double",
        "total_elapsed_time": "bigint",
        "rows_produced": "bigint",
        "rows_unloaded": "bigint",
        "rows_inserted": "bigint",
        "rows_updated": "bigint",
        "rows_deleted": "bigint",
        "bytes_scanned": "bigint",
    },
    "server_fact": {
        "server_id": "string",
        "installation_id": "string",
        "first_active_date": "date",
        "last_telemetry_date": "date",
        "days_active": "bigint",
        "days_inactive": "bigint",
        "max_active_user_count": "bigint",
        **{name: "bigint" for name in WORKSPACE_COUNTERS},
    },
    "excludable_servers": {"server_id": "string", "reason": "string"},
    "license_server_fact": {
        "server_id": "string",
        "license_email": "string",
        "license_retired_date": "date",
    },
    "incident_events": {"id": "bigint", "user_id": "string"},
    "plugin_events": {"id": "bigint", "user_id": "string"},
    "public_domains": {"domain_name": "string"},
    "log_entries": {"logdate": "string", "logtime": "string"},
    "server_telemetry": {"event_ts": "timestamp"},
    "marketing_pages": {"event_ts": "timestamp"},
    "portal_pages": {"event_ts": "timestamp"},
    "nps_feedback": {"event_ts": "timestamp"},
}

# Identifiers may be of any type; they are only compared and counted.
_ANY_TYPE = {"id", "user_actual_id", "anonymous_id"}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Keep the contract's columns, cast to the contract's types; fail early on a missing one."""
    contract = SOURCE_CONTRACTS[table]
    missing = sorted(set(contract) - set(df.columns))
    if missing:
        raise ValueError(f"table {table!r} lacks columns {missing}")
    out = []
    for name, type_name in contract.items():
        actual, wanted = df.schema[name].dataType, _TYPES[type_name]
        if wanted is None:
            if not isinstance(actual, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                raise TypeError(f"{table}.{name} is {actual.simpleString()}, not a timestamp")
            out.append(F.col(name))
        elif name in _ANY_TYPE or actual == wanted:
            out.append(F.col(name))
        else:
            out.append(F.col(name).cast(wanted).alias(name))
    return df.select(*out)
