"""Workspace feature table for retention analysis.

Event tables meet the eligible workspaces before they are deduplicated, so events of other
servers are dropped where they are read or at the first shuffle.  Joined rows are then shuffled on
all that they are deduplicated by: the join's partitioning by workspace is not kept, so a hot
workspace's values are spread over the tasks, and AQE may split it in the join.  What is reduced
to a row per workspace combines before it shuffles.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricwatch.config import (
    MIN_DAYS_OBSERVED,
    MIN_REGISTERED_USERS,
    PREINSTALLED_PLUGINS,
    WORKSPACE_COUNTERS,
)
from metricwatch.functions import above_floor, email_domain, ratio_or_zero, server_key


def workspaces(facts: DataFrame, excluded: DataFrame, licences: DataFrame, as_of: date) -> DataFrame:
    """Eligible workspaces: not excluded, installed, at least 3 users and 3 observed days.

    A workspace listed with a NULL reason stays, so this is a left join and a filter, not
    an anti join.  Several live licences repeat the workspace.
    """
    days = F.col("s.days_active") + F.col("s.days_inactive")
    live = licences.where(F.col("license_retired_date") >= F.lit(as_of))
    return (
        facts.where(
            F.col("installation_id").isNotNull()
            & (F.col("max_registered_users") >= MIN_REGISTERED_USERS)
            & (F.col("days_active") + F.col("days_inactive") >= MIN_DAYS_OBSERVED)
        )
        .alias("s")
        .join(excluded.alias("es"), F.col("s.server_id") == F.col("es.server_id"), "left")
        .where(F.col("es.reason").isNull())
        .join(live.alias("l"), F.col("s.server_id") == F.col("l.server_id"), "left")
        .select(
            "s.server_id",
            "s.first_active_date",
            F.col("s.max_active_user_count").alias("max_daily_active_user_count"),
            "s.last_telemetry_date",
            (F.col("s.days_active").cast("double") / days.cast("double")).alias("pct_active"),
            days.alias("total_days"),
            *[f"s.{c}" for c in WORKSPACE_COUNTERS],
            email_domain("l.license_email").alias("email_domain"),
        )
    )


def days_to_threshold(details: DataFrame, base: DataFrame, threshold: int = MIN_REGISTERED_USERS) -> DataFrame:
    """Days from an eligible workspace's first snapshot to its first with enough registered users."""
    reached = F.min(F.when(F.col("registered_users") >= threshold, F.col("day")))
    # Reduced before the join: a workspace has one row a task then, however many snapshots.
    days = details.groupBy("server_id").agg(F.datediff(reached, F.min("day")).cast("bigint").alias("days_to_registered_users"))
    return _of(base, days)


def post_users(events: DataFrame, base: DataFrame, min_users: int | None = None) -> DataFrame:
    """Distinct users and first- and second-day events per user, per workspace with events.

    ``min_users`` optionally drops workspaces with fewer distinct users.
    """
    out = _post_user_counts(events, base)
    return out if min_users is None else out.where(F.col("post_users") >= min_users)


def _of(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of eligible workspaces only, before anything is shuffled for them."""
    return rows.join(base.select("server_id"), "server_id", "left_semi")


def _post_user_counts(events: DataFrame, base: DataFrame) -> DataFrame:
    """Counts for every workspace in ``base`` with events; others drop out at the first join.

    ``events_per_user_second_day`` divides distinct events by distinct events, as the
    established metric does, so it is 0 or 1; the ``_fixed`` column divides by users.
    """
    first_days = base.select("server_id", "first_active_date").distinct()
    keyed = events.select(
        server_key("user_id", "context_server", "context_traits_server").alias("server_id"),
        F.to_date("event_ts").alias("day"),
        F.col("user_actual_id").cast("string").alias("user"),
        F.col("id").cast("string").alias("event"),
    )
    def on(day):
        return F.coalesce((F.col("day") == day).cast("int"), F.lit(0))

    flagged = keyed.join(first_days, "server_id").select(
        "server_id", on(F.col("first_active_date")).alias("d1"), on(F.date_add("first_active_date", 1)).alias("d2"), "user", "event"
    )
    # One value per row, deduplicated once for all four counts: every event brings its
    # user, only those of the first two days bring their id.
    on_early_day = (F.col("d1") + F.col("d2")) > 0
    values = flagged.select(
        "server_id",
        "d1",
        "d2",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("u").alias("kind"), F.col("user").alias("value")),
                    F.struct(F.lit("e").alias("kind"), F.when(on_early_day, F.col("event")).alias("value")),
                ),
                lambda v: v["value"].isNotNull() | (v["kind"] == "u"),
            )
        ).alias("v"),
    )
    spread = values.select("server_id", "d1", "d2", "v.*").repartition("server_id", "kind", "value")
    distinct = spread.groupBy("server_id", "kind", "value").agg(F.max("d1").alias("d1"), F.max("d2").alias("d2"))
    is_user = (F.col("kind") == "u") & F.col("value").isNotNull()
    is_event = F.col("kind") == "e"

    def count(cond):
        return F.count(F.when(cond, F.lit(1)))

    counted = distinct.groupBy("server_id").agg(
        count(is_user).alias("post_users"),
        count(is_event & (F.col("d1") == 1)).alias("events_1"),
        count(is_user & (F.col("d1") == 1)).alias("users_1"),
        count(is_event & (F.col("d2") == 1)).alias("events_2"),
        count(is_user & (F.col("d2") == 1)).alias("users_2"),
    )
    return counted.select(
        "server_id",
        "post_users",
        ratio_or_zero("events_1", "users_1").alias("events_per_user_first_day"),
        ratio_or_zero("events_2", "events_2").alias("events_per_user_second_day"),
        ratio_or_zero("events_2", "users_2").alias("events_per_user_second_day_fixed"),
    )


def usage(events: DataFrame, base: DataFrame, prefix: str, flag: str) -> DataFrame:
    """Distinct events and a usage flag per eligible workspace that has any."""
    own = _of(base, events.select(F.col("user_id").alias("server_id"), "id"))
    counted = own.repartition("server_id", "id").distinct().groupBy("server_id").agg(F.count("id").alias(f"{prefix}_events"))
    return counted.withColumn(flag, F.when(F.col(f"{prefix}_events") > 0, 1).otherwise(0))


def retention_features(
    base: DataFrame,
    details: DataFrame,
    telemetry: DataFrame,
    incidents: DataFrame,
    plugins: DataFrame,
    public_domains: DataFrame,
) -> DataFrame:
    """One row per eligible workspace with a snapshot on its last day (more where joins fan out)."""
    posts = _post_user_counts(telemetry, base)
    threshold = days_to_threshold(details, base)
    incident = usage(incidents, base, "incident_mgmt", "used_incident_mgmt")
    plugin = usage(plugins, base, "plugin", "used_plugins")
    snapshot = details.select(
        "server_id",
        F.col("day").alias("last_telemetry_date"),
        above_floor("enabled_plugins", PREINSTALLED_PLUGINS).alias("enabled_plugins"),
        "disabled_plugins",
    )
    domains = public_domains.select(F.trim("domain_name").alias("public_domain"))
    zero = F.lit(0)
    return (
        base.join(snapshot, ["server_id", "last_telemetry_date"])
        .join(posts, "server_id", "left")
        .join(threshold, "server_id", "left")
        .join(incident, "server_id", "left")
        .join(plugin, "server_id", "left")
        .join(domains, F.trim("email_domain") == F.col("public_domain"), "left")
        .select(
            F.coalesce("post_users", zero).alias("total_active_users"),
            F.coalesce("events_per_user_first_day", F.lit(0.0)).alias("events_per_user_first_day"),
            F.coalesce("events_per_user_second_day", F.lit(0.0)).alias("events_per_user_second_day"),
            F.coalesce("events_per_user_second_day_fixed", F.lit(0.0)).alias(
                "events_per_user_second_day_fixed"
            ),
            *base.columns,
            "enabled_plugins",
            "disabled_plugins",
            F.coalesce("incident_mgmt_events", zero).alias("incident_mgmt_events"),
            F.coalesce("used_incident_mgmt", zero).alias("used_incident_mgmt"),
            F.coalesce("plugin_events", zero).alias("plugin_events"),
            F.coalesce("used_plugins", zero).alias("used_plugins"),
            F.coalesce("days_to_registered_users", zero).alias("days_to_registered_users"),
            F.when(F.col("public_domain").isNotNull(), 0).otherwise(1).alias("private_domain"),
        )
    )
