from metricwatch.functions.scalars import (  # noqa: F401
    above_floor,
    compute_hours,
    email_domain,
    first_match,
    hash_percent,
    hash_uniform,
    model_name,
    month_start,
    nice_bytes,
    not_spider,
    ratio_or_zero,
    server_key,
    warehouse_rate,
)
