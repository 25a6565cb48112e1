"""Daily metrics, anomaly bands, cost attribution and retention analysis as Spark DataFrame jobs."""
