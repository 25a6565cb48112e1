"""Table lookup by logical name, and result writers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricwatch.schemas import SOURCE_CONTRACTS, conform
from metricwatch.sources.standins import DRIVER_TABLES, STAND_IN_SQL


class Sources:
    """Logical table name -> DataFrame.

    ``locations`` maps a logical name to a catalog table (``db.schema.table``) or to a
    path; a path is recognised by a slash and read with ``format``.
    """

    def __init__(self, spark: SparkSession, locations: Mapping[str, str], format: str = "parquet"):
        self.spark = spark
        self.locations = dict(locations)
        self.format = format
        self._opened: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """The table under its contract.  Opened once, so files are listed once per instance."""
        if name not in self._opened:
            self._opened[name] = self._open(name)
        return self._opened[name]

    def _open(self, name: str) -> DataFrame:
        if name not in self.locations:
            raise KeyError(f"no location for table {name!r}")
        where = self.locations[name]
        if "/" in where:
            df = self.spark.read.format(self.format).load(where)
        else:
            df = self.spark.table(where)
        return conform(df, name) if name in SOURCE_CONTRACTS else df

    def query(self, sql: str, *names: str) -> DataFrame:
        """Run a query over logical tables, written as ``{name}`` in the text; lazy."""
        return self.spark.sql(sql, **{name: self.table(name) for name in names})


class StandInSources(Sources):
    """The logical tables derived from the TPC-H-like test tables in one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, {t: f"{sf_dir}/{t}.parquet" for t in DRIVER_TABLES})

    def _open(self, name: str) -> DataFrame:
        if name in self.locations:
            return super()._open(name)
        text = STAND_IN_SQL[name]
        used = [t for t in DRIVER_TABLES if "{" + t + "}" in text]
        df = self.query(text, *used) if used else self.spark.sql(text)
        return conform(df, name)


def write_by_series(df: DataFrame, path: str) -> None:
    """One folder per series, so a reader of one series opens only its files."""
    (
        df.repartition("series")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("series")
        .parquet(path)
    )


def write_alerts(alerts: DataFrame, path: str, as_of) -> None:
    """Store one run's alert rows under its date; a rerun replaces that date only."""
    (
        alerts.withColumn("as_of", F.lit(as_of).cast("date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("as_of")
        .parquet(path)
    )
