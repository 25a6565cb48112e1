"""Intermediate results that several branches read, kept in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    A local session without that setting, as in tests, gets a temporary folder once.  A
    cluster without it is an error: a machine's own folder is not visible to the others.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        master = sc.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="metricwatch-checkpoint-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder and return the written rows.

    The rows outlive lost executors and every branch reads the same values.  Set
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` to have the files removed with
    the frame; ``bench.py`` and the tests do.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a folder below the shared one that nothing has written to yet."""
    return f"{shared_folder(spark)}/tables/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    For large intermediates: compressed, and later branches read only the columns they use.
    The folder name starts with ``label``, so a finished run's tables are easy to find and drop.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete ``written`` tables that no later step reads, and let Spark drop finished plans' shuffle files.

    Shuffle files go when the driver's collector finds their plans unused, which a busy driver
    may put off until the disks are full; so it is asked here.
    """
    for df in tables:
        sc = df.sparkSession.sparkContext
        root = f"{shared_folder(df.sparkSession)}/tables/".split(":", 1)[-1].lstrip("/")
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            if root in folder:
                path = sc._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        sc._jvm.System.gc()
