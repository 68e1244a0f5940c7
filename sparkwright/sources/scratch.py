"""Intermediate tables that every executor can read again after a failure."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Since Spark 4.1: what a finished query has shuffled goes with it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir; a temporary one only where it is unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage.

    Losing an executor afterwards costs nothing: the files are not on its disk. What the write shuffled is freed at its end.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    if before is not None:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Have Spark's cleaner drop, on all executors, the shuffles and broadcasts of plans that nothing refers to any more.

    The cleaner acts when the driver's JVM collects its garbage, which a driver that only plans may not do for long. The last
    query's plan is referred to until another one has run, so a small one does.
    """
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the tables that ``materialize`` wrote and ``df`` reads, once nothing needs them; other files are left alone."""
    context = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.search(r"/tables/[0-9a-f]{32}$", folder):
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint for iterative plans.

    Spark's cleaner drops its files once it is unused if the session sets spark.cleaner.referenceTracking.cleanCheckpoints.
    Columns are named anew, as plans that join a checkpoint with what came from it need different attributes.
    """
    shared_folder(df.sparkSession)
    saved = df.checkpoint(eager=True)
    return saved.select(*(saved[c].alias(c) for c in saved.columns))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the tables of a data folder; the path goes to Spark's reader only, so any store works."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
