"""Tables written once to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session takes a folder of its own and a cluster has none to take."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("touchline.scratch.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="touchline-")
        spark.conf.set("touchline.scratch.dir", folder)
    return folder.rstrip("/")


_PATHS: dict = {}
_TABLES: dict = {}
#: How often stored tables have been removed: what is remembered from before may be gone.
removed = 0


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, computed once: plans that use it several times read it instead, and lost executors recompute nothing."""
    path = f"{shared_folder(df.sparkSession)}/touchline-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _PATHS.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by_run(df: DataFrame, label: str, buckets: int) -> DataFrame:
    """df, stored with all rows of a run in one of so many buckets: plans within a run or a frame read it without a shuffle.

    df comes dealt by run_id into as many parts, else each of its tasks writes a file per bucket.
    """
    spark, name = df.sparkSession, f"touchline_{label}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    # A join by run and frame then takes both sides' buckets by run as they are.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    df.write.bucketBy(buckets, "run_id").option("path", path).saveAsTable(name, format="parquet")
    _PATHS.setdefault(spark.sparkContext.applicationId, []).append(path)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(name)
    return spark.table(name)


def release(spark: SparkSession) -> int:
    """Removes what this application has stored, and tells how many tables: for when no plan that reads them is left."""
    global removed
    removed += 1
    paths = _PATHS.pop(spark.sparkContext.applicationId, [])
    for name in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)
