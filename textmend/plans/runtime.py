"""Session helpers: shared scratch folder, written intermediate tables, table reading.

Intermediate results that are used twice are written as Parquet below the shared folder that the
session names in ``spark.checkpoint.dir``; that cuts lineage and survives the loss of executors.
Only where no such folder is configured (a local session, as in the tests) a temporary one is made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach; a temporary one only in a session without the setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    key = spark.sparkContext.applicationId
    if key not in _own_dirs:
        _own_dirs[key] = tempfile.mkdtemp(prefix="textmend-")
        spark.sparkContext.setCheckpointDir(_own_dirs[key])
        atexit.register(_remove, _own_dirs[key])
    return _own_dirs[key]


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def stage_dir(spark: SparkSession) -> str:
    """Where this application writes its intermediate tables."""
    return f"{shared_dir(spark)}/stage/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application; to be called when its results are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(stage_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows that cost much each, over all tasks: only where the scan has fewer tasks than there are cores, as a few small files
    have. Larger inputs are read as they lie, without a shuffle."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by name; columns are pruned by the caller's select."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
