"""Cut lineage through storage every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`. Where it is unset, a session on one machine gets a
    temporary folder and a cluster uses its warehouse, which all executors share. Plans are the same everywhere."""
    global _own_folder
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        _own_folder = _own_folder or tempfile.mkdtemp(prefix="autostat-")
        return _own_folder
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_autostat"


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/autostat-{kind}-{uuid.uuid4().hex}"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a stored table when the session's JVM ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` once and go on from the stored table, so several tables can start from it and
    lost executors cost no recomputation. (`checkpoint()` would run the plan twice.)"""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
