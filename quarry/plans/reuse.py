"""Results that several branches of a plan read, and where they are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def reuse(df: DataFrame) -> DataFrame:
    """df computed once: written where the session has a shared folder for that (checkpoint() would compute it twice), else persisted."""
    return written(df, "reuse") if _shared(df.sparkSession) else df.persist()


def _shared(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that the driver and all executors share, under spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    root = _shared(spark)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}"
    return f"{root.rstrip('/')}/quarry/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to a scratch folder and read back."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as there are cores, where it is read in fewer; larger tables and shuffled rows stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString() or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
