"""Places for intermediate tables that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in that of ``spark.checkpoint.dir``; where
    neither that nor a checkpoint folder is set, in a temporary one if all runs
    on one machine, else that is an error."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not given:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="koine-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(given)
    return f"{given.rstrip('/')}/koine-{sc.applicationId}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, a table of many rows, as a side of a join that is not broadcast.
    Spark judges by the bytes of files, and ids in them are compressed to a
    tenth and less of what the driver has to hold."""
    return df.hint("merge")


def clear(spark: SparkSession) -> None:
    """Remove all tables this application has written; results not yet read go with them."""
    remove(spark, shared_dir(spark))


def remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
