"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only a local master without that setting gets a folder of its own; anywhere else a machine-local
    folder would not be seen by the other executors, so the missing setting is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint now: later reads come from shared files and survive a lost executor."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def through_table(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared folder and read back. The folder goes when the application ends."""
    spark = df.sparkSession
    home = f"{scratch_dir(spark)}/millrace-{spark.sparkContext.applicationId}"
    path = f"{home}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(home)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by `through_table` that nothing reads any more, and let go of finished shuffles."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Have the context cleaner remove the files of shuffles and checkpoints that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()
