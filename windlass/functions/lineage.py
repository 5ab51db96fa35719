"""Cutting lineage so that lost executors cost a reread."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; one is made only in single-machine mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="windlass-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, so that a lost
    executor costs a reread and never a rerun of what came before. Partitions stay as they are."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_by(df: DataFrame, parts: int, key: str) -> DataFrame:
    """``df`` dealt to ``parts`` partitions by ``key`` and cut there. What is grouped or joined by
    ``key`` later is not shuffled again: Spark knows how the cut rows lie, which it doesn't of a
    plan that is still to be adapted, so that is off for this one job."""
    spark, name = df.sparkSession, "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return cut(df.repartition(parts, key))
    finally:
        spark.conf.set(name, before)


def landed(df: DataFrame, group: int = 128 << 20) -> DataFrame:
    """The same as a Parquet table, in row groups of about ``group`` bytes (a task that reads large
    values holds a group of them at once, and so does one that writes them). Its size is read from the files, so the planner's estimate,
    which a checkpoint hands on and every join multiplies, starts anew: for loops over joins."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", group).option("parquet.block.size.row.check.min", 4).option("parquet.page.size.row.check.min", 4).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that no frame in use reads any more, in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
