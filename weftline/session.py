"""Session helpers: table access and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset.

    On a cluster the setting must name storage that every executor reaches. The
    fallback serves tests on one machine.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = "file://" + os.path.join(tempfile.gettempdir(), f"weftline-{os.getuid()}")
    return where.rstrip("/")


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back, cutting its lineage.

    The files survive the loss of executors. They lie under one folder per
    application, so that a later clean-up can remove them together.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Remove all that this application wrote with ``materialise``; lazy results that read it can't be read any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small table over all cores, before work that is heavy for each row.

    Tables that are read in at least as many splits as there are cores stay as they are: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
