"""Tables kept between steps, and the driver's input tables."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from talkframe.session import checkpoint_dir, ship_package


#: Rows of an Arrow batch: with long texts the default of 10,000 fills an executor.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Settings of the session that the operators want, and the package on its workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    ship_package(spark)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that nothing refers to any more.

    They go when the driver collects its garbage, which on an idle driver may be
    long after the disks of the executors are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that read the table, not
    the steps that made it.  Parquet keeps it compressed and lets later steps
    read only the columns that they use.
    """
    spark = df.sparkSession
    release(spark)
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df
