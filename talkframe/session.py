"""Spark session helpers.

The library never creates a session behind the caller's back except through
``get_spark`` (tests, bench).  Lineage cuts go to the shared folder named by
``spark.checkpoint.dir``; only when that is unset (local tests) do we pick a
scratch folder ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "talkframe", extra: dict | None = None) -> SparkSession:
    """Return the active session or build a local one (tests / bench only)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("TALKFRAME_MASTER", "local[8]"))
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder; set a scratch one only when unset (tests)."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a Spark Connect session: the server owns the folder
        return current
    if not current:
        current = sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="talkframe-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
        sc.setCheckpointDir(current)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def written(df, label: str):
    """Write ``df`` to the shared folder and read it back: as ``cut_lineage``, but
    later steps read only the columns that they use."""
    path = f"{checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_parts(spark) -> int:
    """Partitions to deal into: the cluster's initial number of adaptive
    partitions where it is set, else the number of shuffle partitions."""
    initial = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return int(initial or spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark) -> None:
    """End Arrow batches at 4 MB: with whole sessions as rows, Spark's 64 MB (and the
    copies made of them) are most of what a Python worker holds."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def by_session(df, *keys):
    """Deal rows by their session keys before per-row text work, so that the
    windows and aggregates on those keys that follow need no shuffle of their
    own and a table of few row groups is not read by as few tasks."""
    return df.repartition(shuffle_parts(df.sparkSession), *keys)


_SHIPPED: set = set()


def ship_package(spark) -> None:
    """Make ``talkframe`` importable in Python workers (pandas UDFs, mapInPandas
    hooks) when it is not installed on the executors: zip the package once per
    SparkContext and register it with ``addPyFile`` (Spark serves the file to
    every executor and puts it on the workers' path)."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: install the package on the server instead
        return
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile

    import talkframe
    root = os.path.dirname(os.path.dirname(os.path.abspath(talkframe.__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="talkframe-pkg-", dir="/tmp"), "talkframe.zip")
    with zipfile.ZipFile(out, "w") as z:
        for base, _, files in os.walk(os.path.join(root, "talkframe")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
