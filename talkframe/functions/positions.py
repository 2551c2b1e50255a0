"""Row positions inside groups without sorting a whole group in one task.

``row_number() over (partition by g order by o)`` sends every row of a group to
one task; with one group holding a third of the data that task sorts a third of
the data.  Here the rows are range-partitioned on ``(g, o)`` (a hot group spans
many partitions), sorted within partitions, numbered with
``monotonically_increasing_id`` (consecutive inside a partition), and each
(partition, group) segment gets the count of the group's rows in earlier
partitions from a window over the segment table — one row per segment, so that
window is small even for the hottest group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkframe.session import cut_lineage, shuffle_parts


def positions(df: DataFrame, by, order, name: str = "idx", partitions: int | None = None) -> DataFrame:
    """``df`` plus a 0-based position ``name`` of each row within its ``by`` group
    in ``order`` (ties broken by the order columns given; make them unique)."""
    by, order = list(by), list(order)
    n = partitions or shuffle_parts(df.sparkSession)
    s = (df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order)
         .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    # partition ids and row ids are non-deterministic expressions: pin them once
    # (both branches below must see the same values, also after an executor loss)
    s = cut_lineage(s)
    seg = s.groupBy("_pid", *by).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    out = s.join(seg.select("_pid", *by, "_first", "_off"), ["_pid", *by])
    return out.withColumn(name, (F.col("_mid") - F.col("_first") + F.col("_off")).cast("bigint")).drop(
        "_pid", "_mid", "_first", "_off")
