"""The objects of large JSON files, read by many tasks.

The multi-line JSON reader gives a file to one task.  Here a file is read as text cut
at every ``}``, which Spark's text source splits by byte ranges like any line format,
and the structure is found by a scan over the pieces:

* whether a piece starts inside a string is the parity of the quotes before it
  (escaped characters taken out first; a ``}`` follows no odd backslash);
* the depth at its start is the sum of the brackets before it that lie outside
  strings.  Within a split both answers (split starts outside or inside a string) are
  scanned, and one row per split carries quotes and depths over to the next;
* an object ends at a ``}`` outside strings that closes back to the depth of the list
  (1 in a file that begins with ``[``, else 0: single objects, or one after another).

Pieces of an object then meet by its number in the file.  A file is never held by one
task, however it is formatted; an object is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SPLIT = ["file_path", "_split"]


def _pieces(spark: SparkSession, path) -> DataFrame:
    """(file_path, _split, _at, piece, size of the file) of the text between closing braces."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_split"),
        F.col("_metadata.file_size").alias("_size"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("piece"))


def _net(parts, outside: int):
    """Brackets opened less brackets closed in every second part between quotes."""
    text = F.array_join(F.filter(parts, lambda _, i: i % 2 == outside), "")
    return F.length(F.regexp_replace(text, r"[^\[{]", "")) - F.length(F.regexp_replace(text, r"[^\]]", ""))


def _scanned(pieces: DataFrame) -> DataFrame:
    """Pieces with what holds if their split starts outside (0) or inside (1) a string:
    quotes and bytes before them in the split, and the depth after them."""
    w = Window.partitionBy(*_SPLIT).orderBy("_at")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    parts = F.split(F.regexp_replace("piece", r"(?s)\\.", ""), '"')
    p = pieces.withColumn("_parts", parts).withColumn("_quotes", F.size("_parts") - 1)
    p = p.withColumn("_even", _net(F.col("_parts"), 0)).withColumn("_odd", _net(F.col("_parts"), 1)).drop("_parts")
    p = p.withColumn("_in", F.coalesce(F.sum("_quotes").over(before), F.lit(0)) % 2)
    for s in (0, 1):
        start = (F.col("_in") + s) % 2
        closed = F.when((start + F.col("_quotes")) % 2 == 0, 1).otherwise(0)  # the brace that ends the piece counts
        p = p.withColumn(f"_net{s}", F.when(start == 0, F.col("_even")).otherwise(F.col("_odd")) - closed).withColumn(f"_closes{s}", closed == 1)
    return p.select("*", F.sum("_net0").over(upto).alias("_depth0"), F.sum("_net1").over(upto).alias("_depth1"),
                    F.sum(F.octet_length("piece") + 1).over(upto).alias("_bytes"))


def _ends(pieces: DataFrame) -> DataFrame:
    """Pieces with ``_end``: whether an object of the list ends with them."""
    scanned = _scanned(pieces)
    per = scanned.groupBy(*_SPLIT).agg(F.sum("_quotes").alias("_q"), F.sum("_net0").alias("_n0"), F.sum("_net1").alias("_n1"),
                                       F.sum(F.octet_length("piece") + 1).alias("_b"), F.min_by("piece", "_at").alias("_first"))
    w = Window.partitionBy("file_path").orderBy("_split")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_inside", F.coalesce(F.sum("_q").over(before), F.lit(0)) % 2)
    per = per.withColumn("_net", F.when(F.col("_inside") == 0, F.col("_n0")).otherwise(F.col("_n1")))
    start = F.regexp_replace(F.first("_first").over(w.rowsBetween(Window.unboundedPreceding, 0)), r"^[\s\x{FEFF}]+", "")
    carry = per.select(*_SPLIT, "_inside", F.coalesce(F.sum("_net").over(before), F.lit(0)).alias("_from"),
                       F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_skip"), F.when(start.startswith("["), 1).otherwise(0).alias("_list"))
    p = scanned.join(carry, _SPLIT)
    inside = F.col("_inside") == 1
    depth = F.col("_from") + F.when(inside, F.col("_depth1")).otherwise(F.col("_depth0"))
    braced = F.col("_skip") + F.col("_bytes") <= F.col("_size")  # only the last piece of a file may lack its brace
    end = F.when(inside, F.col("_closes1")).otherwise(F.col("_closes0")) & (depth == F.col("_list")) & braced
    return p.select(*_SPLIT, "_at", "piece", end.alias("_end"))


def read_json_objects(spark: SparkSession, path) -> DataFrame:
    """(file_path, position, json): the text of every object of the files' lists, by its
    number from 0.  Other values between the objects are skipped and not counted; what
    is cut off at the end of a file is no object."""
    p = _ends(_pieces(spark, path))
    w = Window.partitionBy(*_SPLIT).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("_own", F.coalesce(F.sum(F.col("_end").cast("bigint")).over(w), F.lit(0)))
    per = p.groupBy(*_SPLIT).agg(F.sum(F.col("_end").cast("bigint")).alias("_n"))
    earlier = Window.partitionBy("file_path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*_SPLIT, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_done"))
    p = p.join(per, _SPLIT).withColumn("position", F.col("_done") + F.col("_own"))
    g = p.groupBy("file_path", "position").agg(F.bool_or("_end").alias("_whole"),
                                               F.array_sort(F.collect_list(F.struct("_split", "_at", "piece"))).alias("_p"))
    text = F.concat(F.array_join(F.col("_p.piece"), "}"), F.lit("}"))
    return g.where("_whole").select("file_path", "position", F.regexp_replace(text, r"^[^{]*", "").alias("json"))
