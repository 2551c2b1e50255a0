"""Connected components of links that Spark holds (no driver, no task sees them all).

Alternating large-star and small-star steps: every node's neighbours are hooked
onto the smallest of them until each component is a star around its smallest
node.  The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.llm.tables import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over ``u > v`` edges."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(low, "u")
        out = (joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(low.select("u", F.col("m").alias("v"))))
    out = out.where("u <> v")
    return out if large else out.distinct()  # the small star that follows takes repeats out


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, roots included; ``links`` has ``a`` and ``b``."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if not mark.n or (mark.n, mark.s) == last:
            break
        last = (mark.n, mark.s)
        edges = stored(_star(_star(edges, True), False), "edges")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
