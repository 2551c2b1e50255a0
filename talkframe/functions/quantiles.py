"""Exact linear-interpolated quantiles without gathering a group in one task.

Equal values are counted first (partial aggregates), so a value that fills a
third of the rows is one row.  The distinct values are range-partitioned on
(group, value): a hot group spans many partitions.  Each (partition, group)
segment gets the rows of the group before it and the group's total from a
window over the segment table, one row per segment; running counts inside the
segments then give every distinct value its interval of ranks, and the rows that
hold a wanted rank are kept.  One path for every size; no join on the group
alone and no driver job.

Linear interpolation between the two ranks matches numpy's default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkframe.session import cut_lineage, shuffle_parts


def exact_quantiles(df: DataFrame, value: str, probs, by=()) -> DataFrame:
    """Rows ``(*by, p, quantile)`` for each group and probability."""
    by = list(by)
    g = by + ["_grp"]  # ``_grp`` gives the ungrouped case a key too
    x = df.select(*by, F.lit(0).alias("_grp"), F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    counted = x.groupBy(*g, "_x").agg(F.count(F.lit(1)).alias("_c"))
    n = shuffle_parts(df.sparkSession)
    # partition ids are pinned: both branches below must see the same ones
    s = cut_lineage(counted.repartitionByRange(n, *g, "_x").withColumn("_pid", F.spark_partition_id()))
    group = Window.partitionBy(*g)
    before = group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    seg = s.groupBy("_pid", *g).agg(F.sum("_c").alias("_s"))
    seg = seg.select("_pid", *g, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"), F.sum("_s").over(group).alias("_n"))
    inside = Window.partitionBy("_pid", *g).orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    ranked = s.withColumn("_in", F.coalesce(F.sum("_c").over(inside), F.lit(0))).join(seg, ["_pid", *g])
    first = F.col("_off") + F.col("_in")  # ranks first .. first + _c - 1 hold this value
    pos = F.col("p") * (F.col("_n") - 1)
    holds = lambda r: (first <= r) & (r < first + F.col("_c"))
    hits = (ranked.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
            .withColumn("_low", holds(F.floor(pos))).withColumn("_high", holds(F.ceil(pos))).where("_low or _high"))
    out = hits.groupBy(*g, "p").agg(F.max(F.when(F.col("_low"), F.col("_x"))).alias("_a"),
                                    F.max(F.when(F.col("_high"), F.col("_x"))).alias("_b"),
                                    F.first(pos - F.floor(pos)).alias("_f"))
    return out.select(*by, "p", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("quantile"))


#: Consecutive whole numbers that make one row.
SPAN = 1024


def count_stats(df: DataFrame, value: str, by, probs=()) -> DataFrame:
    """Rows ``(*by, n, mean, std, min, max, q0, q1, ...)`` of whole numbers such as counts:
    population std, and a quantile (linear) for each of ``probs``.

    Equal values are counted first, ``SPAN`` neighbouring values make one row, and a window
    over those rows gives each the number of values before it; the row that holds a wanted
    rank looks it up.  The data is read once, nothing runs while the query is built, and no
    group is gathered in one row.  Sums are whole numbers up to the last division.
    Nulls are left out; a group without a value has no row.
    """
    by = list(by)
    x = df.select(*by, F.col(value).cast("bigint").alias("_x")).where("_x is not null")
    counted = x.groupBy(*by, F.floor(F.col("_x") / SPAN).cast("bigint").alias("_span"), "_x").agg(F.count(F.lit(1)).alias("_c"))
    d, c = F.col("_x").cast("decimal(19,0)"), F.col("_c").cast("decimal(19,0)")
    spans = counted.groupBy(*by, "_span").agg(
        F.sum("_c").alias("_s"), F.sum((d * c).cast("decimal(28,0)")).alias("_sum"), F.sum((d * d * c).cast("decimal(38,0)")).alias("_squares"),
        F.min("_x").alias("_min"), F.max("_x").alias("_max"), F.array_sort(F.collect_list(F.struct("_x", "_c"))).alias("_values"))
    group = Window.partitionBy(*by)
    before = F.sum("_s").over(group.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    placed = spans.withColumn("_off", F.coalesce(before, F.lit(0))).withColumn("_n", F.sum("_s").over(group))
    at = lambda p, end: f"CAST({end}({float(p)!r}D * (_n - 1)) AS BIGINT)"

    def value_at(rank: str):
        """The value of that rank if this row holds it, else null."""
        found = f"""aggregate(_values, named_struct('first', _off, 'x', CAST(NULL AS BIGINT)), (a, v) -> named_struct(
            'first', a.first + v._c, 'x', IF({rank} >= a.first AND {rank} < a.first + v._c, v._x, a.x)), a -> a.x)"""
        return F.max(F.expr(f"CASE WHEN {rank} >= _off AND {rank} < _off + _s THEN {found} END"))

    ranks = [f(i) for i, p in enumerate(probs) for f in (
        lambda i, p=p: value_at(at(p, "floor")).alias(f"_a{i}"), lambda i, p=p: value_at(at(p, "ceil")).alias(f"_b{i}"))]
    g = placed.groupBy(*by).agg(F.max("_n").alias("n"), F.sum("_sum").cast("decimal(19,0)").alias("_t"), F.sum("_squares").alias("_q"),
                                F.min("_min").alias("min"), F.max("_max").alias("max"), *ranks)
    m = F.col("n").cast("decimal(19,0)")
    spread = (m * F.col("_q") - F.col("_t") * F.col("_t")).cast("double")
    pos = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    return g.select(*by, "n", (F.col("_t").cast("double") / F.col("n")).alias("mean"), (F.sqrt(spread) / F.col("n")).alias("std"), "min", "max",
                    *[(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (q - F.floor(q))).cast("double").alias(f"q{i}")
                      for i, q in enumerate(pos)])
