"""Agreement between two labelers.

Input: ``pairs(session_id, idx, a, b)`` — labeler 1 and 2 on the same item,
aligned by position (inner join = truncation to the shorter sequence when
positions are dense).  Category grids are built from the given category list
(a fixed, tiny literal table), never by a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkframe.operators.labels import label_number


def align(l1: DataFrame, l2: DataFrame, key=("corpus", "session_id"), idx: str = "label_idx") -> DataFrame:
    """Position alignment of two label sequences, truncating to the shorter."""
    a = l1.select(*key, F.col(idx).alias("idx"), F.col("label").alias("a"))
    b = l2.select(*key, F.col(idx).alias("idx"), F.col("label").alias("b"))
    return a.join(b, [*key, "idx"], "inner")


def _grid(spark, categories, two=False):
    if two:
        rows = [(x, y) for x in categories for y in categories]
        return spark.createDataFrame(rows, "a string, b string")
    return spark.createDataFrame([(x,) for x in categories], "label string")


def agreement_summary(pairs: DataFrame) -> DataFrame:
    """A28 + A29: n, agreements, disagreements, accuracy, Cohen's kappa (null if pe = 1).

    Everything comes from the (k×k-row) confusion counts: marginals are summed
    per label from one exploded pass, so no join is needed.
    """
    counts = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    agree = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(F.lit(0))
    long = counts.select(F.inline(F.array(
        F.struct(F.col("a").alias("label"), F.col("n").alias("na"), F.lit(0).cast("bigint").alias("nb"), agree.alias("ag")),
        F.struct(F.col("b").alias("label"), F.lit(0).cast("bigint").alias("na"), F.col("n").alias("nb"),
                 F.lit(0).cast("bigint").alias("ag")))))
    per = long.groupBy("label").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum("ag").alias("ag"))
    g = per.agg(F.coalesce(F.sum("na"), F.lit(0)).alias("n"), F.coalesce(F.sum("ag"), F.lit(0)).alias("agree"),
                F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("pe_num"))
    po = F.col("agree") / F.nullif("n", F.lit(0))
    pe = F.col("pe_num") / F.nullif(F.col("n") * F.col("n"), F.lit(0))
    return g.select(F.col("n").cast("bigint").alias("n_samples"), F.col("agree").cast("bigint").alias("n_agreements"),
                    (F.col("n") - F.col("agree")).cast("bigint").alias("n_disagreements"),
                    F.coalesce(po, F.lit(0.0)).alias("accuracy"),
                    ((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def confusion_matrix(pairs: DataFrame, categories) -> DataFrame:
    """rows = labeler 1, columns = labeler 2, zero cells included."""
    spark = pairs.sparkSession
    counts = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    grid = _grid(spark, categories, two=True)
    full = grid.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return full.groupBy(F.col("a").alias("true_label")).pivot("b", list(categories)).agg(F.first("n"))


def class_agreement(pairs: DataFrame, categories) -> DataFrame:
    """Agreement rate among items labeler 1 put in each class (null when absent)."""
    g = pairs.groupBy(F.col("a").alias("label")).agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"))
    return _grid(pairs.sparkSession, categories).join(g, "label", "left")


def classification_report(pairs: DataFrame, categories) -> DataFrame:
    """Precision, recall, F1, support per class; accuracy, macro and weighted
    averages (zero_division = 0).

    One pass over the pairs: everything follows from their (a, b) counts, which
    are a few rows and are exploded to one row for each side and class."""
    counts = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    same = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(zero)
    sides = F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("support"), zero.alias("pred"), same.alias("tp")),
                    F.struct(F.col("b").alias("label"), zero.alias("support"), F.col("n").alias("pred"), zero.alias("tp")))
    j = (_grid(pairs.sparkSession, categories).join(counts.select(F.inline(sides)), "label", "left").groupBy("label")
         .agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("tp", "support", "pred")]))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    per = j.select("label", "tp", share(F.col("tp"), F.col("pred")).alias("precision"),
                   share(F.col("tp"), F.col("support")).alias("recall"), "support")
    p, r = F.col("precision"), F.col("recall")
    per = per.withColumn("f1", F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)))
    scores = ("precision", "recall", "f1")
    everything = Window.partitionBy()  # over one row for each class
    total = F.sum("support").over(everything)
    accuracy = share(F.sum("tp").over(everything), total)
    rows = per.select(
        F.struct("label", *scores, "support").alias("own"),
        F.struct(F.lit("accuracy").alias("label"), *[accuracy.alias(c) for c in scores], total.alias("support")).alias("acc"),
        F.struct(F.lit("macro avg").alias("label"), *[F.avg(c).over(everything).alias(c) for c in scores], total.alias("support")).alias("macro"),
        F.struct(F.lit("weighted avg").alias("label"),
                 *[share(F.sum(F.col(c) * F.col("support")).over(everything), total).alias(c) for c in scores],
                 total.alias("support")).alias("weighted"))
    return rows.select(F.inline(F.array("own", "acc", "macro", "weighted"))).distinct()


def agreement_by_position(pairs: DataFrame) -> DataFrame:
    """Agree / total per position and the mean of the per-position rates
    (a window over the positions, one row each)."""
    g = pairs.groupBy("idx").agg(F.count_if(F.col("a") == F.col("b")).alias("agree"), F.count(F.lit(1)).alias("total"))
    g = g.withColumn("rate", F.col("agree") / F.col("total"))
    return g.withColumn("mean_rate", F.avg("rate").over(Window.partitionBy()))


def agreement_by_conversation(pairs: DataFrame, sessions: DataFrame, key=("corpus", "session_id")) -> DataFrame:
    """Every conversation of ``sessions``; without an aligned pair n and accuracy are 0."""
    same = F.col("a") == F.col("b")
    return sessions.join(pairs, list(key), "left").groupBy(*key).agg(
        F.count("idx").alias("n"), F.count_if(same).alias("agreements"),
        F.coalesce(F.avg(same.cast("double")), F.lit(0.0)).alias("accuracy"))


def label_distribution(pairs: DataFrame, categories, names=("labeler_1", "labeler_2")) -> DataFrame:
    """Label counts per labeler incl. zero counts."""
    long = pairs.select(F.inline(F.array(F.struct(F.lit(names[0]).alias("labeler"), F.col("a").alias("label")),
                                         F.struct(F.lit(names[1]).alias("labeler"), F.col("b").alias("label")))))
    c = long.groupBy("labeler", "label").agg(F.count(F.lit(1)).alias("count"))
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(n, x) for n in names for x in categories], "labeler string, label string")
    return grid.join(c, ["labeler", "label"], "left").select("labeler", "label",
                                                             F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def disagreements(pairs: DataFrame, n: int = 20, parts: int = 64) -> DataFrame:
    """First ``n`` disagreements by (session, position) and the total count.

    One pass over the pairs: each of ``parts`` parts gives its first ``n`` and its
    count, and the last step sees ``parts * n`` rows at most."""
    keys = ["corpus", "session_id", "idx"]
    d = pairs.where(F.col("a") != F.col("b")).withColumn("_part", F.pmod(F.xxhash64(*keys[:2]), F.lit(parts)))
    own = Window.partitionBy("_part")
    d = d.withColumn("_r", F.row_number().over(own.orderBy(*keys))).withColumn("_n", F.count(F.lit(1)).over(own)).where(F.col("_r") <= n)
    few = Window.partitionBy()
    total = F.sum(F.when(F.col("_r") == 1, F.col("_n"))).over(few)
    d = d.withColumn("total_disagreements", total).withColumn("_r", F.row_number().over(few.orderBy(*keys)))
    return d.where(F.col("_r") <= n).drop("_part", "_r", "_n")


def progression_comparison(pairs: DataFrame, max_positions: int = 15) -> DataFrame:
    """Numeric labels (F→0) of both labelers per position, disagreement flag."""
    return pairs.where(F.col("idx") < max_positions).select(
        "corpus", "session_id", "idx", label_number(F.col("a"), True).alias("labeler_1"),
        label_number(F.col("b"), True).alias("labeler_2"), (F.col("a") != F.col("b")).alias("disagree"))
