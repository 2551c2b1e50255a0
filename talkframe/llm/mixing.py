"""Mixing sources to target weights (DataFrame functions only).

Every document gets a hash-random key from its id; the order of the keys is the
random order of its source.  The key space is cut into ``2 ** BUCKET_BITS``
ranges: a range of a source is sorted on its own, sums of the ranges before it
are prefix sums over one row for each range, and both add up to the words that
precede a document.  A source takes whole epochs and, of one more epoch, the
documents up to the word at which its budget is spent exactly.

Targets: the sources, by code point with null last, weigh ``weights`` in turn
and share ``share`` of all words; a target stops at ``cap`` times its source's
words and the excess goes to the others by weight until none is above.  That
is the level at which sum(min(cap * size, level * weight)) meets the total;
sources sorted by cap * size / weight give it in one pass over one row for
each source.

Skew: a source may hold any share of the rows, since its rows are dealt by
(source, range); the sums are pre-aggregated.

Cases: null or empty texts have size 0 and take 0; a null source is a source
of its own, the last; a null id has the key of the empty string; rows with
equal id and size are interchangeable.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from talkframe.llm.tables import stored

BUCKET_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"


def hash_key(key: str) -> Column:
    """60 random bits of an id as a long (the first 15 hex digits of its MD5)."""
    digits = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint")


def sized(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Narrow rows: id, source, size in words, random key and its range."""
    rows = docs.select(F.col(key).alias("id"), F.col(source).alias("source"),
                       F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
                       hash_key(key).alias("key"))
    return rows.withColumn("range", F.shiftright("key", 60 - BUCKET_BITS).cast("int"))


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.0, cap: int = 3) -> DataFrame:
    """(source, source_size, target) of each source."""
    # one row for each source; the windows below run over those rows only
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = (per.withColumn("i", F.row_number().over(by_name) - 1)
              .withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int")))
              .withColumn("most", F.col("source_size") * float(cap)))
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("most") / F.col("w"), "i")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    levels = (ranked.withColumn("level", left / weight).withColumn("place", F.row_number().over(by_level))
              .withColumn("fits", F.col("level") <= F.col("most") / F.col("w")))
    level = F.coalesce(F.min_by("level", F.when(F.col("fits"), F.col("place"))).over(everything), F.lit(0.0))
    # min_by skips nothing by itself: where no source fits (no words at all) the level is that of nobody
    level = F.when(F.max("fits").over(everything), level).otherwise(F.lit(0.0))
    return levels.select("source", "source_size", F.least("most", level * F.col("w")).alias("target"))


def planned(sizes: DataFrame, **how) -> DataFrame:
    """Targets with whole epochs and the words left for one more epoch."""
    words = F.round("target").cast("bigint")
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size")).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return (targets(sizes, **how).withColumn("epochs", whole)
            .withColumn("rest", words - F.col("epochs") * F.col("source_size")))


def _same_source(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def taken(sizes: DataFrame, **how) -> DataFrame:
    """``sizes`` plus source_size, target and ``taken``, the words that the mix takes."""
    plan = planned(sizes, **how)
    sums = sizes.groupBy("source", "range").agg(F.sum("size").alias("here"))
    by_range = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sums.withColumn("offset", F.coalesce(F.sum("here").over(by_range), F.lit(0)))
               .join(plan.withColumnRenamed("source", "_s"), _same_source("source", "_s"))
               .select(F.col("source").alias("_s"), F.col("range").alias("_r"), "offset", "source_size", "target", "epochs", "rest"))
    inside = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = sizes.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = ordered.join(offsets, _same_source("source", "_s") & (F.col("range") == F.col("_r")))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("offset") - F.col("before")))
    return joined.withColumn("taken", F.col("epochs") * F.col("size") + part).drop("_s", "_r")


def cuts(sizes: DataFrame, **how) -> DataFrame:
    """For each source its epochs and the key up to which one more epoch goes (-1: none)."""
    part = F.col("taken") - F.col("epochs") * F.col("size")
    return (taken(sizes, **how).groupBy("source")
            .agg(F.first("epochs").alias("epochs"), F.coalesce(F.max(F.when(part > 0, F.col("key"))), F.lit(-1)).alias("cut")))


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The rows of the mix: each document as often as it is taken, whole texts.

    A source overshoots its budget by less than the document that the cut falls
    into.  Texts are not shuffled: what decides is one row for each source.
    Documents without words are never taken.
    """
    sizes = stored(sized(docs, key, source, text), "mix-sizes")
    plan = stored(cuts(sizes, **how), "mix-cuts").toDF("_s", "_epochs", "_cut")
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    of = dict(zip(docs.columns, names))
    rows = inner.join(plan, F.col(of[source]).eqNullSafe(F.col("_s")))
    copies = (F.col("_epochs") + F.when(hash_key(of[key]) <= F.col("_cut"), 1).otherwise(0)).cast("int")
    has_words = F.coalesce(F.regexp_like(F.col(of[text]), F.lit(WORD)), F.lit(False))
    rows = rows.where(has_words).withColumn("_n", copies).where("_n > 0")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return rows.select(*[F.col(n).alias(c) for c, n in of.items()])
