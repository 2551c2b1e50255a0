"""Emotion scores (A19-A22, U3), re-aimed as a lexicon z-score.

For a text with n lexicon-scored words of which k carry emotion e, and p_e the
share of distinct lexicon words tagged e:
``z = (k - n p_e) / sqrt(n p_e (1 - p_e))`` (binomial null model), 0 when n = 0
or p_e ∈ {0, 1}; stripped texts shorter than 2 characters score 0.  k and n are
additive, so pooled buckets (A22) sum counts and never concatenate text.

The lexicon is joined, not unrolled: it is pre-aggregated to one row per word
(its emotion set); Spark broadcasts it or shuffles by its measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.functions.text import py_strip, strict_words
from talkframe.lexicons import EMOTIONS
from talkframe.operators.turns import SESSION


# The order in which the radar and bucket reports show emotions.
DISPLAY_ORDER = ["joy", "trust", "fear", "surprise", "sadness", "disgust", "anger", "anticipation"]


def display_rank(emotion: Column, place: Column) -> Column:
    """Place of an emotion in the reports: the known ones in their order, others after them by ``place``."""
    known = F.array(*[F.lit(e) for e in DISPLAY_ORDER])
    rank = F.array_position(known, emotion)
    return F.when(rank > 0, rank - 1).otherwise(place + len(DISPLAY_ORDER)).cast("int")


def lexicon_table(spark, pairs) -> DataFrame:
    return spark.createDataFrame(list(pairs), "word string, emotion string")


def _z(k, n, p):
    return F.when((n > 0) & (p > 0) & (p < 1), (k - n * p) / F.sqrt(n * p * (1 - p))).otherwise(F.lit(0.0))


def emotion_priors(lexicon: DataFrame, emotions=EMOTIONS) -> Column:
    """A struct of p_e per emotion: the share of distinct lexicon words tagged e, as
    one scalar subquery (nothing runs while a query is being built)."""
    d = lexicon.distinct()
    return d.agg(F.struct(*[F.coalesce(F.count_if(F.col("emotion") == e) / F.nullif(F.count_distinct("word"), F.lit(0)),
                                       F.lit(0.0)).alias(e) for e in emotions]).alias("p")).scalar()


def message_emotion_counts(msgs: DataFrame, lexicon: DataFrame, emotions=EMOTIONS,
                           keys=("corpus", "session_id", "idx")) -> DataFrame:
    """Per message: n scored words and k per emotion (stripped texts < 2 chars → 0).

    One pass: messages without a scored word keep their row through the outer
    explode and the left join.  Whether the lexicon is broadcast is Spark's
    choice by its measured size."""
    per_word = lexicon.distinct().groupBy("word").agg(F.collect_set("emotion").alias("emos"))
    scored = F.when(F.length(py_strip("text")) >= 2, strict_words("text"))
    toks = msgs.select(*keys, F.explode_outer(scored).alias("word"))
    hit = toks.join(per_word, "word", "left")
    return hit.groupBy(*keys).agg(F.count("emos").alias("n"),
                                  *[F.count_if(F.array_contains("emos", e)).alias(f"k_{e}") for e in emotions])


def with_z(counts: DataFrame, priors: Column, emotions=EMOTIONS) -> DataFrame:
    known = counts.withColumn("_p", priors)  # a column, so that the subquery is read once
    return known.select("*", *[_z(F.col(f"k_{e}"), F.col("n"), F.col(f"_p.{e}")).alias(e) for e in emotions]).drop("_p")


def patient_sequence(turns: DataFrame) -> DataFrame:
    """Patient messages (role compared lower-cased, empties kept) with a 0-based index."""
    p = turns.where(F.lower("role") == "assistant").withColumn("text", F.coalesce("text", F.lit("")))
    w = Window.partitionBy(*SESSION).orderBy("turn")
    return p.select(*SESSION, "turn", "text", (F.row_number().over(w) - 1).cast("bigint").alias("idx"))


def turn_emotions(turns: DataFrame, lexicon: DataFrame, emotions=EMOTIONS) -> DataFrame:
    """The eight z-scores per patient turn."""
    pri = emotion_priors(lexicon, emotions)
    counts = message_emotion_counts(patient_sequence(turns), lexicon, emotions)
    return with_z(counts, pri, emotions).drop("n", *[f"k_{e}" for e in emotions])


def global_intensity(z: DataFrame, emotions=EMOTIONS) -> DataFrame:
    """Per corpus, the mean over sessions of each session's mean z."""
    s = z.groupBy(*SESSION).agg(*[F.avg(e).alias(e) for e in emotions])
    return s.groupBy("corpus").agg(*[F.avg(e).alias(e) for e in emotions])


def emotion_timeline(z: DataFrame, left: str = "real", right: str = "synthetic", max_turns: int = 15,
                     emotions=EMOTIONS) -> DataFrame:
    """Per-turn mean over sessions after truncating each session pair to the
    shorter sequence (J6), first ``max_turns`` turns; long format."""
    l = z.where(F.col("corpus") == left).select("session_id", "idx")
    r = z.where(F.col("corpus") == right).select("session_id", "idx")
    both = l.join(r, ["session_id", "idx"], "inner")
    kept = z.join(both, ["session_id", "idx"], "left_semi").where(F.col("idx") < max_turns)
    long = kept.select("corpus", "idx", F.inline(F.array(*[F.struct(F.lit(e).alias("emotion"), F.col(e).alias("z"))
                                                          for e in emotions])))
    return long.groupBy("corpus", "emotion", "idx").agg(F.avg("z").alias("mean_z"))


def bucket_scores(turns: DataFrame, lexicon: DataFrame, size: int = 3, max_turns: int = 15,
                  emotions=EMOTIONS, significance: float = 1.96) -> DataFrame:
    """Pooled counts per (corpus, 3-turn bucket) over all sessions → z,
    |z|, significance, fixed emotion order."""
    seq = patient_sequence(turns).where(F.col("idx") < max_turns)
    pri = emotion_priors(lexicon, emotions)
    counts = message_emotion_counts(seq, lexicon, emotions)
    pooled = counts.groupBy("corpus", F.floor(F.col("idx") / size).cast("bigint").alias("bucket")).agg(
        F.sum("n").alias("n"), *[F.sum(f"k_{e}").alias(f"k_{e}") for e in emotions])
    zed = with_z(pooled, pri, emotions)
    long = zed.select("corpus", "bucket", F.inline(F.array(*[
        F.struct(F.lit(i).alias("_place"), F.lit(e).alias("emotion"), F.col(e).alias("z")) for i, e in enumerate(emotions)])))
    rank = display_rank(F.col("emotion"), F.col("_place"))
    return long.select("corpus", "bucket", rank.alias("emotion_order"), "emotion", "z", F.abs("z").alias("abs_z"),
                       (F.abs("z") >= significance).alias("significant"))
