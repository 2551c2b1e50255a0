"""Score series.

A37 (re-aimed): turn scores from a corpus bigram language model kept as
tables — ``bigram(w1, w2, c12)`` and ``context(w1, c1)`` — built from a training
corpus.  The distinct bigrams of the responses are scored once, by equi-joins of
counted rows; responses then meet that table once.  Its heavy hitters, bigrams with
more than a ``HEAVY``-th of all occurrences (so fewer than ``HEAVY`` of them), are
broadcast; the others are joined by a shuffle in which no key is hot.

A38-A41 summarise any ``scores(session_id, idx, score)`` table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkframe.functions.quantiles import exact_quantiles
from talkframe.functions.text import strict_words
from talkframe.operators.turns import SESSION
from talkframe.session import written

BOS = "<s>"


def message_tokens(turns: DataFrame) -> DataFrame:
    return turns.select(*SESSION, "turn", "role", strict_words("text").alias("toks"))


def _bigrams(toks, first):
    """Array of (w1, w2) structs with ``first`` as the context of the first token."""
    before = F.slice(F.concat(F.array(first), toks), 1, F.size(toks))
    return F.arrays_zip(before.alias("w1"), toks.alias("w2"))


#: A bigram with more than this part of all occurrences is a heavy hitter.
HEAVY = 4096


def train_bigram_model(train_turns: DataFrame):
    """Bigram and context counts over every message (``<s>`` starts a message)."""
    t = message_tokens(train_turns).where(F.size("toks") > 0)
    bg = t.select(F.inline(_bigrams(F.col("toks"), F.lit(BOS))))
    # the scorer, the contexts and the vocabulary read one shuffle of these counts
    bigram = bg.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c12"))
    context = bigram.groupBy("w1").agg(F.sum("c12").alias("c1"))
    # every training token is the w2 of exactly one bigram occurrence, so the
    # vocabulary comes from the (already aggregated) bigram table, not a re-scan
    vocab = bigram.agg(F.count_distinct("w2").alias("V"))
    return bigram, context, vocab


def score_responses(turns: DataFrame, model, max_patient_turns: int = 20, role: str = "assistant",
                    profiles: DataFrame | None = None) -> DataFrame:
    """Per patient turn (first ``max_patient_turns``) the add-one bigram
    NLL of the response given the last context word, and ppl = exp(nll).

    Only the response is scored (quirk Q5); the context is every earlier message
    and, when ``profiles(corpus, session_id, profile_text)`` is given, the profile
    before them — so the first response is conditioned on the profile's last word
    instead of ``<s>``."""
    bigram, context, vocab = model
    t = message_tokens(turns)
    w = Window.partitionBy(*SESSION).orderBy("turn")
    t = t.withColumn("_last", F.element_at(F.when(F.size("toks") > 0, F.col("toks")), -1))
    ctx = F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    if profiles is not None:
        pw = profiles.select(*SESSION, F.element_at(F.when(F.size(strict_words("profile_text")) > 0,
                                                           strict_words("profile_text")), -1).alias("_plast"))
        t = t.join(pw, SESSION, "left")
        ctx = F.coalesce(ctx, F.col("_plast"))
    t = t.withColumn("ctx_word", F.coalesce(ctx, F.lit(BOS)))
    t = t.withColumn("patient_idx", F.sum((F.col("role") == role).cast("int")).over(
        w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    r = t.where((F.col("role") == role) & (F.col("patient_idx") < max_patient_turns) & (F.size("toks") > 0))
    bg = r.select(*SESSION, F.col("patient_idx").cast("bigint").alias("patient_idx"),
                  F.inline(_bigrams(F.col("toks"), F.col("ctx_word"))))
    V = vocab.scalar()
    msg = ", ".join([*SESSION, "patient_idx"])
    # every distinct bigram is scored once and written: it is read as the few that
    # are heavy hitters and as the others
    counted = bg.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("k"))
    lp = F.ln((F.coalesce("c12", F.lit(0)) + 1) / (F.coalesce("c1", F.lit(0)) + V))
    scored = written(counted.join(bigram, ["w1", "w2"], "left").join(context, "w1", "left").select("w1", "w2", "k", lp.alias("lp")), "bigram-scores")
    sums = f"SELECT {msg}, count(*) AS n, sum(lp) AS s FROM"
    return turns.sparkSession.sql(f"""
        WITH often AS (SELECT w1, w2, lp AS hot FROM {{scored}} WHERE k * {HEAVY} > (SELECT sum(k) FROM {{scored}})),
        met AS (SELECT /*+ BROADCAST(often) */ * FROM {{bg}} LEFT JOIN often USING (w1, w2)),
        parts AS (
          {sums} (SELECT *, hot AS lp FROM met WHERE hot IS NOT NULL) GROUP BY {msg}
          UNION ALL
          {sums} (SELECT * FROM met JOIN {{scored}} USING (w1, w2) WHERE hot IS NULL) GROUP BY {msg})
        SELECT *, exp(nll) AS ppl FROM (SELECT {msg}, sum(n) AS n_bigrams, -sum(s) / sum(n) AS nll FROM parts GROUP BY {msg})""",
                                  bg=bg, scored=scored)


def score_summary(scores: DataFrame, all_sessions: DataFrame | None = None, key=("session_id",)) -> DataFrame:
    """Turn-level avg/min/max, conversation-level avg/min/max of the
    per-conversation means, average loss, counts; 0 when there is nothing.
    ``all_sessions`` (one row per conversation, ``key`` columns) counts
    conversations that produced no score."""
    key = list(key)
    loss = F.col("loss") if "loss" in scores.columns else F.lit(None).cast("double")
    per = scores.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("m"), F.sum("score").alias("s"),
                                   F.count("score").alias("k"), F.min("score").alias("lo"), F.max("score").alias("hi"),
                                   F.sum(loss).alias("ls"), F.count(loss).alias("lk"))
    if all_sessions is not None:
        per = all_sessions.select(*key).distinct().join(per, key, "left")
    t = per.agg(F.count(F.lit(1)).alias("num_conversations"), F.count("n").alias("num_conversations_processed"),
                F.coalesce(F.sum("n"), F.lit(0)).alias("num_turns"),
                F.avg("m").alias("conversation_avg"), F.min("m").alias("conversation_min"), F.max("m").alias("conversation_max"),
                (F.sum("s") / F.nullif(F.sum("k"), F.lit(0))).alias("turn_avg"), F.min("lo").alias("turn_min"),
                F.max("hi").alias("turn_max"), (F.sum("ls") / F.nullif(F.sum("lk"), F.lit(0))).alias("avg_loss"))
    return t.select(*t.columns[:3], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in t.columns[3:]])


def score_trend(scores: DataFrame, max_positions: int = 20) -> DataFrame:
    """Mean score per position (first ``max_positions``) and the overall
    mean/min/max of that trend."""
    t = scores.where(F.col("idx") < max_positions).groupBy("idx").agg(F.avg("score").alias("mean_score"),
                                                                       F.count(F.lit(1)).alias("n"))
    trend = Window.partitionBy()  # over one row for each position
    return t.select("idx", "mean_score", "n", F.avg("mean_score").over(trend).alias("trend_mean"),
                    F.min("mean_score").over(trend).alias("trend_min"), F.max("mean_score").over(trend).alias("trend_max"))


def clip_bounds(scores: DataFrame, low: float = 0.01, high: float = 0.95) -> DataFrame:
    """Exact linear percentiles (numpy default) of the score column, computed by
    distributed selection (no single task holds the column)."""
    return exact_quantiles(scores, "score", [low, high])


def clipped_distribution(scores: DataFrame, low: float = 0.01, high: float = 0.95, bins: int = 50):
    """Keep p_low ≤ x ≤ p_high and x > 0; summary and ``bins`` equal bins."""
    p = clip_bounds(scores, low, high)
    lo = p.where(F.col("p") == low).select("quantile").scalar()
    hi = p.where(F.col("p") == high).select("quantile").scalar()
    kept = scores.where((F.col("score") >= lo) & (F.col("score") <= hi) & (F.col("score") > 0))
    summary = kept.agg(F.count(F.lit(1)).alias("kept"), F.avg("score").alias("avg"), F.min("score").alias("min"),
                       F.max("score").alias("max")).select(lo.alias("p_low"), hi.alias("p_high"), "kept", "avg", "min", "max")
    from talkframe.operators.markers import density_histogram
    hist = density_histogram(kept, ["score"], bins=bins)
    return summary, hist


def flatten_nested(nested: DataFrame, col: str = "scores") -> DataFrame:
    """``(session_id, array<double>)`` → ``(session_id, idx, score)``."""
    return nested.select("session_id", F.posexplode(col).alias("idx", "score")).withColumn("idx", F.col("idx").cast("bigint"))


def nest_scores(scores: DataFrame) -> DataFrame:
    """S14 helper: per session the ordered score list (a session is one row)."""
    g = scores.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("idx", "score"))).alias("_s"))
    return g.select("session_id", F.transform("_s", lambda s: s["score"]).alias("scores"))
