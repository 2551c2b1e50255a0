"""Lexical diversity strategies.

Input: patient messages with empties kept (P2b grain, role ``assistant``).
Words are the strict preprocess (P7) of each message; a session's aggregate
text is the ordered concatenation of its messages' words (identical to
preprocessing the space-joined text).  Output rows follow the reference's
result table: ``session_id, speaker_type, analysis_type, turn_index,
token_count, mtld, meets_threshold``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkframe.functions.mtld import mtld_udf, prefix_mtld_udf
from talkframe.functions.quantiles import exact_quantiles
from talkframe.functions.text import strict_words
from talkframe.lexicons import STRICT_DISFLUENCIES
from talkframe.operators.turns import SESSION
from talkframe.session import cut_lineage, small_batches

SPEAKER = {"real": "Real", "synthetic": "Synthetic"}


def message_words(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """P7 per patient message (empties kept) with its 1-based index among all
    patient messages of the session."""
    small_batches(turns.sparkSession)
    m = turns.where(F.col("role") == role)
    w = Window.partitionBy(*SESSION).orderBy("turn")
    return m.select(*SESSION, "turn", strict_words("text", STRICT_DISFLUENCIES).alias("words"),
                    F.row_number().over(w).cast("bigint").alias("turn_index"))


def _speaker(c="corpus"):
    return F.when(F.col(c) == "real", "Real").when(F.col(c) == "synthetic", "Synthetic").otherwise(F.col(c))


def _row(df, analysis, turn_index, words_col, min_tokens, meets=None):
    n = F.size(words_col).cast("bigint")
    return df.select(
        "session_id", _speaker().alias("speaker_type"), F.lit(analysis).alias("analysis_type"),
        turn_index.cast("bigint").alias("turn_index"), n.alias("token_count"),
        mtld_udf(words_col).alias("mtld"),
        (meets if meets is not None else n >= min_tokens).alias("meets_threshold"))


def session_words(msgs: DataFrame) -> DataFrame:
    """Ordered concatenation of a session's message words (conversation-bounded)."""
    g = msgs.groupBy(*SESSION).agg(F.array_sort(F.collect_list(F.struct("turn", "words"))).alias("_p"))
    return g.select(*SESSION, F.flatten(F.transform("_p", lambda p: p["words"])).alias("words"))


def raw_strategy(sw: DataFrame, min_tokens: int = 100) -> DataFrame:
    """MTLD of each session's whole patient text."""
    return _row(sw, "Raw", F.lit(-1), F.col("words"), min_tokens)


def matched_strategy(sw: DataFrame, left: str = "real", right: str = "synthetic", min_tokens: int = 100) -> DataFrame:
    """Both sides cut to the shorter length, only when both are non-empty."""
    l = sw.where(F.col("corpus") == left).select("session_id", F.col("words").alias("lw"))
    r = sw.where(F.col("corpus") == right).select("session_id", F.col("words").alias("rw"))
    j = l.join(r, "session_id").where((F.size("lw") > 0) & (F.size("rw") > 0))
    j = j.withColumn("target", F.least(F.size("lw"), F.size("rw")))
    both = j.select("session_id", "target", F.inline(F.array(
        F.struct(F.lit(left).alias("corpus"), F.slice("lw", 1, F.col("target")).alias("words")),
        F.struct(F.lit(right).alias("corpus"), F.slice("rw", 1, F.col("target")).alias("words")))))
    return _row(both, "Matched", F.lit(-1), F.col("words"), min_tokens, meets=F.col("target") >= min_tokens)


def cumulative_strategy(msgs: DataFrame, min_tokens: int = 100) -> DataFrame:
    """After each non-empty message, MTLD of all words so far.

    A session's words are gathered once and every prefix is scored on the way
    (``functions/mtld.py``): rows and memory grow with the words, not their square."""
    g = msgs.where(F.size("words") > 0).groupBy(*SESSION).agg(F.array_sort(F.collect_list(F.struct("turn", "turn_index", "words"))).alias("_p"))
    scored = F.arrays_zip(F.col("_p.turn_index").alias("turn_index"), prefix_mtld_udf(F.col("_p.words")).alias("_s"))
    rows = g.select(*SESSION, F.explode(scored).alias("_r"))
    n = F.col("_r._s.token_count")
    return rows.select("session_id", _speaker().alias("speaker_type"), F.lit("Cumulative").alias("analysis_type"),
                       F.col("_r.turn_index").cast("bigint").alias("turn_index"), n.alias("token_count"), F.col("_r._s.mtld").alias("mtld"),
                       (n >= min_tokens).alias("meets_threshold"))


def turn_strategy(msgs: DataFrame, min_tokens: int = 100) -> DataFrame:
    """MTLD per non-empty message."""
    return _row(msgs.where(F.size("words") > 0), "Turn-Level", F.col("turn_index"), F.col("words"), min_tokens)


def lexical_diversity(turns: DataFrame, variant_turns: DataFrame | None = None, left: str = "real",
                      right: str = "synthetic", turn_min: int | None = None, turn_max: int | None = None,
                      min_tokens: int = 100) -> DataFrame:
    """All four strategies for sessions present in both corpora (J1), optionally
    restricted to a patient-message count range on both sides (P11).  Turn-level
    rows of the ``right`` corpus come only from ``variant_turns`` (the turn
    variant), as in the reference."""
    msgs = message_words(turns)
    counts = msgs.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("n"))
    keep = counts.groupBy("session_id").agg(
        F.max(F.when(F.col("corpus") == left, F.col("n"))).alias("nl"),
        F.max(F.when(F.col("corpus") == right, F.col("n"))).alias("nr"))
    cond = F.col("nl").isNotNull() & F.col("nr").isNotNull()
    if turn_min is not None:
        cond = cond & (F.col("nl") >= turn_min) & (F.col("nr") >= turn_min)
    if turn_max is not None:
        cond = cond & (F.col("nl") <= turn_max) & (F.col("nr") <= turn_max)
    # sessions lacking any patient message on one side still pair (empty text);
    # derive the pairing from all turns, not only patient messages
    sessions = turns.groupBy("session_id").agg(
        F.max((F.col("corpus") == left).cast("int")).alias("_l"), F.max((F.col("corpus") == right).cast("int")).alias("_r"))
    sessions = sessions.where((F.col("_l") == 1) & (F.col("_r") == 1)).select("session_id")
    if turn_min is not None or turn_max is not None:
        sessions = sessions.join(keep.where(cond).select("session_id"), "session_id", "left_semi")
    msgs = msgs.join(sessions, "session_id", "left_semi").where(F.col("corpus").isin(left, right))
    all_sessions = sessions.select("session_id", F.explode(F.array(F.lit(left), F.lit(right))).alias("corpus"))
    sw = all_sessions.join(session_words(msgs), SESSION, "left").select(
        *SESSION, F.coalesce("words", F.array().cast("array<string>")).alias("words"))
    parts = [raw_strategy(sw, min_tokens), matched_strategy(sw, left, right, min_tokens),
             cumulative_strategy(msgs, min_tokens), turn_strategy(msgs.where(F.col("corpus") == left), min_tokens)]
    if variant_turns is not None:
        vm = message_words(variant_turns).join(sessions, "session_id", "left_semi")
        parts.append(turn_strategy(vm.withColumn("corpus", F.lit(right)), min_tokens))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def box_summary(results: DataFrame) -> DataFrame:
    """Quartiles (linear), whiskers inside 1.5 IQR, session count per
    strategy × speaker; null MTLD values are left out."""
    # the scores come out of Python: written once, read three times; the nulls are left
    # out afterwards, as a filter on a score before would have it computed twice
    r = cut_lineage(results.select("analysis_type", "speaker_type", "session_id", "mtld")).where(F.col("mtld").isNotNull())
    keys = ["analysis_type", "speaker_type"]
    qs = exact_quantiles(r, "mtld", [0.25, 0.5, 0.75], by=keys)
    qw = qs.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(n)
                                 for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    sessions = r.groupBy(*keys).agg(F.count_distinct("session_id").alias("sessions"))
    q = sessions.join(qw, keys).select(*keys, "sessions", "q1", "median", "q3")
    # q has one row per (strategy, speaker): at most 4 × 2 rows
    j = r.join(F.broadcast(q), ["analysis_type", "speaker_type"])
    iqr = F.col("q3") - F.col("q1")
    return j.groupBy("analysis_type", "speaker_type", "sessions", "q1", "median", "q3").agg(
        F.min(F.when(F.col("mtld") >= F.col("q1") - 1.5 * iqr, F.col("mtld"))).alias("whisker_low"),
        F.max(F.when(F.col("mtld") <= F.col("q3") + 1.5 * iqr, F.col("mtld"))).alias("whisker_high"))


def cumulative_means(results: DataFrame) -> DataFrame:
    """Mean cumulative MTLD per turn index and speaker."""
    c = results.where(F.col("analysis_type") == "Cumulative")
    return c.groupBy("speaker_type", "turn_index").agg(F.avg("mtld").alias("mean_mtld"),
                                                        F.count(F.lit(1)).alias("sessions"))


def length_points(results: DataFrame) -> DataFrame:
    """MTLD vs token count of the Raw strategy, with the threshold flag."""
    return results.where(F.col("analysis_type") == "Raw").select(
        "session_id", "speaker_type", "token_count", "mtld", "meets_threshold")
