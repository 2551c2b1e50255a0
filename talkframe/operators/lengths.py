"""Message-length statistics (A1, A2) and the per-turn corpus comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.functions.text import approx_tokens, word_count
from talkframe.operators.turns import SESSION, number_turns, patient_messages


def turn_lengths(turns: DataFrame, max_turns: int | None = None, by: str = "corpus") -> DataFrame:
    """A1/A2: per (``by``, patient turn) count, mean/population-std of words and
    ⌊chars/4⌋ tokens.  ``by`` can be any label column (J10 union label, psi...).

    One ``groupBy`` with partial aggregation: the hot key (turn 0 of a big
    corpus) is combined map-side before the shuffle.  Words and tokens are
    counted first, so the numbering moves no text.
    """
    keys = list(dict.fromkeys([*SESSION, by]))
    msgs = patient_messages(turns).select(*keys, "turn", word_count("text").alias("w"), approx_tokens("text").alias("t"))
    pt = number_turns(msgs, max_turns)
    return pt.groupBy(by, F.col("patient_idx").alias("turn")).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("w").alias("avg_words"), F.stddev_pop("w").alias("std_words"),
        F.avg("t").alias("avg_tokens"), F.stddev_pop("t").alias("std_tokens"))


def compare_turn_lengths(stats: DataFrame, left: str = "synthetic", right: str = "real",
                         by: str = "corpus") -> DataFrame:
    """Two corpora's per-turn stats side by side, in one aggregate by turn.

    Missing count → 0, missing mean → null, difference only when both exist
    (null arithmetic gives that rule for free).
    """
    of = lambda side, c: F.max(F.when(F.col(by) == side, F.col(c)))
    j = stats.where(F.col(by).isin(left, right)).groupBy("turn").agg(
        *[of(side, c).alias(f"{side}_{c}") for side in (left, right) for c in ("count", "avg_words", "avg_tokens")])
    count = lambda side: F.coalesce(f"{side}_count", F.lit(0)).cast("bigint").alias(f"{side}_count")
    diff = lambda c: F.col(f"{left}_{c}") - F.col(f"{right}_{c}")
    return j.select("turn", count(left), count(right), f"{left}_avg_words", f"{right}_avg_words",
                    diff("avg_words").alias("words_diff"), f"{left}_avg_tokens", f"{right}_avg_tokens",
                    diff("avg_tokens").alias("tokens_diff"))
