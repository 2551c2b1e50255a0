"""Turn-label analytics.

Input: ``labels(corpus, session_id, label_idx, label)`` with label in P/T/C/F.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.functions.text import py_strip
from talkframe.operators.turns import PATIENT_ROLE, SESSION

NON_FILLER = ["P", "T", "C"]


def label_number(label: Column, filler_as_zero: bool = False) -> Column:
    """P→1, T→2, C→3, F→null (progression) or 0 (plots)."""
    f = F.lit(0.0) if filler_as_zero else F.lit(None).cast("double")
    return (F.when(label == "P", 1.0).when(label == "T", 2.0).when(label == "C", 3.0)
            .when(label == "F", f).otherwise(F.lit(None).cast("double")))


def sessions_of(turns: DataFrame) -> DataFrame:
    """Every conversation once, whatever its messages hold."""
    return turns.select(*SESSION).distinct()


def conversation_label_counts(labels: DataFrame, sessions: DataFrame) -> DataFrame:
    """Counts and ratios per conversation (P/T/C over non-filler, F over all);
    a conversation without labels counts 0 everywhere."""
    g = sessions.join(labels, SESSION, "left").groupBy(*SESSION).agg(
        F.count("label").alias("total_patient_turns"),
        *[F.count_if(F.col("label") == x).alias(f"{x}_count") for x in "PTCF"])
    nf = F.col("P_count") + F.col("T_count") + F.col("C_count")
    g = g.withColumn("non_filler_turns", nf)
    ratios = [F.coalesce(F.col(f"{x}_count") / F.nullif("non_filler_turns", F.lit(0)), F.lit(0.0)).alias(f"{x}_ratio")
              for x in NON_FILLER]
    fr = F.coalesce(F.col("F_count") / F.nullif("total_patient_turns", F.lit(0)), F.lit(0.0)).alias("F_ratio")
    return g.select(*SESSION, "total_patient_turns", "non_filler_turns",
                    *[f"{x}_count" for x in "PTCF"], *ratios, fr)


def label_count_check(turns: DataFrame, labels: DataFrame, history_limit: int = 32) -> DataFrame:
    """expected = min(history_limit div 2, #non-empty patient turns) vs labels
    received, for every conversation: without patient text 0 are expected, without
    labels 0 received."""
    spoken = (F.col("role") == PATIENT_ROLE) & (F.length(py_strip("text")) > 0)
    n = turns.groupBy(*SESSION).agg(F.count_if(spoken).alias("n_patient"))
    got = labels.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("n_labels"))
    j = n.join(got, SESSION, "left")
    exp = F.least(F.lit(history_limit // 2), F.col("n_patient"))
    return j.select(*SESSION, "n_patient", exp.cast("bigint").alias("expected"),
                    F.coalesce("n_labels", F.lit(0)).cast("bigint").alias("received"),
                    (exp != F.coalesce("n_labels", F.lit(0))).alias("has_mismatch"))


def mismatch_summary(check: DataFrame) -> DataFrame:
    """A24 summary: conversations, mismatches, rate in %."""
    return check.groupBy("corpus").agg(
        F.count(F.lit(1)).alias("conversations"),
        F.count_if("has_mismatch").alias("mismatches"),
        (F.avg(F.col("has_mismatch").cast("double")) * 100.0).alias("mismatch_rate_pct"))


def macro_comparison(per_conv: DataFrame, left: str = "real", right: str = "synthetic") -> DataFrame:
    """Per label, mean and **sample** std of the per-conversation ratios per
    corpus and the difference right − left."""
    long = per_conv.select("corpus", F.inline(F.array(*[
        F.struct(F.lit(x).alias("label"), F.col(f"{x}_ratio").alias("ratio")) for x in "PTCF"])))
    g = long.groupBy("label").agg(
        F.avg(F.when(F.col("corpus") == left, F.col("ratio"))).alias(f"{left}_mean"),
        F.stddev_samp(F.when(F.col("corpus") == left, F.col("ratio"))).alias(f"{left}_std"),
        F.avg(F.when(F.col("corpus") == right, F.col("ratio"))).alias(f"{right}_mean"),
        F.stddev_samp(F.when(F.col("corpus") == right, F.col("ratio"))).alias(f"{right}_std"))
    return g.withColumn("difference", F.col(f"{right}_mean") - F.col(f"{left}_mean"))


def turn_totals(per_conv: DataFrame) -> DataFrame:
    """A25 turn statistics: total and non-filler turns, mean filler ratio."""
    return per_conv.groupBy("corpus").agg(
        F.sum("total_patient_turns").alias("total_turns"), F.sum("non_filler_turns").alias("non_filler_turns"),
        F.avg("F_ratio").alias("filler_mean"))


def micro_distribution(per_conv: DataFrame) -> DataFrame:
    """Σcount / Σturns per corpus, filler included."""
    tot = F.sum("total_patient_turns")
    return per_conv.groupBy("corpus").agg(
        *[(F.sum(f"{x}_count") / F.nullif(tot, F.lit(0))).alias(f"{x}_share") for x in "PTCF"])


def label_progression(labels: DataFrame, per_conv: DataFrame, threshold: int = 12) -> DataFrame:
    """Mean numeric label per position for conversations with ≥ threshold
    labels, positions < threshold, filler excluded (null)."""
    keep = per_conv.where(F.col("total_patient_turns") >= threshold).select(*SESSION)
    l = labels.join(keep, SESSION, "left_semi").where(F.col("label_idx") < threshold)
    return l.groupBy("corpus", "label_idx").agg(F.avg(label_number(F.col("label"))).alias("mean_label"))


def mismatch_debug(turns: DataFrame, labels: DataFrame, check: DataFrame) -> DataFrame:
    """A24/S13 quarantine rows: for each session whose label count differs from the
    expected count, the input messages and the labels received (one row per
    session, ready for ``sinks.write_session_json``)."""
    bad = check.where("has_mismatch").select(*SESSION, "expected", "received")
    msgs = turns.join(bad.select(*SESSION), SESSION, "left_semi").groupBy(*SESSION).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("input_messages"))
    got = labels.join(bad.select(*SESSION), SESSION, "left_semi").groupBy(*SESSION).agg(
        F.array_sort(F.collect_list(F.struct("label_idx", "label"))).alias("output_labels"))
    return bad.join(msgs, SESSION, "left").join(got, SESSION, "left")
