"""Data quality, resume and inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.operators.turns import patient_messages


def validate_turn_counts(stored: DataFrame, turns: DataFrame) -> DataFrame:
    """Stored patient-turn count vs actual non-empty patient messages.

    ``stored(session_id, num_patient_turns, corrupt)``: a missing field fails,
    an unreadable record (``corrupt`` true) fails, otherwise pass iff equal.
    """
    actual = patient_messages(turns).groupBy("session_id").agg(F.count(F.lit(1)).alias("actual"))
    j = stored.join(actual, "session_id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)).cast("bigint"))
    status = (F.when(F.col("corrupt"), "fail").when(F.col("num_patient_turns").isNull(), "fail")
              .when(F.col("num_patient_turns") == F.col("actual"), "pass").otherwise("fail"))
    msg = (F.when(F.col("corrupt"), F.lit("unreadable session file"))
           .when(F.col("num_patient_turns").isNull(), F.lit("num_patient_turns missing"))
           .when(F.col("num_patient_turns") == F.col("actual"), F.lit("ok"))
           .otherwise(F.format_string("expected %d patient turns, found %d", F.col("num_patient_turns"), F.col("actual"))))
    return j.select("session_id", F.col("num_patient_turns").cast("bigint").alias("stored"), "actual",
                    status.alias("status"), msg.alias("message"))


def validation_summary(results: DataFrame, by=()) -> DataFrame:
    """Total, passed, failed and percentages."""
    g = results.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "pass").alias("passed"))
    g = g.withColumn("failed", F.col("total") - F.col("passed"))
    return g.withColumn("pass_pct", F.col("passed") / F.nullif("total", F.lit(0)) * 100.0).withColumn(
        "fail_pct", F.col("failed") / F.nullif("total", F.lit(0)) * 100.0)


def pending_sessions(todo: DataFrame, done: DataFrame, key: str = "session_id") -> DataFrame:
    """Sessions still to generate = todo ⟕̸ stored-and-valid (left anti join)."""
    return todo.join(done.select(key), key, "left_anti")


def valid_sessions(results: DataFrame) -> DataFrame:
    """The stored sessions to keep: those that pass A55."""
    return results.where(F.col("status") == "pass").select("session_id")


def reusable_ccd(stored: DataFrame, results: DataFrame) -> DataFrame:
    """The stored cognitive diagram of every valid session that has one, to be
    reused instead of drawn again."""
    return stored.where(F.col("ccd").isNotNull()).join(valid_sessions(results), "session_id", "left_semi").select("session_id", "ccd")


def corpus_inventory(turns: DataFrame, by: str = "corpus") -> DataFrame:
    """Rows, sessions, and the sorted distinct psi / backend values."""
    aggs = [F.count(F.lit(1)).alias("rows"), F.count_distinct("session_id").alias("sessions")]
    for c in ("psi", "backend_llm"):
        if c in turns.columns:
            aggs.append(F.array_join(F.array_sort(F.collect_set(c)), ",").alias(f"{c}_values"))
    return turns.groupBy(by).agg(*aggs)


def session_count_check(turns: DataFrame, left: str = "real", right: str = "synthetic") -> DataFrame:
    """Session counts of two corpora and whether they match."""
    g = turns.groupBy().agg(F.count_distinct(F.when(F.col("corpus") == left, F.col("session_id"))).alias(f"{left}_sessions"),
                            F.count_distinct(F.when(F.col("corpus") == right, F.col("session_id"))).alias(f"{right}_sessions"))
    return g.withColumn("counts_match", F.col(f"{left}_sessions") == F.col(f"{right}_sessions"))


def folder_structure(sessions: DataFrame, levels=("psi", "backend", "dataset")) -> DataFrame:
    """Session count per folder level combination; ``ok`` when > 0."""
    return sessions.groupBy(*levels).agg(F.count(F.lit(1)).alias("sessions")).withColumn("ok", F.col("sessions") > 0)
