"""Writers (S11-S14).  Output folders are overwritten atomically by Spark's
commit protocol; a re-run after executor loss rewrites the same files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export_corpus(sessions: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One parquet dataset; nested values as JSON text, CCD forced to '{}'
    unless psi is patientpsi; psi/backend columns kept as written, partitioned by
    their lower-cased keys so readers prune folders."""
    out = sessions
    for c in ("messages", "profile"):
        if c in out.columns and out.schema[c].dataType.simpleString() != "string":
            out = out.withColumn(c, F.to_json(c))
    if "ccd" in out.columns:
        ccd = F.col("ccd") if out.schema["ccd"].dataType.simpleString() == "string" else F.to_json("ccd")
        out = out.withColumn("ccd", F.when(F.lower("psi") == "patientpsi", ccd).otherwise(F.lit("{}")))
    # lower-cased partition keys: case-insensitive filters become partition pruning
    out = out.withColumn("psi_key", F.lower("psi")).withColumn("backend_key", F.lower("backend_llm"))
    out.write.mode(mode).partitionBy("psi_key", "backend_key").parquet(path)


#: Quotes doubled (RFC 4180), no text trimmed, line breaks kept as they are; an empty text
#: is written in quotes, a null as nothing.
CSV = {"header": True, "quote": '"', "escape": '"', "lineSep": "\n", "emptyValue": '""', "nullValue": "",
       "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result tables as CSV with a header."""
    df.write.mode(mode).options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table of ``write_csv``, every text as it was, but that an empty text comes back as
    null: Spark's reader does not tell them apart.  A record may have line breaks, so a
    file is read by one task; ``write_csv`` writes as many files as it has tasks."""
    return spark.read.schema(schema).options(**{**CSV, "emptyValue": ""}, multiLine=True, mode="FAILFAST").csv(path)


def write_session_json(df: DataFrame, path: str, partition_by=("corpus",), mode: str = "overwrite") -> None:
    """One JSON record per session (the row keeps its session_id); partitioned
    by corpus, not by session, so the file count stays bounded at scale."""
    df.write.mode(mode).partitionBy(*partition_by).json(path)


def session_scores_json(nested: DataFrame) -> DataFrame:
    """``{session_id, scores[]}``, one JSON row per session, so that no task
    gathers the corpus; the number of conversations is the number of rows."""
    return nested.select(F.to_json(F.struct("session_id", "scores")).alias("json"))


def write_bucketed_turns(turns: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Store a turn table bucketed and sorted by ``session_id``.

    Corpora that are compared again and again (J1 pairing, per-session windows)
    are joined on ``session_id``; when both sides are bucketed the same way the
    sort-merge join reads matching buckets directly — no shuffle of either side.
    ``path`` places the table files in a shared folder (an external table)."""
    w = turns.write.mode("overwrite").bucketBy(buckets, "session_id").sortBy("session_id", "turn")
    if path is not None:
        w = w.option("path", path)
    w.saveAsTable(table)
