"""Model hooks (U1-U4) as Arrow-batched ``mapInPandas`` stages.

A hook is a plain Python callable on a pandas batch; Spark partitions the
request table, streams Arrow batches (``spark.sql.execution.arrow.maxRecordsPerBatch``
bounds the batch = the reference's batch size) and collects raw replies as a
column.  Failure contract: a failed batch yields null replies, never a failed
job.  Replies are non-deterministic and costly, so callers persist them
(``talkframe.session.cut_lineage`` or a written table) before parsing.

No model ships with the library: a hook is any client with this signature.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.operators.replies import parse_label_json, parse_letter
from talkframe.operators.turns import SESSION, history_windows, transcripts

# --- hook runners --------------------------------------------------------------

def _chunks(pdf: pd.DataFrame, batch_size: int | None):
    if not batch_size or len(pdf) <= batch_size:
        yield pdf
        return
    for i in range(0, len(pdf), batch_size):
        yield pdf.iloc[i:i + batch_size]


def _bounded(requests: DataFrame, max_concurrency: int | None) -> DataFrame:
    """At most ``max_concurrency`` tasks call the model at once (one
    explicit shuffle, only when asked for)."""
    return requests.repartition(max_concurrency) if max_concurrency else requests


def _run_hook(requests: DataFrame, hook: Callable, out_col: str, keep: list[str],
              batch_size: int | None = None, max_concurrency: int | None = None) -> DataFrame:
    """Call ``hook(pdf) -> Series`` on batches of exactly ``batch_size`` requests
    (P27; the last batch of a task may be smaller).  Arrow batches are split, so
    the model batch does not depend on ``maxRecordsPerBatch``."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema.fields if f.name in keep)
    schema += f", {out_col} string"

    def run(batches):
        for big in batches:
            for pdf in _chunks(big, batch_size):
                try:
                    reply = hook(pdf)
                except Exception:  # noqa: BLE001 - failure contract: no label, no crash
                    reply = pd.Series([None] * len(pdf), index=pdf.index)
                out = pdf[keep].copy()
                out[out_col] = reply.astype(object).where(reply.notna(), None)
                yield out

    return _bounded(requests, max_concurrency).mapInPandas(run, schema)


def keep_replies(replies: DataFrame, path: str | None = None) -> DataFrame:
    """Pin non-deterministic replies so a lost executor never re-asks the model:
    write them as a table under ``path`` (a shared folder) and read it back, or,
    without a path, a reliable checkpoint into ``spark.checkpoint.dir``."""
    if path is None:
        from talkframe.session import cut_lineage
        return cut_lineage(replies)
    replies.write.mode("overwrite").parquet(path)
    return replies.sparkSession.read.parquet(path)


def label_turns(turns: DataFrame, judge: Callable, k: int = 6,
                keep: bool | str = True, batch_size: int | None = None,
                max_concurrency: int | None = None) -> DataFrame:
    """One request per non-empty patient turn (W2 history + message) → raw reply.
    Replies are pinned (see ``keep_replies``; ``keep``: a table path, or False to
    ask again whenever they are read)."""
    req = history_windows(turns, k=k)
    out = _run_hook(req, judge, "raw_reply", SESSION + ["turn", "message", "history"], batch_size, max_concurrency)
    return keep_replies(out, keep if isinstance(keep, str) else None) if keep else out


def parse_turn_labels(replies: DataFrame) -> DataFrame:
    """P21 on U2 replies; label index = order of the labelled turns."""
    from pyspark.sql import Window
    lab = replies.select(*SESSION, "turn", "message", parse_letter(F.col("raw_reply")).alias("label")).where(
        F.col("label").isNotNull())
    w = Window.partitionBy(*SESSION).orderBy("turn")
    return lab.withColumn("label_idx", (F.row_number().over(w) - 1).cast("bigint"))


def label_conversations(turns: DataFrame, judge: Callable,
                        history_limit: int = 32, keep: bool | str = True, batch_size: int | None = None,
                        max_concurrency: int | None = None) -> DataFrame:
    """One request per session (P17 transcript) → raw JSON reply; the
    reference sends 10-32 conversations per model batch (``batch_size``)."""
    req = transcripts(turns, history_limit=history_limit)
    out = _run_hook(req, judge, "raw_reply", SESSION + ["transcript"], batch_size, max_concurrency)
    return keep_replies(out, keep if isinstance(keep, str) else None) if keep else out


def parse_conversation_labels(replies: DataFrame) -> DataFrame:
    """P22 on U1 replies → one row per label, numbered after invalid items are
    dropped; unparsable replies give none (see ``parse_errors``)."""
    items = replies.select(*SESSION, F.posexplode(parse_label_json(F.col("raw_reply"))).alias("label_idx", "_it"))
    return items.select(*SESSION, F.col("label_idx").cast("bigint").alias("label_idx"),
                        F.col("_it.content").alias("content"), F.col("_it.classification").alias("label"))


def parse_errors(replies: DataFrame) -> DataFrame:
    """Sessions whose reply could not be parsed (rerun candidates)."""
    return replies.where(parse_label_json(F.col("raw_reply")).isNull()).select(*SESSION, "raw_reply")


def score_texts(df: DataFrame, scorer: Callable, out_schema: str, keep: list[str],
                batch_size: int | None = None, max_concurrency: int | None = None) -> DataFrame:
    """Run any batch scorer ``scorer(pdf) -> pdf`` (one output row per input
    row, columns ``out_schema``) over Arrow batches; a failed batch yields nulls.
    The default emotion and sequence scorers are the SQL forms in
    ``operators.emotion`` and ``operators.scores``; this is the hook for models."""
    out_cols = [c.strip().split(" ")[0] for c in out_schema.split(",")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep)
    schema += ", " + out_schema

    def run(batches):
        for big in batches:
            for pdf in _chunks(big, batch_size):
                out = pdf[keep].copy()
                try:
                    scored = scorer(pdf)
                    for c in out_cols:
                        out[c] = scored[c].values
                except Exception:  # noqa: BLE001 - failure contract
                    for c in out_cols:
                        out[c] = None
                yield out

    return _bounded(df, max_concurrency).mapInPandas(run, schema)
