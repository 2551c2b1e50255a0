"""Incremental session ingest with versions (J7 as a stream, S1, A55).

The reference resumes generation by skipping session files that exist and
validate; a session that failed is generated again under the same name.  A file
source goes by path and would never see that file again, so the log here goes by
path, modification time and length.

A step lists the folder (a listing only: no content is read), takes the file
versions that the log does not hold, reads those files, and writes under
``out_dir``, each under ``batch_id=N``:

* ``turns``: the messages, with the version they come from;
* ``validation``: one row per file version, A55;
* ``log``: the versions taken.  Written last: it is what makes a batch count.

A step that dies before its log is written left nothing that counts; the next one
takes the same number and overwrites what is there.  A file that changes between
listing and reading is not in the batch and is found by the next step.

``current`` gives the turns and validation rows of the newest version of each
session, out of the batches that count; ``pending_from_ingested`` goes by it, so a
session whose newest version fails is pending, whatever an earlier one did.
``compact`` rewrites the tables to the newest versions.

A file without a byte is not listed by the reader and counts as not there.
Nothing keeps state per session across batches: a file is a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkframe.functions.text import py_strip
from talkframe.schemas import SESSION_FILE
from talkframe.session import checkpoint_dir
from talkframe.sources.corpus import path_exists, session_id_from_name

_VERSION = ["file_path", "modified", "length"]
_LOG = "file_path string, modified timestamp, length bigint, session_id bigint, batch_id int"
_TURNS = "corpus string, session_id bigint, turn bigint, role string, text string, file_path string, modified timestamp, length bigint, batch_id int"
_VALIDATION = "session_id bigint, stored bigint, actual bigint, status string, file_path string, modified timestamp, length bigint, batch_id int"


def _files(spark: SparkSession, data_dir: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "session_*.json").load(data_dir)


def _version(files: DataFrame, *more) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.col("path").alias("file_path"), F.col("modificationTime").alias("modified"), "length",
                        session_id_from_name(name).alias("session_id"), *more).where(F.col("session_id").isNotNull())


def versions(spark: SparkSession, data_dir: str) -> DataFrame:
    """(file_path, modified, length, session_id) of the session files that are there."""
    return _version(_files(spark, data_dir))


def _table(spark: SparkSession, out_dir: str, name: str, schema: str) -> DataFrame:
    path = f"{out_dir}/{name}"
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def log(spark: SparkSession, out_dir: str) -> DataFrame:
    """The file versions ingested so far, with the number of their batch."""
    return _table(spark, out_dir, "log", _LOG)


def _parsed(spark: SparkSession, data_dir: str, todo: DataFrame, oldest) -> DataFrame:
    """The documents of the versions in ``todo``; content older than ``oldest`` is not read."""
    files = _files(spark, data_dir).where(F.col("modificationTime") >= F.lit(oldest))
    read = _version(files, F.col("content").cast("string").alias("_json")).join(todo.select(*_VERSION), _VERSION)
    doc = F.from_json("_json", SESSION_FILE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return read.withColumn("doc", doc).select(*_VERSION, "session_id", "doc.*")


def _turns_of(sessions: DataFrame, corpus: str) -> DataFrame:
    x = sessions.where(F.col("_corrupt_record").isNull()).select(
        F.lit(corpus).alias("corpus"), "session_id", F.posexplode("messages").alias("turn", "m"), *_VERSION)
    return x.select("corpus", "session_id", F.col("turn").cast("bigint").alias("turn"), F.col("m.role").alias("role"),
                    F.coalesce("m.content", F.lit("")).alias("text"), *_VERSION)


def _validated(sessions: DataFrame) -> DataFrame:
    """A55 per file version: unreadable, without messages or with another count fails."""
    spoken = F.filter("messages", lambda m: (m["role"] == "assistant") & (F.length(py_strip(m["content"])) > 0))
    rows = sessions.select("session_id", F.col("num_patient_turns").cast("bigint").alias("stored"),
                           F.when(F.col("messages").isNotNull(), F.size(spoken)).cast("bigint").alias("actual"), *_VERSION)
    passes = F.coalesce(F.col("stored") == F.col("actual"), F.lit(False))
    return rows.select("session_id", "stored", "actual", F.when(passes, "pass").otherwise("fail").alias("status"), *_VERSION)


def ingest_step(spark: SparkSession, data_dir: str, out_dir: str, corpus: str = "synthetic") -> int:
    """Ingest the file versions that are new; how many they were."""
    if not path_exists(spark, data_dir):
        return 0
    done = log(spark, out_dir)
    todo = versions(spark, data_dir).join(done.select(*_VERSION), _VERSION, "left_anti")
    # the listing is written once, so that all that follows sees the same versions
    at = f"{checkpoint_dir(spark)}/ingest-listing-{spark.sql('select uuid() u').first().u}"
    todo.write.parquet(at)
    todo = spark.read.parquet(at)
    oldest = todo.agg(F.min("modified").alias("m")).first().m
    if oldest is None:
        return 0
    batch = (done.agg(F.max("batch_id").alias("n")).first().n or 0) + 1
    sessions = _parsed(spark, data_dir, todo, oldest).persist()
    try:
        for rows, name in ((_turns_of(sessions, corpus), "turns"), (_validated(sessions), "validation"),
                           (sessions.select(*_VERSION, "session_id"), "log")):
            rows.write.mode("overwrite").parquet(f"{out_dir}/{name}/batch_id={batch}")
    finally:
        sessions.unpersist()
    return log(spark, out_dir).where(F.col("batch_id") == batch).count()


def ingest_sessions(spark: SparkSession, data_dir: str, out_dir: str, corpus: str = "synthetic",
                    checkpoint: str | None = None, available_now: bool = True, every: str = "30 seconds"):
    """Ingest what is new now (the number of file versions), or go on doing so.

    Without ``available_now`` a running streaming query is returned whose ticks
    each take a step; ``checkpoint`` is where it keeps its own place.
    """
    if available_now:
        return ingest_step(spark, data_dir, out_dir, corpus)
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (ticks.writeStream.foreachBatch(lambda _, __: ingest_step(spark, data_dir, out_dir, corpus) and None)
            .option("checkpointLocation", checkpoint or f"{checkpoint_dir(spark)}/ingest-{corpus}")
            .trigger(processingTime=every).start())


def current(spark: SparkSession, out_dir: str) -> tuple[DataFrame, DataFrame]:
    """(turns, validation) of the newest version of each session, of the batches that count.

    The newest is the latest modified; of equal times the later batch, then the
    greater path (a session may lie in two folders).
    """
    newest = Window.partitionBy("session_id").orderBy(F.desc("modified"), F.desc("batch_id"), F.desc("file_path"), F.desc("length"))
    key = [*_VERSION, "batch_id"]
    keep = log(spark, out_dir).withColumn("_r", F.row_number().over(newest)).where(F.col("_r") == 1).select(*key)
    return (_table(spark, out_dir, "turns", _TURNS).join(keep, key, "left_semi"),
            _table(spark, out_dir, "validation", _VALIDATION).join(keep, key, "left_semi"))


def compact(spark: SparkSession, out_dir: str, to_dir: str) -> None:
    """Write the newest versions of ``out_dir`` to ``to_dir``; the log keeps all versions, and rows their batches."""
    turns, validation = current(spark, out_dir)
    for rows, name in ((turns, "turns"), (validation, "validation"), (log(spark, out_dir), "log")):
        rows.write.mode("overwrite").partitionBy("batch_id").parquet(f"{to_dir}/{name}")


def pending_from_ingested(spark: SparkSession, todo: DataFrame, out_dir: str) -> DataFrame:
    """Sessions still to generate = todo minus sessions whose newest version is valid."""
    done = current(spark, out_dir)[1].where(F.col("status") == "pass").select("session_id")
    return todo.join(done, "session_id", "left_anti")
