"""Corpus readers.

All readers declare their schema (no inference), read with ``PERMISSIVE`` and a
``_corrupt_record`` column so unreadable files are quarantined instead of
failing the job, and take keys from ``_metadata.file_path`` rather than from a
load order.  ``to_turns`` turns the nested ``messages`` array into the canonical
turn table with ``posexplode``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.operators.turns import normalize_backend, relabel_role
from talkframe.schemas import CCD, MESSAGES, PROFILE, PUBLISHED_CORPUS, RAW_DIALOG, REAL_CORPUS, SESSION_FILE
from talkframe.sources.json_objects import read_json_objects

SESSION_FILE_RE = r"^session_(\d+)\.json$"
# Real corpus sources and the names that route to them.
REAL_SOURCES = {"esc": ["ESC"], "hope": ["HOPE"], "annomi": ["AnnoMI"], "all": ["ESC", "HOPE", "AnnoMI"]}


def session_id_from_name(file_name: Column) -> Column:
    """Integer id of ``session_<n>.json``; null for other names (incl. ``_turn``)."""
    return F.regexp_extract(file_name, SESSION_FILE_RE, 1).try_cast("bigint")


def _file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _json_reader(spark: SparkSession, schema, recursive: bool = False):
    r = (spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", "session_*.json"))
    if recursive:
        r = r.option("recursiveFileLookup", True)
    return r


def scan_sessions(spark: SparkSession, data_dir: str, recursive: bool = False, keep_corrupt: bool = False) -> DataFrame:
    """``session_*.json`` files of a folder (``recursive`` → whole tree).

    Adds ``file_path``, ``session_id`` (from the file name) and ``corrupt``.
    Unreadable files are dropped unless ``keep_corrupt`` (quarantine view); a
    document without messages has none (an empty array).  A missing folder gives
    an empty frame.
    """
    if not path_exists(spark, data_dir):
        from pyspark.sql import types as T
        empty = T.StructType(SESSION_FILE.fields + [T.StructField("file_path", T.StringType()),
                                                    T.StructField("session_id", T.LongType()),
                                                    T.StructField("corrupt", T.BooleanType())])
        return spark.createDataFrame([], empty)
    df = _json_reader(spark, SESSION_FILE, recursive).json(data_dir)
    df = df.select("*", F.col("_metadata.file_path").alias("file_path"))
    df = df.withColumn("session_id", session_id_from_name(_file_name(F.col("file_path"))))
    return _readable(df, keep_corrupt)


def _readable(df: DataFrame, keep_corrupt: bool) -> DataFrame:
    none, bad = F.array().cast(MESSAGES), F.col("_corrupt_record").isNotNull()
    # Spark refuses to read the corrupt-record column alone: the flag looks at messages too
    df = df.withColumn("corrupt", F.when(F.col("messages").isNotNull() & ~bad, F.lit(False)).otherwise(bad)).withColumn("messages", F.coalesce("messages", none))
    return df if keep_corrupt else df.where(~F.col("corrupt"))


def scan_synthetic(spark: SparkSession, data_dir: str) -> DataFrame:
    """Session files projected to (session_id, messages, profile, source='SYNTHETIC')."""
    s = scan_sessions(spark, data_dir).where(F.col("session_id").isNotNull())
    return s.select("session_id", "messages", "profile", F.lit("SYNTHETIC").alias("source"))


def scan_tree(spark: SparkSession, root: str, psi_filter: str | None = None) -> DataFrame:
    """S3: the files ``{psi}/{backend}/{dataset}/session_*.json`` (exactly that deep)
    with the path levels as columns, the backend normalised.

    ``psi_filter`` is part of the path pattern, so other folders are not listed.
    The session id is that inside the file, else that of the file name, else a
    stable hash of the path."""
    from pyspark.sql import types as T
    folders = f"{root}/{psi_filter or '*'}/*/*"
    schema = T.StructType([*SESSION_FILE.fields[:-1], T.StructField("session_id", T.StringType()), SESSION_FILE.fields[-1]])
    if not _glob_dirs(spark, folders):
        df = spark.createDataFrame([], schema).withColumn("file_path", F.lit(""))
    else:
        df = _json_reader(spark, schema).json(folders).select("*", F.col("_metadata.file_path").alias("file_path"))
    parts = F.split(F.col("file_path"), "/")
    named = F.regexp_extract(_file_name(F.col("file_path")), r"session_([^/]*)\.json$", 1).try_cast("bigint")
    df = df.withColumn("session_id", F.coalesce(F.col("session_id").try_cast("bigint"), named, F.abs(F.xxhash64("file_path"))))
    df = df.select("*", F.element_at(parts, -4).alias("psi"), normalize_backend(F.element_at(parts, -3)).alias("backend"),
                   F.element_at(parts, -2).alias("dataset"))
    return _readable(df, keep_corrupt=False)


def psi_and_dataset(path: Column, known_psis, known_datasets) -> list[Column]:
    """Psi / dataset = the last path part that is a known name; ``path_error``
    when either is absent (callers quarantine those rows)."""
    parts = F.split(path, "/")
    psi = F.element_at(F.filter(parts, lambda x: x.isin(*known_psis)), -1)
    ds = F.element_at(F.filter(parts, lambda x: x.isin(*known_datasets)), -1)
    psi = F.when(F.size(F.filter(parts, lambda x: x.isin(*known_psis))) > 0, psi)
    ds = F.when(F.size(F.filter(parts, lambda x: x.isin(*known_datasets))) > 0, ds)
    return [psi.alias("psi"), ds.alias("dataset"), (psi.isNull() | ds.isNull()).alias("path_error")]


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def resolve_synthetic_dir(spark: SparkSession, base: str, psi: str | None = None, model: str | None = None,
                          dataset: str | None = None) -> str | None:
    """The session folder, by the two fallback chains of the reference.

    Without ``model``: ``base`` if it holds session files, else ``base/dataset`` if
    it does, else ``base/psi/dataset`` (returned even when absent).  With
    ``model``: the first folder matching ``base/psi/model/dataset``, else
    ``base/*/psi/model/dataset``; None when neither matches.  A driver-side
    listing of a handful of paths — never of data.
    """
    if model is None:
        if _has_sessions(spark, base):
            return base
        if dataset and _has_sessions(spark, f"{base}/{dataset}"):
            return f"{base}/{dataset}"
        return f"{base}/{psi}/{dataset}"
    for pattern in (f"{base}/{psi}/{model}/{dataset}", f"{base}/*/{psi}/{model}/{dataset}"):
        hits = _glob_dirs(spark, pattern)
        if hits:
            return hits[0]
    return None


def _glob_dirs(spark, pattern):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    st = fs.globStatus(p)
    if st is None:
        return []
    return sorted(x.getPath().toUri().getPath() for x in st if x.isDirectory())


def _has_sessions(spark, path):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path + "/session_*.json")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    st = fs.globStatus(p)
    return st is not None and len(st) > 0


def route_sources(df: DataFrame, name: str, routes: dict, column: str = "source") -> DataFrame:
    """S6 routing: keep the sources a name routes to (pushed to the scan as an
    IN filter); an unknown name is an error, as in the reference."""
    key = name.lower()
    if key not in routes:
        raise ValueError(f"Unsupported dataset type: {name}")
    return df.where(F.col(column).isin(*routes[key]))


def read_real_corpus(spark: SparkSession, path: str, name: str = "all", ids: DataFrame | None = None) -> DataFrame:
    """Real corpus parquet routed by name (esc / hope / annomi / all); the
    source filter is pushed to the scan.  ``ids`` (a DataFrame of session_id)
    restricts rows with a semi join; ``None`` means no restriction."""
    df = route_sources(spark.read.schema(REAL_CORPUS).parquet(path), name, REAL_SOURCES)
    if ids is not None:
        df = df.join(ids.select("session_id"), "session_id", "left_semi")
    return df


def read_raw_dialogs(spark: SparkSession, path: str, indices: DataFrame | None = None) -> DataFrame:
    """Raw support-dialogue JSON files (a list of dialogs); a dialog is one
    row, keyed by its file and, as ``id_source``, its position in that file;
    speaker seeker → assistant, supporter → user.  One file is read by many tasks
    (``sources/json_objects.py``).  ``indices`` has ``id_source``
    and, to tell files apart, may have ``file``."""
    doc = F.from_json("json", RAW_DIALOG)
    rows = read_json_objects(spark, path).select(_file_name(F.col("file_path")).alias("file"), F.col("position").alias("id_source"), doc.alias("d"))
    rows = rows.select("file", "id_source", "d.situation",
                       F.transform("d.dialog", lambda m: F.struct(relabel_role(m["speaker"], "speaker").alias("role"),
                                                                  m["content"].alias("content"))).alias("messages"))
    if indices is not None:
        keys = [c for c in ("file", "id_source") if c in indices.columns]
        rows = rows.join(indices.select(*keys), keys, "left_semi")
    return rows


def read_published(spark: SparkSession, path: str, psi: str | None = None, backend: str | None = None) -> DataFrame:
    """Published synthetic parquet filtered case-insensitively on psi/backend
    (partition pruning on the lower-cased keys written by ``export_corpus``);
    JSON-text columns parsed with fixed schemas, non-JSON text kept as is."""
    df = spark.read.parquet(path)
    keyed = "psi_key" in df.columns and "backend_key" in df.columns
    if not keyed:  # a dataset not written by ``export_corpus``: fixed schema, no pruning
        df = spark.read.schema(PUBLISHED_CORPUS).parquet(path)
    if psi is not None:
        df = df.where(F.col("psi_key") == psi.lower()) if keyed else df.where(F.lower("psi") == psi.lower())
    if backend is not None:
        df = df.where(F.col("backend_key") == backend.lower()) if keyed else df.where(F.lower("backend_llm") == backend.lower())
    for c, schema in (("messages", MESSAGES), ("profile", PROFILE), ("ccd", CCD)):
        if c in df.columns:
            is_json = F.try_parse_json(c).isNotNull()
            df = (df.withColumn(f"{c}_parsed", F.when(is_json, F.from_json(c, schema)))
                  .withColumn(f"{c}_raw", F.when(~is_json, F.col(c))))
    return df


def read_with_variants(spark: SparkSession, data_dir: str) -> DataFrame:
    """Per session the main file, else ``turn/session_<n>.json``, else
    ``session_<n>_turn.json`` (priority union, first per session)."""
    from pyspark.sql import Window
    main = scan_sessions(spark, data_dir).where(F.col("session_id").isNotNull()).withColumn("priority", F.lit(0))
    sub = scan_sessions(spark, f"{data_dir}/turn") if path_exists(spark, f"{data_dir}/turn") else None
    parts = [main]
    if sub is not None:
        parts.append(sub.where(F.col("session_id").isNotNull()).withColumn("priority", F.lit(1)))
    alt = (_json_reader(spark, SESSION_FILE).option("pathGlobFilter", "session_*_turn.json").json(data_dir)
           .select("*", F.col("_metadata.file_path").alias("file_path")))
    alt = alt.withColumn("session_id", F.regexp_extract(_file_name(F.col("file_path")), r"^session_(\d+)_turn\.json$", 1)
                         .try_cast("bigint")).withColumn("corrupt", F.col("_corrupt_record").isNotNull())
    alt = alt.withColumn("messages", F.coalesce("messages", F.array().cast(MESSAGES)))
    parts.append(alt.where(~F.col("corrupt") & F.col("session_id").isNotNull()).withColumn("priority", F.lit(2)))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    w = Window.partitionBy("session_id").orderBy("priority")
    return u.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def to_turns(sessions: DataFrame, corpus: str | Column, messages: str = "messages") -> DataFrame:
    """Nested ``messages`` → ``turns(corpus, session_id, turn, role, text)``."""
    c = F.lit(corpus) if isinstance(corpus, str) else corpus
    x = sessions.select(c.alias("corpus"), "session_id", F.posexplode(messages).alias("turn", "m"))
    return x.select("corpus", "session_id", F.col("turn").cast("bigint").alias("turn"),
                    F.col("m.role").alias("role"), F.coalesce(F.col("m.content"), F.lit("")).alias("text"))
