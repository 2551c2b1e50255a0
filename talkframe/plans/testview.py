"""Mapping of the driver's ``conversations(conv_id, turn, role, text)`` table onto
the data model.

* ``corpus``: even ``conv_id`` → real, odd → synthetic; ``session_id = conv_id div 2``
  pairs one real and one synthetic conversation per session (J1).
* ``psi``/``backend_llm``: derived from ``session_id`` so A2/J11 have several
  simulator pairs; ``backend_llm`` carries raw hosting/vendor prefixes for P6.

The same mapping exists as SQL in ``talkframe.plans.sqlfrag.TURNS_CTE``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.operators.turns import normalize_backend
from talkframe.session import by_session


_SCHEMAS: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver table as a DataFrame; its schema is kept for each application,
    so that only the first reference reads a footer."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.read.schema(_SCHEMAS[key]).parquet(f"{sf_dir}/{name}.parquet")


def turns_view(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """``dealt``: rows of a session together, for reports that work on sessions;
    reports on single messages, and scans by segments, take them as they lie."""
    conv = table(spark, sf_dir, "conversations")
    turns = conv.selectExpr(
        "IF(conv_id % 2 = 0, 'real', 'synthetic') AS corpus", "conv_id div 2 AS session_id", "turn", "role", "text",
        "IF((conv_id div 2) % 2 = 0, 'patientpsi', 'roleplaydoh') AS psi",
        """CASE (conv_id div 2) % 4 WHEN 0 THEN 'hosted_vllm_openai_gpt-oss-120b' WHEN 1 THEN 'openai_gpt-oss-120b'
           WHEN 2 THEN 'Qwen_Qwen3' ELSE 'hosted_vllm_Qwen_Qwen3' END AS backend_llm""")
    return by_session(turns, "corpus", "session_id") if dealt else turns


def turns_only(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    return turns_view(spark, sf_dir, dealt).select("corpus", "session_id", "turn", "role", "text")


def run_label(df: DataFrame) -> DataFrame:
    """J10 label: real stays 'real'; synthetic → ``psi-backend`` (normalised, safe)."""
    from talkframe.operators.turns import safe_name
    return df.withColumn(
        "label",
        F.when(F.col("corpus") == "real", F.lit("real"))
        .otherwise(F.concat_ws("-", F.col("psi"), safe_name(normalize_backend(F.col("backend_llm"))))))
