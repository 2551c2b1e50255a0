"""Fixed Spark types for the data model (no schema inference on the hot path)."""

from pyspark.sql import types as T

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])
MESSAGES = T.ArrayType(MESSAGE)

# One multi-line JSON document per session file.  profile / ccd are objects in
# the files; they are kept as JSON text (Spark renders a nested object read as a
# string column back to its JSON text) and parsed on demand with PROFILE / CCD.
SESSION_FILE = T.StructType([
    T.StructField("messages", MESSAGES),
    T.StructField("profile", T.StringType()),
    T.StructField("ccd", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("num_patient_turns", T.LongType()),
    T.StructField("_corrupt_record", T.StringType()),
])

REAL_CORPUS = T.StructType([
    T.StructField("session_id", T.LongType()),
    T.StructField("messages", MESSAGES),
    T.StructField("profile", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("id_source", T.StringType()),
])

PUBLISHED_CORPUS = T.StructType([
    T.StructField("session_id", T.LongType()),
    T.StructField("messages", T.StringType()),
    T.StructField("profile", T.StringType()),
    T.StructField("ccd", T.StringType()),
    T.StructField("psi", T.StringType()),
    T.StructField("backend_llm", T.StringType()),
    T.StructField("num_patient_turns", T.LongType()),
    T.StructField("source", T.StringType()),
])

DIALOG_TURN = T.StructType([
    T.StructField("speaker", T.StringType()),
    T.StructField("content", T.StringType()),
])
RAW_DIALOG = T.StructType([
    T.StructField("situation", T.StringType()),
    T.StructField("dialog", T.ArrayType(DIALOG_TURN)),
])
RAW_DIALOG_FILE = T.ArrayType(RAW_DIALOG)

PROFILE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("age", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("occupation", T.StringType()),
    T.StructField("marital status", T.StringType()),
    T.StructField("situation of the client", T.StringType()),
    T.StructField("counseling history", T.StringType()),
    T.StructField("resistance toward the support", T.StringType()),
    T.StructField("symptom severity", T.MapType(T.StringType(), T.StringType())),
    T.StructField("cognition distortion exhibition", T.MapType(T.StringType(), T.StringType())),
    T.StructField("depression severity", T.StringType()),
    T.StructField("suicidal ideation severity", T.StringType()),
    T.StructField("homicidal ideation severity", T.StringType()),
])

COGNITIVE_MODEL = T.StructType([
    T.StructField("situation", T.StringType()),
    T.StructField("automatic_thoughts", T.StringType()),
    T.StructField("emotion", T.StringType()),
    T.StructField("behavior", T.StringType()),
])
CCD = T.StructType([
    T.StructField("life_history", T.StringType()),
    T.StructField("core_beliefs", T.StringType()),
    T.StructField("core_belief_description", T.StringType()),
    T.StructField("intermediate_beliefs", T.StringType()),
    T.StructField("intermediate_beliefs_during_depression", T.StringType()),
    T.StructField("coping_strategies", T.StringType()),
    T.StructField("cognitive_models", T.ArrayType(COGNITIVE_MODEL)),
])

LABEL_ITEM = T.StructType([
    T.StructField("content", T.StringType()),
    T.StructField("classification", T.StringType()),
])

TURNS_DDL = "corpus string, session_id bigint, turn bigint, role string, text string"
