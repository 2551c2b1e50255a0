"""Registered queries: message lengths."""

from pyspark.sql import functions as F

from talkframe.operators.lengths import compare_turn_lengths, turn_lengths
from talkframe.operators.turns import normalize_backend, safe_name
from talkframe.plans.catalog import query
from talkframe.plans.sqlfrag import PATIENT_TURNS_CTE, approx_tokens, with_turns, word_count
from talkframe.plans.testview import run_label, turns_only, turns_view

_A1_SQL = with_turns(PATIENT_TURNS_CTE) + f"""
SELECT corpus, patient_idx AS turn, count(*) AS count,
       round(avg({word_count('text')}), 6) AS avg_words,
       round(stddev_pop({word_count('text')}), 6) AS std_words,
       round(avg({approx_tokens('text')}), 6) AS avg_tokens,
       round(stddev_pop({approx_tokens('text')}), 6) AS std_tokens
FROM pt GROUP BY corpus, patient_idx"""


@query("a1_turn_lengths", _A1_SQL)
def a1_turn_lengths(spark, sf_dir):
    """A1: per corpus and patient turn, count and mean/std of words and tokens."""
    return turn_lengths(turns_only(spark, sf_dir, dealt=False))


_J4_SQL = with_turns(PATIENT_TURNS_CTE) + f""",
st AS (SELECT corpus, patient_idx AS turn, count(*) AS c,
              avg({word_count('text')}) AS w, avg({approx_tokens('text')}) AS t
       FROM pt GROUP BY corpus, patient_idx),
s AS (SELECT * FROM st WHERE corpus = 'synthetic'),
r AS (SELECT * FROM st WHERE corpus = 'real')
SELECT coalesce(s.turn, r.turn) AS turn,
       CAST(coalesce(s.c, 0) AS BIGINT) AS synthetic_count, CAST(coalesce(r.c, 0) AS BIGINT) AS real_count,
       round(s.w, 6) AS synthetic_avg_words, round(r.w, 6) AS real_avg_words, round(s.w - r.w, 6) AS words_diff,
       round(s.t, 6) AS synthetic_avg_tokens, round(r.t, 6) AS real_avg_tokens, round(s.t - r.t, 6) AS tokens_diff
FROM s FULL OUTER JOIN r ON s.turn = r.turn"""


@query("j4_compare_turn_lengths", _J4_SQL)
def j4_compare_turn_lengths(spark, sf_dir):
    """J4 (flagship): synthetic vs real per-turn lengths, full outer on turn."""
    return compare_turn_lengths(turn_lengths(turns_only(spark, sf_dir, dealt=False)))


_LABEL = """CASE WHEN corpus = 'real' THEN 'real' ELSE psi || '-' ||
  translate(regexp_replace(regexp_replace(backend_llm, '^hosted_vllm_', ''), '^(openai_|Qwen_|meta-llama_|llama_)', ''), '/: ', '___') END"""

_A2_SQL = with_turns(f"""lt AS (SELECT *, {_LABEL} AS label FROM turns)""", PATIENT_TURNS_CTE.replace("FROM turns", "FROM lt").replace(
    "SELECT corpus,", "SELECT label, corpus,")) + f"""
SELECT label, patient_idx AS turn, count(*) AS count,
       round(avg({word_count('text')}), 6) AS avg_words, round(stddev_pop({word_count('text')}), 6) AS std_words,
       round(avg({approx_tokens('text')}), 6) AS avg_tokens, round(stddev_pop({approx_tokens('text')}), 6) AS std_tokens
FROM pt GROUP BY label, patient_idx"""


@query("a2_label_turn_lengths", _A2_SQL)
def a2_label_turn_lengths(spark, sf_dir):
    """A2 + J10: one groupBy over the union labelled real / psi-backend."""
    return turn_lengths(run_label(turns_view(spark, sf_dir, dealt=False)), by="label")


_J11_SQL = with_turns() + """
SELECT DISTINCT psi, regexp_replace(regexp_replace(backend_llm, '^hosted_vllm_', ''),
       '^(openai_|Qwen_|meta-llama_|llama_)', '') AS backend
FROM turns WHERE corpus = 'synthetic'"""


@query("j11_psi_backend_pairs", _J11_SQL)
def j11_psi_backend_pairs(spark, sf_dir):
    """J11 + P6: distinct (psi, normalised backend) pairs of the synthetic corpus."""
    t = turns_view(spark, sf_dir, dealt=False).where(F.col("corpus") == "synthetic")
    return t.select("psi", normalize_backend(F.col("backend_llm")).alias("backend")).distinct()


_P6_SQL = with_turns() + """
SELECT DISTINCT backend_llm,
       regexp_replace(regexp_replace(backend_llm, '^hosted_vllm_', ''), '^(openai_|Qwen_|meta-llama_|llama_)', '') AS backend,
       translate(backend_llm, '/: ', '___') AS safe
FROM turns"""


@query("p6_backend_names", _P6_SQL)
def p6_backend_names(spark, sf_dir):
    """Backend name normalisation and safe names."""
    t = turns_view(spark, sf_dir, dealt=False)
    return t.select("backend_llm", normalize_backend(F.col("backend_llm")).alias("backend"),
                    safe_name(F.col("backend_llm")).alias("safe")).distinct()


_J10_SQL = with_turns(f"""lt AS (SELECT *, {_LABEL} AS label FROM turns)""") + """
SELECT label, count(DISTINCT session_id) AS sessions, count(*) AS messages FROM lt GROUP BY label"""


@query("j10_corpus_union", _J10_SQL)
def j10_corpus_union(spark, sf_dir):
    """Corpora union with a run label; sessions and messages per label."""
    t = run_label(turns_view(spark, sf_dir, dealt=False))
    return t.groupBy("label").agg(F.countDistinct("session_id").alias("sessions"),
                                  F.count(F.lit(1)).alias("messages"))
