"""Registered queries: turn normalisation, projections and windows
(P1-P5, P7-P11, P17-P21, P24, P28, P29, W2, W4)."""

from pyspark.sql import functions as F

from talkframe.functions.text import approx_tokens, clean_words, strict_words, word_count, words
from talkframe.lexicons import ENGLISH_STOP_WORDS, STRICT_DISFLUENCIES
from talkframe.operators import turns as T
from talkframe.operators.replies import parse_letter, split_thinking
from talkframe.plans.catalog import query
from talkframe.plans.sqlfrag import (PATIENT_TURNS_CTE, approx_tokens as s_tok, strip as s_strip,
                                     strict_words as s_strict, with_turns, word_count as s_wc, words as s_words)
from talkframe.plans.testview import turns_only

NL = "chr(10)"


def _sql_list(items):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in items) + "]"


# --- P1 ------------------------------------------------------------------
_P1_SQL = with_turns("""m AS (SELECT corpus, session_id, turn, CASE WHEN role = 'system' THEN 'user' ELSE role END AS role, text FROM turns)""",
                     """f AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY corpus, session_id ORDER BY turn) IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS nw FROM m)""",
                     """i AS (SELECT *, sum(nw) OVER (PARTITION BY corpus, session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f)""") + f"""
SELECT corpus, session_id, CAST(island - 1 AS BIGINT) AS turn, first(role) AS role,
       string_agg(coalesce(text, ''), {NL} ORDER BY turn) AS text, count(*) AS n_merged
FROM i GROUP BY corpus, session_id, island"""


@query("p1_merge_consecutive", _P1_SQL)
def p1_merge_consecutive(spark, sf_dir):
    """System rows act as therapist, then same-role runs are merged."""
    t = turns_only(spark, sf_dir, dealt=False).withColumn(
        "role", F.when(F.col("role") == "system", "user").otherwise(F.col("role")))
    return T.merge_consecutive(t)


# --- P2 / P3 / W1 ----------------------------------------------------------
_P2A_SQL = with_turns() + f"""
SELECT corpus, session_id, turn, {s_strip('text')} AS text FROM turns
WHERE role = 'assistant' AND length({s_strip('text')}) > 0"""


@query("p2a_patient_messages", _P2A_SQL)
def p2a_patient_messages(spark, sf_dir):
    return T.patient_messages(turns_only(spark, sf_dir, dealt=False)).select("corpus", "session_id", "turn", "text")


_P2B_SQL = with_turns() + """
SELECT corpus, session_id, turn, coalesce(text, '') AS text FROM turns WHERE lower(role) = 'assistant'"""


@query("p2b_patient_messages_raw", _P2B_SQL)
def p2b_patient_messages_raw(spark, sf_dir):
    return T.patient_messages_raw(turns_only(spark, sf_dir, dealt=False)).select("corpus", "session_id", "turn", "text")


_P2D_SQL = with_turns() + """
SELECT corpus, session_id, CAST(sum(CASE WHEN role IN ('assistant', 'patient') THEN 1 ELSE 0 END) AS BIGINT) AS n_patient
FROM turns GROUP BY corpus, session_id"""


@query("p2d_patient_role_count", _P2D_SQL)
def p2d_patient_role_count(spark, sf_dir):
    t = turns_only(spark, sf_dir, dealt=False)
    return t.groupBy("corpus", "session_id").agg(F.sum(T.is_patient_role().cast("bigint")).alias("n_patient"))


_P3_SQL = with_turns(PATIENT_TURNS_CTE) + """
SELECT corpus, session_id, turn, text, CAST(patient_idx AS BIGINT) AS patient_idx FROM pt WHERE patient_idx < 3"""


@query("p3_patient_turn_index", _P3_SQL)
def p3_patient_turn_index(spark, sf_dir):
    """0-based index over non-empty patient messages, max_turns = 3."""
    return T.patient_turns(turns_only(spark, sf_dir, dealt=False), max_turns=3).select(
        "corpus", "session_id", "turn", "text", "patient_idx")


# --- P4 / P5 ---------------------------------------------------------------
_P4_SQL = with_turns() + """
SELECT corpus, session_id, turn,
  CASE WHEN role = 'user' THEN 'THERAPIST' ELSE 'PATIENT' END AS judge_role,
  CASE WHEN role = 'user' THEN 'Therapist' WHEN role = 'assistant' THEN 'Client'
       WHEN coalesce(role, '') = '' THEN 'Unknown' ELSE upper(substr(role, 1, 1)) || lower(substr(role, 2)) END AS client_role,
  replace(replace(role, 'user', 'therapist'), 'assistant', 'patient') AS plain_role,
  CASE WHEN role = 'assistant' THEN 'User' ELSE 'Assistant' END AS swapped_role
FROM turns"""


@query("p4_role_relabel", _P4_SQL)
def p4_role_relabel(spark, sf_dir):
    t = turns_only(spark, sf_dir, dealt=False)
    r = F.col("role")
    return t.select("corpus", "session_id", "turn",
                    T.relabel_role(r, "judge").alias("judge_role"), T.relabel_role(r, "client").alias("client_role"),
                    T.relabel_role(r, "plain").alias("plain_role"), T.relabel_role(r, "swapped").alias("swapped_role"))


_P5_SQL = with_turns() + """
SELECT corpus, session_id, turn, upper(role) AS role,
       regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM turns"""


@query("p5_format_messages", _P5_SQL)
def p5_format_messages(spark, sf_dir):
    return T.format_messages(turns_only(spark, sf_dir, dealt=False)).select("corpus", "session_id", "turn", "role", "text")


# --- P7 / P8 / P9 / P10 ------------------------------------------------------
_STRICT = _sql_list(STRICT_DISFLUENCIES)
_P7_SQL = with_turns() + f"""
SELECT corpus, session_id, turn,
       array_to_string(list_filter({s_strict('text')}, lambda w: NOT list_contains({_STRICT}, w)), ' ') AS clean_text,
       CAST(len(list_filter({s_strict('text')}, lambda w: NOT list_contains({_STRICT}, w))) AS BIGINT) AS n_words
FROM turns WHERE lower(role) = 'assistant'"""


@query("p7_strict_preprocess", _P7_SQL)
def p7_strict_preprocess(spark, sf_dir):
    """Lower, drop non-word punctuation, split, drop strict disfluencies."""
    t = T.patient_messages_raw(turns_only(spark, sf_dir, dealt=False)).withColumn("_w", strict_words("text", STRICT_DISFLUENCIES))
    return t.select("corpus", "session_id", "turn", F.array_join("_w", " ").alias("clean_text"),
                    F.size("_w").cast("bigint").alias("n_words"))


_STOP = _sql_list(ENGLISH_STOP_WORDS)
_PUNCT = "'" + __import__("string").punctuation.replace("'", "''") + "'"
_P8_SQL = with_turns() + f"""
SELECT corpus, session_id, turn,
       array_to_string(list_filter({s_words(f"translate(lower(text), {_PUNCT}, '')")}, lambda w: NOT list_contains({_STOP}, w)), ' ') AS clean_text
FROM turns"""


@query("p8_similarity_clean", _P8_SQL)
def p8_similarity_clean(spark, sf_dir):
    """Lower, drop ASCII punctuation, drop English stop words."""
    t = turns_only(spark, sf_dir, dealt=False)
    return t.select("corpus", "session_id", "turn",
                    F.array_join(clean_words("text", ENGLISH_STOP_WORDS), " ").alias("clean_text"))


_P9_SQL = with_turns() + f"""
SELECT corpus, session_id, turn, {s_wc('text')} AS n_words, {s_tok('text')} AS n_tokens FROM turns"""


@query("p9_word_token_counts", _P9_SQL)
def p9_word_token_counts(spark, sf_dir):
    t = turns_only(spark, sf_dir, dealt=False)
    return t.select("corpus", "session_id", "turn", word_count("text").alias("n_words"),
                    approx_tokens("text").alias("n_tokens"))


_P10_SQL = with_turns() + f"""
SELECT corpus, session_id, turn, array_to_string({s_words('text')}[1:10], ' ') AS head_text FROM turns WHERE role = 'assistant'"""


@query("p10_truncate_tokens", _P10_SQL)
def p10_truncate_tokens(spark, sf_dir):
    """P10: first 10 whitespace tokens of each patient message."""
    t = turns_only(spark, sf_dir, dealt=False).where(F.col("role") == "assistant")
    return t.select("corpus", "session_id", "turn", F.array_join(F.slice(words("text"), 1, 10), " ").alias("head_text"))


# --- P11 ---------------------------------------------------------------------
_P11_SQL = with_turns() + """,
c AS (SELECT corpus, session_id, count(*) AS n FROM turns WHERE lower(role) = 'assistant' GROUP BY corpus, session_id)
SELECT r.session_id, CAST(r.n AS BIGINT) AS n_real, CAST(s.n AS BIGINT) AS n_synthetic
FROM c r JOIN c s ON r.session_id = s.session_id AND r.corpus = 'real' AND s.corpus = 'synthetic'
WHERE r.n BETWEEN 2 AND 3 AND s.n BETWEEN 2 AND 3"""


@query("p11_turn_count_range", _P11_SQL)
def p11_turn_count_range(spark, sf_dir):
    """Sessions whose patient-message count is in [2, 3] on both sides."""
    return T.sessions_in_turn_range(turns_only(spark, sf_dir, dealt=False), turn_min=2, turn_max=3)


# --- P17 / P18 / P19 ---------------------------------------------------------
_P17_SQL = with_turns(f"""k AS (SELECT *, row_number() OVER (PARTITION BY corpus, session_id ORDER BY turn) AS rn
  FROM turns WHERE length({s_strip('text')}) > 0)""", "sess AS (SELECT DISTINCT corpus, session_id FROM turns)") + f"""
SELECT s.corpus, s.session_id,
  coalesce(string_agg(CASE WHEN role = 'user' THEN 'THERAPIST' ELSE 'PATIENT' END || ': ' || text, {NL} ORDER BY turn)
    FILTER (WHERE rn <= 32), '') AS transcript,
  count(rn) AS n_messages
FROM sess s LEFT JOIN k ON s.corpus = k.corpus AND s.session_id = k.session_id GROUP BY ALL"""


@query("p17_transcripts", _P17_SQL)
def p17_transcripts(spark, sf_dir):
    """Judge transcript (THERAPIST/PATIENT lines, empties skipped, limit 32)."""
    return T.transcripts(turns_only(spark, sf_dir, dealt=False), history_limit=32)


_P18_SQL = with_turns(f"""b AS (
  SELECT *, {s_tok('text')} AS msg_tokens,
    count(*) OVER (PARTITION BY corpus, session_id) AS n_messages,
    sum(length(coalesce(text, ''))) OVER (PARTITION BY corpus, session_id) // 4 AS total_tokens,
    sum({s_tok('text')}) OVER (PARTITION BY corpus, session_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
  FROM turns)""", """k AS (SELECT *, (n_messages > 4 AND total_tokens > 150) AS truncated FROM b
  WHERE NOT (n_messages > 4 AND total_tokens > 150) OR running <= 150)""") + f"""
SELECT corpus, session_id,
  CASE WHEN count(*) < max(n_messages) THEN '[Earlier messages truncated...]' || {NL} ELSE '' END ||
  string_agg(upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ': ' || text, {NL} ORDER BY turn) AS history
FROM k GROUP BY corpus, session_id"""


@query("p18_context_budget", _P18_SQL)
def p18_context_budget(spark, sf_dir):
    """Newest suffix within 150 tokens when a session has > 4 messages."""
    kept = T.context_budget(turns_only(spark, sf_dir, dealt=False), budget_tokens=150, min_messages=4)
    return T.render_history(kept)


_P19_SQL = with_turns() + """
SELECT corpus, session_id, count(*) AS n_messages, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars,
       CAST(sum(length(coalesce(text, ''))) // 4 AS BIGINT) AS approx_tokens
FROM turns GROUP BY corpus, session_id"""


@query("p19_prompt_size", _P19_SQL)
def p19_prompt_size(spark, sf_dir):
    return T.prompt_size(turns_only(spark, sf_dir, dealt=False))


# --- P20 / P21 ---------------------------------------------------------------
_P20_SQL = with_turns() + f"""
SELECT corpus, session_id, turn,
  CASE WHEN regexp_matches(text, '(?i)</think>') THEN {s_strip("regexp_extract(text, '(?is)^(.*?)</think>', 1)")} END AS thinking,
  CASE WHEN regexp_matches(text, '(?i)</think>') THEN {s_strip("regexp_extract(text, '(?is)</think>(.*)$', 1)")}
       ELSE {s_strip('text')} END AS response
FROM (SELECT * REPLACE (CASE WHEN turn % 3 = 0 THEN text || ' </Think> so ' || role || ' </think>' ELSE text END AS text) FROM turns) t"""


@query("p20_split_thinking", _P20_SQL)
def p20_split_thinking(spark, sf_dir):
    """P20: split each text at the first ``</think>`` into thinking / response; every
    third turn gets one written in."""
    t = turns_only(spark, sf_dir, dealt=False)
    tagged = F.concat("text", F.lit(" </Think> so "), "role", F.lit(" </think>"))
    return t.select("corpus", "session_id", "turn", *split_thinking(F.when(F.col("turn") % 3 == 0, tagged).otherwise(F.col("text"))))


_P21_SQL = with_turns() + f"""
SELECT * FROM (
  SELECT corpus, session_id, turn,
    CASE WHEN contains(upper({s_strip('text')}), 'P') THEN 'P' WHEN contains(upper({s_strip('text')}), 'T') THEN 'T'
         WHEN contains(upper({s_strip('text')}), 'C') THEN 'C' WHEN contains(upper({s_strip('text')}), 'F') THEN 'F' END AS label
  FROM turns WHERE role = 'assistant') WHERE label IS NOT NULL"""


@query("p21_parse_letter", _P21_SQL)
def p21_parse_letter(spark, sf_dir):
    """First of P, T, C, F occurring in the upper-cased reply; others dropped.
    The patient texts stand in for free-form judge replies."""
    t = turns_only(spark, sf_dir, dealt=False).where(F.col("role") == "assistant")
    return (t.select("corpus", "session_id", "turn", parse_letter(F.col("text")).alias("label"))
            .where(F.col("label").isNotNull()))


# --- P24 / P28 / P29 ---------------------------------------------------------
_P24_SQL = with_turns(PATIENT_TURNS_CTE) + """
SELECT corpus, session_id, CAST(patient_idx AS BIGINT) AS patient_idx, CAST(patient_idx // 3 AS BIGINT) AS bucket
FROM pt WHERE patient_idx < 15"""


@query("p24_turn_buckets", _P24_SQL)
def p24_turn_buckets(spark, sf_dir):
    pt = T.patient_turns(turns_only(spark, sf_dir, dealt=False))
    return T.turn_buckets(pt).select("corpus", "session_id", "patient_idx", "bucket")


_P28_SQL = with_turns() + """
SELECT corpus, session_id, n_patient, first_role,
       CAST(least(n_patient, 20) - CASE WHEN first_role IN ('assistant', 'patient') THEN 1 ELSE 0 END AS BIGINT) AS turn_budget,
       first_role IN ('assistant', 'patient') AS blank_opening
FROM (SELECT corpus, session_id, CAST(sum(CASE WHEN role IN ('assistant', 'patient') THEN 1 ELSE 0 END) AS BIGINT) AS n_patient,
             arg_min(role, turn) AS first_role FROM turns GROUP BY corpus, session_id)"""


@query("p28_turn_budget", _P28_SQL)
def p28_turn_budget(spark, sf_dir):
    return T.turn_budget(turns_only(spark, sf_dir, dealt=False), max_turns=20)


_P29_SQL = with_turns("""w AS (SELECT *, lag(role) OVER s AS prev_role, lag(text) OVER s AS prev_text,
    list(CASE WHEN role = 'user' THEN 'THERAPIST' ELSE 'PATIENT' END || ': ' || text) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS h
  FROM turns WINDOW s AS (PARTITION BY corpus, session_id ORDER BY turn))""",
                      """e AS (SELECT *, row_number() OVER (PARTITION BY corpus, session_id ORDER BY turn) - 1 AS pair_idx
  FROM w WHERE role = 'assistant' AND prev_role = 'user')""") + f"""
SELECT corpus, session_id, turn, CAST(pair_idx AS BIGINT) AS pair_idx,
       coalesce(array_to_string(h, {NL}), '') AS history, CAST(coalesce(len(h), 0) AS BIGINT) AS n_history,
       prev_text AS therapist_message, text AS target
FROM e WHERE pair_idx >= 1"""


@query("p29_next_turn_examples", _P29_SQL)
def p29_next_turn_examples(spark, sf_dir):
    """Next-turn examples from the second therapist→patient pair on."""
    return T.next_turn_examples(turns_only(spark, sf_dir, dealt=False), start_turn=1)


# --- W2 / W4 -----------------------------------------------------------------
_W2_SQL = with_turns(f"""w AS (SELECT *, list(struct_pack(role := role, text := text)) OVER (PARTITION BY corpus, session_id ORDER BY turn
    ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS h FROM turns)""",
                     f"""k AS (SELECT *, list_filter(coalesce(h, []), lambda m: length({s_strip('m.text')}) > 0) AS kept FROM w
  WHERE role = 'assistant' AND length({s_strip('text')}) > 0)""") + f"""
SELECT corpus, session_id, turn, text AS message,
  CASE WHEN len(coalesce(h, [])) > 0 THEN array_to_string(list_transform(kept, lambda m: CASE WHEN m.role = 'user' THEN 'THERAPIST' ELSE 'PATIENT' END || ': ' || m.text), {NL})
       ELSE '(No previous history)' END AS history,
  CAST(len(kept) AS BIGINT) AS n_history
FROM k"""


@query("w2_history_window", _W2_SQL)
def w2_history_window(spark, sf_dir):
    """Six messages before each non-empty patient turn, empties dropped after the frame."""
    return T.history_windows(turns_only(spark, sf_dir, dealt=False), k=6)


_W4_SQL = with_turns("""w AS (SELECT *, list(coalesce(text, '')) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h,
    sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS patient_idx
  FROM turns WINDOW s AS (PARTITION BY corpus, session_id ORDER BY turn))""") + f"""
SELECT corpus, session_id, turn, CAST(patient_idx AS BIGINT) AS patient_idx, coalesce(array_to_string(h, {NL}), '') AS context, text AS response
FROM w WHERE role = 'assistant' AND patient_idx < 20"""


@query("w4_perplexity_context", _W4_SQL)
def w4_perplexity_context(spark, sf_dir):
    """All earlier contents newline-joined, first 20 patient turns."""
    return T.perplexity_contexts(turns_only(spark, sf_dir, dealt=False), max_patient_turns=20)
