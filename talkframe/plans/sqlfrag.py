"""DuckDB SQL fragments for the oracle side of every registered query.

These mirror the Spark column helpers so each oracle is an independent
re-statement of the same definition in another engine.
"""

TURNS_CTE = """turns AS (
  SELECT CASE WHEN conv_id % 2 = 0 THEN 'real' ELSE 'synthetic' END AS corpus,
         conv_id // 2 AS session_id, turn, role, text,
         CASE WHEN (conv_id // 2) % 2 = 0 THEN 'patientpsi' ELSE 'roleplaydoh' END AS psi,
         CASE (conv_id // 2) % 4 WHEN 0 THEN 'hosted_vllm_openai_gpt-oss-120b'
                                 WHEN 1 THEN 'openai_gpt-oss-120b'
                                 WHEN 2 THEN 'Qwen_Qwen3'
                                 ELSE 'hosted_vllm_Qwen_Qwen3' END AS backend_llm
  FROM conversations)"""


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '\\s+'), lambda w: w <> '')"


def word_count(x: str) -> str:
    return f"CAST(len({words(x)}) AS BIGINT)"


def approx_tokens(x: str) -> str:
    return f"CAST(length(coalesce({x}, '')) // 4 AS BIGINT)"


def ascii_safe(x: str) -> str:
    """RE2 treats non-ASCII letters as non-word characters; Java/Python do not.
    Replacing them by an ASCII letter keeps word boundaries identical."""
    return f"regexp_replace({x}, '[^\\x00-\\x7F]', 'x', 'g')"


def strict_words(x: str) -> str:
    cleaned = f"regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g')"
    return words(cleaned)


PATIENT_TURNS_CTE = """pt AS (
  SELECT corpus, session_id, turn, {strip_text} AS text,
         row_number() OVER (PARTITION BY corpus, session_id ORDER BY turn) - 1 AS patient_idx
  FROM turns WHERE role = 'assistant' AND length({strip_text}) > 0)""".format(strip_text=strip("text"))


def with_turns(*ctes: str) -> str:
    return "WITH " + ",\n".join((TURNS_CTE,) + ctes) + "\n"
