"""Registered queries: emotion z-scores (A19-A22) with a corpus emotion lexicon."""

from talkframe.lexicons import EMOTIONS
from talkframe.operators import emotion as E
from talkframe.plans.catalog import query
from talkframe.plans.sqlfrag import TURNS_CTE, strict_words as s_strict, strip as s_strip
from talkframe.plans.testview import turns_only

# Fixed values (ours): frequent words of the generated corpus tagged with emotions.
CORPUS_EMOTION_WORDS = [
    ("the", "anger"), ("der", "anger"), ("of", "anticipation"), ("die", "anticipation"),
    ("and", "disgust"), ("und", "disgust"), ("to", "fear"), ("zu", "fear"), ("in", "joy"), ("en", "joy"),
    ("a", "sadness"), ("la", "sadness"), ("de", "surprise"), ("le", "surprise"), ("is", "trust"),
    ("es", "trust"), ("que", "trust"), ("that", "joy"), ("that", "trust"), ("it", "fear"), ("it", "sadness"),
    ("for", "anticipation"), ("with", "trust"), ("on", "surprise"), ("was", "sadness"), ("ci", "disgust"),
]


def _lex_sql():
    vals = ", ".join(f"('{w}', '{e}')" for w, e in CORPUS_EMOTION_WORDS)
    return f"lex AS (SELECT DISTINCT * FROM (VALUES {vals}) t(word, emotion))"


def _lexicon(spark):
    return E.lexicon_table(spark, CORPUS_EMOTION_WORDS)


_PRI = ", ".join(f"count(*) FILTER (WHERE emotion = '{e}') / (SELECT count(DISTINCT word) FROM lex) AS p_{e}" for e in EMOTIONS)
_K = ", ".join(f"count(*) FILTER (WHERE list_contains(emos, '{e}')) AS k_{e}" for e in EMOTIONS)
_KC = ", ".join(f"CAST(coalesce(c.k_{e}, 0) AS BIGINT) AS k_{e}" for e in EMOTIONS)


def _z(e):
    return (f"CASE WHEN n > 0 AND p_{e} > 0 AND p_{e} < 1 THEN (k_{e} - n * p_{e}) / sqrt(n * p_{e} * (1 - p_{e})) ELSE 0.0 END")


_CTES = [
    TURNS_CTE, _lex_sql(),
    f"pri AS (SELECT {_PRI} FROM lex)",
    "pw AS (SELECT word, list(DISTINCT emotion) AS emos FROM lex GROUP BY word)",
    """seq AS (SELECT corpus, session_id, turn, coalesce(text, '') AS text,
              CAST(row_number() OVER (PARTITION BY corpus, session_id ORDER BY turn) - 1 AS BIGINT) AS idx FROM turns WHERE lower(role) = 'assistant')""",
    # unnest in FROM (not in the select list): DuckDB 2.0 mis-binds filters pushed
    # through a select-list unnest
    f"""tok AS (SELECT corpus, session_id, idx, u.word FROM (SELECT *, {s_strict('text')} AS ws FROM seq WHERE length({s_strip('text')}) >= 2) q,
               unnest(q.ws) AS u(word))""",
    f"""cnt AS (SELECT corpus, session_id, idx, count(*) AS n, {_K} FROM tok JOIN pw USING (word) GROUP BY ALL)""",
    f"""mc AS (SELECT s.corpus, s.session_id, s.idx, CAST(coalesce(c.n, 0) AS BIGINT) AS n, {_KC}
             FROM seq s LEFT JOIN cnt c ON s.corpus = c.corpus AND s.session_id = c.session_id AND s.idx = c.idx)""",
    f"""z AS (SELECT corpus, session_id, idx, {', '.join(_z(e) + ' AS ' + e for e in EMOTIONS)} FROM mc, pri)""",
]


def _sql(select):
    return "WITH " + ",\n".join(_CTES) + "\n" + select


_ZR = ", ".join(f"round({e}, 6) AS {e}" for e in EMOTIONS)


@query("a19_turn_emotions", _sql(f"SELECT corpus, session_id, idx, {_ZR} FROM z"))
def a19_turn_emotions(spark, sf_dir):
    """Eight emotion z-scores per patient turn (lexicon form)."""
    return E.turn_emotions(turns_only(spark, sf_dir), _lexicon(spark))


@query("a20_global_intensity", _sql(f"""SELECT corpus, {', '.join(f'round(avg({e}), 6) AS {e}' for e in EMOTIONS)} FROM (
  SELECT corpus, session_id, {', '.join(f'avg({e}) AS {e}' for e in EMOTIONS)} FROM z GROUP BY corpus, session_id) GROUP BY corpus"""))
def a20_global_intensity(spark, sf_dir):
    """Mean of session means per emotion and corpus."""
    return E.global_intensity(E.turn_emotions(turns_only(spark, sf_dir), _lexicon(spark)))


_LONG = " UNION ALL ".join(f"SELECT corpus, session_id, idx, '{e}' AS emotion, {e} AS z FROM z" for e in EMOTIONS)


@query("a21_emotion_timeline", _sql(f"""SELECT corpus, emotion, idx, round(avg(z), 6) AS mean_z FROM ({_LONG}) lz
WHERE idx < 15 AND EXISTS (SELECT 1 FROM z a JOIN z b ON a.session_id = b.session_id AND a.idx = b.idx
                           WHERE a.corpus = 'real' AND b.corpus = 'synthetic' AND a.session_id = lz.session_id AND a.idx = lz.idx)
GROUP BY corpus, emotion, idx"""))
def a21_emotion_timeline(spark, sf_dir):
    """Per-turn mean z after pairwise min-length truncation, first 15 turns."""
    return E.emotion_timeline(E.turn_emotions(turns_only(spark, sf_dir), _lexicon(spark)))


_BK = ", ".join(f"sum(k_{e}) AS k_{e}" for e in EMOTIONS)
_BL = " UNION ALL ".join(f"SELECT corpus, bucket, {i} AS emotion_order, '{e}' AS emotion, {_z(e)} AS z FROM pooled, pri"
                         for i, e in enumerate("joy trust fear surprise sadness disgust anger anticipation".split()))


@query("a22_bucket_scores", _sql(f"""SELECT corpus, bucket, emotion_order, emotion, round(z, 6) AS z, round(abs(z), 6) AS abs_z,
  abs(z) >= 1.96 AS significant FROM (
  WITH pooled AS (SELECT corpus, CAST(idx // 3 AS BIGINT) AS bucket, sum(n) AS n, {_BK} FROM mc WHERE idx < 15 GROUP BY ALL)
  {_BL})"""))
def a22_bucket_scores(spark, sf_dir):
    """Pooled 3-turn bucket z-scores, |z|, significance at 1.96, fixed order."""
    return E.bucket_scores(turns_only(spark, sf_dir), _lexicon(spark))
