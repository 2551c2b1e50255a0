"""Registered queries: lexical diversity (A42-A49, W5) with a DuckDB
recursive-CTE MTLD as the oracle."""

from pyspark.sql import functions as F

from talkframe.functions.mtld import mtld_udf
from talkframe.lexicons import STRICT_DISFLUENCIES
from talkframe.operators import diversity as D
from talkframe.plans.catalog import query
from talkframe.plans.sqlfrag import TURNS_CTE, strict_words as s_strict
from talkframe.plans.testview import turns_only

_STRICT = "[" + ", ".join(f"'{w}'" for w in STRICT_DISFLUENCIES) + "]"
_W = f"list_filter({s_strict('text')}, lambda x: NOT list_contains({_STRICT}, x))"
_SPK = "CASE corpus WHEN 'real' THEN 'Real' WHEN 'synthetic' THEN 'Synthetic' ELSE corpus END"


def mtld_ctes(docs: str = "docs") -> list[str]:
    """CTEs turning ``docs(doc, w)`` into ``mt(doc, mtld)`` by a recursive fold."""
    nxt = "d.w[r.i + 1]"
    s2 = f"(CASE WHEN list_contains(r.seen, {nxt}) THEN r.seen ELSE list_append(r.seen, {nxt}) END)"
    ttr2 = f"(len({s2}) / (r.cnt + 1))"
    return [
        f"""d AS (SELECT doc, dir, CASE WHEN dir = 0 THEN w ELSE list_reverse(w) END AS w, len(w) AS n
              FROM {docs} CROSS JOIN (VALUES (0), (1)) t(dir) WHERE len(w) > 0)""",
        f"""r(doc, dir, i, seen, cnt, factors, ttr) AS (
              SELECT doc, dir, 0, CAST([] AS VARCHAR[]), 0, CAST(0.0 AS DOUBLE), CAST(1.0 AS DOUBLE) FROM d
              UNION ALL
              SELECT r.doc, r.dir, r.i + 1,
                     CASE WHEN {ttr2} <= 0.72 THEN CAST([] AS VARCHAR[]) ELSE {s2} END,
                     CASE WHEN {ttr2} <= 0.72 THEN 0 ELSE r.cnt + 1 END,
                     r.factors + CASE WHEN {ttr2} <= 0.72 THEN 1 ELSE 0 END,
                     {ttr2}
              FROM r JOIN d ON r.doc = d.doc AND r.dir = d.dir WHERE r.i < d.n)""",
        """fin AS (SELECT r.doc, r.dir, d.n, r.factors + CASE WHEN r.cnt > 0 THEN (1 - r.ttr) / (1 - 0.72) ELSE 0 END AS f,
                   len(list_distinct(d.w)) / d.n AS whole FROM r JOIN d ON r.doc = d.doc AND r.dir = d.dir WHERE r.i = d.n)""",
        """mt AS (SELECT doc, sum(n / CASE WHEN f = 0 THEN CASE WHEN whole = 1 THEN 1.0 ELSE (1 - whole) / (1 - 0.72) END ELSE f END) / 2.0 AS mtld
                  FROM fin GROUP BY doc)""",
    ]


_BASE = [
    f"""msgs AS (SELECT corpus, session_id, turn, {_W} AS w,
          row_number() OVER (PARTITION BY corpus, session_id ORDER BY turn) AS turn_index FROM turns WHERE role = 'assistant')""",
    """pairs AS (SELECT session_id FROM turns GROUP BY session_id
          HAVING max(CASE WHEN corpus = 'real' THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN corpus = 'synthetic' THEN 1 ELSE 0 END) = 1)""",
    """sw AS (SELECT p.session_id, c.corpus, coalesce(x.w, CAST([] AS VARCHAR[])) AS w
          FROM pairs p CROSS JOIN (VALUES ('real'), ('synthetic')) c(corpus)
          LEFT JOIN (SELECT corpus, session_id, flatten(list(w ORDER BY turn)) AS w FROM msgs GROUP BY corpus, session_id) x
            ON x.session_id = p.session_id AND x.corpus = c.corpus)""",
    f"""raw AS (SELECT session_id, {_SPK} AS speaker_type, 'Raw' AS analysis_type, CAST(-1 AS BIGINT) AS turn_index, w,
               len(w) >= 100 AS meets_threshold FROM sw)""",
    f"""matched AS (SELECT l.session_id, {_SPK.replace('corpus', 'c.corpus')} AS speaker_type, 'Matched' AS analysis_type, CAST(-1 AS BIGINT) AS turn_index,
               CASE c.corpus WHEN 'real' THEN l.w[1:least(len(l.w), len(r.w))] ELSE r.w[1:least(len(l.w), len(r.w))] END AS w,
               least(len(l.w), len(r.w)) >= 100 AS meets_threshold
             FROM sw l JOIN sw r ON l.session_id = r.session_id AND l.corpus = 'real' AND r.corpus = 'synthetic'
             CROSS JOIN (VALUES ('real'), ('synthetic')) c(corpus) WHERE len(l.w) > 0 AND len(r.w) > 0)""",
    f"""cumul AS (SELECT session_id, {_SPK} AS speaker_type, 'Cumulative' AS analysis_type, CAST(turn_index AS BIGINT) AS turn_index, cw AS w,
               len(cw) >= 100 AS meets_threshold FROM (
               SELECT *, flatten(list(w) OVER (PARTITION BY corpus, session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS cw
               FROM msgs WHERE session_id IN (SELECT session_id FROM pairs)) WHERE len(w) > 0)""",
    f"""turnl AS (SELECT session_id, {_SPK} AS speaker_type, 'Turn-Level' AS analysis_type, CAST(turn_index AS BIGINT) AS turn_index, w,
               len(w) >= 100 AS meets_threshold FROM (
                 SELECT * REPLACE (CASE WHEN corpus = 'real' THEN session_id ELSE session_id - 1 END AS session_id) FROM msgs)
               WHERE len(w) > 0 AND session_id IN (SELECT session_id FROM pairs))""",
    "{ALLR}",
    """docs AS (SELECT DISTINCT w AS doc, w FROM allr)""",
]
_STRATS = {"Raw": "raw", "Matched": "matched", "Cumulative": "cumul", "Turn-Level": "turnl"}


_RESULTS = """res AS (SELECT a.session_id, a.speaker_type, a.analysis_type, a.turn_index, CAST(len(a.w) AS BIGINT) AS token_count,
   mt.mtld, a.meets_threshold FROM allr a LEFT JOIN mt ON mt.doc = a.w)"""


def _res_sql(select, *extra, strategies=tuple(_STRATS)):
    """Oracle over the chosen strategies only (MTLD is folded just for their texts)."""
    allr = "allr AS (" + " UNION ALL ".join(f"SELECT * FROM {_STRATS[x]}" for x in strategies) + ")"
    base = [allr if c == "{ALLR}" else c for c in _BASE]
    return "WITH RECURSIVE " + ",\n".join([TURNS_CTE] + base + mtld_ctes() + [_RESULTS, *extra]) + "\n" + select


def _results(spark, sf_dir):
    t = turns_only(spark, sf_dir)
    # the turn variant of a session is the synthetic talk of the next one
    variant = t.where(F.col("corpus") == "synthetic").withColumn("session_id", F.col("session_id") - 1)
    return D.lexical_diversity(t, variant_turns=variant)


_COLS = "session_id, speaker_type, analysis_type, turn_index, token_count, round(mtld, 6) AS mtld, meets_threshold"


@query("a42_message_mtld", "WITH RECURSIVE " + ",\n".join([TURNS_CTE, _BASE[0], "docs AS (SELECT DISTINCT w AS doc, w FROM msgs)"] + mtld_ctes()) + """
SELECT corpus, session_id, turn, CAST(len(w) AS BIGINT) AS token_count, round(mt.mtld, 6) AS mtld FROM msgs LEFT JOIN mt ON mt.doc = msgs.w""")
def a42_message_mtld(spark, sf_dir):
    """Bidirectional MTLD (threshold 0.72) of every patient message (null when empty)."""
    m = D.message_words(turns_only(spark, sf_dir))
    return m.select("corpus", "session_id", "turn", F.size("words").cast("bigint").alias("token_count"),
                    mtld_udf("words").alias("mtld"))


@query("a43_raw_strategy", _res_sql(f"SELECT {_COLS} FROM res WHERE analysis_type = 'Raw'", strategies=("Raw",)))
def a43_raw_strategy(spark, sf_dir):
    """MTLD of each paired session's whole patient text."""
    return _results(spark, sf_dir).where(F.col("analysis_type") == "Raw")


@query("a44_matched_strategy", _res_sql(f"SELECT {_COLS} FROM res WHERE analysis_type = 'Matched'", strategies=("Matched",)))
def a44_matched_strategy(spark, sf_dir):
    """Both sides truncated to the shorter length."""
    return _results(spark, sf_dir).where(F.col("analysis_type") == "Matched")


@query("a45_cumulative_strategy", _res_sql(f"SELECT {_COLS} FROM res WHERE analysis_type = 'Cumulative'", strategies=("Cumulative",)))
def a45_cumulative_strategy(spark, sf_dir):
    """MTLD after each non-empty patient message."""
    return _results(spark, sf_dir).where(F.col("analysis_type") == "Cumulative")


@query("a46_turn_level_strategy", _res_sql(f"SELECT {_COLS} FROM res WHERE analysis_type = 'Turn-Level'", strategies=("Turn-Level",)))
def a46_turn_level_strategy(spark, sf_dir):
    """Per-message MTLD (synthetic side from the turn variant)."""
    return _results(spark, sf_dir).where(F.col("analysis_type") == "Turn-Level")


_BOX_Q = """q AS (SELECT analysis_type, speaker_type, count(DISTINCT session_id) AS sessions,
          quantile_cont(mtld, 0.25) AS q1, quantile_cont(mtld, 0.5) AS median, quantile_cont(mtld, 0.75) AS q3
        FROM res WHERE mtld IS NOT NULL GROUP BY ALL)"""


@query("a47_box_summary", _res_sql("""
SELECT q.analysis_type, q.speaker_type, q.sessions, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(CASE WHEN mtld >= q1 - 1.5 * (q3 - q1) THEN mtld END), 6) AS whisker_low,
       round(max(CASE WHEN mtld <= q3 + 1.5 * (q3 - q1) THEN mtld END), 6) AS whisker_high
FROM res JOIN q ON res.analysis_type = q.analysis_type AND res.speaker_type = q.speaker_type
WHERE mtld IS NOT NULL GROUP BY q.analysis_type, q.speaker_type, q.sessions, q1, median, q3""", _BOX_Q))
def a47_box_summary(spark, sf_dir):
    """Quartiles, 1.5-IQR whiskers and session counts per strategy × speaker."""
    return D.box_summary(_results(spark, sf_dir))


@query("a48_cumulative_means", _res_sql("""
SELECT speaker_type, turn_index, round(avg(mtld), 6) AS mean_mtld, count(*) AS sessions FROM res
WHERE analysis_type = 'Cumulative' GROUP BY speaker_type, turn_index""", strategies=("Cumulative",)))
def a48_cumulative_means(spark, sf_dir):
    return D.cumulative_means(_results(spark, sf_dir))


@query("a49_length_points", _res_sql("""
SELECT session_id, speaker_type, token_count, round(mtld, 6) AS mtld, meets_threshold FROM res WHERE analysis_type = 'Raw'""", strategies=("Raw",)))
def a49_length_points(spark, sf_dir):
    return D.length_points(_results(spark, sf_dir))
