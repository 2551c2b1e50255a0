"""Registered queries: score series (A37-A41) — the n-gram turn scorer on the
conversations, and the ``events`` table as a score series
(session = user_id, idx = order by ts, event_id; score = value)."""

from pyspark.sql import functions as F

from talkframe.functions.positions import positions
from talkframe.operators import scores as SC
from talkframe.plans.catalog import query
from talkframe.plans.sqlfrag import TURNS_CTE, strict_words as s_strict
from talkframe.plans.testview import table, turns_only


def event_scores(spark, sf_dir):
    """Score series: position by (ts, event_id) within each user, computed with
    range partitioning so a user holding a third of the events is not ranked by
    one task."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    p = positions(e, ["user_id"], ["ts", "event_id"])
    return p.select(F.col("user_id").alias("session_id"), "idx", F.col("value").alias("score"))


_EV = """ev AS (SELECT user_id AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx,
                value AS score FROM events)"""


@query("a38_score_summary", f"""WITH {_EV},
conv AS (SELECT session_id, avg(score) AS m FROM ev GROUP BY session_id)
SELECT (SELECT count(DISTINCT session_id) FROM ev) AS num_conversations, (SELECT count(*) FROM conv) AS num_conversations_processed,
       count(*) AS num_turns, round(coalesce((SELECT avg(m) FROM conv), 0.0), 6) AS conversation_avg,
       round(coalesce((SELECT min(m) FROM conv), 0.0), 6) AS conversation_min, round(coalesce((SELECT max(m) FROM conv), 0.0), 6) AS conversation_max,
       round(coalesce(avg(score), 0.0), 6) AS turn_avg, round(coalesce(min(score), 0.0), 6) AS turn_min, round(coalesce(max(score), 0.0), 6) AS turn_max,
       CAST(0.0 AS DOUBLE) AS avg_loss FROM ev""")
def a38_score_summary(spark, sf_dir):
    """A38 on the events score series."""
    return SC.score_summary(event_scores(spark, sf_dir))


@query("a39_score_trend", f"""WITH {_EV},
t AS (SELECT idx, avg(score) AS mean_score, count(*) AS n FROM ev WHERE idx < 20 GROUP BY idx)
SELECT idx, round(mean_score, 6) AS mean_score, n, round((SELECT avg(mean_score) FROM t), 6) AS trend_mean,
       round((SELECT min(mean_score) FROM t), 6) AS trend_min, round((SELECT max(mean_score) FROM t), 6) AS trend_max FROM t""")
def a39_score_trend(spark, sf_dir):
    """Mean score per position, first 20 positions, and the trend's mean/min/max."""
    return SC.score_trend(event_scores(spark, sf_dir))


_CLIP = """p AS (SELECT quantile_cont(score, 0.01) AS lo, quantile_cont(score, 0.95) AS hi FROM ev),
kept AS (SELECT score FROM ev, p WHERE score >= lo AND score <= hi AND score > 0)"""


@query("a40_score_clip_summary", f"""WITH {_EV}, {_CLIP}
SELECT round((SELECT lo FROM p), 6) AS p_low, round((SELECT hi FROM p), 6) AS p_high, count(*) AS kept,
       round(avg(score), 6) AS avg, round(min(score), 6) AS min, round(max(score), 6) AS max FROM kept""")
def a40_score_clip_summary(spark, sf_dir):
    """Exact p1/p95 clip (x > 0) and the kept scores' avg/min/max."""
    return SC.clipped_distribution(event_scores(spark, sf_dir))[0]


@query("a40_score_histogram", f"""WITH {_EV}, {_CLIP},
r0 AS (SELECT min(score) AS lo, max(score) AS hi, count(*) AS n FROM kept),
rw AS (SELECT n, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, (CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END - CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END) / 50 AS width FROM r0),
b AS (SELECT CAST(least(floor((score - lo) / width), 49) AS BIGINT) AS bin FROM kept, rw),
c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin),
g AS (SELECT CAST(unnest(range(0, 50)) AS BIGINT) AS bin)
SELECT 'score' AS series, g.bin, round(lo + g.bin * width, 6) AS bin_start, CAST(coalesce(cnt, 0) AS BIGINT) AS count,
       round(coalesce(cnt, 0) / (n * width), 6) AS density FROM g CROSS JOIN rw LEFT JOIN c ON g.bin = c.bin""")
def a40_score_histogram(spark, sf_dir):
    """50-bin histogram of the kept scores."""
    return SC.clipped_distribution(event_scores(spark, sf_dir))[1]


@query("a41_flatten_scores", f"""WITH {_EV} SELECT session_id, idx, score FROM ev""")
def a41_flatten_scores(spark, sf_dir):
    """Scores that arrive nested, one list per session, as a flat series."""
    return SC.flatten_nested(SC.nest_scores(event_scores(spark, sf_dir)))


@query("s14_session_scores", f"""WITH {_EV},
s AS (SELECT session_id, list(score ORDER BY idx) AS scores FROM ev GROUP BY session_id)
SELECT session_id, len(scores) AS n_scores, round(scores[1], 6) AS first_score, round(scores[len(scores)], 6) AS last_score,
       round(list_sum(scores), 4) AS total FROM s""")
def s14_session_scores(spark, sf_dir):
    """S14 + A41: one JSON row per session, read back and summed up."""
    from talkframe.sources.sinks import session_scores_json
    rows = session_scores_json(SC.nest_scores(event_scores(spark, sf_dir)))
    back = rows.select(F.from_json("json", "session_id bigint, scores array<double>").alias("r")).select("r.*")
    return back.select("session_id", F.size("scores").cast("bigint").alias("n_scores"), F.element_at("scores", 1).alias("first_score"),
                       F.element_at("scores", -1).alias("last_score"),
                       F.round(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


_TOK = s_strict("text")
_A37_SQL = f"""WITH {TURNS_CTE},
toks AS (SELECT corpus, session_id, turn, role, {_TOK} AS t FROM turns),
train AS (SELECT * FROM toks WHERE corpus = 'real' AND len(t) > 0),
tbg AS (SELECT list_transform(range(1, len(t) + 1), lambda i: struct_pack(w1 := (['<s>'] || t)[i], w2 := t[i])) AS b FROM train),
bigram AS (SELECT x.w1, x.w2, count(*) AS c12 FROM (SELECT unnest(b) AS x FROM tbg) GROUP BY ALL),
ctx AS (SELECT w1, sum(c12) AS c1 FROM bigram GROUP BY w1),
voc AS (SELECT count(DISTINCT w) AS V FROM (SELECT unnest(t) AS w FROM train)),
m AS (SELECT *, CASE WHEN len(t) > 0 THEN t[len(t)] END AS lastw,
         sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY corpus, session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS patient_idx,
         coalesce(last(CASE WHEN len(t) > 0 THEN t[len(t)] END IGNORE NULLS) OVER (PARTITION BY corpus, session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '<s>') AS ctx_word
      FROM toks),
r AS (SELECT corpus, session_id, patient_idx, unnest(list_transform(range(1, len(t) + 1), lambda i: struct_pack(w1 := ([ctx_word] || t)[i], w2 := t[i]))) AS x
      FROM m WHERE role = 'assistant' AND patient_idx < 20 AND len(t) > 0),
s AS (SELECT corpus, session_id, patient_idx, ln((coalesce(b.c12, 0) + 1) / (coalesce(c.c1, 0) + (SELECT V FROM voc))) AS lp
      FROM r LEFT JOIN bigram b ON b.w1 = r.x.w1 AND b.w2 = r.x.w2 LEFT JOIN ctx c ON c.w1 = r.x.w1)
SELECT corpus, session_id, CAST(patient_idx AS BIGINT) AS patient_idx, count(*) AS n_bigrams, round(-avg(lp), 6) AS nll, round(exp(-avg(lp)), 6) AS ppl
FROM s GROUP BY corpus, session_id, patient_idx"""


@query("a37_bigram_turn_scores", _A37_SQL)
def a37_bigram_turn_scores(spark, sf_dir):
    """Bigram LM trained on the real corpus scores every patient response
    (first 20 per session) given the last earlier word."""
    t = turns_only(spark, sf_dir)
    model = SC.train_bigram_model(t.where(F.col("corpus") == "real"))
    return SC.score_responses(t, model, max_patient_turns=20)


def bigram_scores(spark, sf_dir):
    """A37 output as a score table: score = perplexity, loss = NLL, idx = patient turn."""
    t = turns_only(spark, sf_dir)
    model = SC.train_bigram_model(t.where(F.col("corpus") == "real"))
    s = SC.score_responses(t, model, max_patient_turns=20)
    return s.select("corpus", "session_id", F.col("patient_idx").alias("idx"), F.col("ppl").alias("score"),
                    F.col("nll").alias("loss"))


_A37_BASE = _A37_SQL.replace("round(-avg(lp), 6) AS nll, round(exp(-avg(lp)), 6) AS ppl", "-avg(lp) AS nll, exp(-avg(lp)) AS ppl")


@query("a38_turn_score_summary", f"""WITH sc AS ({_A37_BASE}),
allc AS (SELECT DISTINCT conv_id FROM conversations),
conv AS (SELECT corpus, session_id, avg(ppl) AS m FROM sc GROUP BY corpus, session_id)
SELECT (SELECT count(*) FROM allc) AS num_conversations, (SELECT count(*) FROM conv) AS num_conversations_processed,
       count(*) AS num_turns, round(coalesce((SELECT avg(m) FROM conv), 0.0), 6) AS conversation_avg,
       round(coalesce((SELECT min(m) FROM conv), 0.0), 6) AS conversation_min, round(coalesce((SELECT max(m) FROM conv), 0.0), 6) AS conversation_max,
       round(coalesce(avg(ppl), 0.0), 6) AS turn_avg, round(coalesce(min(ppl), 0.0), 6) AS turn_min, round(coalesce(max(ppl), 0.0), 6) AS turn_max,
       round(coalesce(avg(nll), 0.0), 6) AS avg_loss FROM sc""")
def a38_turn_score_summary(spark, sf_dir):
    """A38 on the bigram turn scores: perplexity summary at turn and conversation
    level, average loss; every conversation of the table is counted."""
    allc = turns_only(spark, sf_dir).select("corpus", "session_id").distinct()
    return SC.score_summary(bigram_scores(spark, sf_dir), all_sessions=allc, key=("corpus", "session_id"))


@query("a39_turn_score_trend", f"""WITH sc AS ({_A37_BASE}),
t AS (SELECT patient_idx AS idx, avg(ppl) AS mean_score, count(*) AS n FROM sc WHERE patient_idx < 20 GROUP BY patient_idx)
SELECT CAST(idx AS BIGINT) AS idx, round(mean_score, 6) AS mean_score, n, round((SELECT avg(mean_score) FROM t), 6) AS trend_mean,
       round((SELECT min(mean_score) FROM t), 6) AS trend_min, round((SELECT max(mean_score) FROM t), 6) AS trend_max FROM t""")
def a39_turn_score_trend(spark, sf_dir):
    """A39 on the bigram turn scores: mean perplexity per patient turn (first 20)."""
    return SC.score_trend(bigram_scores(spark, sf_dir))
