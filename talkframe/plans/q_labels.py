"""Registered queries: reply parsing, label analytics and labeler agreement
(P22, P26, J6, J9, A23-A36, A58)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkframe.functions.text import py_strip, word_count
from talkframe.operators import agreement as G
from talkframe.operators import labels as L
from talkframe.operators.alignment import aligned_labels
from talkframe.operators.replies import parse_label_json
from talkframe.operators.turns import patient_messages, patient_turns
from talkframe.plans.catalog import query
from talkframe.plans.sqlfrag import strip as s_strip, with_turns, words as s_words
from talkframe.plans.testview import table, turns_only

CATS = ["P", "T", "C", "F"]


def _numbered(df):
    w = Window.partitionBy("corpus", "session_id").orderBy("turn")
    return df.withColumn("label_idx", (F.row_number().over(w) - 1).cast("bigint"))


def _letter(n):
    return F.substring(F.lit("PTCF"), (1 + n % 4).cast("int"), F.lit(1))


def turn_labels(spark, sf_dir):
    """Labeler 2 of the reports: a label for each non-empty patient turn, a fixed
    expression of the message's length (the table holds no such labels)."""
    t = turns_only(spark, sf_dir).where((F.col("role") == "assistant") & (F.length(py_strip("text")) > 0))
    return _numbered(t.select("corpus", "session_id", "turn", F.col("text").alias("message"), _letter(F.length("text")).alias("label")))


def conv_labels(spark, sf_dir):
    """Labeler 1: labels for the patient turns among the first 32 non-empty messages,
    a fixed expression of the message's words; those of five words and a
    multiple thereof are left unlabelled, so that sequences shift and end early."""
    w = Window.partitionBy("corpus", "session_id").orderBy("turn")
    t = turns_only(spark, sf_dir).where(F.length(py_strip("text")) > 0).withColumn("rn", F.row_number().over(w))
    n = word_count("text")
    lab = t.where((F.col("role") != "user") & (F.col("rn") <= 32) & (n % 5 != 0))
    return _numbered(lab.select("corpus", "session_id", "turn", F.col("text").alias("content"), _letter(n).alias("label")))


def all_sessions(spark, sf_dir):
    return L.sessions_of(turns_only(spark, sf_dir))


def counts(spark, sf_dir):
    return L.conversation_label_counts(conv_labels(spark, sf_dir), all_sessions(spark, sf_dir))


def judge_pairs(spark, sf_dir):
    """Conversation-judge labels (labeler 1) vs turn-judge labels (labeler 2)."""
    return G.align(conv_labels(spark, sf_dir), turn_labels(spark, sf_dir))


def label_pairs(spark, sf_dir):
    """The ``labels`` table as two binary labelers (quality vs toxic) per document."""
    lab = table(spark, sf_dir, "labels")
    return lab.select(F.lit("labels").alias("corpus"), F.col("doc_id").alias("session_id"),
                      F.lit(0).cast("bigint").alias("idx"), F.col("quality").cast("string").alias("a"),
                      F.col("toxic").cast("string").alias("b"))


_LABEL_CTES = [
    f"""ne AS (SELECT *, row_number() OVER (PARTITION BY corpus, session_id ORDER BY turn) AS rn
               FROM turns WHERE length({s_strip('text')}) > 0)""",
    "sess AS (SELECT DISTINCT corpus, session_id FROM turns)",
    f"""convl AS (SELECT corpus, session_id, turn, text, row_number() OVER (PARTITION BY corpus, session_id ORDER BY turn) - 1 AS label_idx,
                  substr('PTCF', 1 + len({s_words('text')}) % 4, 1) AS label FROM ne
                 WHERE role <> 'user' AND rn <= 32 AND len({s_words('text')}) % 5 <> 0)""",
    f"""turnl AS (SELECT corpus, session_id, turn, row_number() OVER (PARTITION BY corpus, session_id ORDER BY turn) - 1 AS label_idx,
                  substr('PTCF', 1 + length(text) % 4, 1) AS label FROM turns WHERE role = 'assistant' AND length({s_strip('text')}) > 0)""",
    """pairs AS (SELECT c.corpus, c.session_id, c.label_idx AS idx, c.label AS a, t.label AS b
                FROM convl c JOIN turnl t ON c.corpus = t.corpus AND c.session_id = t.session_id AND c.label_idx = t.label_idx)""",
    """per_conv AS (SELECT s.corpus, s.session_id, count(label) AS total_patient_turns,
          count(*) FILTER (WHERE label IN ('P','T','C')) AS non_filler_turns,
          count(*) FILTER (WHERE label = 'P') AS P_count, count(*) FILTER (WHERE label = 'T') AS T_count,
          count(*) FILTER (WHERE label = 'C') AS C_count, count(*) FILTER (WHERE label = 'F') AS F_count
        FROM sess s LEFT JOIN convl c ON s.corpus = c.corpus AND s.session_id = c.session_id GROUP BY ALL)""",
    """ratios AS (SELECT *, coalesce(P_count / nullif(non_filler_turns, 0), 0.0) AS P_ratio,
          coalesce(T_count / nullif(non_filler_turns, 0), 0.0) AS T_ratio, coalesce(C_count / nullif(non_filler_turns, 0), 0.0) AS C_ratio,
          coalesce(F_count / nullif(total_patient_turns, 0), 0.0) AS F_ratio FROM per_conv)""",
]


def _sql(body):
    return with_turns(*_LABEL_CTES) + body


@query("a23_conversation_label_counts", _sql("""
SELECT corpus, session_id, total_patient_turns, non_filler_turns, P_count, T_count, C_count, F_count,
       round(P_ratio, 6) AS P_ratio, round(T_ratio, 6) AS T_ratio, round(C_ratio, 6) AS C_ratio, round(F_ratio, 6) AS F_ratio
FROM ratios"""))
def a23_conversation_label_counts(spark, sf_dir):
    """Label counts and ratios per conversation."""
    return counts(spark, sf_dir)


@query("a24_label_count_check", _sql(f"""
SELECT n.corpus, n.session_id, n.n_patient, CAST(least(16, n.n_patient) AS BIGINT) AS expected,
       CAST(coalesce(p.total_patient_turns, 0) AS BIGINT) AS received, least(16, n.n_patient) <> coalesce(p.total_patient_turns, 0) AS has_mismatch
FROM (SELECT corpus, session_id, count(*) FILTER (WHERE role = 'assistant' AND length({s_strip('text')}) > 0) AS n_patient FROM turns GROUP BY ALL) n
LEFT JOIN per_conv p ON n.corpus = p.corpus AND n.session_id = p.session_id"""))
def a24_label_count_check(spark, sf_dir):
    """Expected min(32 div 2, #non-empty patient turns) vs labels received."""
    return L.label_count_check(turns_only(spark, sf_dir), conv_labels(spark, sf_dir), history_limit=32)


@query("a24_mismatch_summary", _sql(f"""
SELECT corpus, count(*) AS conversations, count(*) FILTER (WHERE has_mismatch) AS mismatches, round(avg(CAST(has_mismatch AS DOUBLE)) * 100.0, 6) AS mismatch_rate_pct
FROM (SELECT n.corpus, least(16, n.n_patient) <> coalesce(p.total_patient_turns, 0) AS has_mismatch
      FROM (SELECT corpus, session_id, count(*) FILTER (WHERE role = 'assistant' AND length({s_strip('text')}) > 0) AS n_patient FROM turns GROUP BY ALL) n
      LEFT JOIN per_conv p ON n.corpus = p.corpus AND n.session_id = p.session_id) GROUP BY corpus"""))
def a24_mismatch_summary(spark, sf_dir):
    return L.mismatch_summary(L.label_count_check(turns_only(spark, sf_dir), conv_labels(spark, sf_dir)))


def _a25_sql():
    parts = [f"""SELECT '{x}' AS label, avg(CASE WHEN corpus = 'real' THEN {x}_ratio END) AS rm, stddev_samp(CASE WHEN corpus = 'real' THEN {x}_ratio END) AS rs,
                avg(CASE WHEN corpus = 'synthetic' THEN {x}_ratio END) AS sm, stddev_samp(CASE WHEN corpus = 'synthetic' THEN {x}_ratio END) AS ss FROM ratios"""
             for x in CATS]
    return _sql(f"""SELECT label, round(rm, 6) AS real_mean, round(rs, 6) AS real_std, round(sm, 6) AS synthetic_mean,
                    round(ss, 6) AS synthetic_std, round(sm - rm, 6) AS difference FROM ({' UNION ALL '.join(parts)})""")


@query("a25_macro_comparison", _a25_sql())
def a25_macro_comparison(spark, sf_dir):
    """Mean and sample std of per-conversation ratios, synthetic − real."""
    return L.macro_comparison(counts(spark, sf_dir))


@query("a25_turn_totals", _sql("""
SELECT corpus, CAST(sum(total_patient_turns) AS BIGINT) AS total_turns, CAST(sum(non_filler_turns) AS BIGINT) AS non_filler_turns,
       round(avg(F_ratio), 6) AS filler_mean FROM ratios GROUP BY corpus"""))
def a25_turn_totals(spark, sf_dir):
    return L.turn_totals(counts(spark, sf_dir))


@query("a26_micro_distribution", _sql("""
SELECT corpus, round(sum(P_count) / nullif(sum(total_patient_turns), 0), 6) AS P_share, round(sum(T_count) / nullif(sum(total_patient_turns), 0), 6) AS T_share,
       round(sum(C_count) / nullif(sum(total_patient_turns), 0), 6) AS C_share, round(sum(F_count) / nullif(sum(total_patient_turns), 0), 6) AS F_share
FROM ratios GROUP BY corpus"""))
def a26_micro_distribution(spark, sf_dir):
    return L.micro_distribution(counts(spark, sf_dir))


@query("a27_label_progression", _sql("""
SELECT c.corpus, CAST(c.label_idx AS BIGINT) AS label_idx,
       round(avg(CASE c.label WHEN 'P' THEN 1.0 WHEN 'T' THEN 2.0 WHEN 'C' THEN 3.0 END), 6) AS mean_label
FROM convl c JOIN per_conv p ON c.corpus = p.corpus AND c.session_id = p.session_id
WHERE p.total_patient_turns >= 3 AND c.label_idx < 3 GROUP BY c.corpus, c.label_idx"""))
def a27_label_progression(spark, sf_dir):
    """A27 + P26: mean numeric label per position (threshold 3 turns)."""
    lab = conv_labels(spark, sf_dir)
    return L.label_progression(lab, counts(spark, sf_dir), threshold=3)


# --- agreement between labelers -----------------------------------------------

_SUMMARY = """
SELECT CAST(n AS BIGINT) AS n_samples, CAST(agree AS BIGINT) AS n_agreements, CAST(n - agree AS BIGINT) AS n_disagreements,
       round(coalesce(agree / nullif(n, 0), 0.0), 6) AS accuracy,
       round((agree / nullif(n, 0) - pe) / nullif(1 - pe, 0.0), 6) AS kappa
FROM (SELECT n, agree, pe_num / nullif(n * n, 0) AS pe FROM
  (SELECT (SELECT count(*) FROM pairs) AS n, (SELECT count(*) FROM pairs WHERE a = b) AS agree,
          (SELECT coalesce(sum(na * nb), 0) FROM (SELECT a AS label, count(*) AS na FROM pairs GROUP BY a) x
             JOIN (SELECT b AS label, count(*) AS nb FROM pairs GROUP BY b) y USING (label)) AS pe_num))"""


@query("a28_a29_judge_agreement", _sql(_SUMMARY))
def a28_a29_judge_agreement(spark, sf_dir):
    """Accuracy and Cohen's kappa, conversation judge vs turn judge."""
    return G.agreement_summary(judge_pairs(spark, sf_dir))


_LABEL_PAIRS = """pairs AS (SELECT 'labels' AS corpus, doc_id AS session_id, CAST(0 AS BIGINT) AS idx,
                   CAST(quality AS VARCHAR) AS a, CAST(toxic AS VARCHAR) AS b FROM labels)"""


@query("a28_a29_labels_agreement", "WITH " + _LABEL_PAIRS + _SUMMARY)
def a28_a29_labels_agreement(spark, sf_dir):
    """A28/A29 on the labels table: quality vs toxic as two binary labelers."""
    return G.agreement_summary(label_pairs(spark, sf_dir))


def _confusion_sql(cats):
    vals = ", ".join(f"('{x}')" for x in cats)
    cols = ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE g.b = '{x}'), 0) AS BIGINT) AS \"{x}\"" for x in cats)
    return f"""SELECT g.a AS true_label, {cols} FROM
      (SELECT x.c AS a, y.c AS b FROM (VALUES {vals}) x(c), (VALUES {vals}) y(c)) g
      LEFT JOIN (SELECT a, b, count(*) AS n FROM pairs GROUP BY a, b) p ON g.a = p.a AND g.b = p.b GROUP BY g.a"""


@query("a30_confusion_matrix", _sql(_confusion_sql(CATS)))
def a30_confusion_matrix(spark, sf_dir):
    """P/T/C/F confusion matrix incl. zero cells."""
    return G.confusion_matrix(judge_pairs(spark, sf_dir), CATS)


@query("a30_labels_confusion", "WITH " + _LABEL_PAIRS + _confusion_sql(["0", "1"]))
def a30_labels_confusion(spark, sf_dir):
    return G.confusion_matrix(label_pairs(spark, sf_dir), ["0", "1"])


@query("a31_class_agreement", _sql(f"""
SELECT g.label, round(x.agreement, 6) AS agreement FROM (VALUES {', '.join(f"('{c}')" for c in CATS)}) g(label)
LEFT JOIN (SELECT a AS label, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS agreement FROM pairs GROUP BY a) x ON g.label = x.label"""))
def a31_class_agreement(spark, sf_dir):
    return G.class_agreement(judge_pairs(spark, sf_dir), CATS)


def _report_sql(cats):
    vals = ", ".join(f"('{c}')" for c in cats)
    return f""", per AS (
  SELECT g.label, coalesce(tp / nullif(pred, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall,
         CAST(coalesce(support, 0) AS BIGINT) AS support
  FROM (VALUES {vals}) g(label)
  LEFT JOIN (SELECT a AS label, count(*) AS tp FROM pairs WHERE a = b GROUP BY a) t ON g.label = t.label
  LEFT JOIN (SELECT a AS label, count(*) AS support FROM pairs GROUP BY a) s ON g.label = s.label
  LEFT JOIN (SELECT b AS label, count(*) AS pred FROM pairs GROUP BY b) p ON g.label = p.label),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0.0), 0.0) AS f1 FROM per)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), CAST((SELECT sum(support) FROM f) AS BIGINT)
  FROM (SELECT coalesce(count(*) FILTER (WHERE a = b) / nullif(count(*), 0), 0.0) AS acc FROM pairs) x
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(coalesce(sum(precision * support) / nullif(sum(support), 0), 0.0), 6),
  round(coalesce(sum(recall * support) / nullif(sum(support), 0), 0.0), 6), round(coalesce(sum(f1 * support) / nullif(sum(support), 0), 0.0), 6),
  CAST(sum(support) AS BIGINT) FROM f"""


@query("a32_classification_report", _sql(_report_sql(CATS)))
def a32_classification_report(spark, sf_dir):
    """Precision / recall / F1 / support with macro and weighted averages."""
    return G.classification_report(judge_pairs(spark, sf_dir), CATS)


@query("a33_agreement_by_position", _sql("""
SELECT CAST(idx AS BIGINT) AS idx, agree, total, round(agree / total, 6) AS rate, round(avg(agree / total) OVER (), 6) AS mean_rate
FROM (SELECT idx, count(*) FILTER (WHERE a = b) AS agree, count(*) AS total FROM pairs GROUP BY idx)"""))
def a33_agreement_by_position(spark, sf_dir):
    return G.agreement_by_position(judge_pairs(spark, sf_dir))


@query("a34_agreement_by_conversation", _sql("""
SELECT s.corpus, s.session_id, count(idx) AS n, count(*) FILTER (WHERE a = b) AS agreements,
       round(coalesce(sum(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) / nullif(count(idx), 0), 0.0), 6) AS accuracy
FROM sess s LEFT JOIN pairs p ON s.corpus = p.corpus AND s.session_id = p.session_id GROUP BY ALL"""))
def a34_agreement_by_conversation(spark, sf_dir):
    """Every conversation, also those without an aligned pair."""
    return G.agreement_by_conversation(judge_pairs(spark, sf_dir), all_sessions(spark, sf_dir))


@query("a35_label_distribution", _sql(f"""
SELECT g.labeler, g.label, CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
FROM (SELECT l.n AS labeler, c.c AS label FROM (VALUES ('labeler_1'), ('labeler_2')) l(n), (VALUES {', '.join(f"('{c}')" for c in CATS)}) c(c)) g
LEFT JOIN (SELECT 'labeler_1' AS labeler, a AS label, count(*) AS cnt FROM pairs GROUP BY a
           UNION ALL SELECT 'labeler_2', b, count(*) FROM pairs GROUP BY b) c ON g.labeler = c.labeler AND g.label = c.label"""))
def a35_label_distribution(spark, sf_dir):
    return G.label_distribution(judge_pairs(spark, sf_dir), CATS)


@query("a36_disagreements", _sql(f"""
SELECT p.corpus, p.session_id, CAST(p.idx AS BIGINT) AS idx, p.a, p.b, coalesce(t.text, 'N/A') AS message,
       (SELECT count(*) FROM pairs WHERE a <> b) AS total_disagreements
FROM pairs p LEFT JOIN (SELECT corpus, session_id, text, row_number() OVER (PARTITION BY corpus, session_id ORDER BY turn) - 1 AS idx
                   FROM turns WHERE role = 'assistant' AND length({s_strip('text')}) > 0) t
  ON p.corpus = t.corpus AND p.session_id = t.session_id AND p.idx = t.idx
WHERE p.a <> p.b ORDER BY p.corpus, p.session_id, p.idx LIMIT 20"""))
def a36_disagreements(spark, sf_dir):
    """First 20 disagreements with the nth non-empty patient message
    (N/A beyond the last), and the total."""
    d = G.disagreements(judge_pairs(spark, sf_dir), 20)
    msgs = patient_messages(turns_only(spark, sf_dir)).select(
        "corpus", "session_id", F.col("text").alias("message"),
        (F.row_number().over(Window.partitionBy("corpus", "session_id").orderBy("turn")) - 1).cast("bigint").alias("idx"))
    return d.join(msgs, ["corpus", "session_id", "idx"], "left").select(
        "corpus", "session_id", "idx", "a", "b", F.coalesce("message", F.lit("N/A")).alias("message"), "total_disagreements")


@query("a58_progression_comparison", _sql("""
SELECT corpus, session_id, CAST(idx AS BIGINT) AS idx,
  CAST(CASE a WHEN 'P' THEN 1 WHEN 'T' THEN 2 WHEN 'C' THEN 3 WHEN 'F' THEN 0 END AS DOUBLE) AS labeler_1,
  CAST(CASE b WHEN 'P' THEN 1 WHEN 'T' THEN 2 WHEN 'C' THEN 3 WHEN 'F' THEN 0 END AS DOUBLE) AS labeler_2, a <> b AS disagree
FROM pairs WHERE idx < 15"""))
def a58_progression_comparison(spark, sf_dir):
    return G.progression_comparison(judge_pairs(spark, sf_dir))


@query("j9_label_turn_alignment", _sql(f"""
SELECT c.corpus, c.session_id, CAST(c.label_idx AS BIGINT) AS label_idx, p.turn, c.label,
       substr({s_strip('c.text')}, 1, 30) <> substr({s_strip('p.text')}, 1, 30) AS misaligned
FROM convl c JOIN (SELECT corpus, session_id, turn, text, row_number() OVER (PARTITION BY corpus, session_id ORDER BY turn) - 1 AS idx
                   FROM turns WHERE role = 'assistant' AND length({s_strip('text')}) > 0) p
  ON c.corpus = p.corpus AND c.session_id = p.session_id AND c.label_idx = p.idx"""))
def j9_label_turn_alignment(spark, sf_dir):
    """J9 + quirk Q7: labels paired with patient turns by position, plus a content
    prefix check that flags shifted labels."""
    lab = conv_labels(spark, sf_dir).drop("turn")
    pt = patient_turns(turns_only(spark, sf_dir)).select("corpus", "session_id", "turn", "text",
                                                          F.col("patient_idx").alias("label_idx"))
    j = lab.join(pt, ["corpus", "session_id", "label_idx"], "inner")
    return j.select("corpus", "session_id", "label_idx", "turn", "label",
                    (F.substring(py_strip("content"), 1, 30) != F.substring(py_strip("text"), 1, 30)).alias("misaligned"))


def shifted_labels(spark, sf_dir):
    """Labels as a careless labeler returns them: neighbours changed over in every third
    session, some contents retold, some cut to nothing."""
    idx, n = F.col("label_idx"), word_count("content")
    lab = conv_labels(spark, sf_dir).drop("turn")
    last = F.max("label_idx").over(Window.partitionBy("corpus", "session_id"))
    other = F.when(idx % 2 == 1, idx - 1).when(idx < last, idx + 1).otherwise(idx)
    told = F.when(n % 7 == 3, F.concat(F.lit("Retold: "), "content")).when(n % 11 == 4, F.lit(" ")).otherwise(F.col("content"))
    return lab.select("corpus", "session_id", F.when(F.col("session_id") % 3 == 0, other).otherwise(idx).alias("label_idx"), "label", told.alias("content"))


@query("j9_content_alignment", _sql(f"""
, seen AS (SELECT *, max(label_idx) OVER (PARTITION BY corpus, session_id) AS last_idx, len({s_words('text')}) AS nw FROM convl),
lab AS (SELECT corpus, session_id, label,
    CAST(CASE WHEN session_id % 3 <> 0 THEN label_idx WHEN label_idx % 2 = 1 THEN label_idx - 1 WHEN label_idx < last_idx THEN label_idx + 1
         ELSE label_idx END AS BIGINT) AS label_idx,
    CASE WHEN nw % 7 = 3 THEN 'Retold: ' || text WHEN nw % 11 = 4 THEN ' ' ELSE text END AS content FROM seen),
pt AS (SELECT corpus, session_id, turn, {s_strip('text')} AS text, row_number() OVER (PARTITION BY corpus, session_id ORDER BY turn) - 1 AS p
       FROM turns WHERE role = 'assistant' AND length({s_strip('text')}) > 0),
lk AS (SELECT *, row_number() OVER (PARTITION BY corpus, session_id, k ORDER BY label_idx) AS nth FROM (
       SELECT corpus, session_id, label_idx, substr({s_strip('content')}, 1, 30) AS k FROM lab) x WHERE length(k) > 0),
pk AS (SELECT *, row_number() OVER (PARTITION BY corpus, session_id, k ORDER BY p) AS nth FROM (
       SELECT corpus, session_id, p, substr(text, 1, 30) AS k FROM pt) x),
a AS (SELECT corpus, session_id, lk.label_idx AS l, pk.p FROM lk JOIN pk USING (corpus, session_id, k, nth)),
up(corpus, session_id, l, p, n) AS (
  SELECT *, 1 FROM a UNION SELECT b.corpus, b.session_id, b.l, b.p, up.n + 1 FROM up JOIN a b
    ON b.corpus = up.corpus AND b.session_id = up.session_id AND b.l > up.l AND b.p > up.p),
down(corpus, session_id, l, p, n) AS (
  SELECT *, 1 FROM a UNION SELECT b.corpus, b.session_id, b.l, b.p, down.n + 1 FROM down JOIN a b
    ON b.corpus = down.corpus AND b.session_id = down.session_id AND b.l < down.l AND b.p < down.p),
best AS (
  SELECT *, max(u) OVER (PARTITION BY corpus, session_id) AS most FROM (
    SELECT corpus, session_id, l, p, max(n) AS u FROM up GROUP BY ALL) x JOIN (
    SELECT corpus, session_id, l, p, max(n) AS d FROM down GROUP BY ALL) y USING (corpus, session_id, l, p)),
cand AS (SELECT * FROM best WHERE u + d - 1 = most),
chain(corpus, session_id, l, p, u) AS (
  SELECT corpus, session_id, min(l), arg_min(p, l), 1 FROM cand WHERE u = 1 GROUP BY corpus, session_id
  UNION ALL
  SELECT c.corpus, c.session_id, min(n.l), arg_min(n.p, n.l), c.u + 1 FROM chain c JOIN cand n
    ON n.corpus = c.corpus AND n.session_id = c.session_id AND n.u = c.u + 1 AND n.l > c.l AND n.p > c.p GROUP BY c.corpus, c.session_id, c.u),
placed AS (
  SELECT lab.corpus, lab.session_id, lab.label_idx, lab.label, h.p AS own,
    (SELECT max(l) FROM chain c WHERE c.corpus = lab.corpus AND c.session_id = lab.session_id AND c.l <= lab.label_idx) AS bl,
    (SELECT min(l) FROM chain c WHERE c.corpus = lab.corpus AND c.session_id = lab.session_id AND c.l >= lab.label_idx) AS fl
  FROM lab LEFT JOIN chain h ON h.corpus = lab.corpus AND h.session_id = lab.session_id AND h.l = lab.label_idx),
near AS (
  SELECT q.*, b.p AS bp, f.p AS fp FROM placed q
  LEFT JOIN chain b ON b.corpus = q.corpus AND b.session_id = q.session_id AND b.l = q.bl
  LEFT JOIN chain f ON f.corpus = q.corpus AND f.session_id = q.session_id AND f.l = q.fl),
guess AS (
  SELECT *, CASE WHEN own IS NOT NULL THEN own WHEN bl IS NOT NULL AND fl IS NOT NULL THEN CASE WHEN fl - bl = fp - bp THEN bp + label_idx - bl END
                 WHEN bl IS NOT NULL THEN bp + label_idx - bl WHEN fl IS NOT NULL THEN fp - (fl - label_idx) ELSE label_idx END AS g,
         CASE WHEN own IS NOT NULL THEN 'content' WHEN bl IS NOT NULL AND fl IS NOT NULL THEN 'between'
              WHEN bl IS NULL AND fl IS NULL THEN 'position' ELSE 'beside' END AS how FROM near)
SELECT g.corpus, g.session_id, g.label_idx, g.label, CAST(pt.p AS BIGINT) AS patient_idx, pt.turn,
       CASE WHEN pt.turn IS NULL THEN 'unplaced' ELSE how END AS method, CAST(pt.p - g.label_idx AS BIGINT) AS shift
FROM guess g LEFT JOIN pt ON pt.corpus = g.corpus AND pt.session_id = g.session_id AND pt.p = g.g""").replace("WITH ", "WITH RECURSIVE ", 1))
def j9_content_alignment(spark, sf_dir):
    """Labels on their turns by content, whatever was left out, changed over or retold."""
    return aligned_labels(shifted_labels(spark, sf_dir), turns_only(spark, sf_dir))


@query("a24_mismatch_debug", _sql(f"""
, n AS (SELECT corpus, session_id, count(*) FILTER (WHERE role = 'assistant' AND length({s_strip('text')}) > 0) AS n_patient,
               CAST(to_json(list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn)) AS VARCHAR) AS input_messages
        FROM turns GROUP BY corpus, session_id),
got AS (SELECT corpus, session_id, CAST(to_json(list(struct_pack(label_idx := label_idx, label := label) ORDER BY label_idx)) AS VARCHAR)
          AS output_labels FROM convl GROUP BY corpus, session_id)
SELECT n.corpus, n.session_id, CAST(least(16, n.n_patient) AS BIGINT) AS expected,
       CAST(p.total_patient_turns AS BIGINT) AS received, n.input_messages, g.output_labels
FROM n JOIN per_conv p ON n.corpus = p.corpus AND n.session_id = p.session_id
LEFT JOIN got g ON n.corpus = g.corpus AND n.session_id = g.session_id
WHERE least(16, n.n_patient) <> p.total_patient_turns"""))
def a24_mismatch_debug(spark, sf_dir):
    """Quarantine rows (input messages and labels received, as JSON text)
    for sessions whose label count differs from the expected one."""
    t = turns_only(spark, sf_dir)
    lab = conv_labels(spark, sf_dir)
    d = L.mismatch_debug(t, lab, L.label_count_check(t, lab))
    text = lambda c: F.to_json(c, {"ignoreNullFields": "false"}).alias(c)
    return d.select("corpus", "session_id", "expected", "received", text("input_messages"), text("output_labels"))


@query("a24_mismatch_debug_flat", _sql(f"""
, n AS (SELECT corpus, session_id, count(*) FILTER (WHERE role = 'assistant' AND length({s_strip('text')}) > 0) AS n_patient
        FROM turns GROUP BY ALL),
bad AS (SELECT n.corpus, n.session_id, CAST(least(16, n.n_patient) AS BIGINT) AS expected,
               CAST(coalesce(p.total_patient_turns, 0) AS BIGINT) AS received
        FROM n LEFT JOIN per_conv p ON n.corpus = p.corpus AND n.session_id = p.session_id
        WHERE least(16, n.n_patient) <> coalesce(p.total_patient_turns, 0))
SELECT b.corpus, b.session_id, b.expected, b.received,
       (SELECT count(*) FROM turns t WHERE t.corpus = b.corpus AND t.session_id = b.session_id) AS n_input_messages,
       coalesce((SELECT string_agg(label, '' ORDER BY label_idx) FROM convl c WHERE c.corpus = b.corpus AND c.session_id = b.session_id), '') AS labels
FROM bad b"""))
def a24_mismatch_debug_flat(spark, sf_dir):
    """A24/S13 debug rows flattened for the oracle: message count and the label
    string received per mismatching session."""
    t = turns_only(spark, sf_dir)
    lab = conv_labels(spark, sf_dir)
    d = L.mismatch_debug(t, lab, L.label_count_check(t, lab))
    return d.select("corpus", "session_id", "expected", "received",
                    F.size("input_messages").cast("bigint").alias("n_input_messages"),
                    F.coalesce(F.array_join(F.transform("output_labels", lambda x: x["label"]), ""), F.lit("")).alias("labels"))


# --- P22: replies of every shape, written from table columns -------------------

@query("p22_parse_label_json", """
SELECT doc_id, CAST(idx AS BIGINT) AS idx, label FROM (
  SELECT doc_id, substr('PTCF', CAST(1 + doc_id % 4 AS INT), 1) AS x, substr('CFPT', CAST(1 + doc_id % 4 AS INT), 1) AS y, doc_id % 10 AS shape
  FROM documents) d,
LATERAL (SELECT unnest(CASE WHEN shape IN (0, 1, 2, 4, 7) THEN [x, y] WHEN shape IN (3, 5, 8) THEN [y] ELSE [] END) AS label,
                unnest(CASE WHEN shape IN (0, 1, 2, 4, 7) THEN [0, 1] WHEN shape IN (3, 5, 8) THEN [0] ELSE [] END) AS idx) u""")
def p22_parse_label_json(spark, sf_dir):
    """Objects under each of the keys, strings, lists of lists, items to drop
    (numbers, nulls, bare strings, other keys), no JSON, no list, code fences."""
    x, y = _letter(F.col("doc_id")), F.substring(F.lit("CFPT"), (1 + F.col("doc_id") % 4).cast("int"), F.lit(1))
    body = F.regexp_replace(F.to_json(F.struct(F.substring("text", 1, 30).alias("content"))), r"^\{|\}$", "")
    obj = lambda label: F.concat(F.lit("{"), body, F.lit(', "classification": "'), label, F.lit('"}'))
    both = F.concat(F.lit("["), obj(x), F.lit(", "), obj(y), F.lit("]"))
    shapes = [F.concat(F.lit('{"classifications": '), both, F.lit("}")),
              F.concat(F.lit('{"classifications": 3, "turns": '), both, F.lit("}")),
              F.concat(F.lit('["'), x, F.lit('", "'), y, F.lit('"]')),
              F.concat(F.lit('[{"classification": 5}, '), obj(y), F.lit("]")),
              F.concat(F.lit("["), both, F.lit(', [{"classification": "P"}]]')),
              F.concat(F.lit('{"labels": [{"label": "P"}, {"classification": null}, "P", '), obj(y), F.lit("]}")),
              F.lit("no JSON at all"), F.concat(F.lit("```json\n"), both, F.lit("\n```")),
              F.concat(F.lit('  [7, "T", '), obj(y), F.lit("]")), F.lit('{"other": [{"classification": "P"}]}')]
    reply = F.coalesce(*[F.when(F.col("doc_id") % 10 == i, s) for i, s in enumerate(shapes)])
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parse_label_json(reply)).alias("idx", "it"))
    return docs.select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.col("it.classification").alias("label"))
