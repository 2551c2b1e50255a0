"""Registered queries: situation similarity."""

import string

from pyspark.sql import functions as F

from talkframe.lexicons import ENGLISH_STOP_WORDS
from talkframe.operators import similarity as S
from talkframe.plans.catalog import query
from talkframe.plans.sqlfrag import with_turns, words as s_words
from talkframe.plans.testview import table, turns_only

_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS) + "]"
_PUNCT = "'" + string.punctuation.replace("'", "''") + "'"


def _clean(x):
    return f"list_filter({s_words(f'translate(lower({x}), {_PUNCT}, {chr(39)}{chr(39)})')}, lambda w: NOT list_contains({_STOP}, w))"


def _rouge(x):
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


def _bigrams(x):
    return f"CASE WHEN len({x}) >= 2 THEN list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1]) ELSE CAST([] AS VARCHAR[]) END"


def _jac(a, b):
    u = f"len(list_distinct(list_concat({a}, {b})))"
    i = f"len(list_intersect(list_distinct({a}), list_distinct({b})))"
    return f"CASE WHEN {u} > 0 THEN {i} / {u} * 100.0 ELSE 0.0 END"


_CTES = [
    """pt AS (SELECT corpus, session_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS patient_text
              FROM turns WHERE role = 'assistant' GROUP BY corpus, session_id)""",
    """j AS (SELECT pt.*, d.text AS situation FROM pt JOIN documents d ON d.doc_id = pt.session_id WHERE d.text <> '')""",
    f"""c AS (SELECT corpus, session_id, {_clean('patient_text')} AS cw, {_clean('situation')} AS tw FROM j)""",
    f"""c2 AS (SELECT *, {_bigrams('cw')} AS cb, {_bigrams('tw')} AS tb,
              {_rouge("array_to_string(cw, ' ')")} AS cr, {_rouge("array_to_string(tw, ' ')")} AS tr FROM c)""",
    """rt AS (SELECT corpus, session_id, tok, count(*) AS ct FROM (SELECT corpus, session_id, unnest(tr) AS tok FROM c2) GROUP BY ALL)""",
    """rc AS (SELECT corpus, session_id, tok, count(*) AS cp FROM (SELECT corpus, session_id, unnest(cr) AS tok FROM c2) GROUP BY ALL)""",
    """rg AS (SELECT rt.corpus, rt.session_id, sum(least(ct, coalesce(cp, 0))) AS overlap, sum(ct) AS tcount
             FROM rt LEFT JOIN rc ON rt.corpus = rc.corpus AND rt.session_id = rc.session_id AND rt.tok = rc.tok GROUP BY ALL)""",
    f"""m AS (SELECT c2.corpus, c2.session_id, {_jac('cw', 'tw')} AS word_overlap_percentage,
             {_jac('cb', 'tb')} AS ngram_overlap_percentage,
             coalesce(rg.overlap, 0) / greatest(coalesce(rg.tcount, 0), 1) AS rouge1_recall
           FROM c2 LEFT JOIN rg ON c2.corpus = rg.corpus AND c2.session_id = rg.session_id)""",
]


def _situations(spark, sf_dir):
    """The session's situation: ``documents.text`` of doc_id = session_id."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), F.col("text").alias("situation"))


def _metrics(spark, sf_dir):
    return S.similarity_metrics(turns_only(spark, sf_dir), _situations(spark, sf_dir))


@query("a50_a52_similarity", with_turns(*_CTES) + """
SELECT corpus, session_id, round(word_overlap_percentage, 6) AS word_overlap_percentage,
       round(ngram_overlap_percentage, 6) AS ngram_overlap_percentage, round(rouge1_recall, 6) AS rouge1_recall FROM m""")
def a50_a52_similarity(spark, sf_dir):
    """J3 + P8 + A50 (word Jaccard), A51 (bigram Jaccard), A52 (ROUGE-1 recall)."""
    return _metrics(spark, sf_dir)


@query("a54_similarity_describe", with_turns(*_CTES) + """
SELECT metric, round(avg(v), 5) AS mean, round(min(v), 5) AS min, round(max(v), 5) AS max, round(stddev_samp(v), 5) AS std FROM (
  SELECT 'word_overlap_percentage' AS metric, word_overlap_percentage AS v FROM m
  UNION ALL SELECT 'ngram_overlap_percentage', ngram_overlap_percentage FROM m
  UNION ALL SELECT 'rouge1_recall', rouge1_recall FROM m) GROUP BY metric""")
def a54_similarity_describe(spark, sf_dir):
    """Describe (mean, min, max, sample std, rounded to 5)."""
    return S.describe(_metrics(spark, sf_dir), ["word_overlap_percentage", "ngram_overlap_percentage", "rouge1_recall"])


@query("a53_embedding_recall", """
WITH e AS (SELECT vec_id, CAST(label + 100 * (vec_id // 64) AS BIGINT) AS doc, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
t AS (SELECT * FROM e WHERE vec_id % 2 = 0), c AS (SELECT * FROM e WHERE vec_id % 2 = 1),
b AS (SELECT t.doc, t.vec_id, max(list_cosine_similarity(t.v, c.v)) AS best FROM t JOIN c ON t.doc = c.doc GROUP BY t.doc, t.vec_id)
SELECT doc AS doc_id, round(avg(best), 6) AS embedding_recall, count(*) AS n_targets FROM b GROUP BY doc""")
def a53_embedding_recall(spark, sf_dir):
    """Per document (a label's vectors among 64 consecutive ids) mean over target
    vectors (even ids) of the max cosine to candidate vectors (odd ids); exact, blocked."""
    doc = F.expr("label + 100 * (vec_id div 64)").cast("bigint")
    e = table(spark, sf_dir, "embeddings").select("vec_id", doc.alias("doc_id"), "embedding")
    # parity splits the table into its two roles (targets / candidates); no row is dropped.
    # Results do not depend on the block size; 16 makes the small test tables span
    # several blocks per document so the block-pair path is exercised.
    return S.embedding_recall(e.where(F.col("vec_id") % 2 == 0), e.where(F.col("vec_id") % 2 == 1), block_size=16)
