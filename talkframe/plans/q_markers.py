"""Registered queries: lexicon markers (J8, A3-A18) with DuckDB oracles."""

from pyspark.sql import functions as F

from talkframe.lexicons import as_rows
from talkframe.operators import markers as M
from talkframe.plans.catalog import query
from talkframe.plans.corpus_lexicons import CORPUS_DISFLUENCIES, CORPUS_LINGUISTIC, CORPUS_MARKERS
from talkframe.plans.sqlfrag import PATIENT_TURNS_CTE, approx_tokens, ascii_safe, with_turns, word_count
from talkframe.plans.testview import turns_only


def _q(s):
    return "'" + s.replace("'", "''") + "'"


def sql_count(x, lexicon, cat, case_insensitive=True, lower_text=False):
    t = f"lower({x})" if lower_text else x
    terms = []
    for e in as_rows(lexicon):
        if e.category != cat:
            continue
        if e.kind == "substring":
            terms.append(f"((length({t}) - length(replace({t}, {_q(e.pattern)}, ''))) // {len(e.pattern)})")
        else:
            flags = "(?i)" if case_insensitive else ""
            terms.append(f"len(regexp_extract_all({ascii_safe(t)}, {_q(flags + e.pattern)}))")
    return "CAST(" + " + ".join(terms) + " AS BIGINT)"


def _n(c):
    return M._col_name(c)


def session_markers_sql(lexicon, max_turns=None):
    cats = M.categories(lexicon)
    hits = ", ".join(f"CAST({sql_count('text', lexicon, c)} > 0 AS BIGINT) AS hit_{_n(c)}" for c in cats)
    where = f"WHERE patient_idx < {max_turns}" if max_turns is not None else ""
    msgs = ", ".join(f"sum(hit_{_n(c)}) AS msgs_{_n(c)}" for c in cats)
    cnts = ", ".join(f"{sql_count('full_text', lexicon, c)} AS cnt_{_n(c)}" for c in cats)
    msgcols = ", ".join(f"CAST(msgs_{_n(c)} AS BIGINT) AS msgs_{_n(c)}" for c in cats)
    return [PATIENT_TURNS_CTE,
            f"h AS (SELECT corpus, session_id, turn, text, {hits} FROM pt {where})",
            f"""g AS (SELECT corpus, session_id, count(*) AS utterances, {msgs},
                  string_agg(text, ' ' ORDER BY turn) AS full_text FROM h GROUP BY corpus, session_id)""",
            f"""sess AS (SELECT corpus, session_id, utterances, {word_count('full_text')} AS words,
                  {approx_tokens('full_text')} AS tokens, {cnts}, {msgcols} FROM g)"""]


def totals_sql(lexicon):
    cats = M.categories(lexicon)
    fill = ["utterances", "words", "tokens"] + [p + _n(c) for c in cats for p in ("cnt_", "msgs_")]
    sums = ", ".join(f"sum({c}) AS {c}" for c in fill)
    cols = ", ".join(f"CAST(coalesce(t.{c}, 0) AS BIGINT) AS {c}" for c in fill)
    return [f"tot AS (SELECT corpus, {sums} FROM sess GROUP BY corpus)",
            "conv AS (SELECT corpus, count(DISTINCT session_id) AS conversations FROM turns GROUP BY corpus)",
            f"totals AS (SELECT conv.corpus, CAST(conv.conversations AS BIGINT) AS conversations, {cols} FROM conv LEFT JOIN tot t ON conv.corpus = t.corpus)"]


def _sess_select(lexicon):
    cats = M.categories(lexicon)
    return ["corpus", "session_id", "utterances", "words", "tokens"] + [f"cnt_{_n(c)}" for c in cats] + [f"msgs_{_n(c)}" for c in cats]


@query("a3_session_markers", with_turns(*session_markers_sql(CORPUS_MARKERS)) + "SELECT * FROM sess")
def a3_session_markers(spark, sf_dir):
    """Per-session counts on the joined patient text, messages with hits."""
    return M.session_markers(turns_only(spark, sf_dir), CORPUS_MARKERS)


@query("a3_session_markers_first2", with_turns(*session_markers_sql(CORPUS_MARKERS, 2)) + "SELECT * FROM sess")
def a3_session_markers_first2(spark, sf_dir):
    """A3 with max_turns = 2."""
    return M.session_markers(turns_only(spark, sf_dir), CORPUS_MARKERS, max_turns=2)


@query("a4_corpus_totals", with_turns(*session_markers_sql(CORPUS_MARKERS), *totals_sql(CORPUS_MARKERS)) + "SELECT * FROM totals")
def a4_corpus_totals(spark, sf_dir):
    """A4: raw totals per corpus; conversations include sessions without patient text."""
    t = turns_only(spark, sf_dir)
    return M.corpus_totals(t, M.session_markers(t, CORPUS_MARKERS), CORPUS_MARKERS)


def _a6_sql():
    cats = [c for c in M.categories(CORPUS_MARKERS) if c not in ("first_person_singular", "social_pronouns")]
    parts = [f"""SELECT corpus, '{c}' AS metric,
        round(CASE WHEN tokens > 0 THEN cnt_{_n(c)} / tokens * 100 ELSE 0.0 END, 6) AS per_tokens,
        round(CASE WHEN utterances > 0 THEN msgs_{_n(c)} / utterances * 100.0 ELSE 0.0 END, 6) AS percentage_messages FROM totals"""
             for c in cats]
    ratio = """CASE WHEN cnt_social_pronouns > 0 THEN cnt_first_person_singular / cnt_social_pronouns
                    WHEN cnt_first_person_singular > 0 THEN 'Infinity'::DOUBLE ELSE 0.0 END"""
    parts.append(f"SELECT corpus, 'self_focus_ratio' AS metric, round({ratio}, 6) AS per_tokens, round({ratio}, 6) AS percentage_messages FROM totals")
    return " UNION ALL ".join(parts)


@query("a6_normalized_metrics", with_turns(*session_markers_sql(CORPUS_MARKERS), *totals_sql(CORPUS_MARKERS)) + _a6_sql())
def a6_normalized_metrics(spark, sf_dir):
    """Per 100 tokens, % of messages, self-focus ratio."""
    t = turns_only(spark, sf_dir)
    return M.normalized_metrics(M.corpus_totals(t, M.session_markers(t, CORPUS_MARKERS), CORPUS_MARKERS), CORPUS_MARKERS)


def _a7_sql():
    parts = [f"""SELECT corpus, '{c}' AS marker, round(avg(cnt_{_n(c)}), 6) AS mean, round(stddev_pop(cnt_{_n(c)}), 6) AS std,
                 round(CAST(quantile_cont(cnt_{_n(c)}::DOUBLE, 0.5) AS DOUBLE), 6) AS median,
                 min(cnt_{_n(c)}) AS min, max(cnt_{_n(c)}) AS max FROM sess GROUP BY corpus"""
             for c in M.categories(CORPUS_MARKERS)]
    return " UNION ALL ".join(parts)


@query("a7_per_conversation_stats", with_turns(*session_markers_sql(CORPUS_MARKERS)) + _a7_sql())
def a7_per_conversation_stats(spark, sf_dir):
    """Distribution of per-conversation counts (mean, pop. std, median, min, max)."""
    return M.per_conversation_stats(M.session_markers(turns_only(spark, sf_dir), CORPUS_MARKERS), CORPUS_MARKERS)


@query("a8_marker_matrix", with_turns(*session_markers_sql(CORPUS_MARKERS), *totals_sql(CORPUS_MARKERS)) + f"""
SELECT metric, round(max(CASE WHEN corpus = 'real' THEN per_tokens END), 6) AS "real",
       round(max(CASE WHEN corpus = 'synthetic' THEN per_tokens END), 6) AS synthetic
FROM ({_a6_sql()}) GROUP BY metric""")
def a8_marker_matrix(spark, sf_dir):
    """Marker × corpus matrix of per-100-token rates."""
    t = turns_only(spark, sf_dir)
    m = M.normalized_metrics(M.corpus_totals(t, M.session_markers(t, CORPUS_MARKERS), CORPUS_MARKERS), CORPUS_MARKERS)
    return M.marker_matrix(m, ["real", "synthetic"])


@query("a9_dataset_statistics", with_turns(*session_markers_sql(CORPUS_MARKERS), *totals_sql(CORPUS_MARKERS)) + """
SELECT corpus, conversations, utterances, words,
       round(CASE WHEN conversations > 0 THEN words / conversations ELSE 0.0 END, 6) AS words_per_conv,
       round(CASE WHEN conversations > 0 THEN utterances / conversations ELSE 0.0 END, 6) AS utterances_per_conv
FROM totals""")
def a9_dataset_statistics(spark, sf_dir):
    t = turns_only(spark, sf_dir)
    return M.dataset_statistics(M.corpus_totals(t, M.session_markers(t, CORPUS_MARKERS), CORPUS_MARKERS))


# --- message-grain disfluency / marker tables ----------------------------------

def message_disfluency_sql():
    dcats = M.categories(CORPUS_DISFLUENCIES)
    dis = ", ".join(f"{sql_count('text', CORPUS_DISFLUENCIES, c, lower_text=True)} AS dis_{_n(c)}" for c in dcats)
    total = " + ".join(sql_count('text', CORPUS_DISFLUENCIES, c, lower_text=True) for c in dcats)
    mk = ", ".join(f"{sql_count('text', CORPUS_LINGUISTIC, c, case_insensitive=False, lower_text=True)} AS mk_{_n(c)}"
                   for c in M.categories(CORPUS_LINGUISTIC))
    return [PATIENT_TURNS_CTE,
            f"""msg AS (SELECT corpus, session_id, turn, patient_idx, {word_count('text')} AS tokens,
                  CAST({total} AS BIGINT) AS dis_total, {dis}, {mk} FROM pt)"""]


@query("a10_a11_message_disfluency", with_turns(*message_disfluency_sql()) + """
SELECT corpus, session_id, turn, CAST(patient_idx AS BIGINT) AS patient_idx, tokens, dis_total, * EXCLUDE (corpus, session_id, turn, patient_idx, tokens, dis_total) FROM msg""")
def a10_a11_message_disfluency(spark, sf_dir):
    """A10 (substring disfluencies, per type and total) and A11 (regex markers) per message."""
    return M.message_disfluency(turns_only(spark, sf_dir), CORPUS_DISFLUENCIES, CORPUS_LINGUISTIC)


def paired_sql():
    mk = M.categories(CORPUS_LINGUISTIC)
    sums = ", ".join(f"sum(mk_{_n(c)}) AS mk_{_n(c)}" for c in mk)
    fields = ["dis", "tokens"] + [f"mk_{_n(c)}" for c in mk]
    cols = ", ".join(f"CAST(coalesce({s[0]}.{f}, 0) AS BIGINT) AS {s}_{f}" for s in ("real", "synthetic") for f in fields)
    return message_disfluency_sql() + [
        f"per AS (SELECT corpus, session_id, sum(dis_total) AS dis, sum(tokens) AS tokens, {sums} FROM msg GROUP BY corpus, session_id)",
        """pairs AS (SELECT session_id FROM turns GROUP BY session_id
                     HAVING max(CASE WHEN corpus = 'real' THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN corpus = 'synthetic' THEN 1 ELSE 0 END) = 1)""",
        f"""pj AS (SELECT p.session_id, {cols} FROM pairs p
              LEFT JOIN (SELECT * FROM per WHERE corpus = 'real') r ON p.session_id = r.session_id
              LEFT JOIN (SELECT * FROM per WHERE corpus = 'synthetic') s ON p.session_id = s.session_id)""",
        """paired AS (SELECT *, real_dis - synthetic_dis AS diff_dis,
              real_dis / greatest(real_tokens, 1) AS real_dis_norm, synthetic_dis / greatest(synthetic_tokens, 1) AS synthetic_dis_norm,
              real_dis / greatest(real_tokens, 1) - synthetic_dis / greatest(synthetic_tokens, 1) AS diff_norm FROM pj)"""]


@query("a12_paired_disfluency", with_turns(*paired_sql()) + """
SELECT * EXCLUDE (real_dis_norm, synthetic_dis_norm, diff_norm), round(real_dis_norm, 6) AS real_dis_norm,
       round(synthetic_dis_norm, 6) AS synthetic_dis_norm, round(diff_norm, 6) AS diff_norm FROM paired""")
def a12_paired_disfluency(spark, sf_dir):
    """Paired per-session totals, per-token rates with max(tokens, 1), differences."""
    return M.paired_disfluency(turns_only(spark, sf_dir), CORPUS_DISFLUENCIES, CORPUS_LINGUISTIC)


@query("a13_macro_rates", with_turns(*paired_sql()) + """
SELECT round(avg(real_dis_norm), 6) AS real_mean_norm, round(avg(synthetic_dis_norm), 6) AS synthetic_mean_norm,
       round(avg(diff_norm), 6) AS mean_diff_norm, count(*) AS sessions FROM paired""")
def a13_macro_rates(spark, sf_dir):
    return M.macro_rates(M.paired_disfluency(turns_only(spark, sf_dir), CORPUS_DISFLUENCIES, CORPUS_LINGUISTIC))


def _a14_sql():
    mk = M.categories(CORPUS_LINGUISTIC)
    per = " UNION ALL ".join(f"SELECT '{c}' AS marker, sum(real_mk_{_n(c)}) AS l, sum(synthetic_mk_{_n(c)}) AS r FROM paired" for c in mk)
    return f"""SELECT marker, CAST(l AS BIGINT) AS real_total, CAST(r AS BIGINT) AS synthetic_total, CAST(l - r AS BIGINT) AS difference FROM (
      {per}
      UNION ALL SELECT 'ALL', sum(l), sum(r) FROM ({per})
      UNION ALL SELECT 'disfluency', sum(real_dis), sum(synthetic_dis) FROM paired)"""


@query("a14_marker_totals", with_turns(*paired_sql()) + _a14_sql())
def a14_marker_totals(spark, sf_dir):
    """Total disfluency, per-marker totals and the all-marker total (rollup)."""
    p = M.paired_disfluency(turns_only(spark, sf_dir), CORPUS_DISFLUENCIES, CORPUS_LINGUISTIC)
    return M.marker_totals(p, CORPUS_LINGUISTIC).select(
        "marker", F.col("real_total").cast("bigint").alias("real_total"),
        F.col("synthetic_total").cast("bigint").alias("synthetic_total"), F.col("difference").cast("bigint").alias("difference"))


def _a15_sql():
    mk = M.categories(CORPUS_LINGUISTIC)
    l = " + ".join(f"real_mk_{_n(c)}" for c in mk)
    r = " + ".join(f"synthetic_mk_{_n(c)}" for c in mk)
    return f"""SELECT round(l / greatest(lt, 1), 6) AS real_per_token, round(r / greatest(rt, 1), 6) AS synthetic_per_token,
                      round(l / greatest(lt, 1) - r / greatest(rt, 1), 6) AS difference
               FROM (SELECT sum({l}) AS l, sum({r}) AS r, sum(real_tokens) AS lt, sum(synthetic_tokens) AS rt FROM paired)"""


@query("a15_micro_marker_rate", with_turns(*paired_sql()) + _a15_sql())
def a15_micro_marker_rate(spark, sf_dir):
    return M.micro_marker_rate(M.paired_disfluency(turns_only(spark, sf_dir), CORPUS_DISFLUENCIES, CORPUS_LINGUISTIC),
                               CORPUS_LINGUISTIC)


def _a16_sql(where):
    sec = {}
    for e in CORPUS_LINGUISTIC:
        sec.setdefault(e.category, e.section or "Other")
    per = " UNION ALL ".join(f"SELECT '{sec[c]}' AS section, real_mk_{_n(c)} AS l, synthetic_mk_{_n(c)} AS r FROM paired"
                             for c in M.categories(CORPUS_LINGUISTIC))
    return f"""SELECT section, round(sum(l) / nullif((SELECT sum(real_tokens) FROM paired), 0) * 100.0, 6) AS real_per_100,
                      round(sum(r) / nullif((SELECT sum(synthetic_tokens) FROM paired), 0) * 100.0, 6) AS synthetic_per_100
               FROM ({per}) WHERE {where} GROUP BY section"""


@query("a16_section_rates_excl_self", with_turns(*paired_sql()) + _a16_sql("section <> 'Self-focus'"))
def a16_section_rates_excl_self(spark, sf_dir):
    """Markers per 100 tokens by section, Self-focus excluded."""
    p = M.paired_disfluency(turns_only(spark, sf_dir), CORPUS_DISFLUENCIES, CORPUS_LINGUISTIC)
    return M.section_rates(p, CORPUS_LINGUISTIC, exclude=["Self-focus"])


@query("a16_section_rates_focus", with_turns(*paired_sql()) + _a16_sql("section IN ('Self-focus', 'Social/connection')"))
def a16_section_rates_focus(spark, sf_dir):
    """Only Self-focus and Social/connection."""
    p = M.paired_disfluency(turns_only(spark, sf_dir), CORPUS_DISFLUENCIES, CORPUS_LINGUISTIC)
    return M.section_rates(p, CORPUS_LINGUISTIC, keep=["Self-focus", "Social/connection"])


@query("a17_density_histogram", with_turns(*paired_sql()) + """,
long AS (SELECT 'real_dis_norm' AS series, real_dis_norm AS x FROM paired UNION ALL SELECT 'synthetic_dis_norm', synthetic_dis_norm FROM paired),
r0 AS (SELECT series, min(x) AS lo, max(x) AS hi, count(*) AS n FROM long GROUP BY series),
rng AS (SELECT series, n, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM r0),
rw AS (SELECT *, (hi - lo) / 10 AS width FROM rng),
b AS (SELECT long.series, CAST(least(floor((x - lo) / width), 9) AS BIGINT) AS bin FROM long JOIN rw ON long.series = rw.series),
c AS (SELECT series, bin, count(*) AS cnt FROM b GROUP BY series, bin),
grid AS (SELECT series, n, lo, width, CAST(unnest(range(0, 10)) AS BIGINT) AS bin FROM rw)
SELECT grid.series, grid.bin, round(lo + grid.bin * width, 6) AS bin_start, CAST(coalesce(cnt, 0) AS BIGINT) AS count,
       round(coalesce(cnt, 0) / (n * width), 6) AS density
FROM grid LEFT JOIN c ON grid.series = c.series AND grid.bin = c.bin""")
def a17_density_histogram(spark, sf_dir):
    """10-bin density histogram of the per-session disfluency rates."""
    p = M.paired_disfluency(turns_only(spark, sf_dir), CORPUS_DISFLUENCIES, CORPUS_LINGUISTIC)
    return M.density_histogram(p, ["real_dis_norm", "synthetic_dis_norm"])


@query("a18_per_turn_disfluency", with_turns(*paired_sql()) + """
SELECT CAST(patient_idx + 1 AS BIGINT) AS turn_index,
       CAST(sum(CASE WHEN corpus = 'real' THEN 1 ELSE 0 END) AS BIGINT) AS real_n_convos,
       CAST(sum(CASE WHEN corpus = 'synthetic' THEN 1 ELSE 0 END) AS BIGINT) AS synthetic_n_convos,
       round(coalesce(avg(CASE WHEN corpus = 'real' THEN dis_total / greatest(tokens, 1) END), 0.0), 6) AS real_mean_dis_norm,
       round(coalesce(avg(CASE WHEN corpus = 'synthetic' THEN dis_total / greatest(tokens, 1) END), 0.0), 6) AS synthetic_mean_dis_norm
FROM msg WHERE patient_idx < 12 AND session_id IN (SELECT session_id FROM pairs) GROUP BY patient_idx""")
def a18_per_turn_disfluency(spark, sf_dir):
    """Per-turn mean disfluency rate, first 12 turns, paired sessions."""
    return M.per_turn_disfluency(turns_only(spark, sf_dir), CORPUS_DISFLUENCIES)
