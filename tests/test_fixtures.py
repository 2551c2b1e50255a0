"""Authored fixtures with hand-computed expectations (FIXTURES.md §3)."""

import json
import math

import pytest
from pyspark.sql import functions as F

from conftest import turns_df
from talkframe.functions.mtld import mtld
from talkframe.lexicons import depressive_lexicon, disfluency_lexicon
from talkframe.operators import agreement as G
from talkframe.operators import labels as L
from talkframe.operators import markers as M
from talkframe.operators import turns as T
from talkframe.operators.lengths import compare_turn_lengths, turn_lengths
from talkframe.operators.profiles import blank_placeholder, exhibited_distortions, severity_buckets
from talkframe.operators.replies import parse_label_json, parse_letter, split_thinking


def test_f1_merge_consecutive(spark):
    df = turns_df(spark, [("r", 1, 0, "user", "a"), ("r", 1, 1, "user", "b"), ("r", 1, 2, "assistant", "c"),
                          ("r", 1, 3, "user", "d")])
    out = [(r.role, r.text) for r in T.merge_consecutive(df).orderBy("turn").collect()]
    assert out == [("user", "a\nb"), ("assistant", "c"), ("user", "d")]


def _f2(spark):
    return turns_df(spark, [("r", 1, 0, "assistant", "I always feel bad, you"),
                            ("r", 1, 1, "user", "ok"),
                            ("r", 1, 2, "assistant", "know nothing helps me. Um, we lost")])


def test_f2_f3_markers_joined_and_message_grain(spark):
    s = M.session_markers(_f2(spark), depressive_lexicon()).first()
    assert (s.cnt_absolutist, s.cnt_depressive_words, s.cnt_non_fluencies, s.cnt_first_person_singular,
            s.cnt_social_pronouns) == (2, 2, 2, 2, 1)
    assert (s.words, s.tokens, s.utterances) == (12, 14, 2)
    assert (s.msgs_absolutist, s.msgs_depressive_words, s.msgs_non_fluencies, s.msgs_first_person_singular,
            s.msgs_social_pronouns) == (2, 2, 1, 2, 1)


def test_f4_normalized(spark):
    t = _f2(spark)
    lex = depressive_lexicon()
    m = {r.metric: r for r in M.normalized_metrics(M.corpus_totals(t, M.session_markers(t, lex), lex), lex).collect()}
    assert m["absolutist"].per_tokens == pytest.approx(14.285714, abs=1e-6)
    assert m["self_focus_ratio"].per_tokens == pytest.approx(2.0)
    only_me = turns_df(spark, [("r", 1, 0, "assistant", "me and my cat")])
    m2 = {r.metric: r for r in M.normalized_metrics(M.corpus_totals(only_me, M.session_markers(only_me, lex), lex), lex).collect()}
    assert math.isinf(m2["self_focus_ratio"].per_tokens)
    none = turns_df(spark, [("r", 1, 0, "assistant", "cats and dogs")])
    m3 = {r.metric: r for r in M.normalized_metrics(M.corpus_totals(none, M.session_markers(none, lex), lex), lex).collect()}
    assert m3["self_focus_ratio"].per_tokens == 0.0


def test_f5_substring_disfluencies(spark):
    t = turns_df(spark, [("r", 1, 0, "assistant", "Um, the number of plums, umm. [sigh] You know")])
    r = M.message_disfluency(t, disfluency_lexicon()).first().asDict()
    assert r["dis_um"] == 4 and r["dis_umm"] == 1 and r["dis_mm"] == 1 and r["dis_you_know"] == 1
    assert r["dis__sigh_"] == 1 and r["dis_total"] == 8 and r["tokens"] == 9


def test_f6_mtld():
    assert mtld("a b a b a b".split()) == 3.0
    assert mtld("a b c d".split()) == 4.0
    assert mtld(["a"]) == 1.0
    assert mtld("the cat sat on the mat and the cat ran".split()) == 10.0
    assert mtld([]) is None


def test_f6_mtld_native_fold_cross_check(spark):
    """The Arrow UDF agrees with a built-in ``aggregate`` fold (one direction each way)."""
    from talkframe.functions.mtld import mtld_udf
    texts = ["a b a b a b", "the cat sat on the mat and the cat ran", "x y z x y z x", "a"]
    df = spark.createDataFrame([(t.split(),) for t in texts], "w array<string>")

    def fold(arr):
        init = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(0).alias("n"), F.lit(0.0).alias("f"),
                        F.lit(1.0).alias("ttr"))

        def step(acc, x):
            seen = F.when(F.array_contains(acc["seen"], x), acc["seen"]).otherwise(F.array_append(acc["seen"], x))
            ttr = F.size(seen) / (acc["n"] + 1)
            close = ttr <= 0.72
            return F.struct(F.when(close, F.array().cast("array<string>")).otherwise(seen).alias("seen"),
                            F.when(close, 0).otherwise(acc["n"] + 1).alias("n"),
                            (acc["f"] + F.when(close, 1.0).otherwise(0.0)).alias("f"), ttr.alias("ttr"))

        def finish(acc):
            f = acc["f"] + F.when(acc["n"] > 0, (1 - acc["ttr"]) / (1 - 0.72)).otherwise(0.0)
            whole = F.size(F.array_distinct(arr)) / F.size(arr)
            f = F.when(f == 0, F.when(whole == 1, 1.0).otherwise((1 - whole) / (1 - 0.72))).otherwise(f)
            return F.size(arr) / f
        return F.aggregate(arr, init, step, finish)

    out = df.select(mtld_udf("w").alias("u"), ((fold(F.col("w")) + fold(F.reverse("w"))) / 2).alias("n")).collect()
    for r in out:
        assert r.u == pytest.approx(r.n)


def _pairs(spark, a, b):
    rows = [("c", 1, i, x, y) for i, (x, y) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "corpus string, session_id bigint, idx bigint, a string, b string")


def test_f7_agreement(spark):
    p = _pairs(spark, "PPTTCF", "PTTTCP")
    s = G.agreement_summary(p).first()
    assert s.accuracy == pytest.approx(0.666667, abs=1e-6) and s.kappa == pytest.approx(0.52, abs=1e-6)
    ca = {r.label: r.agreement for r in G.class_agreement(p, list("PTCF")).collect()}
    assert ca == {"P": 0.5, "T": 1.0, "C": 1.0, "F": 0.0}
    rep = {r.label: r for r in G.classification_report(p, list("PTCF")).collect()}
    assert rep["P"].precision == pytest.approx(0.5) and rep["T"].precision == pytest.approx(0.666667, abs=1e-6)
    assert rep["C"].precision == 1.0 and rep["F"].precision == 0.0
    cm = {r.true_label: [r.P, r.T, r.C, r.F] for r in G.confusion_matrix(p, list("PTCF")).collect()}
    assert cm == {"P": [1, 1, 0, 0], "T": [0, 2, 0, 0], "C": [0, 0, 1, 0], "F": [1, 0, 0, 0]}
    same = _pairs(spark, "PTCF", "PTCF")
    assert G.agreement_summary(same).first().kappa == pytest.approx(1.0)


def test_f8_rouge1_recall(spark):
    from talkframe.operators.similarity import rouge1_recall
    df = spark.createDataFrame([("c", 1, "i lost my job job".split(), "job lost job x".split())],
                               "corpus string, session_id bigint, target_words array<string>, cand_words array<string>")
    assert rouge1_recall(df).first().rouge1_recall == pytest.approx(0.6)


def test_f9_jaccard(spark):
    from talkframe.functions.text import jaccard_pct, ngrams
    df = spark.createDataFrame([("lost job bank debt".split(), "lost job home job bank".split())], "a array<string>, b array<string>")
    r = df.select(jaccard_pct("a", "b").alias("w"), jaccard_pct(ngrams("a", 2), ngrams("b", 2)).alias("n")).first()
    assert r.w == pytest.approx(60.0) and r.n == pytest.approx(40.0)


def test_f10_clip(spark):
    from talkframe.operators.scores import clipped_distribution
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([1, 2, 3, 4, 100])], "session_id bigint, idx bigint, score double")
    summary, hist = clipped_distribution(df)
    s = summary.first()
    assert s.p_low == pytest.approx(1.04) and s.p_high == pytest.approx(80.8) and s.kept == 3
    assert hist.agg(F.sum("count")).first()[0] == 3


def test_f11_density(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 0.1, 0.2, 0.5, 1.0]], "x double")
    h = {r.bin: r for r in M.density_histogram(df, ["x"]).collect()}
    assert sum(r["count"] for r in h.values()) == 5
    assert h[0]["count"] == 1 and h[9]["count"] == 1 and h[5]["count"] == 1
    assert h[9].density == pytest.approx(2.0)


def test_f12_context_budget(spark):
    rows = [("c", 1, i, "user", "x" * (4 * t)) for i, t in enumerate([10, 20, 5, 30])]
    kept = T.context_budget(turns_df(spark, rows), budget_tokens=40, min_messages=3)
    assert [r.msg_tokens for r in kept.orderBy("turn").collect()] == [5, 30]
    hist = T.render_history(kept).first().history
    assert hist.startswith("[Earlier messages truncated...]\nUser: ")


def test_f13_turn_lengths(spark):
    t = turns_df(spark, [("r", 1, 0, "assistant", "a b"), ("r", 1, 1, "assistant", "c"),
                         ("r", 2, 0, "assistant", "a b c d")])
    s = {r.turn: r for r in turn_lengths(t).collect()}
    assert (s[0].avg_words, s[0].std_words) == (3.0, 1.0) and (s[1].avg_words, s[1].std_words) == (1.0, 0.0)


def test_f14_parse_letter(spark):
    df = spark.createDataFrame([(x,) for x in ["TRANSITION", "not sure", "C", "Problem.", "42", "filler"]], "r string")
    assert [r.l for r in df.select(parse_letter(F.col("r")).alias("l")).collect()] == ["T", "T", "C", "P", None, "F"]


def test_f15_parse_label_json(spark):
    replies = ['[{"content":"a","classification":"P"}]', '{"classifications":[{"content":"a","classification":"T"}]}',
               '["P","T"]', '[[{"content":"a","classification":"C"}]]', "not json", '[{"content":"a"}]',
               '{"labels":["P","F"]}', '[{"content":"a","classification":5}]', '```json\n["C"]\n```']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    items = df.select("i", parse_label_json(F.col("r")).alias("x")).orderBy("i").collect()
    labels = [None if r.x is None else [y.classification for y in r.x if y.classification in "PTCF"] for r in items]
    assert labels == [["P"], ["T"], ["P", "T"], ["C"], None, [], ["P", "F"], [], ["C"]]


def test_f16_backend_names(spark):
    df = spark.createDataFrame([(x,) for x in ["hosted_vllm_openai_gpt-oss-120b", "hosted_vllm_meta-llama_Llama-3.1",
                                               "Qwen_Qwen_x"]], "n string")
    assert [r.b for r in df.select(T.normalize_backend(F.col("n")).alias("b")).collect()] == ["gpt-oss-120b", "Llama-3.1", "Qwen_x"]
    assert spark.range(1).select(T.safe_name(F.lit("a/b:c d"))).first()[0] == "a_b_c_d"


def test_f17_placeholders(spark):
    vals = ["", "Unknown", "n/a", "Age cannot be determined", "not mentioned", "teacher"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    assert [r.o for r in df.select(blank_placeholder(F.col("v")).alias("o")).collect()] == ["", "", "", "", "", "teacher"]


def test_f18_severity(spark):
    df = spark.createDataFrame([({"Low mood": "Moderate to severe", "Sleep": "Mild", "Appetite": "none"},
                                 {"Overgeneralization": "Exhibited", "Labeling": "Not exhibited"})],
                               "s map<string,string>, d map<string,string>")
    r = df.select(*severity_buckets(F.col("s")), exhibited_distortions(F.col("d")).alias("dist")).first()
    assert r.mild_symptoms == ["sleep"] and r.moderate_symptoms == ["low mood"] and r.severe_symptoms == ["low mood"]
    assert r.dist == ["overgeneralization"]


def test_f20_golden_sample(spark):
    labels = "PPPTTCCCCCCCCTPF"
    lab = spark.createDataFrame([("s", 1, i, x) for i, x in enumerate(labels)],
                                "corpus string, session_id bigint, label_idx bigint, label string")
    sessions = lab.select("corpus", "session_id").distinct()
    c = L.conversation_label_counts(lab, sessions).first()
    assert (c.P_count, c.T_count, c.C_count, c.F_count) == (4, 3, 8, 1)
    assert c.P_ratio == pytest.approx(4 / 15) and c.T_ratio == pytest.approx(0.2) and c.C_ratio == pytest.approx(8 / 15)
    assert c.F_ratio == pytest.approx(0.0625)
    turns = turns_df(spark, [("s", 1, 2 * i, "assistant", f"m{i}") for i in range(17)])
    chk = L.label_count_check(turns, lab, history_limit=32).first()
    assert (chk.expected, chk.received, chk.has_mismatch) == (16, 16, False)


def test_conversations_without_labels_or_patient_text_are_counted(spark):
    turns = turns_df(spark, [("s", 1, 0, "user", "hi"), ("s", 1, 1, "assistant", "ok"), ("s", 2, 0, "user", "hi"),
                             ("s", 3, 0, "user", " "), ("s", 3, 1, "assistant", None)])
    lab = spark.createDataFrame([("s", 1, 0, "P")], "corpus string, session_id bigint, label_idx bigint, label string")
    c = {r.session_id: r for r in L.conversation_label_counts(lab, L.sessions_of(turns)).collect()}
    assert [c[i].total_patient_turns for i in (1, 2, 3)] == [1, 0, 0] and c[2].F_ratio == 0.0 and c[2].P_ratio == 0.0
    chk = {r.session_id: r for r in L.label_count_check(turns, lab).collect()}
    assert [(chk[i].expected, chk[i].received, chk[i].has_mismatch) for i in (1, 2, 3)] == [(1, 1, False), (0, 0, False), (0, 0, False)]
    t = {r.session_id: (r.transcript, r.n_messages) for r in T.transcripts(turns, history_limit=32, empty_text="-").collect()}
    assert t == {1: ("THERAPIST: hi\nPATIENT: ok", 2), 2: ("THERAPIST: hi", 1), 3: ("-", 0)}
    from talkframe.operators.agreement import agreement_by_conversation, align
    a = agreement_by_conversation(align(lab, lab), L.sessions_of(turns))
    assert {(r.session_id, r.n, r.accuracy) for r in a.collect()} == {(1, 1, 1.0), (2, 0, 0.0), (3, 0, 0.0)}
    h = turns_df(spark, [("s", 1, 0, "user", " "), ("s", 1, 1, "assistant", "x")])
    assert T.history_windows(h).first().history == ""
    from talkframe.operators.turns import transcript_line
    row = spark.createDataFrame([(" Assistant ", " a\nb ")], "r string, t string")
    assert row.select(transcript_line(F.col("r"), F.col("t"), "client")).first()[0] == "Client: a b"
    assert row.select(transcript_line(F.lit("user"), F.lit("x"), "plain")).first()[0] == "therapist:x"


def test_emotion_of_a_blank_padded_letter_is_zero(spark):
    from talkframe.operators.emotion import lexicon_table, turn_emotions
    t = turns_df(spark, [("c", 1, 0, "assistant", " a "), ("c", 1, 1, "assistant", "a a")])
    z = turn_emotions(t, lexicon_table(spark, [("a", "sadness"), ("b", "joy")])).orderBy("idx").collect()
    assert z[0].sadness == 0.0 and z[1].sadness > 0


def test_f21_split_thinking(spark):
    df = spark.createDataFrame([("reason </THINK> ans",), ("none",)], "r string")
    out = [(r.thinking, r.response) for r in df.select(*split_thinking(F.col("r"))).collect()]
    assert out == [("reason", "ans"), (None, "none")]


def test_f22_emotion_z(spark):
    from talkframe.operators.emotion import _z
    r = spark.range(1).select(_z(F.lit(8), F.lit(20), F.lit(0.2)).alias("z")).first()
    assert r.z == pytest.approx(2.236068, abs=1e-6) and abs(r.z) >= 1.96


def test_f23_turn_budget(spark):
    a = [("c", 1, i, "assistant" if i % 2 == 0 else "user", "x") for i in range(10)]
    b = [("c", 2, i, "user" if i % 2 == 0 else "assistant", "x") for i in range(50)]
    out = {r.session_id: r for r in T.turn_budget(turns_df(spark, a + b), max_turns=20).collect()}
    assert (out[1].turn_budget, out[1].blank_opening) == (4, True)
    assert (out[2].turn_budget, out[2].blank_opening) == (20, False)


def test_f24_compare_turn_lengths(spark):
    t = turns_df(spark, [("real", 1, 0, "assistant", "a b"), ("real", 1, 1, "assistant", "a"),
                         ("synthetic", 1, 0, "assistant", "a"), ("synthetic", 2, 0, "assistant", "a b c"),
                         ("synthetic", 2, 1, "user", "x"), ("synthetic", 2, 2, "assistant", ""),
                         ("synthetic", 3, 0, "assistant", "q"), ("synthetic", 3, 1, "assistant", "r"),
                         ("synthetic", 3, 2, "assistant", "s")])
    c = {r.turn: r for r in compare_turn_lengths(turn_lengths(t)).collect()}
    assert set(c) == {0, 1, 2}
    assert c[2].real_count == 0 and c[2].words_diff is None and c[0].words_diff is not None


def test_q6_word_mode_disfluencies(spark):
    t = turns_df(spark, [("r", 1, 0, "assistant", "Um, the number of plums, umm. [sigh] You know")])
    r = M.message_disfluency(t, disfluency_lexicon("word")).first().asDict()
    assert r["dis_um"] == 1 and r["dis_umm"] == 1 and r["dis_mm"] == 0 and r["dis__sigh_"] == 1
    assert r["dis_you_know"] == 1 and r["dis_total"] == 4


def test_q5_profile_context(spark):
    from talkframe.operators.scores import score_responses, train_bigram_model
    t = turns_df(spark, [("r", 1, 0, "assistant", "job lost"), ("r", 1, 1, "user", "why"), ("r", 1, 2, "assistant", "lost job")])
    model = train_bigram_model(t)
    plain = {r.patient_idx: r.nll for r in score_responses(t, model).collect()}
    prof = spark.createDataFrame([("r", 1, "Patient lost her job")], "corpus string, session_id bigint, profile_text string")
    withp = {r.patient_idx: r.nll for r in score_responses(t, model, profiles=prof).collect()}
    assert withp[1] == pytest.approx(plain[1]) and withp[0] != pytest.approx(plain[0])


def test_marker_report_shares_one_feature_table(spark):
    t = _f2(spark).unionByName(turns_df(spark, [("s", 2, 0, "assistant", "we always talk")]))
    rep = M.marker_report(t, depressive_lexicon(), corpora=["r", "s"])
    try:
        assert rep["totals"].count() == 2 and rep["dataset"].count() == 2
        m = {r.metric: r for r in rep["matrix"].collect()}
        assert m["absolutist"].r == pytest.approx(14.285714, abs=1e-6)
        assert "InMemoryTableScan" in rep["normalized"]._jdf.queryExecution().executedPlan().toString()
    finally:
        rep["features"].unpersist()


def test_p18_marker_only_when_messages_dropped(spark):
    # per-message tokens 0+0+0+0 fit a budget of 1 although ⌊Σchars/4⌋ = 2 exceeds it
    rows = [("c", 1, i, "user", "abc") for i in range(4)]
    kept = T.context_budget(turns_df(spark, rows), budget_tokens=1, min_messages=3)
    assert kept.count() == 4
    assert not T.render_history(kept).first().history.startswith("[Earlier")
