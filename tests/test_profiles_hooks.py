"""Profiles (P15, P16), JSON grab (P30), nested scores (S14), scorer hooks."""

import json

import pandas as pd
from pyspark.sql import functions as F

from talkframe.operators import judge as J
from talkframe.operators.profiles import flatten_ccd, render_profile
from talkframe.operators.replies import grab_json_object
from talkframe.operators.scores import nest_scores, flatten_nested
from talkframe.sources.sinks import session_scores_json


def test_p15_render_profile(spark):
    prof = {"name": "Ann", "age": "Unknown", "gender": "Female", "occupation": "Teacher", "marital status": "n/a",
            "situation of the client": "Lost her JOB", "counseling history": "None before",
            "resistance toward the support": "not mentioned",
            "symptom severity": {"Low mood": "Moderate to severe", "Sleep": "Mild"},
            "cognition distortion exhibition": {"Labeling": "Exhibited", "Mind reading": "Not exhibited"},
            "depression severity": "Moderate", "suicidal ideation severity": "cannot be determined",
            "homicidal ideation severity": "None"}
    df = spark.createDataFrame([(1, json.dumps(prof))], "session_id bigint, profile string")
    r = render_profile(df).first()
    assert r.profile_prompt == (
        "- name: ann\n- gender: female\n- occupation: teacher\n- situation of the client: lost her job\n"
        "- counseling history: None before\n- symptom severity\n  - low mood: severe\n  - low mood: moderate\n"
        "  - sleep: mild\n- cognition distortion exhibition\n  - labeling: exhibited\n- depression severity: Moderate\n"
        "- homicidal ideation severity: None\n")
    d = r.profile_dict
    assert (d.name, d.age, d.symptom_severity_mild, d.cognitive_distortion, d.depression_severity, d.suicidal_ideation_severity) == \
        ("ann", "", ["sleep"], ["labeling"], "Moderate", "")


def test_p16_flatten_ccd(spark):
    ccd = {"core_beliefs": "", "core_belief_description": "I am helpless", "intermediate_beliefs": "If I try I fail",
           "coping_strategies": "avoid", "cognitive_models": [{"situation": "exam", "automatic_thoughts": "I will fail",
                                                               "emotion": "fear", "behavior": "stay home"}]}
    df = spark.createDataFrame([(1, json.dumps(ccd), "Upset"), (2, json.dumps({"core_beliefs": "x", "life_history": "h", "intermediate_beliefs_during_depression": "d"}), None)],
                               "session_id bigint, ccd string, style string")
    styles = spark.createDataFrame([("Upset", "show frustration"), ("plain", "")], "style string, style_description string")
    r = {x.session_id: x for x in flatten_ccd(df, style_col="style", styles=styles).collect()}
    assert r[1].core_belief == "I am helpless" and r[1].situation == "exam" and r[1].style_instruction == "1. Upset\n - show frustration"
    assert r[2].core_belief == "x" and r[2].situation == "" and r[2].behavior == ""
    assert (r[2].life_history, r[2].intermediate_belief_depression, r[2].style_instruction) == ("h", "d", "1. plain")


def test_p30_grab_json(spark):
    df = spark.createDataFrame([('noise {"result": {"response": "ok"}} tail',), ("no json here",)], "r string")
    out = [x.o for x in df.select(grab_json_object(F.col("r"), "result struct<response:string>").alias("o")).collect()]
    assert out[0].result.response == "ok" and out[1] is None


def test_s14_nested_scores(spark):
    s = spark.createDataFrame([(1, 0, 2.0), (1, 1, 3.0), (2, 0, 5.0)], "session_id bigint, idx bigint, score double")
    nested = nest_scores(s)
    docs = sorted((json.loads(r.json) for r in session_scores_json(nested).collect()), key=lambda d: d["session_id"])
    assert docs == [{"session_id": 1, "scores": [2.0, 3.0]}, {"session_id": 2, "scores": [5.0]}]
    assert flatten_nested(nested).count() == 3


def test_u3_u4_scorer_hook(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "")], "session_id bigint, text string")

    def scorer(pdf):
        return pd.DataFrame({"n_words": pdf["text"].str.split().str.len().astype("int64")})

    out = {r.session_id: r.n_words for r in J.score_texts(df, scorer, "n_words bigint", ["session_id"]).collect()}
    assert out == {1: 3, 2: 0}

    def broken(pdf):
        raise RuntimeError("model down")

    assert J.score_texts(df, broken, "n_words bigint", ["session_id"]).where("n_words IS NULL").count() == 2


def test_replies_are_pinned(spark, scratch):
    from conftest import turns_df
    t = turns_df(spark, [("s", 1, 0, "user", "hi"), ("s", 1, 1, "assistant", "I feel low")])
    calls = []

    def judge(pdf):
        calls.append(len(pdf))
        return pdf["message"].map(lambda m: "P")

    kept = J.label_turns(t, judge=judge, keep=f"{scratch}/replies")
    assert kept.count() == 1 and kept.count() == 1
    assert spark.read.parquet(f"{scratch}/replies").first().raw_reply == "P"


def test_p27_fixed_size_batches(spark):
    df = spark.range(0, 100, 1, 2).selectExpr("id AS session_id", "cast(id AS string) AS text")

    def scorer(pdf):
        return pd.DataFrame({"batch_rows": [len(pdf)] * len(pdf)})

    out = J.score_texts(df, scorer, "batch_rows bigint", ["session_id"], batch_size=32, max_concurrency=3)
    sizes = [r.batch_rows for r in out.collect()]
    assert len(sizes) == 100 and max(sizes) <= 32
