"""Invariants over the driver's sf0.01 tables (SURVEY §5 strategy (3)) plus a
property test of MTLD against the definition."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talkframe.functions.mtld import mtld, mtld_one_way
from talkframe.operators import diversity as D
from talkframe.operators import labels as L
from talkframe.operators.lengths import compare_turn_lengths, turn_lengths
from talkframe.operators.turns import patient_turns
from talkframe.plans.q_labels import conv_labels, counts, judge_pairs
from talkframe.plans.testview import turns_only

SF = "/root/testdata/sf0.01"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(list("abcdefg")), min_size=1, max_size=60))
def test_mtld_properties(ws):
    m = mtld(ws)
    assert m == pytest.approx(mtld(ws[::-1]))
    assert m == pytest.approx((mtld_one_way(ws) + mtld_one_way(ws[::-1])) / 2)
    assert 0 < m <= len(ws) or len(set(ws)) < len(ws)


def test_lexical_diversity_invariants(spark):
    res = D.lexical_diversity(turns_only(spark, SF)).cache()
    raw = res.where("analysis_type = 'Raw'").select("session_id", "speaker_type", F.col("mtld").alias("raw"),
                                                    F.col("token_count").alias("n"))
    w = res.where("analysis_type = 'Cumulative'").groupBy("session_id", "speaker_type").agg(
        F.max_by("mtld", "turn_index").alias("last"), F.max("token_count").alias("last_n"))
    j = raw.join(w, ["session_id", "speaker_type"])
    assert j.where("n <> last_n").count() == 0
    assert j.where("abs(raw - last) > 1e-9").count() == 0
    m = res.where("analysis_type = 'Matched'").groupBy("session_id").agg(F.count_distinct("token_count").alias("k"))
    assert m.where("k <> 1").count() == 0
    res.unpersist()


def test_turn_counts_conserved(spark):
    t = turns_only(spark, SF)
    cmp = compare_turn_lengths(turn_lengths(t))
    tot = cmp.agg(F.sum("synthetic_count"), F.sum("real_count")).first()
    pt = patient_turns(t).groupBy("corpus").count().collect()
    n = {r.corpus: r["count"] for r in pt}
    assert (tot[0], tot[1]) == (n["synthetic"], n["real"])


def test_label_ratios_bounded(spark):
    c = counts(spark, SF)
    bad = c.where("P_ratio < 0 OR P_ratio > 1 OR F_ratio < 0 OR F_ratio > 1 OR "
                  "abs(P_ratio + T_ratio + C_ratio - CASE WHEN non_filler_turns > 0 THEN 1 ELSE 0 END) > 1e-9")
    assert bad.count() == 0


def test_alignment_is_min_length_truncation(spark):
    p = judge_pairs(spark, SF).groupBy("corpus", "session_id").agg(F.count(F.lit(1)).alias("n"))
    a = conv_labels(spark, SF).groupBy("corpus", "session_id").agg(F.count(F.lit(1)).alias("na"))
    from talkframe.plans.q_labels import turn_labels
    b = turn_labels(spark, SF).groupBy("corpus", "session_id").agg(F.count(F.lit(1)).alias("nb"))
    j = a.join(b, ["corpus", "session_id"]).join(p, ["corpus", "session_id"], "left")
    assert j.where("coalesce(n, 0) <> least(na, nb)").count() == 0


def test_positions_match_row_number_with_hot_group(spark):
    from pyspark.sql import Window
    from talkframe.functions.positions import positions
    rows = [(7 if i % 3 == 0 else i % 50, i // 7, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g bigint, t bigint, id bigint")
    a = positions(df, ["g"], ["t", "id"], partitions=12).select("id", "idx")
    b = df.select("id", (F.row_number().over(Window.partitionBy("g").orderBy("t", "id")) - 1).cast("bigint").alias("idx"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_exact_quantiles_match_numpy_with_a_hot_group(spark):
    import random

    import numpy as np
    from talkframe.functions.quantiles import exact_quantiles
    random.seed(7)
    rows = ([("a", random.random() * 100) for _ in range(3000)] + [("b", 7.0)] * 2000
            + [("b", float(i)) for i in range(10)] + [("c", 1.5)])
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.01, 0.25, 0.5, 0.95]
    small = {(r.g, r.p): r.quantile for r in exact_quantiles(df, "v", probs, by=["g"]).collect()}
    for g in "abc":
        vals = np.array([v for k, v in rows if k == g])
        for p in probs:
            want = np.percentile(vals, p * 100)
            assert small[(g, p)] == pytest.approx(want)
    glob = exact_quantiles(df.where("g = 'a'"), "v", [0.5]).first().quantile
    assert glob == pytest.approx(np.percentile([v for k, v in rows if k == "a"], 50))
