"""Quantiles of counts equal numpy's, whatever the spread of the values."""

import random

import numpy as np
import pytest

from talkframe.functions import quantiles as Q

PROBS = [0.0, 0.25, 0.5, 0.9, 1.0]
KEYS = ["corpus", "marker"]


@pytest.mark.parametrize("span", [1, 3, 1024])
def test_stats_of_groups(spark, monkeypatch, span):
    monkeypatch.setattr(Q, "SPAN", span)
    r = random.Random(span)
    groups = {("a", "x"): [0] * 500 + [r.randint(0, 9) for _ in range(100)], ("a", "y"): [r.randint(-50, 5000) for _ in range(301)],
              ("b", "x"): [7], ("b", None): [1, 2], (None, "x"): [-5, -4, 10 ** 12], ("c", "x"): [None]}
    rows = [(*k, v) for k, vs in groups.items() for v in vs]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "corpus string, marker string, n bigint")
    got = {(x.corpus, x.marker): x for x in Q.count_stats(df, "n", KEYS, PROBS).collect()}
    assert got.keys() == {k for k, vs in groups.items() if vs != [None]}
    for k, x in got.items():
        vs = groups[k]
        assert (x.n, x.min, x.max) == (len(vs), min(vs), max(vs))
        assert [x.mean, x["std"]] == pytest.approx([np.mean(vs), np.std(vs)], rel=1e-9)
        assert [x[f"q{i}"] for i in range(len(PROBS))] == pytest.approx([np.quantile(np.array(vs, float), p) for p in PROBS], rel=1e-12)
    assert Q.count_stats(df.where("false"), "n", KEYS, PROBS).count() == 0


def test_nothing_runs_while_the_query_is_built(spark, monkeypatch):
    monkeypatch.setattr(Q, "cut_lineage", lambda *a, **k: pytest.fail("a written step"))
    df = spark.createDataFrame([("a", 1)], "corpus string, n bigint")
    assert Q.count_stats(df, "n", ["corpus"], [0.5]).first().q0 == 1.0


def test_stats_of_large_counts(spark):
    from talkframe.lexicons import Entry
    from talkframe.operators.markers import per_conversation_stats
    r = random.Random(3)
    values = [r.randint(0, 10 ** 6) for _ in range(2001)] + [10 ** 9]
    df = spark.createDataFrame([("real", v) for v in values], "corpus string, cnt_a bigint")
    got = per_conversation_stats(df, [Entry("a", "x")]).first()
    assert (got.mean, got.median, got.min, got.max) == (pytest.approx(np.mean(values)), float(np.median(values)), min(values), max(values))
    assert got["std"] == pytest.approx(np.std(values), rel=1e-9)
