"""Scans by segments: the same rows as plain windows, and a hot conversation in many tasks."""

import random

import pytest
from conftest import turns_df
from pyspark.sql import functions as F

from talkframe.functions.segments import SEG, segment_of
from talkframe.operators import turns as T


def _rows(seed, n_sessions=12):
    r = random.Random(seed)
    rows = []
    for s in range(n_sessions):
        kind, n = r.choice(["mixed", "one", "blank"]), r.choice([1, 3, 8, 40])
        turn = r.choice([0, 0, -5, 7])
        for _ in range(n):
            role = "assistant" if kind == "one" else r.choice(["user", "assistant", "assistant", None])
            text = None if r.random() < 0.1 else "  " if kind == "blank" and r.random() < 0.5 else "w" * r.randint(0, 60)
            rows.append((r.choice(["real"]), s, turn, role, text))
            turn += r.choice([1, 1, 1, 2, 9])
    return rows


def _by_session(rows):
    out = {}
    for row in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        out.setdefault(row[:2], []).append(row)
    return out


def _merged(rows):
    out = []
    for key, own in _by_session(rows).items():
        runs = []
        for _, _, _, role, text in own:
            if runs and runs[-1][0] == role:
                runs[-1][1].append(text or "")
            else:
                runs.append((role, [text or ""]))
        out += [(*key, i, role, "\n".join(t), len(t)) for i, (role, t) in enumerate(runs)]
    return sorted(out, key=str)


def _numbered(rows, most):
    out = []
    for own in _by_session(rows).values():
        spoken = [(c, s, t, (x or "").strip()) for c, s, t, role, x in own if role == "assistant" and (x or "").strip()]
        out += [(*x, i) for i, x in enumerate(spoken) if most is None or i < most]
    return sorted(out)


def _budget(rows, budget, least):
    out = []
    for own in _by_session(rows).values():
        total = sum(len(x[4] or "") for x in own) // 4
        cut = len(own) > least and total > budget
        spent = 0
        for c, s, t, _, x in reversed(own):
            spent += len(x or "") // 4
            if not cut or spent <= budget:
                out.append((c, s, t, cut, len(own)))
    return sorted(out)


@pytest.mark.parametrize("seed,segment", [(1, 3), (2, 3), (3, 1), (4, 10), (5, 4096)])
def test_segmented_scans_equal_plain_ones(spark, seed, segment):
    rows = _rows(seed)
    t = turns_df(spark, rows).repartition(3)
    got = [tuple(x) for x in T.merge_consecutive(t, segment).collect()]
    assert sorted(got, key=str) == _merged(rows)
    for most in (None, 2, 5):
        got = T.patient_turns(t, most, segment).select("corpus", "session_id", "turn", "text", "patient_idx").collect()
        assert sorted(tuple(x) for x in got) == _numbered(rows, most)
    got = T.context_budget(t, 40, 4, segment).select("corpus", "session_id", "turn", "truncated", "n_messages").collect()
    assert sorted(tuple(x) for x in got) == _budget(rows, 40, 4)


def test_empty_turns(spark):
    t = turns_df(spark, [])
    assert T.merge_consecutive(t).count() == T.patient_turns(t).count() == T.context_budget(t, 1).count() == 0


def test_a_hot_conversation_spreads_over_the_tasks(spark):
    """One conversation of 40,000 messages among short ones: no task holds more than some of its segments."""
    hot = spark.range(40_000).select(F.lit("real").alias("corpus"), F.lit(1).cast("bigint").alias("session_id"), F.col("id").alias("turn"),
                                     F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.lit("some text").alias("text"))
    cold = spark.range(60_000).select(F.lit("real").alias("corpus"), (2 + F.col("id") % 3000).alias("session_id"),
                                      F.expr("id div 3000").alias("turn"), F.lit("assistant").alias("role"), F.lit("x").alias("text"))
    t = hot.unionByName(cold)
    keys = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = T.patient_turns(t, segment=500).withColumn("_task", F.spark_partition_id())
        per = got.where("session_id = 1").groupBy("_task").agg(F.count("*").alias("count"), F.max("patient_idx")).collect()
        assert len(per) > 8 and max(x["count"] for x in per) < 40_000 * 2 / 3 / 3
        last = got.where("session_id = 1").agg(F.max("patient_idx").alias("n"), F.count_distinct("patient_idx").alias("d")).first()
        assert (last.n, last.d) == (26_665, 26_666)
        merged = T.merge_consecutive(t, 500).where("session_id = 1")
        assert merged.count() == 26_667 and merged.agg(F.max("n_merged")).first()[0] == 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_segments_follow_the_order_column(spark):
    df = spark.createDataFrame([(-1,), (0,), (4095,), (4096,), (None,)], "turn bigint").withColumn(SEG, F.expr(segment_of("turn")))
    assert [x[SEG] for x in df.collect()] == [-1, 0, 0, 1, -(1 << 62)]
