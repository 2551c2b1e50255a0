"""MTLD on whole Arrow batches: equal to texts taken alone, few words as Python objects, scored once."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from conftest import turns_df
from pyspark.sql import functions as F

from talkframe.functions import mtld as M
from talkframe.operators import diversity as D

WORDS, PARTS = pa.list_(pa.string()), pa.list_(pa.list_(pa.string()))


def _texts(r, n):
    return [[r.choice(["a", "b", "dé", f"w{r.randint(0, 40)}"]) for _ in range(r.choice([0, 1, 5, 60, 300]))] for _ in range(n)]


@pytest.mark.parametrize("size", [1, 37, 1 << 15])
def test_slices_of_batches_equal_texts_taken_alone(monkeypatch, size):
    monkeypatch.setattr(M, "_SLICE_WORDS", size)
    r = random.Random(size)
    texts = [None, *_texts(r, 150), None, []]
    for a, n in ((0, len(texts)), (17, 90), (3, 0)):  # a slice keeps the buffers of the whole
        got = M.mtld_udf.func(pa.array(texts, WORDS).slice(a, n))
        assert got.to_pylist() == [M.mtld(t) for t in texts[a:a + n]]
    sessions = [_texts(r, r.choice([0, 1, 4])) for _ in range(60)]
    for a, n in ((0, 60), (9, 30), (2, 0)):
        got = M.prefix_mtld_udf.func(pa.array(sessions, PARTS).slice(a, n)).to_pylist()
        for s, rows in zip(sessions[a:a + n], got, strict=True):
            ends = np.cumsum([len(m) for m in s]).tolist() if s else []
            assert rows == [{"token_count": e, "mtld": v} for e, v in zip(ends, M.prefix_mtld([w for m in s for w in m], ends))]


@pytest.mark.parametrize("udf, kind, of", [("mtld_udf", WORDS, lambda t: t), ("prefix_mtld_udf", PARTS, lambda t: [t])])
def test_python_objects_do_not_grow_with_the_batch(udf, kind, of):
    """600,000 words of which no two are equal: as Python strings they take more than 30 MB."""
    batch = pa.array((of([f"{i}-{j}" for j in range(300)]) for i in range(2000)), kind)
    tracemalloc.start()
    try:
        getattr(M, udf).func(batch)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 8e6


def test_box_summary_scores_each_text_once(spark):
    scored = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(x):
        scored.add(1)
        return None if x == 3 else float(x)
    results = spark.range(40).select(F.lit("Raw").alias("analysis_type"), F.lit("Real").alias("speaker_type"),
                                     F.col("id").alias("session_id"), score("id").alias("mtld"))
    row = D.box_summary(results).collect()[0]
    assert (row.sessions, row.whisker_low, row.whisker_high) == (39, 0.0, 39.0)
    assert scored.value == 40


def test_batches_of_long_texts_hold_few(spark):
    msgs = D.message_words(turns_df(spark, [("real", i, 0, "assistant", "x y") for i in range(16)]))

    @F.arrow_udf("int")
    def together(text: pa.Array) -> pa.Array:
        return pa.array([len(text)] * len(text), pa.int32())
    long = msgs.coalesce(1).select(together(F.repeat(F.element_at("words", 1), 1_000_000)).alias("n"))
    assert 1 <= max(r.n for r in long.collect()) <= 6
