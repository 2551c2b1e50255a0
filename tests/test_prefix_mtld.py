"""MTLD of every prefix against MTLD of each prefix taken alone."""

import random

import pytest
from conftest import turns_df

from talkframe.functions import mtld as M
from talkframe.operators import diversity as D


@pytest.mark.parametrize("steps", [1, 7, 256])
def test_prefixes_equal_texts_taken_alone(monkeypatch, steps):
    monkeypatch.setattr(M, "_STEPS", steps)
    r = random.Random(steps)
    for _ in range(400):
        k, n = r.choice([1, 2, 5, 30, 400]), r.randint(0, 300)
        words = [str(r.randint(1, k)) for _ in range(n)]
        if r.random() < 0.3:
            words = [f"x{i}" for i in range(n)] + words  # long stretches without a repeated word
        ends = sorted(r.randint(0, len(words)) for _ in range(r.randint(1, 8)))
        assert M.prefix_mtld(words, ends) == pytest.approx([M.mtld(words[:e]) for e in ends], abs=1e-9)


def test_work_stays_linear_in_the_words(monkeypatch):
    """4,000 prefixes of 40,000 words: the words looked at one by one are a few for each word of the text."""
    looked = [0]

    class Ids(list):
        def __getitem__(self, i):
            looked[0] += 1
            return list.__getitem__(self, i)
    real = M._factor_back
    monkeypatch.setattr(M, "_factor_back", lambda ids, *a: real(Ids(ids) if not isinstance(ids, Ids) else ids, *a))
    r = random.Random(2)
    words = [str(int(r.paretovariate(0.8))) for _ in range(10_000)]
    M.prefix_mtld(words, list(range(10, 10_001, 10)))
    assert looked[0] < 60 * len(words)


def test_cumulative_rows(spark):
    texts = ["a b c a", "", "um", "d d d e", None, "a b"]
    turns = turns_df(spark, [("real", 1, 2 * i, "assistant", t) for i, t in enumerate(texts)] + [("synthetic", 1, 0, "user", "x y")])
    msgs = D.message_words(turns)
    got = {r.turn_index: r for r in D.cumulative_strategy(msgs, min_tokens=5).collect()}
    so_far, want = [], {}
    for r in sorted(msgs.collect(), key=lambda r: r.turn):
        so_far += r.words
        if r.words:
            want[r.turn_index] = (len(so_far), M.mtld(so_far), len(so_far) >= 5)
    assert {k: (v.token_count, v.mtld, v.meets_threshold) for k, v in got.items()} == \
        {k: (n, pytest.approx(m), f) for k, (n, m, f) in want.items()}
    assert {v.speaker_type for v in got.values()} == {"Real"}
