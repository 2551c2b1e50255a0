"""Pruned embedding recall, many literals in one pass, bounded lexicons, first disagreements."""

import random
import re

import numpy as np
import pytest
from conftest import turns_df
from pyspark.sql import functions as F

from talkframe import lexicons
from talkframe.functions import automaton
from talkframe.lexicons import Entry
from talkframe.operators import agreement as G
from talkframe.operators import markers as M
from talkframe.operators import similarity as S


def _vectors(spark, docs):
    rows = [(d, i, v.tolist()) for d, vs in docs.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "doc_id bigint, vec_id bigint, embedding array<double>")


def _plain(targets, cands):
    unit = lambda a: np.divide(a, np.linalg.norm(a, axis=1, keepdims=True), out=np.zeros_like(a), where=np.linalg.norm(a, axis=1, keepdims=True) > 0)
    return {d: (unit(t) @ unit(cands[d]).T).max(axis=1).mean() for d, t in targets.items() if d in cands}


def test_recall_equals_all_pairs_and_skips_most_blocks_of_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(30, 12)) * 3
    near = lambda n: centers[rng.integers(0, 30, n)] + rng.normal(size=(n, 12)) * 0.05
    targets = {1: near(600), 2: rng.normal(size=(90, 12)), 3: np.zeros((2, 12)), 4: near(3)}
    cands = {1: near(900), 2: np.vstack([rng.normal(size=(70, 12)), np.zeros((1, 12))]), 3: rng.normal(size=(3, 12)), 5: near(3)}
    t, c = _vectors(spark, targets), _vectors(spark, cands)
    got = {r.doc_id: (r.embedding_recall, r.n_targets) for r in S.embedding_recall(t, c, block_size=16).collect()}
    want = _plain(targets, cands)
    assert set(got) == {1, 2, 3} and all(got[d][0] == pytest.approx(want[d], abs=1e-9) and got[d][1] == len(targets[d]) for d in got)
    pairs = S.block_pairs(S._blocks(t, c, "doc_id", "vec_id", "embedding", 16))
    n = {r.doc: (r.n, r.k) for r in pairs.groupBy("doc").agg(F.count("*").alias("n"), F.count_if("kept").alias("k")).collect()}
    assert n[1][0] > 1000 and n[1][1] < 0.2 * n[1][0]


def _by_passes(text, entries, categories):
    out = [0] * categories
    for c, kind, p in entries:
        if kind == "substring":
            out[c] += text.count(p)
        else:
            out[c] += len(re.findall(r"(?<!\w)" + re.escape(p) + r"(?!\w)", text, re.I))
    return out


def test_one_pass_counts_what_a_pass_per_literal_counts():
    r = random.Random(4)
    for _ in range(300):
        pieces = ["a", "b", "ab", "ba", " ", "é", "-", "aa"]
        make = lambda n: "".join(r.choice(pieces) for _ in range(r.randint(1, n)))
        entries = [(r.randrange(3), r.choice(["substring", "word"]), make(3)) for _ in range(r.randint(1, 12))]
        text = make(60).replace("a", r.choice(["a", "A"]))
        assert automaton.Counter(entries, 3, True).count(text) == _by_passes(text, entries, 3)
    with pytest.raises(ValueError):
        automaton.Counter([(0, "word", "")], 1, True)


def test_a_lexicon_of_thousands_of_literals(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    lexicon = [Entry(f"c{i % 4}", w, "word" if i % 2 else "substring") for i, w in enumerate(words)] + [Entry("c0", r"\bx+\b", "regex")]
    texts = [" ".join(r.choice(words + ["xx", "w1w2", "W77"]) for _ in range(40)) for _ in range(12)] + ["", None]
    turns = turns_df(spark, [("real", i, 0, "assistant", t) for i, t in enumerate(texts)])
    cols = M.count_columns(F.col("text"), lexicon)
    got = {x.session_id: list(x)[1:] for x in turns.select("session_id", *cols).collect()}
    entries = [(int(e.category[1]), e.kind, e.pattern) for e in lexicon[:-1]]
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] == [None] * 4
            continue
        want = _by_passes(t, entries, 4)
        want[0] += len(re.findall(r"\bx+\b", t, re.I))
        assert got[i] == want
    sess = M.session_markers(turns, lexicon).collect()
    assert len(sess) == 12 and all(x.cnt_c1 == got[x.session_id][1] for x in sess)


def test_few_and_many_literals_agree(spark, monkeypatch):
    lexicon = lexicons.disfluency_lexicon()
    text = "Um, the number of plums, umm. [sigh] You know, uh huh, you know."
    turns = turns_df(spark, [("real", 1, 0, "assistant", text)])
    plain = M.message_disfluency(turns, lexicon).collect()
    monkeypatch.setattr(M, "PASSES", 0)
    assert M.message_disfluency(turns, lexicon).collect() == plain


def test_a_lexicon_frame_is_bounded(spark, monkeypatch):
    frame = lexicons.lexicon_frame(spark, lexicons.disfluency_lexicon())
    assert len(lexicons.as_rows(frame)) == len(lexicons.disfluency_lexicon())
    monkeypatch.setattr(lexicons, "MAX_ENTRIES", 3)
    with pytest.raises(ValueError):
        lexicons.as_rows(frame)


def test_first_disagreements_and_their_number(spark):
    rows = [("real", s, i, "P", "T" if (s + i) % 3 else "P") for s in range(40) for i in range(5)]
    pairs = spark.createDataFrame(rows, "corpus string, session_id bigint, idx bigint, a string, b string")
    want = sorted((c, s, i) for c, s, i, a, b in rows if a != b)
    got = G.disagreements(pairs, 7).collect()
    assert sorted((x.corpus, x.session_id, x.idx) for x in got) == want[:7] and {x.total_disagreements for x in got} == {len(want)}
    assert G.disagreements(pairs.where("false"), 7).count() == 0
