"""Counts over joined messages by pieces equal those over the joined text."""

import random
import re

import pytest

from conftest import turns_df
from talkframe.functions.seams import reach
from talkframe.lexicons import Entry, depressive_lexicon, disfluency_lexicon, linguistic_lexicon
from talkframe.operators import markers as M


def _count(text, e):
    if e.kind == "substring":
        return text.count(e.pattern)
    p = e.pattern if e.kind == "regex" else r"(?<!\w)" + re.escape(e.pattern) + r"(?!\w)"
    return len(re.findall(p, text, re.I))


def _want(sessions, lexicon):
    out = {}
    for s, texts in sessions.items():
        said = [t.strip() for t in texts if t is not None and t.strip()]
        if said:
            full = " ".join(said)
            count = lambda t, c: sum(_count(t, e) for e in lexicon if e.category == c)
            cats = M.categories(lexicon)
            out[s] = [len(said), len(full.split()), len(full) // 4, *[count(full, c) for c in cats],
                      *[sum(count(t, c) > 0 for t in said) for c in cats]]
    return out


def _got(spark, sessions, lexicon):
    rows = [("real", s, i, "assistant", t) for s, texts in sessions.items() for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    return {r.session_id: list(r)[2:] for r in M.session_markers(turns_df(spark, rows), lexicon).collect()}


PHRASES = [Entry("a", "ha ha", "substring"), Entry("a", "b a", "word"), Entry("b", r"\b(a b c|b ha)\b", "regex"), Entry("b", "a", "word"),
           Entry("c", r"\ba\W\Wha\b", "regex"), Entry("d", r"c+", "regex")]


@pytest.mark.parametrize("extra", [[], [Entry("d", r"a\s+b", "regex")]])
def test_phrases_over_many_seams(spark, extra):
    r = random.Random(7)
    words = ["ha", "a", "b", "c", "ha ha", "a b", "-", "aha"]
    sessions = {s: [" ".join(r.choice(words) for _ in range(r.randint(0, 4))) for _ in range(r.randint(1, 40))] for s in range(60)}
    sessions[60] = ["ha"] * 301                       # one chain of competing matches
    sessions[61] = ["ha", " ", None, "", "ha", "ha"]  # blank messages are not joined
    sessions[62] = [None, "  "]
    sessions[63] = ["a", "b", "c", "x" * 500 + " a", "b", "c " + "y" * 500]
    lexicon = PHRASES + extra
    assert _got(spark, sessions, lexicon) == _want(sessions, lexicon)
    assert _got(spark, sessions, lexicon)[60][3] == 150


def test_words_alone_need_no_seams(spark):
    lexicon = [Entry("a", r"\bha+\b", "regex"), Entry("b", "a", "substring")]
    sessions = {1: ["ha ha", "haa", "ah"], 2: ["", None, "ha"]}
    assert _got(spark, sessions, lexicon) == _want(sessions, lexicon)
    rows = [("real", 1, i, "assistant", "ha") for i in range(9)]
    plan = M.session_markers(turns_df(spark, rows), lexicon)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan


def test_empty_table(spark):
    assert M.session_markers(turns_df(spark, [("real", 1, 0, "user", "x")]), PHRASES).collect() == []


def test_reach_of_patterns():
    assert reach("substring", "you know") == (1, 8) and reach("word", "um") == (0, 0)
    for p in (r"\bI\b", r"(must|never)+", r"\w+\d*", r"[a-z]{3,}"[:5].replace("-", ""), r"y'know"):
        assert reach("regex", p) == (0, 0), p
    for p in (r"give up", r"a\Wb", r"a.b", r"[^a]", r"a[ -~]b", r"a\ b", r"a(?= b)"):
        assert reach("regex", p)[0] >= 1, p
    for p in (r"a\s+b", r".*", r"^a", r"a$", r"\Aa", r"(a ?b)\1", r"\Qa b\E", r"a {2}"):
        assert reach("regex", p) is None, p
    for lexicon in (depressive_lexicon(), linguistic_lexicon(), disfluency_lexicon(), disfluency_lexicon("word")):
        assert all(reach(e.kind, e.pattern) is not None for e in lexicon)
