"""Property tests: Spark operators against plain-Python statements of the same rules
on random inputs (one Spark job per example batch)."""

from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import turns_df
from talkframe.operators import turns as T

ROLES = st.sampled_from(["user", "assistant"])
TEXTS = st.text(alphabet="ab \n", min_size=0, max_size=12)


def py_merge(msgs):
    out = []
    for role, text in msgs:
        if out and out[-1][0] == role:
            out[-1] = (role, out[-1][1] + "\n" + text)
        else:
            out.append((role, text))
    return out


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.tuples(ROLES, TEXTS), min_size=1, max_size=8), min_size=1, max_size=4))
def test_merge_matches_python(spark, convs):
    rows = [("c", sid, i, r, t) for sid, msgs in enumerate(convs) for i, (r, t) in enumerate(msgs)]
    got = {}
    for r in T.merge_consecutive(turns_df(spark, rows)).collect():
        got.setdefault(r.session_id, []).append((r.turn, r.role, r.text))
    for sid, msgs in enumerate(convs):
        assert [(x[1], x[2]) for x in sorted(got[sid])] == py_merge(msgs)


def py_budget(tokens, budget, min_messages):
    if len(tokens) > min_messages and sum(tokens) > budget:
        kept, cur = [], 0
        for t in reversed(tokens):
            if cur + t > budget:
                break
            kept.insert(0, t)
            cur += t
        return kept
    return tokens


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=30), min_size=1, max_size=14), st.integers(min_value=0, max_value=60))
def test_context_budget_matches_loop(spark, toks, budget):
    rows = [("c", 1, i, "user", "x" * (4 * t)) for i, t in enumerate(toks)]
    kept = T.context_budget(turns_df(spark, rows), budget_tokens=budget, min_messages=3)
    got = [r.msg_tokens for r in kept.orderBy("turn").collect()]
    # the reference compares the whole history's ⌊Σchars/4⌋, equal to Σ⌊chars/4⌋ here
    assert got == py_budget(toks, budget, 3)
