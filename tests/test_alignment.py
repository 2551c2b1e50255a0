"""Labels on their turns by content."""

import random
from itertools import combinations

from conftest import turns_df

from talkframe.operators.alignment import aligned_labels, longest_run


def _labels(spark, rows):
    return spark.createDataFrame([("real", *r) for r in rows], "corpus string, session_id bigint, label_idx bigint, label string, content string")


def _talk(session, texts, start=0):
    rows = []
    for i, t in enumerate(texts):
        rows += [("real", session, start + 2 * i, "user", f"q{i}"), ("real", session, start + 2 * i + 1, "assistant", t)]
    return rows


def _aligned(spark, labels, turns, **how):
    return {(r.session_id, r.label_idx): (r.label, r.patient_idx, r.turn, r.method, r["shift"])
            for r in aligned_labels(_labels(spark, labels), turns_df(spark, turns), **how).collect()}


def test_longest_run_is_the_first_of_the_longest():
    r = random.Random(1)
    assert longest_run([]) == [] and longest_run([5]) == [0] and longest_run([2, 1]) == [0]
    for _ in range(300):
        t = r.sample(range(20), r.randint(1, 8))
        runs = [c for k in range(1, len(t) + 1) for c in combinations(range(len(t)), k) if all(t[a] < t[b] for a, b in zip(c, c[1:]))]
        most = max(map(len, runs))
        assert tuple(longest_run(t)) == min(c for c in runs if len(c) == most)


def test_a_labeler_that_left_the_first_turn_out(spark):
    """The shape of the golden sample: 17 patient turns, 16 labels, the first of them for the second turn."""
    said = [f"{i}: this is what I say in this turn, at some length." for i in range(17)]
    labels = [(1, i, "PPPTTCCCCCCCCTPF"[i], said[i + 1]) for i in range(16)]
    got = _aligned(spark, labels, _talk(1, said))
    assert got == {(1, i): ("PPPTTCCCCCCCCTPF"[i], i + 1, 2 * (i + 1) + 1, "content", 1) for i in range(16)}


def test_repeated_retold_missing_and_added_messages(spark):
    said = ["hello there", "yes", "I lost my job", "yes", "  ", "nobody calls me", "thank you", "bye"]
    labels = [(1, 0, "P", "yes"), (1, 1, "P", "He lost his job"), (1, 2, "T", " yes "), (1, 3, "C", "nobody calls me"), (1, 4, "C", "an added one"),
              (1, 5, "F", "thank you"), (1, 6, "F", None), (1, 7, "F", "never said"),
              (2, 0, "P", "no text of mine"), (2, 1, "P", ""), (2, 2, "T", "nor this"),
              (3, 0, "P", "b is the second"), (3, 1, "T", "a is the first"), (3, 2, "C", "c is the third"), (9, 0, "P", "no such session")]
    turns = _talk(1, said) + _talk(2, ["one", "two"], start=10) + _talk(3, ["a is the first", "b is the second", "c is the third"])
    got = _aligned(spark, labels, turns)
    assert {k: v[1:4] for k, v in got.items()} == {
        (1, 0): (1, 3, "content"), (1, 1): (2, 5, "between"), (1, 2): (3, 7, "content"), (1, 3): (4, 11, "content"),
        (1, 4): (None, None, "unplaced"), (1, 5): (5, 13, "content"), (1, 6): (6, 15, "beside"), (1, 7): (None, None, "unplaced"),
        (2, 0): (0, 11, "position"), (2, 1): (1, 13, "position"), (2, 2): (None, None, "unplaced"),
        (3, 0): (1, 3, "content"), (3, 1): (None, None, "unplaced"), (3, 2): (2, 5, "content"), (9, 0): (None, None, "unplaced")}
    assert got[(1, 0)][4] == 1 and got[(2, 0)][4] == 0


def test_empty_tables(spark):
    assert _aligned(spark, [], _talk(1, ["a"])) == {} and _aligned(spark, [(1, 0, "P", "a")], []) == {(1, 0): ("P", None, None, "unplaced", None)}
