"""Incremental ingest: only new file versions are read; the newest version of a session counts."""

import json
import os

import pytest

from talkframe.streaming import ingest
from talkframe.streaming.ingest import compact, current, ingest_sessions, log, pending_from_ingested


def _write(d, i, n_patient, stored, when=None, word="a"):
    os.makedirs(d, exist_ok=True)
    msgs = []
    for k in range(n_patient):
        msgs += [{"role": "user", "content": f"q{k}"}, {"role": "assistant", "content": f"{word}{k}"}]
    with open(f"{d}/session_{i}.json", "w") as f:
        json.dump({"messages": msgs, "num_patient_turns": stored}, f)
    if when:
        os.utime(f"{d}/session_{i}.json", (when, when))


def _todo(spark, n):
    return spark.createDataFrame([(i,) for i in range(1, n + 1)], "session_id bigint")


def _pending(spark, out, n):
    return sorted(r.session_id for r in pending_from_ingested(spark, _todo(spark, n), out).collect())


def test_incremental_ingest(spark, scratch):
    src, out = f"{scratch}/src", f"{scratch}/out"
    assert ingest_sessions(spark, src, out) == 0 and _pending(spark, out, 2) == [1, 2]
    _write(src, 1, 2, 2)
    _write(src, 2, 1, 3)
    assert ingest_sessions(spark, src, out) == 2
    t = spark.read.parquet(f"{out}/turns")
    assert t.count() == 6
    _write(src, 3, 2, 2)
    with open(f"{src}/session_4.json", "w") as f:
        f.write('{"messages": [')
    with open(f"{src}/session_5.json", "w") as f:
        f.write('{"num_patient_turns": 2}')
    open(f"{src}/session_6.json", "w").close()
    open(f"{src}/other.json", "w").close()
    assert ingest_sessions(spark, src, out) == 3  # restart: only what is new
    t = spark.read.parquet(f"{out}/turns")
    assert t.count() == 10 and t.select("session_id").distinct().count() == 3
    v = {r.session_id: r.status for r in spark.read.parquet(f"{out}/validation").collect()}
    assert v == {1: "pass", 2: "fail", 3: "pass", 4: "fail", 5: "fail"}
    assert _pending(spark, out, 6) == [2, 4, 5, 6]
    assert ingest_sessions(spark, src, out) == 0 and log(spark, out).agg({"batch_id": "max"}).first()[0] == 2


def test_a_regenerated_session_is_read_and_replaces_the_old_one(spark, scratch):
    src, out = f"{scratch}/src", f"{scratch}/out"
    _write(src, 1, 1, 3, when=1_000)
    _write(src, 2, 2, 2, when=1_000)
    ingest_sessions(spark, src, out)
    assert _pending(spark, out, 2) == [1]
    _write(src, 1, 3, 3, when=2_000, word="b")
    assert ingest_sessions(spark, src, out) == 1
    assert _pending(spark, out, 2) == []
    turns, validation = current(spark, out)
    assert sorted((r.session_id, r.text) for r in turns.where("role = 'assistant'").collect()) == \
        [(1, "b0"), (1, "b1"), (1, "b2"), (2, "a0"), (2, "a1")]
    assert validation.count() == 2
    _write(src, 2, 1, 5, when=3_000)  # a good one becomes a bad one
    _write(src, 3, 1, 1, when=500)    # a late one with an old date
    assert ingest_sessions(spark, src, out) == 2
    assert _pending(spark, out, 3) == [2] and current(spark, out)[0].where("session_id = 2").count() == 2
    compact(spark, out, f"{scratch}/compact")
    assert _pending(spark, f"{scratch}/compact", 3) == [2]
    assert spark.read.parquet(f"{scratch}/compact/turns").count() == current(spark, out)[0].count() == 10
    assert ingest_sessions(spark, src, f"{scratch}/compact") == 0


def test_a_step_that_dies_leaves_nothing_that_counts(spark, scratch, monkeypatch):
    src, out = f"{scratch}/src", f"{scratch}/out"
    _write(src, 1, 2, 2, when=1_000)
    ingest_sessions(spark, src, out)
    _write(src, 1, 1, 1, when=2_000, word="new")
    _write(src, 2, 1, 1, when=2_000)

    def dies(_):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(ingest, "_validated", dies)  # before anything of the batch is written
        with pytest.raises(RuntimeError):
            ingest_sessions(spark, src, out)
    # what a step that died after its turns leaves: turns of a batch without a log
    old = spark.read.parquet(f"{out}/turns/batch_id=1")
    old.write.parquet(f"{out}/turns/batch_id=2")
    assert current(spark, out)[0].count() == 4 and _pending(spark, out, 2) == [2]
    assert ingest_sessions(spark, src, out) == 2
    assert sorted(r.text for r in current(spark, out)[0].where("role = 'assistant'").collect()) == ["a0", "new0"]
    assert spark.read.parquet(f"{out}/turns").where("batch_id = 2").count() == 4


def test_the_stream_goes_on_seeing_new_versions(spark, scratch):
    import time
    src, out = f"{scratch}/src", f"{scratch}/out"
    _write(src, 1, 1, 2, when=1_000)
    q = ingest_sessions(spark, src, out, checkpoint=f"{scratch}/ckpt", available_now=False, every="1 second")
    try:
        for _ in range(60):
            if log(spark, out).count() == 1:
                _write(src, 1, 2, 2, when=2_000)
            if log(spark, out).count() >= 2:
                break
            time.sleep(1)
        assert q.exception() is None
    finally:
        q.stop()
    assert _pending(spark, out, 1) == []
