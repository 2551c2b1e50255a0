"""Objects of JSON files read in many splits."""

import json
import random

import pytest

from talkframe.sources.corpus import read_raw_dialogs
from talkframe.sources.json_objects import read_json_objects


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def _value(r, deep=0):
    kind = r.random()
    if kind < 0.6 or deep > 3:
        return "".join(r.choice(['"', "\\", "}", "{", "]", "[", "é", "漢", "\n", "a", " ", ",", "🙂", "\t"]) for _ in range(r.randint(0, 30)))
    if kind < 0.75:
        return {f"k{i}": _value(r, deep + 1) for i in range(r.randint(0, 3))}
    return [_value(r, deep + 1) for _ in range(r.randint(0, 3))] if kind < 0.9 else r.choice([None, 1.5, True, -3])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_objects_equal_the_parsed_lists(spark, scratch, small_splits, seed):
    r = random.Random(seed)
    want = {}
    for f in range(6):
        docs = [{"id": i, "v": _value(r)} for i in range(r.choice([0, 1, 5, 30]))]
        text = json.dumps(docs, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1, 4]))
        if f == 4:  # one object after another
            text = "\n".join(json.dumps(d) for d in docs)
        if f == 5:  # blanks in front and behind
            text = "\n  " + text + "\n\n"
        (open(f"{scratch}/f{f}.json", "w", encoding="utf-8")).write(text)
        want |= {(f"f{f}.json", i): d for i, d in enumerate(docs)}
    df = read_json_objects(spark, f"{scratch}/*.json")
    got = {(x.file_path.split("/")[-1], x.position): json.loads(x.json) for x in df.collect()}
    assert got == want


def test_one_file_is_read_by_many_tasks(spark, scratch, small_splits):
    docs = [{"situation": f"s{i} }}", "dialog": [{"speaker": "seeker", "content": 'I "feel" {low}'}, {"speaker": "supporter", "content": "why?"}]}
            for i in range(50)]
    open(f"{scratch}/d.json", "w").write(json.dumps(docs))
    assert spark.read.option("lineSep", "}").text(f"{scratch}/d.json").rdd.getNumPartitions() > 20
    rows = sorted(read_raw_dialogs(spark, f"{scratch}/d.json").collect(), key=lambda x: x.id_source)
    assert [x.id_source for x in rows] == list(range(50)) and rows[7].situation == "s7 }" and rows[7].file == "d.json"
    assert [(m.role, m.content) for m in rows[49].messages] == [("assistant", 'I "feel" {low}'), ("user", "why?")]


def test_what_is_cut_off_is_no_object(spark, scratch):
    open(f"{scratch}/cut.json", "w").write('[{"a": 1}, {"b": {"c": 2}')
    open(f"{scratch}/one.json", "w").write('{"a": {"b": "}"}}')
    open(f"{scratch}/none.json", "w").write("[]")
    open(f"{scratch}/cut2.json", "w").write('[{"a": 1')
    got = sorted((x.file_path.split("/")[-1], x.position, x.json) for x in read_json_objects(spark, f"{scratch}/*.json").collect())
    assert got == [("cut.json", 0, '{"a": 1}'), ("one.json", 0, '{"a": {"b": "}"}}')]
