"""Readers and writers on JSON session trees written into a scratch folder."""

import json
import os

from pyspark.sql import functions as F

from talkframe.operators.quality import validate_turn_counts, validation_summary, folder_structure
from talkframe.sources import corpus as C
from talkframe.sources import sinks as K


def _session(path, messages, **extra):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        json.dump({"messages": [{"role": r, "content": c} for r, c in messages], **extra}, f, indent=2)


def _tree(root):
    prof = {"name": "Ann", "situation of the client": "lost my job", "symptom severity": {"Sleep": "Mild"}}
    for psi in ("patientpsi", "roleplaydoh"):
        for i in range(3):
            _session(f"{root}/{psi}/gpt-oss-120b/esc/session_{i}.json",
                     [("user", "hi"), ("assistant", f"hello {i}"), ("user", "and?"), ("assistant", "fine")],
                     profile=prof, ccd={"core_beliefs": "I am unlovable", "cognitive_models": []},
                     num_patient_turns=2, source="SYNTHETIC")
    _session(f"{root}/patientpsi/gpt-oss-120b/esc/turn/session_0.json", [("assistant", "variant")])
    with open(f"{root}/patientpsi/gpt-oss-120b/esc/session_9.json", "w") as f:
        f.write("{ broken json")
    with open(f"{root}/patientpsi/gpt-oss-120b/esc/notes.txt", "w") as f:
        f.write("ignore me")


def test_s1_s9_scan_and_quarantine(spark, scratch):
    _tree(scratch)
    d = f"{scratch}/patientpsi/gpt-oss-120b/esc"
    ok = C.scan_sessions(spark, d)
    assert sorted(r.session_id for r in ok.collect()) == [0, 1, 2]
    allrows = C.scan_sessions(spark, d, keep_corrupt=True)
    assert allrows.where("corrupt").count() == 1
    prof = ok.where("session_id = 0").select("profile").first()[0]
    assert json.loads(prof)["situation of the client"] == "lost my job"
    assert C.scan_sessions(spark, f"{scratch}/missing").count() == 0


def test_s2_s3_tree(spark, scratch):
    _tree(scratch)
    t = C.scan_tree(spark, scratch)
    assert t.count() == 6  # the turn/ variant and the broken file are left out
    g = {(r.psi, r.backend, r.dataset): r.sessions for r in folder_structure(t).collect()}
    assert g == {("patientpsi", "gpt-oss-120b", "esc"): 3, ("roleplaydoh", "gpt-oss-120b", "esc"): 3}
    syn = C.scan_synthetic(spark, f"{scratch}/roleplaydoh/gpt-oss-120b/esc")
    assert syn.select("source").distinct().first()[0] == "SYNTHETIC"


def test_s4_s5_paths(spark, scratch):
    _tree(scratch)
    df = spark.createDataFrame([("/x/patientpsi/m/esc/session_1.json",), ("/x/other/session_2.json",)], "p string")
    out = df.select(*C.psi_and_dataset(F.col("p"), ["patientpsi", "roleplaydoh"], ["esc", "hope"])).collect()
    assert (out[0].psi, out[0].dataset, out[0].path_error) == ("patientpsi", "esc", False)
    assert out[1].path_error is True
    found = C.resolve_synthetic_dir(spark, scratch, psi="patientpsi", model="gpt-oss-120b", dataset="esc")
    assert found.endswith("patientpsi/gpt-oss-120b/esc")
    nested = C.resolve_synthetic_dir(spark, os.path.dirname(scratch), psi="patientpsi", model="gpt-oss-120b", dataset="esc")
    assert nested is not None and nested.endswith("patientpsi/gpt-oss-120b/esc")  # via */psi/model/dataset
    assert C.resolve_synthetic_dir(spark, scratch, psi="x", model="y", dataset="z") is None
    d = f"{scratch}/patientpsi/gpt-oss-120b"
    assert C.resolve_synthetic_dir(spark, d, psi="p", dataset="esc") == f"{d}/esc"
    assert C.resolve_synthetic_dir(spark, f"{d}/esc", psi="p", dataset="esc") == f"{d}/esc"


def test_s10_variants(spark, scratch):
    _tree(scratch)
    d = f"{scratch}/patientpsi/gpt-oss-120b/esc"
    _session(f"{d}/session_5_turn.json", [("assistant", "alt")])
    v = {r.session_id: r.priority for r in C.read_with_variants(spark, d).collect()}
    assert v[0] == 0 and v[5] == 2


def test_s7_raw_dialogs(spark, scratch):
    p = f"{scratch}/esc.json"
    with open(p, "w") as f:
        json.dump([{"situation": "exam stress", "dialog": [{"speaker": "seeker", "content": "I am tired"},
                                                           {"speaker": "supporter", "content": "I hear you"}]},
                   {"situation": "", "dialog": []}], f)
    d = C.read_raw_dialogs(spark, p)
    rows = {r.id_source: r for r in d.collect()}
    assert rows[0].messages[0].role == "assistant" and rows[0].messages[1].role == "user"
    turns = C.to_turns(d.withColumnRenamed("id_source", "session_id"), "real")
    assert turns.count() == 2


def test_s6_s8_s11_roundtrip(spark, scratch):
    _tree(scratch)
    t = C.scan_tree(spark, scratch).withColumn("backend_llm", F.col("backend"))
    out = f"{scratch}/export"
    K.export_corpus(t.select("session_id", "messages", "profile", "ccd", "psi", "backend_llm", "num_patient_turns", "source"), out)
    back = C.read_published(spark, out, psi="PATIENTPSI")
    assert back.count() == 3 and back.where(F.col("messages_parsed").isNull()).count() == 0
    rp = C.read_published(spark, out, psi="roleplaydoh")
    assert set(r.ccd for r in rp.collect()) == {"{}"}
    real = f"{scratch}/real"
    spark.createDataFrame([(1, [("assistant", "a")], "{}", "ESC", "1"), (2, [("assistant", "b")], "{}", "HOPE", "2")],
                          "session_id bigint, messages array<struct<role:string,content:string>>, profile string, source string, id_source string"
                          ).write.parquet(real)
    assert C.read_real_corpus(spark, real, "esc").count() == 1
    assert C.read_real_corpus(spark, real, "all").count() == 2
    ids = spark.createDataFrame([(2,)], "session_id bigint")
    assert C.read_real_corpus(spark, real, "all", ids=ids).count() == 1
    try:
        C.read_real_corpus(spark, real, "nope")
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_s12_s13_writers(spark, scratch):
    df = spark.createDataFrame([("real", 1, 0.5), ("synthetic", 1, 0.25)], "corpus string, session_id bigint, x double")
    K.write_csv(df, f"{scratch}/csv")
    assert spark.read.option("header", True).csv(f"{scratch}/csv").count() == 2
    K.write_session_json(df, f"{scratch}/json")
    assert spark.read.json(f"{scratch}/json").where("corpus = 'real'").count() == 1


def test_s12_texts_come_back_as_they_were(spark, scratch):
    texts = ['say "no", she said', " led and trailed ", "a\nb\r\nc\td", "", None, '"', "back\\slash\\", ",", "#no comment", "ü𝄞"]
    df = spark.createDataFrame([(i, t, None if i % 2 else i / 4) for i, t in enumerate(texts)], "i bigint, text string, x double")
    K.write_csv(df.repartition(3), f"{scratch}/texts")
    back = K.read_csv(spark, f"{scratch}/texts", df.schema)
    want = sorted((r.i, r.text or None, r.x) for r in df.collect())   # an empty text comes back as null
    assert sorted(map(tuple, back.collect())) == want


def test_f19_turn_validation_files(spark, scratch):
    d = f"{scratch}/q"
    _session(f"{d}/session_1.json", [("user", "a"), ("assistant", "x"), ("user", "b"), ("assistant", "y"), ("assistant", " ")],
             num_patient_turns=2)
    _session(f"{d}/session_2.json", [("assistant", "x"), ("assistant", "y")], num_patient_turns=3)
    _session(f"{d}/session_3.json", [("assistant", "x")])
    with open(f"{d}/session_4.json", "w") as f:
        f.write("{not json")
    s = C.scan_sessions(spark, d, keep_corrupt=True)
    stored = s.select("session_id", "num_patient_turns", "corrupt")
    s4 = s.where("corrupt").select(F.regexp_extract("file_path", r"session_(\d+)", 1).cast("bigint").alias("sid")).first()
    stored = stored.withColumn("session_id", F.coalesce("session_id", F.lit(s4.sid)))
    turns = C.to_turns(s.where(~F.col("corrupt")), "synthetic")
    res = {r.session_id: r.status for r in validate_turn_counts(stored, turns).collect()}
    assert res == {1: "pass", 2: "fail", 3: "fail", 4: "fail"}
    summ = validation_summary(validate_turn_counts(stored, turns)).first()
    assert (summ.total, summ.passed, summ.failed) == (4, 1, 3)


def test_s8_case_insensitive_filter_prunes_partitions(spark, scratch):
    _tree(scratch)
    t = C.scan_tree(spark, scratch).withColumn("backend_llm", F.col("backend"))
    out = f"{scratch}/export2"
    K.export_corpus(t.select("session_id", "messages", "profile", "ccd", "psi", "backend_llm", "num_patient_turns", "source"), out)
    df = C.read_published(spark, out, psi="PatientPSI", backend="GPT-OSS-120B")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(psi_key" in plan and df.count() == 3


def test_bucketed_corpora_join_without_shuffle(spark, scratch):
    from pyspark.sql import functions as F
    rows = [("real" if i % 2 == 0 else "synthetic", i // 2, 0, "assistant", f"t{i}") for i in range(400)]
    t = spark.createDataFrame(rows, "corpus string, session_id bigint, turn bigint, role string, text string")
    K.write_bucketed_turns(t.where("corpus = 'real'"), "tf_real_b", 8, path=f"{scratch}/real_b")
    K.write_bucketed_turns(t.where("corpus = 'synthetic'"), "tf_syn_b", 8, path=f"{scratch}/syn_b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("tf_real_b").alias("r").join(spark.table("tf_syn_b").alias("s"), "session_id")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert j.count() == 200 and "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
