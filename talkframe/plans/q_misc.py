"""Registered queries: joins, sort/limit/sample, quality and profile fields
(J1, J2, J5, J7, J12, L1-L3, A55-A57, S16, P12, P13)."""

from pyspark.sql import functions as F

from talkframe.operators import quality as Q
from talkframe.operators.profiles import blank_placeholder, json_field
from talkframe.operators.turns import format_messages, patient_messages, session_turn_counts, turn_budget
from talkframe.plans.catalog import query
from talkframe.plans.sqlfrag import strip as s_strip, with_turns
from talkframe.plans.testview import table, turns_only, turns_view


@query("j1_pair_sessions", with_turns() + """,
c AS (SELECT corpus, session_id, count(*) AS n FROM turns GROUP BY corpus, session_id)
SELECT r.session_id, r.n AS real_messages, s.n AS synthetic_messages FROM c r JOIN c s
  ON r.session_id = s.session_id AND r.corpus = 'real' AND s.corpus = 'synthetic'""")
def j1_pair_sessions(spark, sf_dir):
    """Real ⋈ synthetic on session_id (message counts per side)."""
    c = turns_only(spark, sf_dir, dealt=False).groupBy("corpus", "session_id").agg(F.count(F.lit(1)).alias("n"))
    r = c.where(F.col("corpus") == "real").select("session_id", F.col("n").alias("real_messages"))
    s = c.where(F.col("corpus") == "synthetic").select("session_id", F.col("n").alias("synthetic_messages"))
    return r.join(s, "session_id", "inner")


@query("j2_restrict_ids", with_turns() + """
SELECT session_id, count(*) AS n_messages FROM turns
WHERE corpus = 'real' AND session_id IN (SELECT doc_id FROM labels) GROUP BY session_id""")
def j2_restrict_ids(spark, sf_dir):
    """Real corpus restricted to the ids listed in ``labels.doc_id`` (left semi)."""
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("session_id"))
    t = turns_only(spark, sf_dir, dealt=False).where(F.col("corpus") == "real").join(ids, "session_id", "left_semi")
    return t.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_messages"))


_FMT = "upper(role) || ': ' || regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


@query("j5_side_by_side", with_turns(f"""f AS (SELECT corpus, session_id, turn AS pos, {_FMT} AS line FROM turns)""") + """
SELECT coalesce(r.session_id, s.session_id) AS session_id, coalesce(r.pos, s.pos) AS pos,
       coalesce(r.line, '') AS "real", coalesce(s.line, '') AS synthetic, coalesce(v.line, '') AS variant
FROM (SELECT * FROM f WHERE corpus = 'real') r FULL OUTER JOIN (SELECT * FROM f WHERE corpus = 'synthetic') s
  ON r.session_id = s.session_id AND r.pos = s.pos
LEFT JOIN (SELECT session_id - 1 AS session_id, pos, line FROM f WHERE corpus = 'synthetic') v
  ON coalesce(r.session_id, s.session_id) = v.session_id AND coalesce(r.pos, s.pos) = v.pos""")
def j5_side_by_side(spark, sf_dir):
    """Real / synthetic / turn-variant messages side by side by position
    (full join of the first two, left join of the variant; padded with '')."""
    f = format_messages(turns_only(spark, sf_dir, dealt=False)).select(
        "corpus", "session_id", F.col("turn").alias("pos"), F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("line"))
    r = f.where(F.col("corpus") == "real").select("session_id", "pos", F.col("line").alias("real"))
    s = f.where(F.col("corpus") == "synthetic").select("session_id", "pos", F.col("line").alias("synthetic"))
    # the turn variant of a session is the synthetic talk of the next one
    v = s.select((F.col("session_id") - 1).alias("session_id"), "pos", F.col("synthetic").alias("variant"))
    j = r.join(s, ["session_id", "pos"], "full").join(v, ["session_id", "pos"], "left")
    return j.select("session_id", "pos", *[F.coalesce(c, F.lit("")).alias(c) for c in ("real", "synthetic", "variant")])


@query("j7_pending_sessions", with_turns() + f"""
, cnt AS (SELECT corpus, session_id, count(*) FILTER (WHERE role IN ('assistant', 'patient')) AS n_patient, arg_min(role, turn) AS first_role,
               count(*) FILTER (WHERE role = 'assistant' AND length({s_strip('text')}) > 0) AS spoken FROM turns GROUP BY ALL)
SELECT r.session_id FROM cnt r LEFT JOIN cnt s ON r.session_id = s.session_id AND s.corpus = 'synthetic'
WHERE r.corpus = 'real' AND least(r.n_patient, 20) - CASE WHEN r.first_role IN ('assistant', 'patient') THEN 1 ELSE 0 END <> coalesce(s.spoken, 0)""")
def j7_pending_sessions(spark, sf_dir):
    """Real sessions whose synthetic counterpart is missing or does not hold the
    stored number of patient turns (A55 status), by a left anti join."""
    todo = turns_only(spark, sf_dir, dealt=False).where(F.col("corpus") == "real").select("session_id").distinct()
    return Q.pending_sessions(todo, Q.valid_sessions(_validation(spark, sf_dir)))


@query("j12_set_ops", with_turns() + """
SELECT 'both_corpora' AS kind, count(*) AS n FROM (SELECT session_id FROM turns WHERE corpus = 'real' INTERSECT SELECT session_id FROM turns WHERE corpus = 'synthetic')
UNION ALL SELECT 'either_corpus', count(*) FROM (SELECT session_id FROM turns WHERE corpus = 'real' UNION SELECT session_id FROM turns WHERE corpus = 'synthetic')
UNION ALL SELECT 'turn_keys', count(*) FROM (SELECT turn FROM turns WHERE corpus = 'real' UNION SELECT turn FROM turns WHERE corpus = 'synthetic')""")
def j12_set_ops(spark, sf_dir):
    """Intersection / union of session-id sets and union of turn keys."""
    t = turns_only(spark, sf_dir, dealt=False)
    # one pass: a row is a session key and a turn key, and each key is seen once per corpus
    long = t.where(F.col("corpus").isin("real", "synthetic")).select("corpus", F.inline(F.array(
        F.struct(F.lit("session").alias("what"), F.col("session_id").alias("key")), F.struct(F.lit("turn").alias("what"), F.col("turn").alias("key")))))
    per = long.groupBy("what", "key").agg(F.count_distinct("corpus").alias("sides"))
    session = F.col("what") == "session"
    kinds = {"both_corpora": session & (F.col("sides") == 2), "either_corpus": session, "turn_keys": ~session}
    return per.agg(F.array(*[F.struct(F.lit(k).alias("kind"), F.count_if(c).alias("n")) for k, c in kinds.items()]).alias("_k")).select(F.inline("_k"))


@query("l1_first_rows", with_turns() + """
SELECT session_id, turn, role FROM turns WHERE corpus = 'real' ORDER BY session_id, turn LIMIT 25""")
def l1_first_rows(spark, sf_dir):
    """L1: first 25 rows of the real corpus in explicit (session, turn) order."""
    t = turns_only(spark, sf_dir, dealt=False).where(F.col("corpus") == "real")
    return t.orderBy("session_id", "turn").limit(25).select("session_id", "turn", "role")


@query("l2_first_ids", with_turns() + """
SELECT DISTINCT session_id FROM turns WHERE corpus = 'synthetic' ORDER BY session_id LIMIT 10""")
def l2_first_ids(spark, sf_dir):
    """L2: first 10 session ids after a numeric sort."""
    t = turns_only(spark, sf_dir, dealt=False).where(F.col("corpus") == "synthetic")
    return t.select("session_id").distinct().orderBy("session_id").limit(10)


@query("l3_seeded_sample", with_turns() + """
SELECT session_id FROM (SELECT DISTINCT session_id FROM turns) s
ORDER BY md5(CAST(session_id AS VARCHAR) || '-42'), session_id LIMIT 10""")
def l3_seeded_sample(spark, sf_dir):
    """L3: deterministic seeded sample of 10 sessions (hash order with seed 42;
    partition-independent).  The sample is the feature, so the limit stays."""
    t = turns_only(spark, sf_dir, dealt=False).select("session_id").distinct()
    return t.orderBy(F.md5(F.concat(F.col("session_id").cast("string"), F.lit("-42"))), "session_id").limit(10)


_A55 = with_turns(
    """n AS (SELECT corpus, session_id, CAST(sum(CASE WHEN role IN ('assistant', 'patient') THEN 1 ELSE 0 END) AS BIGINT) AS n_patient,
         arg_min(role, turn) AS first_role FROM turns GROUP BY corpus, session_id)""",
    """stored AS (SELECT session_id, CAST(least(n_patient, 20) - CASE WHEN first_role IN ('assistant', 'patient') THEN 1 ELSE 0 END AS BIGINT) AS stored
           FROM n WHERE corpus = 'real')""",
    f"""act AS (SELECT session_id, count(*) AS actual FROM turns WHERE corpus = 'synthetic' AND role = 'assistant' AND length({s_strip('text')}) > 0 GROUP BY session_id)""",
    """res AS (SELECT s.session_id, s.stored, CAST(coalesce(a.actual, 0) AS BIGINT) AS actual,
          CASE WHEN s.stored = coalesce(a.actual, 0) THEN 'pass' ELSE 'fail' END AS status,
          CASE WHEN s.stored = coalesce(a.actual, 0) THEN 'ok' ELSE printf('expected %d patient turns, found %d', s.stored, coalesce(a.actual, 0)) END AS message
        FROM stored s LEFT JOIN act a ON s.session_id = a.session_id)""").rstrip()



def _validation(spark, sf_dir):
    t = turns_only(spark, sf_dir, dealt=False)
    budget = turn_budget(t.where(F.col("corpus") == "real"), max_turns=20)
    stored = budget.select("session_id", F.col("turn_budget").alias("num_patient_turns"), F.lit(False).alias("corrupt"))
    return Q.validate_turn_counts(stored, t.where(F.col("corpus") == "synthetic"))


@query("a55_turn_count_validation", _A55 + "\nSELECT * FROM res")
def a55_turn_count_validation(spark, sf_dir):
    """A55 + P28: synthetic patient-turn count vs the budget stored from the real session."""
    return _validation(spark, sf_dir)


@query("a56_validation_summary", _A55 + """
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status <> 'pass') AS failed,
       round(count(*) FILTER (WHERE status = 'pass') / nullif(count(*), 0) * 100.0, 6) AS pass_pct,
       round(count(*) FILTER (WHERE status <> 'pass') / nullif(count(*), 0) * 100.0, 6) AS fail_pct FROM res""")
def a56_validation_summary(spark, sf_dir):
    return Q.validation_summary(_validation(spark, sf_dir))


@query("a57_corpus_inventory", with_turns() + """
SELECT corpus, count(*) AS rows, count(DISTINCT session_id) AS sessions,
       array_to_string(list_sort(list_distinct(list(psi))), ',') AS psi_values,
       array_to_string(list_sort(list_distinct(list(backend_llm))), ',') AS backend_llm_values FROM turns GROUP BY corpus""")
def a57_corpus_inventory(spark, sf_dir):
    """Rows, sessions and sorted distinct psi / backend values per corpus."""
    return Q.corpus_inventory(turns_view(spark, sf_dir, dealt=False))


@query("a57_session_count_check", with_turns() + """
SELECT count(DISTINCT session_id) FILTER (WHERE corpus = 'real') AS real_sessions,
       count(DISTINCT session_id) FILTER (WHERE corpus = 'synthetic') AS synthetic_sessions,
       count(DISTINCT session_id) FILTER (WHERE corpus = 'real') = count(DISTINCT session_id) FILTER (WHERE corpus = 'synthetic') AS counts_match
FROM turns""")
def a57_session_count_check(spark, sf_dir):
    return Q.session_count_check(turns_only(spark, sf_dir, dealt=False))


@query("s16_folder_structure", with_turns() + """
SELECT psi, regexp_replace(regexp_replace(backend_llm, '^hosted_vllm_', ''), '^(openai_|Qwen_|meta-llama_|llama_)', '') AS backend,
       'conversations' AS dataset, count(DISTINCT session_id) AS sessions, count(DISTINCT session_id) > 0 AS ok
FROM turns WHERE corpus = 'synthetic' GROUP BY ALL""")
def s16_folder_structure(spark, sf_dir):
    """Sessions per (psi, backend, dataset) of the synthetic corpus."""
    from talkframe.operators.turns import normalize_backend
    t = turns_view(spark, sf_dir, dealt=False).where(F.col("corpus") == "synthetic")
    s = t.select("psi", normalize_backend(F.col("backend_llm")).alias("backend"), F.lit("conversations").alias("dataset"),
                 "session_id").distinct()
    return Q.folder_structure(s)


@query("p12_json_field", """
SELECT event_id, json_extract_string(props, '$.k') AS k, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_num FROM events""")
def p12_json_field(spark, sf_dir):
    """A field read out of JSON text (``events.props``)."""
    e = table(spark, sf_dir, "events")
    k = json_field(F.col("props"), "k")
    return e.select("event_id", k.alias("k"), k.try_cast("bigint").alias("k_num"))


@query("p13_blank_placeholders", with_turns() + """
SELECT corpus, session_id, turn, CASE WHEN text IS NULL OR turn % 6 < 5 OR lower(text) IN ('', 'not specified', 'unknown', 'n/a')
  OR contains(lower(text), 'cannot be identified') OR contains(lower(text), 'cannot be determined')
  OR contains(lower(text), 'not mention') OR contains(lower(text), 'not exhibited') THEN '' ELSE text END AS value FROM turns""")
def p13_blank_placeholders(spark, sf_dir):
    """Placeholder answers blanked; of six turns five get one written in."""
    t = turns_only(spark, sf_dir, dealt=False)
    answers = ["Unknown", "N/A", "Age cannot be determined", "It was Not mentioned here", ""]
    text = F.coalesce(*[F.when(F.col("turn") % 6 == i, F.lit(a)) for i, a in enumerate(answers)], F.col("text"))
    return t.select("corpus", "session_id", "turn", blank_placeholder(text).alias("value"))


@query("p11_session_turn_counts", with_turns() + """
SELECT corpus, session_id, count(*) AS n_patient FROM turns WHERE lower(role) = 'assistant' GROUP BY corpus, session_id""")
def p11_session_turn_counts(spark, sf_dir):
    """P11 helper: patient messages per session (LD rule: empties counted)."""
    return session_turn_counts(turns_only(spark, sf_dir, dealt=False))


# Fixed values (ours): routing of names to the test table's document sources.
TEST_SOURCE_ROUTES = {"src1": ["src1"], "all": ["src0", "src1", "src2"]}


@query("s6_source_routing", """
SELECT source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents
WHERE source IN ('src0', 'src1', 'src2') GROUP BY source""")
def s6_source_routing(spark, sf_dir):
    """A corpus routed by name to its sources ("all" = three sources); the IN
    filter reaches the parquet scan."""
    from talkframe.sources.corpus import route_sources
    d = route_sources(table(spark, sf_dir, "documents"), "all", TEST_SOURCE_ROUTES)
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").cast("bigint").alias("chars"))


@query("s8_parse_json_text", """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE TRY_CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
       CASE WHEN event_id % 7 = 0 THEN 'plain ' || props END AS props_raw
FROM events WHERE lower(event_type) = lower('CLICK')""")
def s8_parse_json_text(spark, sf_dir):
    """Case-insensitive filter, JSON text parsed with a fixed schema, text that
    is not JSON kept as is."""
    e = table(spark, sf_dir, "events").where(F.lower("event_type") == "CLICK".lower())
    e = e.withColumn("props", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("plain "), F.col("props"))).otherwise(F.col("props")))
    is_json = F.try_parse_json("props").isNotNull()
    return e.select("event_id", F.when(is_json, F.from_json("props", "k bigint")["k"]).alias("k"),
                    F.when(~is_json, F.col("props")).alias("props_raw"))


@query("s9_session_ids_from_names", with_turns() + """,
names AS (SELECT DISTINCT 'session_' || CAST(session_id AS VARCHAR) || CASE WHEN corpus = 'synthetic' THEN '_turn' ELSE '' END || '.json' AS file_name FROM turns)
SELECT file_name, TRY_CAST(regexp_extract(file_name, '^session_(\\d+)\\.json$', 1) AS BIGINT) AS session_id FROM names""")
def s9_session_ids_from_names(spark, sf_dir):
    """Ids parsed from session file names; ``_turn`` variant names give null.
    File names are derived from every session of the table."""
    from talkframe.sources.corpus import session_id_from_name
    t = turns_only(spark, sf_dir, dealt=False)
    names = t.select(F.concat(F.lit("session_"), F.col("session_id").cast("string"),
                              F.when(F.col("corpus") == "synthetic", F.lit("_turn")).otherwise(F.lit("")),
                              F.lit(".json")).alias("file_name")).distinct()
    return names.select("file_name", session_id_from_name(F.col("file_name")).alias("session_id"))


@query("s4_psi_dataset_from_path", with_turns() + """,
paths AS (SELECT DISTINCT '/data/' || CASE WHEN corpus = 'real' THEN 'recorded' ELSE psi END || '/' || backend_llm || '/esc/session_'
                 || CAST(session_id AS VARCHAR) || '.json' AS path FROM turns),
parts AS (SELECT path, string_split(path, '/') AS p FROM paths)
SELECT path, list_filter(p, lambda x: x IN ('patientpsi', 'roleplaydoh'))[-1] AS psi,
       list_filter(p, lambda x: x IN ('esc', 'hope', 'annomi'))[-1] AS dataset,
       len(list_filter(p, lambda x: x IN ('patientpsi', 'roleplaydoh'))) = 0
         OR len(list_filter(p, lambda x: x IN ('esc', 'hope', 'annomi'))) = 0 AS path_error
FROM parts""")
def s4_psi_dataset_from_path(spark, sf_dir):
    """Psi and dataset = the last known path part; real-corpus paths carry no
    psi and are flagged.  Paths are derived from every session of the table."""
    from talkframe.sources.corpus import psi_and_dataset
    t = turns_view(spark, sf_dir, dealt=False)
    paths = t.select(F.concat_ws("/", F.lit(""), F.lit("data"),
                                 F.when(F.col("corpus") == "real", F.lit("recorded")).otherwise(F.col("psi")),
                                 F.col("backend_llm"), F.lit("esc"),
                                 F.concat(F.lit("session_"), F.col("session_id").cast("string"), F.lit(".json"))).alias("path")).distinct()
    return paths.select("path", *psi_and_dataset(F.col("path"), ["patientpsi", "roleplaydoh"], ["esc", "hope", "annomi"]))


# --- P14-P16, P30: JSON text written from the documents' columns ----------------

def _profiles(spark, sf_dir):
    """A profile document per document row: placeholders, missing keys, severities."""
    d = F.col("doc_id")
    severity = F.element_at(F.array(*[F.lit(x) for x in ("Mild", "Moderate to severe", "Severe", "none")]), (d % 4 + 1).cast("int"))
    fields = {
        "name": F.concat(F.lit("N "), F.col("source")), "age": F.when(d % 3 == 0, "Unknown").otherwise(F.col("n_chars").cast("string")),
        "gender": F.col("lang"), "occupation": F.when(d % 2 == 1, "Clerk"), "marital status": F.lit("Not Specified"),
        "counseling history": F.lit("None Before"), "symptom severity": F.create_map(F.lit("Low Mood"), severity, F.lit("Sleep"), F.lit("mild")),
        "cognition distortion exhibition": F.create_map(F.lit("Labeling"), F.when(d % 5 < 4, "Exhibited").otherwise("Not exhibited")),
        "depression severity": F.lit("Moderate"), "suicidal ideation severity": F.lit("cannot be determined")}
    doc = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
    return table(spark, sf_dir, "documents").select("doc_id", doc.alias("profile"))


@query("p14_severity_buckets", """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'low mood,sleep' ELSE 'sleep' END AS mild,
       CASE WHEN doc_id % 4 = 1 THEN 'low mood' ELSE '' END AS moderate,
       CASE WHEN doc_id % 4 IN (1, 2) THEN 'low mood' ELSE '' END AS severe,
       CASE WHEN doc_id % 5 < 4 THEN 'labeling' ELSE '' END AS distortions FROM documents""")
def p14_severity_buckets(spark, sf_dir):
    """Symptoms by severity (a value may name two) and exhibited distortions."""
    from talkframe.operators.profiles import exhibited_distortions, parse_profile, severity_buckets
    p = _profiles(spark, sf_dir).select("doc_id", parse_profile(F.col("profile")).alias("p"))
    mild, moderate, severe = severity_buckets(F.col("p")["symptom severity"])
    dist = exhibited_distortions(F.col("p")["cognition distortion exhibition"])
    return p.select("doc_id", *[F.array_join(c, ",").alias(n) for n, c in
                                (("mild", mild), ("moderate", moderate), ("severe", severe), ("distortions", dist))])


@query("p15_profile_prompt", """
SELECT doc_id, '- name: n ' || lower(source) || chr(10) || '- gender: ' || lower(lang) || chr(10)
  || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '- age: ' || CAST(n_chars AS VARCHAR) || chr(10) END
  || CASE WHEN doc_id % 2 = 1 THEN '- occupation: clerk' || chr(10) ELSE '' END
  || '- counseling history: None Before' || chr(10) || '- symptom severity' || chr(10)
  || CASE WHEN doc_id % 4 IN (1, 2) THEN '  - low mood: severe' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 4 = 1 THEN '  - low mood: moderate' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 4 = 0 THEN '  - low mood: mild' || chr(10) ELSE '' END || '  - sleep: mild' || chr(10)
  || CASE WHEN doc_id % 5 < 4 THEN '- cognition distortion exhibition' || chr(10) || '  - labeling: exhibited' || chr(10)
          ELSE '${cognition_distortion_exhibition}' END
  || '- depression severity: Moderate' || chr(10) AS profile_prompt,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE CAST(n_chars AS VARCHAR) END AS age, 'Moderate' AS depression_severity,
  '' AS suicidal_ideation_severity FROM documents""")
def p15_profile_prompt(spark, sf_dir):
    """Profile section and dictionary fields."""
    from talkframe.operators.profiles import render_profile
    r = render_profile(_profiles(spark, sf_dir))
    return r.select("doc_id", "profile_prompt", *[F.col(f"profile_dict.{c}").alias(c) for c in
                                                  ("age", "depression_severity", "suicidal_ideation_severity")])


@query("p16_ccd_fields", """
SELECT doc_id, 'h ' || source AS life_history, CASE WHEN doc_id % 2 = 0 THEN 'd ' || lang ELSE 'c ' || source END AS core_belief,
       CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'dep' END AS intermediate_belief_depression,
       CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS situation, '' AS emotion,
       CASE doc_id % 3 WHEN 0 THEN '1. plain' WHEN 1 THEN '1. Upset' || chr(10) || ' - show frustration' ELSE '1. terse' END AS style_instruction
FROM documents""")
def p16_ccd_fields(spark, sf_dir):
    """Prompt fields of a cognitive diagram, blanks and the style line."""
    from talkframe.operators.profiles import flatten_ccd
    d, none = F.col("doc_id"), F.array().cast("array<struct<situation:string>>")
    models = F.when(d % 3 == 0, none).otherwise(F.array(F.struct(F.col("lang").alias("situation"))))
    ccd = F.struct(F.concat(F.lit("h "), "source").alias("life_history"),
                   F.when(d % 2 == 0, "").otherwise(F.concat(F.lit("c "), "source")).alias("core_beliefs"),
                   F.concat(F.lit("d "), "lang").alias("core_belief_description"),
                   F.when(d % 4 != 0, "dep").alias("intermediate_beliefs_during_depression"), models.alias("cognitive_models"))
    style = F.when(d % 3 == 1, "Upset").when(d % 3 == 2, "terse")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.to_json(ccd).alias("ccd"), style.alias("style"))
    styles = spark.createDataFrame([("upset", "show frustration"), ("plain", "")], "style string, style_description string")
    out = flatten_ccd(docs, style_col="style", styles=styles)
    return out.select("doc_id", "life_history", "core_belief", "intermediate_belief_depression", "situation", "emotion", "style_instruction")


@query("p30_grab_json", """
SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN source END AS response FROM documents""")
def p30_grab_json(spark, sf_dir):
    """The outermost object of a noisy reply, parsed with a schema."""
    from talkframe.operators.replies import grab_json_object
    reply = F.when(F.col("doc_id") % 4 < 3, F.concat(F.lit('noise {"result": {"response": "'), "source", F.lit('"}} tail')))
    reply = F.coalesce(reply, F.lit("no object here"))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", grab_json_object(reply, "result struct<response:string>")["result"]["response"].alias("response"))


@query("s11_export_round_trip", with_turns() + """
SELECT session_id, psi, count(*) AS n_messages, CASE WHEN psi = 'patientpsi' THEN '{"k":1}' ELSE '{}' END AS ccd
FROM turns WHERE corpus = 'synthetic' AND psi = 'patientpsi' GROUP BY session_id, psi""")
def s11_export_round_trip(spark, sf_dir):
    """S11 + S8: sessions exported as one partitioned dataset and read back for one
    simulator (case-insensitive, pruned), JSON text parsed."""
    import uuid

    from talkframe.session import checkpoint_dir
    from talkframe.sources.corpus import read_published
    from talkframe.sources.sinks import export_corpus
    t = turns_view(spark, sf_dir, dealt=False).where(F.col("corpus") == "synthetic")
    g = t.groupBy("session_id", "psi", "backend_llm").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    sessions = g.select("session_id", "psi", "backend_llm", F.lit("ESC").alias("source"), F.lit("{}").alias("profile"),
                        F.lit('{"k":1}').alias("ccd"),
                        F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    path = f"{checkpoint_dir(spark)}/export-{uuid.uuid4().hex}"
    export_corpus(sessions, path)
    back = read_published(spark, path, psi="PatientPsi")
    return back.select("session_id", "psi", F.size("messages_parsed").cast("bigint").alias("n_messages"), "ccd")


@query("s8_read_published", """
SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN props END AS content, CASE WHEN event_id % 7 = 0 THEN 'plain ' || props END AS raw
FROM events WHERE lower(event_type) = 'click'""")
def s8_read_published(spark, sf_dir):
    """S8 through its reader: a published dataset of another writer (no keys to prune
    by), filtered whatever the case, JSON text parsed, other text kept as is."""
    import uuid

    from talkframe.session import checkpoint_dir
    from talkframe.sources.corpus import read_published
    e = table(spark, sf_dir, "events")
    said = F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("props").alias("content"))))
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("plain "), F.col("props"))).otherwise(said)
    out = e.select(F.col("event_id").cast("int").alias("session_id"), text.alias("messages"), F.lit("{}").alias("profile"), F.lit("{}").alias("ccd"),
                   F.col("event_type").alias("psi"), F.lit("x").alias("backend_llm"), F.lit(0).alias("num_patient_turns"), F.lit("s").alias("source"))
    path = f"{checkpoint_dir(spark)}/published-{uuid.uuid4().hex}"
    out.write.parquet(path)
    back = read_published(spark, path, psi="CLICK")
    return back.select(F.col("session_id").cast("bigint").alias("event_id"), F.get(F.col("messages_parsed.content"), 0).alias("content"),
                       F.col("messages_raw").alias("raw"))


@query("s7_raw_dialogs", with_turns() + """
SELECT corpus || '/' || session_id AS situation, count(*) AS n_messages, count(*) FILTER (WHERE role = 'assistant') AS n_patient,
       max(length(text)) AS longest FROM (SELECT * REPLACE (CASE WHEN role = 'assistant' THEN role ELSE 'user' END AS role) FROM turns) t GROUP BY ALL""")
def s7_raw_dialogs(spark, sf_dir):
    """Every conversation written as a raw dialogue and read back, in splits, with
    its speakers mapped."""
    import uuid

    from talkframe.session import checkpoint_dir
    from talkframe.sources.corpus import read_raw_dialogs
    t = turns_only(spark, sf_dir, dealt=False)
    speaker = F.when(F.col("role") == "assistant", "seeker").otherwise("supporter")
    g = t.groupBy("corpus", "session_id").agg(F.array_sort(F.collect_list(F.struct("turn", speaker.alias("speaker"), F.col("text").alias("content")))).alias("m"))
    dialog = F.transform("m", lambda x: F.struct(x["speaker"].alias("speaker"), x["content"].alias("content")))
    path = f"{checkpoint_dir(spark)}/dialogs-{uuid.uuid4().hex}"
    g.select(F.concat_ws("/", "corpus", F.col("session_id").cast("string")).alias("situation"), dialog.alias("dialog")).write.json(path)
    back = read_raw_dialogs(spark, path)
    spoken = F.filter("messages", lambda m: m["role"] == "assistant")
    return back.select("situation", F.size("messages").cast("bigint").alias("n_messages"), F.size(spoken).cast("bigint").alias("n_patient"),
                       F.array_max(F.transform("messages", lambda m: F.length(m["content"]))).cast("bigint").alias("longest"))
