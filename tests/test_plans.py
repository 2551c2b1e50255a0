"""Physical-plan checks: shuffles, pushdown, join strategies."""

from pyspark.sql import functions as F

from conftest import turns_df
from talkframe.lexicons import depressive_lexicon
from talkframe.operators import markers as M
from talkframe.operators import turns as T


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_or_nested_loop_join_in_any_query(spark):
    from talkframe.plans import catalog
    bad = {}
    for name, fn in catalog.queries().items():
        p = _plan(fn(spark, "/root/testdata/sf0.001"))
        if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p:
            bad[name] = p[:300]
    assert not bad, bad


def _hash_exchanges(df):
    return _plan(df).count("Exchange hashpartitioning")


def _final(df):
    """The plan as it ran: adaptive execution drops what turned out to be empty."""
    rows = df.collect()
    p = _plan(df)
    return rows, p[p.index("== Final Plan =="):p.index("== Initial Plan ==")]


def test_short_conversations_are_shuffled_once(spark, scratch):
    rows = [("c", i // 4, i % 4, "user" if i % 3 else "assistant", f"t{i}") for i in range(40)]
    turns_df(spark, rows).write.parquet(f"{scratch}/turns")
    t = spark.read.parquet(f"{scratch}/turns")
    for df in (T.merge_consecutive(t), T.patient_turns(t), T.context_budget(t, 5)):
        got, p = _final(df)
        assert got and p.count("Exchange hashpartitioning") == 1 and "Join" not in p
    assert _hash_exchanges(M.session_markers(t, depressive_lexicon())) == 1


def test_message_reports_shuffle_nothing(spark):
    from talkframe.plans import catalog
    for name in ("p4_role_relabel", "p5_format_messages", "p8_similarity_clean", "p9_word_token_counts", "p20_split_thinking"):
        assert "Exchange" not in _plan(catalog.queries()[name](spark, "/root/testdata/sf0.001"))


def test_emotion_priors_are_one_subquery(spark):
    from talkframe.plans import catalog
    for name in ("a19_turn_emotions", "a22_bucket_scores"):
        p = _plan(catalog.queries()[name](spark, "/root/testdata/sf0.001"))
        assert p.count("Exchange") <= 10 and p.count("Subquery subquery") <= 2


def test_partition_numbers_follow_the_cluster_setting(spark):
    from talkframe.session import shuffle_parts
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert shuffle_parts(spark) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(key, "37")
    try:
        assert shuffle_parts(spark) == 37
    finally:
        spark.conf.unset(key)


def test_filters_reach_the_parquet_scan(spark, scratch):
    from talkframe.sources.corpus import read_real_corpus
    real = f"{scratch}/real"
    spark.createDataFrame([(1, [("assistant", "a")], "{}", "ESC", "1")],
                          "session_id bigint, messages array<struct<role:string,content:string>>, profile string, source string, id_source string"
                          ).write.parquet(real)
    p = _plan(read_real_corpus(spark, real, "all").select("session_id"))
    assert "PushedFilters: [In(source" in p and "ReadSchema: struct<session_id:bigint,source:string>" in p  # messages pruned
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    p2 = _plan(T.patient_messages(conv.withColumnRenamed("conv_id", "session_id").withColumn("corpus", F.lit("c"))))
    assert "EqualTo(role,assistant)" in p2


def test_lexicon_is_broadcast_only_by_its_measured_size(spark, scratch):
    from talkframe.operators.emotion import turn_emotions
    t = turns_df(spark, [("c", 1, 0, "assistant", "sad and happy"), ("c", 1, 1, "user", "ok")])
    spark.createDataFrame([("sad", "sadness"), ("happy", "joy")], "word string, emotion string").write.parquet(f"{scratch}/lex")
    lexicon = spark.read.parquet(f"{scratch}/lex")
    assert "BroadcastHashJoin" in _plan(turn_emotions(t, lexicon))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 1)
    try:
        p = _plan(turn_emotions(t, lexicon))
        assert "BroadcastHashJoin" not in p and "SortMergeJoin" in p
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
