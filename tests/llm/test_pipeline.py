"""The pipeline against a brute-force version, and the queries against their SQL."""

import hashlib

import brute
from oracle_check import compare
from talkframe.llm import bpe, doc_stats, mixing, quality_rules

SF = "/root/testdata/sf0.001"


def test_queries_match_their_sql(spark):
    from talkframe.llm.queries import oracle_sql
    res = compare(spark, SF, set(oracle_sql()), verbose=False)
    assert set(res) == set(oracle_sql()) and all(v.startswith("OK") for v in res.values()), res


def _passes(text, rules):
    n, chars, symbols, dup, rep = brute.counts(text)
    if n < 50 or 100 * rep > 50 * n:
        return False
    import pyarrow as pa
    c = doc_stats.counts(pa.array([text])).to_pylist()[0]
    part = lambda a, b: a / b if b else 0.0
    f = {"n_words": n, "mean_word_chars": part(chars, n), "symbols_per_word": part(symbols, n),
         "dup_line_share": part(dup, text.count("\n") + 1), "repeat_word_share": part(rep, n),
         "upper_share": part(c["n_upper"], c["n_ascii_letters"]), "digit_share": part(c["n_digits"], chars),
         "punct_per_word": part(c["n_punct"], n), "distinct_share": part(len(set(brute.words(text))), n),
         "top_word_share": part(c["n_top_word"], n), "words_per_line": part(n, text.count("\n") + 1),
         "stops_per_word": part(c["n_stops"], n)}
    return not any(all(f[t.feature] >= t.threshold if t.op == ">=" else f[t.feature] <= t.threshold for t in r.tests) for r in rules)


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = quality_rules.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(d.doc_id, d.source, d.text) for d in docs.collect() if _passes(d.text, rules)]
    text = {d: t for d, _, _, t in brute.line_dedup([(d, t) for d, _, t in rows])}
    rows = [(d, s, text[d]) for d, s, _ in rows]
    root = {d: c for d, _, c in brute.near_groups([(d, t) for d, _, t in rows], 5, 80)}
    rows = [(d, s, t) for d, s, t in rows if root[d] == d]
    c, want = bpe.coder(bpe.vocabulary()), []
    for i, n in brute.mix(rows).items():
        d, s, t = rows[i]
        size = len(brute.words(t))
        ids = c.tokenizer.encode(t, add_special_tokens=False).ids
        row = (d, s, len(t), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        want += [row] * (-(-n // size) if size else 0)
    got = [(r.doc_id, r.source, r.n_chars, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_stages_keep_columns_and_take_edge_rows(spark):
    import corpus_pipeline
    rows = [(None, None, None, None, None, 1), (1, "", "en", "a", 0, 2), (2, "x " * 200, None, None, None, 3),
            (3, " ".join(f"w{i}" for i in range(90)), "en", "a", 9, 4), (3, " ".join(f"w{i}" for i in range(90)), "en", "a", 9, 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _rule int")
    for df in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, SF)
            assert df.columns == docs.columns
        df = corpus_pipeline.STAGES[-1][1](spark, df, SF)
        assert {r.doc_id for r in df.collect()} <= {3}


def test_last_stage_on_letters_that_change_length(spark):
    import corpus_pipeline
    text = " ".join(f"BELEDİYESİ. {i} İ! ŉx." for i in range(40))
    docs = spark.createDataFrame([(1, text, "tr", "a", len(text))], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).first()
    ids = bpe.coder(bpe.vocabulary()).tokenizer.encode(text, add_special_tokens=False).ids
    assert (got.n_tokens, got.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_hash_key_matches_md5(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(7,), (None,)], "i bigint").select(F.col("i"), mixing.hash_key("i").alias("k"))
    assert {r.k for r in df.collect()} == {int(hashlib.md5(x).hexdigest()[:15], 16) for x in (b"7", b"")}
