"""Word scanning, statistics, the decision list and the classifier."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from talkframe.llm import doc_stats, quality_classifier, quality_rules, words

TEXT = st.text(st.sampled_from(list("ab é\n\t#|漢\x0b\x1c\xa0")), max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_counts_equal_brute_force(texts):
    got = doc_stats.counts(pa.array(texts, pa.string())).to_pylist()
    want = [brute.counts(t) for t in texts]
    assert [tuple(r[c] for c in doc_stats.COUNTS[:5]) for r in got] == want


@settings(max_examples=40, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6), st.booleans())
def test_equal_words_have_equal_hashes(texts, lower):
    found = {}
    for i, data, offs in words.slices(pa.array(texts), size=16):
        doc, start, end, h = words.scan(data, offs, lower)
        for d, a, b, x in zip(doc, start, end, h):
            w = data[a:b].tobytes()
            assert found.setdefault(w.lower() if lower else w, x) == x
    assert len(set(found.values())) == len(found)
    assert set(found) == {w.encode().lower() if lower else w.encode() for t in texts for w in brute.words(t)}


def test_scan_in_pieces_equals_scan_at_once(monkeypatch):
    text = " ".join(f"word{i % 97}é" for i in range(20_000))
    data, offs = words.buffers(pa.array([text, "x", ""]))
    whole = words._scan(data, offs, False)
    monkeypatch.setattr(words, "_PIECE", 1000)
    for a, b in zip(whole, words.scan(data, offs)):
        assert (a == b).all()


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, _rule string, c0 int")


EDGE = [(None, "a b c", "x", 1), (1, None, None, None), (2, "", "y", 2), (2, "", "y", 2), (3, " \n\t", "z", 3),
        (4, "long word " * 50_000, "z", 4), (5, " ".join(f"w{i}" for i in range(80)), "k", 5)]


def test_rules_on_edge_rows_and_empty_tables(spark):
    docs = _docs(spark, EDGE)
    labels = spark.createDataFrame([(1, None), (5, 1), (None, 0)], "doc_id bigint, quality int")
    rules = quality_rules.fit(docs, labels)
    assert rules == []
    kept = quality_rules.kept(docs, rules)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [5]
    empty = docs.where("false")
    assert quality_rules.kept(empty, quality_rules.fit(empty, labels.where("false"))).count() == 0


def test_judged_rows_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y", 7, 1.5)], "doc_id bigint, text string, _rule string, _counts string, _judged int, _base_failed double")
    out = quality_rules.judged(docs, [quality_rules.Rule((quality_rules.Test("n_words", "<=", 5.0),), 1, 1)])
    r = out.first()
    assert out.columns == [*docs.columns, "__judged"] and tuple(r)[:6] == tuple(docs.first())
    assert (r["__judged"].counts.n_words, r["__judged"].rule, r["__judged"].base_failed) == (2, 1, True)


def test_repeated_ids_do_not_multiply_the_sample(spark):
    texts = [("word " * 60 + f"w{i}", 1) for i in range(30)] + [(f"# {i} #", 0) for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)] + [(0, texts[0][0])] * 40, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, (_, q) in enumerate(texts)], "doc_id bigint, quality int")
    assert quality_rules.fit(docs, labels) == quality_rules.fit(docs.dropDuplicates(), labels) != []


def test_learned_list_finds_a_planted_rule(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(3000, 3))
    y = ((x[:, 0] > 0.8) & (x[:, 1] < 0.5)) | (x[:, 2] > 0.95)
    rules = quality_rules.learn(x, y, ["a", "b", "c"])
    hit = np.zeros(len(x), bool)
    for r in rules:
        hit |= quality_rules._holds(x, ["a", "b", "c"], r.tests)
    assert (hit == y).mean() > 0.98 and (hit & ~y).mean() < 0.01


def test_rules_as_columns_equal_rules_on_arrays(spark):
    from pyspark.sql import functions as F
    rules = [quality_rules.Rule((quality_rules.Test("a", ">=", 0.5), quality_rules.Test("b", "<=", 0.2)), 1, 1),
             quality_rules.Rule((quality_rules.Test("b", ">=", 0.9),), 1, 1)]
    rows = [(0.5, 0.2), (0.4, 0.1), (0.9, 0.95), (0.5, 0.9)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = [r.r for r in df.select(quality_rules.reject_column(rules, {"a": F.col("a"), "b": F.col("b")}).alias("r")).collect()]
    assert got == [1, None, 2, 2]


def test_isotonic_pooling():
    level = quality_classifier.pool(np.ones(6), np.array([0, 1, 0, 1, 1, 0.5]))
    assert (np.diff(level) >= 0).all() and level.sum() == pytest.approx(3.5)


def test_classifier_without_labels_and_on_edge_rows(spark):
    docs = _docs(spark, EDGE)
    stats = quality_classifier.statistics(docs)
    names = [c for c in stats.columns if c != "_key"]
    none = quality_classifier.training(stats, spark.createDataFrame([(1, None)], "doc_id bigint, quality int"))
    model = quality_classifier.fit(none, names)
    scores = [r[0] for r in stats.select(quality_classifier.score_column(model)).collect()]
    assert scores == [0.5] * len(EDGE)


def test_classifier_on_an_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "some text here", 0.5, "k", 3)], "doc_id bigint, text string, score double, _key string, n_words int")
    stats = quality_classifier.statistics(docs)
    names = [c for c in stats.columns if c != "_key"]
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality_classifier.fit(quality_classifier.training(stats, labels), names)
    assert [r._key for r in stats.collect()] == [1] and stats.select(quality_classifier.score_column(model)).first()[0] == 0.5
    assert quality_classifier.statistics(docs.where("false")).count() == 0


def _plain_classifier(rows, names):
    """The same model fitted in one place: all rows in memory, sums by numpy, bins by a dictionary."""
    width, gamma, ridge = 192, 0.35, 1e-3
    rng = np.random.default_rng(11)
    omega = rng.normal(0, np.sqrt(2 * gamma / len(names)), (len(names), width))
    phase = rng.uniform(0, 2 * np.pi, width)
    x = {f: np.array([[r[c] for c in names] for r in rows if r["fold"] == f], float) for f in (0, 2)}
    y = {f: np.array([r["y"] for r in rows if r["fold"] == f], float) for f in (0, 2)}
    mean, scale = x[0].mean(0), x[0].std(0)
    scale[scale == 0] = 1

    def mapped(v):
        z = np.clip((v - mean) / scale, -6, 6)
        return np.hstack([np.sqrt(2 / width) * np.cos(z @ omega + phase), np.ones((len(z), 1))])
    f = mapped(x[0])
    a = f.T @ f
    a[np.arange(width), np.arange(width)] += ridge * len(f) / width
    beta = np.linalg.lstsq(a, f.T @ y[0], rcond=None)[0]
    raw, bins = mapped(x[2]) @ beta, {}
    for r, good in zip(raw, y[2]):
        bins.setdefault(min(512, max(-1, int(np.floor((r + 0.5) * 256)))), []).append((r, good))
    order = sorted(bins)
    n = np.array([len(bins[b]) for b in order], float)
    share = np.array([sum(g for _, g in bins[b]) for b in order]) / n
    # isotonic means by the max-min formula
    level = [max(min((share[i:j] * n[i:j]).sum() / n[i:j].sum() for j in range(k + 1, len(n) + 1)) for i in range(k + 1)) for k in range(len(n))]
    grid = [np.mean([r for r, _ in bins[b]]) for b in order]
    return lambda v: np.interp(mapped(v) @ beta, grid, level)


def test_classifier_equals_a_plain_fit(spark):
    from talkframe.llm.queries import queries
    sf = "/root/testdata/sf0.01"
    stats = quality_classifier.statistics(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    names = [c for c in stats.columns if c != "_key"]
    train = quality_classifier.training(stats, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    plain = _plain_classifier([r.asDict() for r in train], names)
    all_rows = stats.collect()
    want = dict(zip([r._key for r in all_rows], plain(np.array([[r[c] for c in names] for r in all_rows], float))))
    got = {r.doc_id: r.score for r in queries()["op9_quality_classifier"](spark, sf).collect()}
    assert set(got) == set(want) and max(abs(got[d] - want[d]) for d in want) < 1e-6


def test_classifier_on_held_out_rows(spark):
    from talkframe.llm.queries import queries
    sf = "/root/testdata/sf0.01"
    got = queries()["op9_quality_classifier"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert got.count() == 1000 and len(rows) > 50
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_rules_query_against_brute_force_and_labels(spark):
    from talkframe.llm.queries import queries
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries()["op4_quality_rules"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        n, chars, symbols, dup, rep = brute.counts(d.text)
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert r.kept == (not r.base_failed and r.rejected_by is None)
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    clean = [got[x.doc_id] for x in labels if x.quality == 1]
    junk = [got[x.doc_id] for x in labels if x.quality == 0]
    assert sum(r.rejected_by is not None for r in clean) <= 0.01 * len(clean)
    assert sum(not r.kept for r in junk) >= 0.95 * len(junk)
