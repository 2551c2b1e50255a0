"""Line dedup, substring dedup and the n-gram join against brute force."""

import random

import numpy as np
import pytest

import brute
from talkframe.llm import components, cuckoo, line_dedup, ngram_join, substring_dedup

LINE = "this common line is longer than forty code points"


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, keys string")


def test_cuckoo_filter_inserts_and_forgets():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (20_000, 2)).astype(np.uint64)
    f, parts = cuckoo.Cuckoo(), np.array_split(keys, 7)
    held = np.repeat([f.insert(part) for part in parts], [len(x) for x in parts])
    f = cuckoo.Cuckoo.from_bytes(f.to_bytes())
    assert f.contains(keys).all()
    other = rng.integers(0, 1 << 63, (20_000, 2)).astype(np.uint64)
    assert f.contains(other).mean() < 0.01
    for layer in np.unique(held):
        f.delete(keys[:10_000][held[:10_000] == layer], layer)
    assert f.contains(keys[10_000:]).all() and f.contains(keys[:10_000]).mean() < 0.01


def test_cuckoo_filter_keeps_every_key_that_stays():
    """Deletions of half of 200,000 keys in several layers lose none of the others."""
    rng = np.random.default_rng(2)
    f, held, keys = cuckoo.Cuckoo(), [], rng.integers(0, 1 << 63, (10, 20_000, 2)).astype(np.uint64)
    for part in keys:
        held.append(f.insert(part))
    assert len(f.layers) > 1
    for layer, part in zip(held, keys):
        f.delete(part[::2], layer)
    assert all(f.contains(part[1::2]).all() for part in keys)
    assert f.contains(keys[:, ::2].reshape(-1, 2)).mean() < 0.01
    with pytest.raises(ValueError):
        cuckoo.Cuckoo([cuckoo.Layer(8)]).delete(keys[0][:1], 0)


def _lines(seed, n=40):
    r = random.Random(seed)
    pool = [f"{LINE} {i}" for i in range(6)] + ["short", "", "  " + LINE.upper() + " 3\t", "é" * 39, "é" * 40, LINE + "\x85"]
    return [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 8)))) for i in range(n)]


def test_line_dedup_equals_brute_force(spark):
    rows = [*_lines(1), (100, None), (101, ""), (None, LINE + " 0"), (102, LINE + " 0\n" + LINE + " 0"), (7, _lines(1)[7][1])]
    out = line_dedup.dedup(_docs(spark, rows))
    got = sorted((r.doc_id is None, r.doc_id or 0, r._n_lines, r._n_dropped, r.text or "") for r in out.collect())
    want = sorted((d is None, d or 0, n, k, t) for d, n, k, t in brute.line_dedup(rows))
    assert out.columns == ["doc_id", "text", "keys", "_n_lines", "_n_dropped"] and got == want


def test_line_index_is_reversible(spark):
    first, more = _lines(2, 30), [(100 + d, t) for d, t in _lines(3, 30)]
    index = line_dedup.LineIndex.empty(spark, shards=3, salts=2).load(_docs(spark, first))
    grown = index.insert(_docs(spark, more))
    back = grown.delete(spark.createDataFrame([(d,) for d, _ in more], "doc_id bigint"))

    def drops(ix):
        return sorted((r.doc_id, sorted(map(bytes, r["keys"]))) for r in ix.drops().collect())
    want = {(d, k) for d, _, k, _ in brute.line_dedup(first + more)}
    got = {(r.doc_id, r._n_dropped) for r in grown.cleaned(_docs(spark, first + more)).collect()}
    assert got == want and drops(back) == drops(index) != drops(grown)
    probe = index.postings
    assert {tuple(r) for r in back.candidates(probe).collect()} >= {tuple(r) for r in index.candidates(probe).collect()
                                                                    if r.key in {c.key for c in index.counts.where("n_docs >= 5").collect()}}


def test_line_index_in_many_steps_with_growing_shards(spark):
    """Insertions and deletions by turns, filters dealt anew on the way: always what a fresh index says."""
    pool = [f"{LINE} {i}" for i in range(90)]
    r = random.Random(5)
    docs = [(d, "\n".join(r.sample(pool, 12))) for d in range(120)]
    index, alive, shards = line_dedup.LineIndex.empty(spark, shard_keys=1), {}, set()
    for step in range(6):
        new = docs[step * 20:(step + 1) * 20]
        index = index.insert(_docs(spark, new))
        alive |= dict(new)
        if step % 2:
            gone = r.sample(sorted(alive), 18 if step < 5 else len(alive) - 10)
            index = index.delete(spark.createDataFrame([(d,) for d in gone], "doc_id bigint"))
            alive = {d: t for d, t in alive.items() if d not in gone}
        shards.add(index.shards)
        got = {(x.doc_id, x._n_dropped) for x in index.cleaned(_docs(spark, sorted(alive.items()))).collect()}
        assert got == {(d, k) for d, _, k, _ in brute.line_dedup(sorted(alive.items()))}
        common = index.counts.where("n_docs >= 5")
        assert common.where("layer is null").count() == 0 and index.counts.where("n_docs < 5 and layer is not null").count() == 0
        assert index.candidates(index.postings).join(common, "key", "left_semi").count() == index.postings.join(common, "key", "left_semi").count()
    assert len(shards) > 1


def test_line_dedup_of_an_empty_table(spark):
    assert line_dedup.dedup(_docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed,vocabulary,window", [(1, 3, 20), (2, 400, 20), (3, 1, 20), (4, 2, 8)])
def test_substring_dedup_equals_brute_force(spark, seed, vocabulary, window):
    r = random.Random(seed)
    passages = [" ".join(f"p{j}w{r.randrange(vocabulary)}" for _ in range(r.randint(15, 60))) for j in range(4)]
    rows = []
    for d in range(30):
        parts = [r.choice(passages) if r.random() < 0.5 else " ".join(f"w{r.randrange(vocabulary)}" for _ in range(r.randint(0, 30)))
                 for _ in range(r.randint(0, 5))]
        rows.append((d * 3, "  ".join(parts)))
    rows += [(200, None), (201, ""), (202, rows[3][1]), (-5, rows[3][1]), (203, "a " * 3000)]
    r.shuffle(rows)
    got = sorted(tuple(x) for x in substring_dedup.dedup(_docs(spark, rows), window).select("doc_id", "n_words", "n_removed", "kept").collect())
    assert got == sorted(brute.substring(rows, window))


def test_windows_that_agree_in_one_hash_only_are_kept_apart(monkeypatch):
    import pyarrow as pa
    first = substring_dedup._windows
    monkeypatch.setattr(substring_dedup, "_windows", lambda h, doc, w: (np.zeros_like(first(h, doc, w)[0]), first(h, doc, w)[1]))
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array(["a b c d x a b c d y b c d x"]), pa.array([[(0, 11)]], pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())])))],
                                       names=["doc", "text", "spans"])
    rows = pa.Table.from_batches(list(substring_dedup._window_rows(4)([batch]))).to_pylist()
    assert {r["window"] for r in rows} == {0} and len({r["second"] for r in rows}) == 9
    assert sorted(r["start"] for r in rows if r["again"]) == [5, 10]


def test_substring_dedup_edge_rows(spark):
    text = " ".join(f"w{i}" for i in range(25))
    got = substring_dedup.dedup(_docs(spark, [(None, text), (1, text), (1, text), (2, "short")])).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in got) == [(False, 0, 0), (True, 1, 25), (True, 1, 25), (True, 2, 0)]
    assert substring_dedup.dedup(_docs(spark, [])).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 160), 100)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def _near(seed, n=3):
    r = random.Random(seed)
    rows, i = [], 0
    for _ in range(12):
        base = [f"w{r.randrange(60)}" for _ in range(r.choice([2, 5, 12, 40, 120, 300]))]
        for _ in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 45))):
                w[r.randrange(len(w))] = f"x{r.randrange(999)}"
            rows.append((i, " ".join(x.upper() if r.random() < 0.1 else x for x in w)))
            i += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,n,percent,leaf", [(1, 3, 90, 512), (2, 5, 80, 512), (3, 3, 90, 2), (4, 1, 70, 3)])
def test_ngram_join_equals_brute_force(spark, monkeypatch, seed, n, percent, leaf):
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    rows = [*_near(seed), (500, None), (501, " \t"), (502, ""), (503, "one"), (504, "ONE"), (505, "one two")]
    got = sorted((r.doc, r.n, r.component) for r in ngram_join.groups(_docs(spark, rows), n, percent).collect())
    assert got == sorted(brute.near_groups(rows, n, percent))


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_documents_leave_hot_nodes_only_within_the_stated_bound(spark, n, percent):
    """Documents share h hot nodes and nothing else; what they leave must be too few for a pair at the threshold."""
    def at_most(h, nodes):  # probability of at most h shared nodes
        p, state = percent / 100, {(0, False): 1.0}
        for _ in range(nodes + 1):
            more = {}
            for (c, last), w in state.items():
                for now, x in ((False, 1 - p), (True, p)):
                    to = (c + (last and now), now)
                    more[to] = more.get(to, 0) + w * x
            state = more
        return sum(w for (c, _), w in state.items() if c <= h)

    text = " ".join(f"w{i}" for i in range(400))
    join = ngram_join.Join(_docs(spark, [(1, text)]), n, percent)
    nodes = len(join.sketched().first()["keys"])
    rows = [(b"%d-%d" % (h, i), 400, [h * 100 + j if j < h else 10_000 + (h * 300 + i) * 100 + j for j in range(nodes)])
            for h in range(1, 11) for i in range(ngram_join.HOT + 4)]
    classes = spark.createDataFrame(rows, "node binary, n bigint, keys array<bigint>")
    stay = {r.key // 100 for r in join.routed(classes).collect()}
    assert all(at_most(h, nodes) <= 2e-11 for h in set(range(1, 11)) - stay) and 1 not in stay


def test_tree_alone_finds_every_link(spark, monkeypatch):
    """With no star links the dual traversal must find all pairs itself."""
    monkeypatch.setattr(ngram_join.Join, "star_pairs", lambda self, routes, classes: classes.select(
        classes.node.alias("a"), classes.node.alias("b")).where("false"))
    monkeypatch.setattr(ngram_join, "LEAF", 3)
    rows = _near(9)
    got = sorted((r.doc, r.n, r.component) for r in ngram_join.groups(_docs(spark, rows)).collect())
    assert got == sorted(brute.near_groups(rows))


def test_ngram_join_edge_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (8, text), (8, text), (9, "other " + text[:20]), (None, None)]
    got = sorted(((r.doc is not None, r.doc or 0, r.component) for r in ngram_join.groups(_docs(spark, rows)).collect()), key=str)
    assert got == sorted([(False, 0, 8), (False, 0, None), (True, 8, 8), (True, 8, 8), (True, 9, 9)], key=str)
    kept = ngram_join.representatives(_docs(spark, rows))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 8, 9] and kept.columns == ["doc_id", "text", "keys"]
    assert ngram_join.representatives(_docs(spark, [])).count() == 0
