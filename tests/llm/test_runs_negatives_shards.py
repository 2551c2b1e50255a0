"""Periodic runs, hard negatives and shards against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from talkframe.llm import hard_negatives as H
from talkframe.llm import run_detection as R
from talkframe.llm import sharding as S

NAN, INF = float("nan"), float("inf")


def _plain_runs(w, least=12):
    """Every period, every stretch; the smallest period of a stretch counts."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((i, n, q) for (i, n), q in found.items())


def _random_words(r):
    k, n = r.choice([1, 2, 2, 3, 6]), r.randint(0, 70)
    w = [r.randint(1, k) for _ in range(n)]
    if r.random() < 0.5 and n > 4:
        a = r.randrange(n)
        p = r.randint(1, max(1, (n - a) // 2))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_runs_equal_every_period_tried():
    r = random.Random(1)
    for _ in range(1500):
        w = _random_words(r)
        for least in (2, 5, 12):
            assert [tuple(x) for x in R.runs(w, least).tolist()] == _plain_runs(w, least)


def test_pieces_hold_all_runs():
    r = random.Random(2)
    for _ in range(800):
        w = [x for _ in range(r.randint(1, 4)) for x in _random_words(r) + [r.randint(100, 10_000)]]
        h = np.array([x * 7919 for x in w], np.uint64)
        for least in (2, 5, 12):
            a, b = R.pieces(h, np.zeros(len(w), np.int64), max(1, least // 2), least)
            assert sorted((x + lo, n, q) for lo, hi in zip(a.tolist(), b.tolist()) for x, n, q in R.runs(w[lo:hi], least).tolist()) == _plain_runs(w, least)


def test_extensions_equal_letter_by_letter_comparison():
    r = random.Random(3)
    for _ in range(60):
        w = [r.randint(1, 2) for _ in range(40)]
        e = R.Extensions(w, 3)
        i, j = (np.array(x) for x in zip(*[(a, b) for a in range(41) for b in range(41) if a != b]))
        want = [next((k for k in range(40) if max(a, b) + k >= 40 or w[a + k] != w[b + k]), 0) for a, b in zip(i, j)]
        assert e.common(i, j).tolist() == want
        assert sorted(range(41), key=lambda k: w[k:]) == np.argsort(e.rank).tolist()


def _collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def test_run_operator_on_edge_rows(spark):
    r = random.Random(4)
    texts = [None, "", " \n\t ", "a " * 11, "a " * 12, "spam  ham\t" * 4000, "é ß " * 9, "x y z " * 5 + "end", "a\x85b c\x1cd " * 8]
    texts += [" ".join(f"w{x}" for x in _random_words(r) + _random_words(r)) for _ in range(150)]
    rows = [(i, t, "z", i) for i, t in enumerate(texts)] + [(4, texts[4], "z", 4), (None, texts[5], None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, n_words int")
    out = R.detected(docs).withColumn("top", R.longest()).collect()
    assert len(out) == len(rows)
    for x in out:
        t = texts[5 if x.doc is None else x.doc]
        w = [y.decode() for y in (t or "").encode().split()]
        want = _plain_runs(w)
        assert x.n_words == len(w) and [tuple(y) for y in x.runs] == want and x.collapsed == " ".join(_collapsed(w, want))
        best = min(want, key=lambda y: (-y[1], y[0], y[2])) if want else None
        assert (tuple(x.top) if x.top else None) == best
    assert R.detected(docs.where("false")).count() == 0
    assert [tuple(y) for y in R.detected(docs.where("doc_id = 3"), min_length=4).first().runs] == [(0, 11, 1)]


@pytest.mark.parametrize("sf", ["0.001"])
def test_run_query_equals_plain_version(spark, sf):
    from talkframe.llm.queries import queries
    got = {x.doc_id: x for x in queries()["op11_periodic_runs"](spark, f"/root/testdata/sf{sf}").collect()}
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").collect()
    assert len(got) == len(docs) and sum(x.n_runs > 0 for x in got.values()) > 5
    for d in docs:
        w = (d.text or "").encode().split()
        h = zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        x = got[d.doc_id]
        if len(w) < 1500:
            want = _plain_runs(w)
            assert x.n_runs == len(want) and x.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
            assert x.collapsed_sha256 == hashlib.sha256(b" ".join(_collapsed(w, want))).hexdigest()
            if want:
                s, n, q = min(want, key=lambda y: (-y[1], y[0], y[2]))
                assert (x.start, x.length, x.period, x.exponent_milli) == (s, n, q, 1000 * n // q)


def _plain_negatives(rows, every, positives=5, negatives=10, low=30, high=90):
    rows = sorted({(i, lab, tuple(v)) for i, lab, v in rows})
    out = []
    for i, lab, v in rows:
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, lab == other) for j, other, w in rows if j != i and len(w) == len(v)]
        for ps, p in sorted({(s, j) for s, j, same in scored if same})[:positives]:
            fits = sorted({(s, j) for s, j, same in scored if not same and low * -ps <= 100 * -s <= high * -ps})[:negatives]
            out += [(i, p, k, j, -ps, -s) for k, (s, j) in enumerate(fits, 1)]
    return sorted(out)


def _mined(spark, rows, every=5, **how):
    df = spark.createDataFrame(rows, "id bigint, label bigint, v array<bigint>")
    from pyspark.sql import functions as F
    return sorted(tuple(x) for x in H.mined(df, F.col("id") % every == 0, **how).collect())


@pytest.mark.parametrize("seed,block,slices", [(1, 512, 1 << 16), (2, 4, 50), (3, 1, 30)])
def test_hard_negatives_equal_brute_force(spark, seed, block, slices):
    rng = np.random.default_rng(seed)
    center = rng.integers(-40, 40, (4, 6))
    rows = [(i, int(rng.integers(0, 3)) if i % 3 else 1, (center[rng.integers(0, 4)] + rng.integers(-9, 9, 6)).tolist()) for i in range(160)]
    rows += [(200 + i, 1, rows[0][2]) for i in range(20)] + [rows[3]] * 30           # copies, repeated rows
    rows += [(300, 1, [5, 5]), (301, 1, [4, 5]), (302, 2, [3, 2]), (305, 2, []), (310, 2, []), (311, 1, [])]  # other lengths
    rows += [(5, 2, rows[7][2]), (5, 2, rows[8][2]), (7, 0, rows[8][2])]              # an id of several rows
    rows += [(400, 9, [1, 0, 0, 0, 0, 0]), (405, 1, [0] * 6), (410, 2, [-30] * 6)]    # alone in its label, zero, far away
    assert _mined(spark, rows, block=block, slice_rows=slices) == _plain_negatives(rows, 5)


def test_hard_negatives_of_large_numbers_and_empty_tables(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, [int(x) for x in rng.integers(-(1 << 29), 1 << 29, 3)]) for i in range(60)]
    assert _mined(spark, rows, every=4) == _plain_negatives(rows, 4)
    assert _mined(spark, []) == []
    vectors = [(1, [0.5, -0.001], 3, 0), (2, [None, 1.0], 3, 0), (3, [NAN, 1.0], 3, 0), (4, [INF, 1.0], 3, 0), (5, None, 3, 0), (6, [1.0], None, 0),
               (None, [1.0], 3, 0)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int, v int")
    assert [tuple(x) for x in H.rows_of(df).collect()] == [(1, 3, [128, -1])]


def test_tree_bounds_leave_most_scores_of_clustered_vectors_out():
    rng = np.random.default_rng(5)
    center = rng.normal(size=(20, 16)) * 400
    anchors = (center[rng.integers(0, 20, 200)] + rng.normal(size=(200, 16)) * 4).astype(np.int64)
    others = (center[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 16)) * 4).astype(np.int64)
    own = np.full(200, 1)
    best = (anchors.astype(float) ** 2).sum(1).astype(np.int64)
    block = H.Block(np.arange(200), own, anchors, [[int(0.85 * b)] for b in best], [[int(0.95 * b)] for b in best], 10, False)
    ident = np.arange(1000, 5000)
    for a in range(0, 4000, 1000):
        block.meet(ident[a:a + 1000], np.zeros(1000), others[a:a + 1000])
    assert block.scored < 0.25 * block.seen
    order, parent, far = H.spanning_tree(anchors)
    assert (parent < 0).sum() == 1 and sorted(order.tolist()) == list(range(200))
    assert np.allclose(far[order[1:]], np.sqrt(((anchors[order[1:]] - anchors[parent[order[1:]]]) ** 2).sum(1)))


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_feistel_network_permutes(n):
    x = np.arange(n)
    y = S.permuted(x, n)
    assert sorted(y.tolist()) == list(range(n)) and (S.permuted(y, n, back=True) == x).all()
    if n > 100:
        assert (S.permuted(x, n, seed=14) != y).mean() > 0.9 and abs(np.corrcoef(x, y)[0, 1]) < 0.1
        assert S.place(7, n) == (int(y[7]) % 16, int(y[7]) // 16) and S.row_at(*S.place(7, n), n) == 7
    with pytest.raises(ValueError):
        S.place(n, n)
    with pytest.raises(ValueError):
        S.row_at(0, n, n)


def test_numbers_of_sixty_bits_permute_too():
    n = (1 << 60) + 12345
    x = np.random.default_rng(1).integers(0, n, 500)
    y = S.permuted(x, n)
    assert (y >= 0).all() and (y < n).all() and (S.permuted(y, n, back=True) == x).all()


def _shard_rows():
    rows = [(i, f"text {i} é", i, "k") for i in range(500)] + [(i, None, 0, "k") for i in range(500, 510)]
    return rows + [(7, "the same", 1, "k")] * 300 + [(None, "no id", 2, None)] * 200 + [(3, "", 3, "k"), (3, "x" * 300_000, 3, "k")]


def test_shards_of_edge_rows(spark):
    rows = _shard_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard int, slot string")
    out = S.sharded(docs, keep=["shard", "slot"]).collect()
    n = len(rows)
    assert sorted(x.row for x in out) == list(range(n))
    assert all((x.shard, x.slot) == S.place(x.row, n) for x in out)
    for s in range(16):
        slots = sorted(x.slot for x in out if x.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (n // 16, n // 16 + 1)
    key = lambda d, t: (d is not None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    want = sorted(key(d, t) for d, t, _, _ in rows)
    assert [(x.doc is not None, x.doc or 0, x.size, x.crc) for x in sorted(out, key=lambda x: x.row)] == want
    assert {x.kept.shard for x in out if x.doc == 7 and x.size == 9} == {1}
    again = S.sharded(docs.repartition(7)).select("doc", "size", "crc", "shard", "slot").collect()
    assert sorted((str(x.doc), x.size, x.shard, x.slot) for x in again) == sorted((str(x.doc), x.size, x.shard, x.slot) for x in out)
    assert S.sharded(docs.where("false")).count() == 0


def test_written_shards_hold_whole_rows_in_order(spark, scratch):
    docs = spark.createDataFrame(_shard_rows(), "doc_id bigint, text string, shard int, slot string")
    S.written(docs, f"{scratch}/shards", shards=4, slots=64)
    back = spark.read.parquet(f"{scratch}/shards")
    assert sorted(map(str, (x.row for x in back.collect()))) == sorted(map(str, docs.collect()))
    want = {(x.shard, x.slot): x.doc for x in S.sharded(docs, shards=4).collect()}
    assert {(x.shard, x.slot): x.row.doc_id for x in back.collect()} == want
    one = spark.read.parquet(f"{scratch}/shards/shard=2/part=1").collect()
    assert [x.slot for x in one] == list(range(64, 128))


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_hard_negatives", "op13_sharding"])
def test_queries_equal_their_sql(spark, name):
    from oracle_check import compare
    assert compare(spark, "/root/testdata/sf0.001", {name}, verbose=False)[name].startswith("OK")
