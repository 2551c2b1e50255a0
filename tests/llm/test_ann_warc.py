"""Nearest neighbours and WARC archives against plain versions."""

import glob
import gzip
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talkframe.llm import ann, warc

NAN, INF = float("nan"), float("inf")


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, v int")


def _exact(rows, k=5, every=50):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows
          if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for q, v in {(i, tuple(v)): (i, v) for i, v in ok if i % every == 0}.values():
        near = sorted({(-(v @ w) / (np.sqrt(v @ v) * np.sqrt(w @ w)), i) for i, w in ok if i != q and len(w) == len(v)})
        out += [(q, r, i) for r, (_, i) in enumerate(near[:k], 1)]
    return out


def test_perturbations_come_in_order_without_contradictions():
    inside = np.array([0.1, 0.45, 0.8])
    cost = [sum((inside[j] if d < 0 else 1 - inside[j]) ** 2 for j, d in m) for m in ann.perturbations(inside)]
    moves = [tuple(sorted(m)) for m in ann.perturbations(inside)]
    assert cost == sorted(cost) and len(set(moves)) == len(moves) == 3 ** 3


def test_recall_against_brute_force(spark):
    from talkframe.llm.queries import queries
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding), 0) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = {(q, i) for q, _, i in _exact(rows)}
    got = queries()["op7_nearest_neighbours"](spark, sf).collect()
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)
    by_id = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows}
    for r in got[:50]:
        a, b = by_id[r.query_id], by_id[r.vec_id]
        assert r.score == pytest.approx(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)), abs=1e-12)


def _noise(n, length, seed):
    rng = np.random.default_rng(seed)
    return [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(n, length)))]


def test_neighbours_out_of_reach_of_all_probes_are_found(spark):
    """Cells so narrow that most neighbours lie two or more of them away: no number of probes visits those."""
    rows = _noise(1500, 32, 6)
    index = ann.Index(_vectors(spark, rows), width=0.1, scan=200)
    assert (index.projections, index.probes) == (0, 1)
    got = index.search(index.all.where("id % 50 = 0"))
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect()) == sorted(_exact(rows))


def test_more_probes_than_can_be_visited_take_larger_buckets(spark):
    """Small buckets of noise need far more than 4,096 probes; the recall has to hold all the same."""
    rows = _noise(3000, 64, 7)
    index = ann.Index(_vectors(spark, rows), occupancy=1)
    assert 0 < index.projections < 11 and index.probes <= 4096
    got = index.search(index.all.where("id % 50 = 0"))
    want = {(q, i) for q, _, i in _exact(rows)}
    assert len({(r.query_id, r.vec_id) for r in got.collect()} & want) >= 0.95 * len(want)


def test_ties_copies_and_vectors_that_take_no_part(spark):
    rng = np.random.default_rng(4)
    hot = rng.normal(size=4).tolist()
    rows = [(i, hot, 0) for i in range(0, 240, 2)] + [(i, rng.normal(size=4).tolist(), 0) for i in range(1, 60, 2)]
    rows += [(1000, None, 0), (1050, [0.0] * 4, 0), (1100, [1.0, None, 0.0, 0.0], 0), (1150, [NAN, 1.0, 1.0, 1.0], 0),
             (1200, [INF, 1.0, 1.0, 1.0], 0), (None, hot, 0), (1250, [1.0, 2.0], 0), (1251, [2.0, 4.0], 0), (50, hot, 0)]
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.neighbours(_vectors(spark, rows), block=16).collect())
    want = sorted(_exact(rows))
    assert [x for x in got if x[0] != 1250] == [x for x in want if x[0] != 1250]
    assert [x for x in got if x[0] == 1250] == [(1250, 1, 1251)]
    assert ann.neighbours(_vectors(spark, [])).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20), max_size=8), max_size=9))
def test_loser_tree_merges_sorted_runs(runs):
    assert list(warc.LoserTree([sorted(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, size int")


def _rows():
    r, long = random.Random(5), "é" * 499 + "ab"
    rows = [(i, f"http://www.h{r.randrange(9)}.example.com:80/p q%20?x={i}#f", r.choice(["a", "b"]) * r.randrange(2500), i) for i in range(60)]
    return rows + [(60, None, None, 1), (61, "no url", "", 1), (62, "http://x/\r\nWARC/1.1", "WARC/1.1\r\n\r\n\r\n\r\n" * 90, 1),
                   (63, "http://x/", "WARC/1.1\r\n\r\n\r\n\r\n" * 90, 1), (64, "u", long, 1), (65, "u", long, 1), (65, "u", long, 1),
                   (None, "u", long, 1), (66, "http://[bad", "x" * 999, 1), (67, "v", "x" * 999, 1), (68, "v", "z" * 300_000, 1)]


def test_round_trip_equals_a_plain_version(spark, scratch):
    rows = _rows()
    got = warc.round_trip(_pages(spark, rows), f"{scratch}/w", records_per_file=7).collect()
    best = {}
    for i, _, h, _ in rows:
        h = (h or "").encode()
        if len(h) >= 1000:
            best[h] = max(best.get(h, -1), -1 if i is None else i)
    want = []
    for i, _, h, _ in rows:
        h = (h or "").encode()
        to = best.get(h)
        revisit = to is not None and to != i and to >= 0
        want.append((i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    assert {r.url for r in got if r.page_id is not None} == {u or "" for i, u, _, _ in rows if i is not None}


def test_history_is_in_global_order(spark, scratch):
    warc.write(_pages(spark, _rows()).repartition(5), f"{scratch}/w", records_per_file=9)
    runs = warc.runs(spark, f"{scratch}/w")
    assert runs.select("run").distinct().count() > 5
    out = warc.history(runs, rows_per_range=10)
    assert out.rdd.getNumPartitions() > 1
    keys = [warc._sort_key(r.asDict()) for r in out.collect()]
    assert keys == sorted(keys) and len(keys) == len(_rows())


def test_archives_hold_whole_records(spark, scratch):
    warc.write(_pages(spark, _rows()), f"{scratch}/w")
    found = 0
    for f in glob.glob(f"{scratch}/w/*.gz"):
        data = open(f, "rb").read()
        plain = gzip.decompress(data)
        for at, length, fields, block in warc.records(warc.inflated(data)):
            assert plain[at:at + 10] == b"WARC/1.1\r\n" and plain[at:at + length].endswith(block + b"\r\n\r\n")
            assert int(fields["Content-Length"]) == len(block)
            found += 1
    assert found == len(_rows())
    broken = gzip.compress(plain[:-9])
    with pytest.raises(ValueError):
        list(warc.records(warc.inflated(broken)))


def test_archives_of_long_pages_and_odd_ends(spark, scratch):
    """Payloads of many megabytes in one archive, and every way that a payload may run into the empty line after it."""
    ends = ["", "\r", "\n", "\r\n", "\r\n\r", "\r\n\r\n", "\n\r\n\r\n\r", "\r\n\r\n\r\n"]
    rows = [(i, "u", "x" * n + e, 1) for i, (n, e) in enumerate((n, e) for e in ends for n in (0, 1, 50))]
    rows += [(100 + i, "long", f"{i}" * 4_000_000 + "\r\n\r\n" * 3, 1) for i in range(6)]
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.round_trip(_pages(spark, rows).coalesce(1), f"{scratch}/w").collect()}
    assert got == {i: (len(h), hashlib.sha1(h.encode()).hexdigest()) for i, _, h, _ in rows}


def test_url_keys():
    assert warc.url_key("https://WWW.Example.com:443/a?b=1#c") == "com,example)/a?b=1"
    assert warc.url_key("http://a.b:8080") == "b,a:8080)/"


def test_no_pages(spark, scratch):
    assert warc.round_trip(_pages(spark, []), f"{scratch}/w").count() == 0
