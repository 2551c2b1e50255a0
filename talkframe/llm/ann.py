"""Approximate nearest neighbours by multiprobe p-stable hashing.

Unit vectors are hashed by ``tables`` tables of Gaussian projections cut into
cells of ``width``; a cell combination is a bucket.  A query visits its own
bucket and then perturbed ones (a projection moved to a neighbouring cell) in
the order of the summed squared distances to the cell walls, which is the order
of their estimated success.  Buckets meet queries in an equi-join; each meeting
reranks its members by exact cosine in double precision and keeps the best
``k``, and the tables' candidates are merged for each query.

Fitting: the projections per table follow from the number of vectors, and the
number of probes from ``sample`` queries (the first by a hash of the id) whose
exact neighbours are found in blocks over all vectors: it is the smallest that
visits the buckets of ``recall`` of those neighbours.  Where that takes more than
``most`` probes, or no number of them does it (a neighbour two cells away is in
no perturbed bucket), the tables get one projection less, so larger buckets, and
are fitted again.  Without projections all vectors of a length are one bucket:
the queries are compared with everything, in blocks of ``scan`` vectors, and the
result is exact.  So no fit is kept that finds less than ``recall`` of the
sample's neighbours.

Skew: equal vectors are collapsed to their k + 1 smallest ids first (no other
copy can be among the k nearest), and a bucket of more than ``block`` vectors
is split into blocks that each of its queries visits, so no vector is left out;
a bucket that more than ``block`` queries visit deals them to as many copies of
its blocks.  A task keeps the best ``k`` of each of its queries over all buckets
that it holds and hands them on once, at most ``HELD`` queries at a time, so what
is shuffled grows with queries and tasks, not with the buckets visited.

Cases: vectors that are null, zero or hold a null or a non-finite component
take no part, nor do rows with a null id; only vectors of equal length are
near each other; a row with a query's id is the query's own; with fewer than k
candidates the result is shorter.  An empty table gives an empty result.  Of the
input only the key and the vector are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from talkframe.llm.tables import stored


HELD = 50_000


class Best:
    """The k best (score, id) of each query that a task has met so far, as sorted columns."""

    def __init__(self, k: int):
        self.k, self.parts, self.size, self.least = k, [], 0, 1 << 18

    def add(self, query: np.ndarray, ident: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((query, ident, score))
        self.size += len(query)
        if self.size > self.least:
            self._shrink()
            self.least = max(1 << 18, 2 * self.size)

    def _shrink(self) -> None:
        q, i, s = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        new = np.ones(len(q), bool)  # a vector met in two tables counts once
        new[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])
        q, i, s = q[new], i[new], s[new]
        best = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.parts = [(q[best], i[best], s[best])]
        self.size = int(best.sum())

    def full(self) -> bool:
        if self.size > max(self.least, HELD * self.k):
            self._shrink()
        return self.size > HELD * self.k

    def taken(self) -> list[np.ndarray]:
        """What was kept, once; nothing is left."""
        if not self.parts:
            return []
        self._shrink()
        out, self.parts, self.size = list(self.parts[0]), [], 0
        return out if len(out[0]) else []


class Hasher:
    """The projections of all tables for one vector length."""

    def __init__(self, length: int, tables: int, projections: int, width: float, seed: int):
        rng = np.random.default_rng([seed, length])
        self.tables, self.projections, self.width = tables, projections, width
        self.a = rng.normal(size=(length, tables * projections))
        self.b = rng.uniform(0, width, tables * projections)
        self.mix = rng.integers(1, 1 << 62, (tables, projections), dtype=np.int64) | 1

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers and the places within the cells, by row, table and projection."""
        x = (unit @ self.a + self.b) / self.width
        cell = np.floor(x)
        shape = (len(unit), self.tables, self.projections)
        return cell.astype(np.int64).reshape(shape), (x - cell).reshape(shape)

    def buckets(self, cell: np.ndarray) -> np.ndarray:
        """Bucket numbers of cells (..., table, projection)."""
        with np.errstate(over="ignore"):
            return (cell * self.mix).sum(-1)

    def moved(self, own: np.ndarray, table: int, moves: list[tuple[int, int]]) -> np.int64:
        """The bucket number of ``table`` after moving projections."""
        with np.errstate(over="ignore"):
            return sum((np.int64(d) * self.mix[table, j] for j, d in moves), own[table])


def perturbations(inside: np.ndarray):
    """Sets of moves [(projection, -1 or 1)] by growing sum of squared wall distances."""
    yield []
    if not len(inside):
        return
    walls = sorted([(x * x, j, -1) for j, x in enumerate(inside)] + [((1 - x) ** 2, j, 1) for j, x in enumerate(inside)])
    heap = [(walls[0][0], (0,))]
    while heap:
        cost, chosen = heapq.heappop(heap)
        moves = [(walls[i][1], walls[i][2]) for i in chosen]
        if len({j for j, _ in moves}) == len(moves):
            yield moves
        last = chosen[-1] + 1
        if last < len(walls):
            heapq.heappush(heap, (cost - walls[last - 1][0] + walls[last][0], (*chosen[:-1], last)))
            heapq.heappush(heap, (cost + walls[last][0], (*chosen, last)))


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def nearest(q, q_id, v, v_id, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, cosine) of the k best of ``v`` for each query, ties to smaller ids."""
    rows, cols = [], []
    for a in range(0, len(q), 256):
        near = unit(q[a:a + 256]) @ unit(v).T
        near[q_id[a:a + 256, None] == v_id[None, :]] = -np.inf
        if near.shape[1] > k:
            least = np.partition(near, -k, axis=1)[:, -k]
            hit = near >= np.maximum(least, -2)[:, None] - 1e-9  # what rounding may have parted stays together
        else:
            hit = near > -2
        r, c = np.nonzero(hit)
        rows.append(r + a)
        cols.append(c)
    r, c = np.concatenate(rows), np.concatenate(cols)
    score = cosine(q[r], v[c])
    order = np.lexsort((v_id[c], -score, r))
    r, c, score = r[order], c[order], score[order]
    start = np.searchsorted(r, r)
    best = np.arange(len(r)) - start < k
    return r[best], c[best], score[best]


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists(v, lambda x: x != 0)
    return (vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(finite & nonzero)
            .select(F.col(key).cast("bigint").alias("id"), v.alias("v")))


def collapsed(rows: DataFrame, k: int) -> DataFrame:
    """The k + 1 smallest ids of each distinct vector."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return rows.withColumn("r", rank).where(F.col("r") <= k + 1).drop("r")


def _matrix(col: pa.Array, length: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _by_length(b: pa.RecordBatch, at: int):
    """Sub-batches of rows whose vectors have one length."""
    size = np.diff(b.column(at).offsets.to_numpy())
    for n in np.unique(size):
        yield int(n), b.filter(pa.array(size == n))


class Index:
    def __init__(self, vectors: DataFrame, k: int = 5, tables: int = 3, width: float = 2.0, occupancy: int = 512,
                 recall: float = 0.97, sample: int = 64, block: int = 1024, seed: int = 5, most: int = 4096, scan: int = 32768,
                 key: str = "vec_id", vector: str = "embedding"):
        self.k, self.tables, self.width, self.seed, self.block = k, tables, width, seed, block
        self.all = stored(valid(vectors, key, vector), "ann-vectors")
        self.rows = stored(collapsed(self.all, k), "ann-distinct")
        n = self.rows.count()
        # a projection of a unit vector fills about 2.05 - log2(width) bits
        bits = max(0.5, 2.05 - float(np.log2(width)))
        self.projections = int(np.clip(round(np.log2(max(2.0, n / occupancy)) / bits), 2, 40))
        self._fit(sample, recall, most, scan)

    @property
    def spec(self) -> tuple:
        """What a task needs to make a length's hasher."""
        return self.tables, self.projections, self.width, self.seed

    def _fit(self, sample: int, recall: float, most: int, scan: int) -> None:
        """Projections and probes per table that find ``recall`` of the exact neighbours of some queries."""
        by_length, truth = self._truth(sample)
        while truth and self.projections:
            ranks = np.sort(np.concatenate([self._ranks(*x, most) for x in self._hashed(by_length, truth)]))
            probes = int(ranks[max(0, int(np.ceil(recall * len(ranks))) - 1)])
            if probes <= most:
                self.probes = probes
                return
            self.projections -= 1
        self.projections, self.tables, self.probes, self.block = 0, 1, 1, scan

    def _truth(self, sample: int) -> tuple[dict, dict]:
        """Some queries, (vectors, ids) by length, and the vectors of the exact neighbours by query id."""
        queries = self.rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
        found: dict[int, list] = {}
        for r in queries:
            found.setdefault(len(r.v), []).append(r)
        by_length = {n: (np.array([r.v for r in rs]), np.array([r.id for r in rs])) for n, rs in found.items()}
        k = self.k

        def exact(batches):  # the sample in blocks against all vectors: k rows for each query and task
            held: dict[int, tuple] = {}
            for b in batches:
                for n, part in _by_length(b, 1):
                    if n in by_length and part.num_rows:
                        q, q_id = by_length[n]
                        v, v_id = _matrix(part.column(1), n), part.column(0).to_numpy()
                        if n in held:
                            v, v_id = np.concatenate([held[n][0], v]), np.concatenate([held[n][1], v_id])
                        r, c, s = nearest(q, q_id, v, v_id, k)
                        near = np.unique(c)
                        at = np.searchsorted(near, c)
                        held[n] = v[near], v_id[near], (q_id[r], s, at)
            for v, v_id, (query, s, at) in held.values():
                vs = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * v.shape[1], pa.int32()), pa.array(v[at].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(s), pa.array(v_id[at]), vs], names=["query", "score", "id", "v"])

        near = self.rows.mapInArrow(exact, "query bigint, score double, id bigint, v array<double>")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        truth: dict[int, list] = {}
        for r in near.withColumn("r", rank).where(F.col("r") <= k).collect():
            truth.setdefault(r.query, []).append(r.v)
        return by_length, truth

    def _hashed(self, by_length: dict, truth: dict):
        """(hasher, own buckets, places within the cells, buckets of the exact neighbours) of each query."""
        for n, (q, q_id) in by_length.items():
            h = Hasher(n, *self.spec)
            cell, inside = h.cells(unit(q))
            own = h.buckets(cell)
            for i, query in enumerate(q_id):
                if query in truth:
                    yield h, own[i], inside[i], h.buckets(h.cells(unit(np.array(truth[query])))[0])

    def _ranks(self, h, own, inside, goal, most) -> np.ndarray:
        """For each neighbour the fewest probes per table after which some table has visited it (most + 1: not by ``most``)."""
        best = np.full(len(goal), most + 1)
        for t in range(self.tables):
            for rank, moves in enumerate(perturbations(inside[t]), 1):
                if rank >= best.max():
                    break
                hit = goal[:, t] == h.moved(own, t, moves)
                best[hit] = np.minimum(best[hit], rank)
        return best

    def _indexed(self) -> DataFrame:
        spec = self.spec

        def rows(batches):
            for b in batches:
                for n, part in _by_length(b, 1):
                    if part.num_rows:
                        h = Hasher(n, *spec)
                        bucket = h.buckets(h.cells(unit(_matrix(part.column(1), n)))[0])
                        for t in range(h.tables):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(part.num_rows, t, np.int32)), pa.array(np.full(part.num_rows, n, np.int32)),
                                 pa.array(bucket[:, t]), part.column(0), part.column(1)], names=["t", "d", "bucket", "id", "v"])
        return self.rows.mapInArrow(rows, "t int, d int, bucket bigint, id bigint, v array<double>")

    def _probing(self, queries: DataFrame) -> DataFrame:
        probes, spec = self.probes, self.spec

        def rows(batches):
            for b in batches:
                for n, part in _by_length(b, 1):
                    if not part.num_rows:
                        continue
                    h = Hasher(n, *spec)
                    cell, inside = h.cells(unit(_matrix(part.column(1), n)))
                    own = h.buckets(cell)
                    for i in range(part.num_rows):
                        t, bucket = [], []
                        for table in range(h.tables):
                            for _, moves in zip(range(probes), perturbations(inside[i, table])):
                                t.append(table)
                                bucket.append(h.moved(own[i], table, moves))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(t, pa.int32()), pa.array(np.full(len(t), n, np.int32)), pa.array(bucket, pa.int64()),
                             part.column(0).take(pa.array(np.full(len(t), i)))], names=["t", "d", "bucket", "query"])
        return queries.mapInArrow(rows, "t int, d int, bucket bigint, query bigint")

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, rank, vec_id, score) of the k best candidates of each query (id, v)."""
        where = ["t", "d", "bucket"]
        index = stored(self._indexed(), "ann-index")
        probing = stored(self._probing(queries), "ann-probes")
        size = index.groupBy(where).agg(F.ceil(F.count("*") / self.block).cast("int").alias("blocks"))
        load = probing.groupBy(where).agg(F.ceil(F.count("*") / self.block).cast("int").alias("parts"))
        met = stored(size.join(load, where), "ann-buckets")
        members = (index.join(met, where).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
                   .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
        probes = (probing.join(met, where).withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int"))
                  .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
        asked = probes.join(queries.withColumnRenamed("id", "query"), "query")
        key = [*where, "block", "part"]
        rows = (members.select(*key, F.lit(0).alias("side"), "id", "v")
                .unionByName(asked.select(*key, F.lit(1).alias("side"), F.col("query").alias("id"), "v"))
                .repartition(*key).sortWithinPartitions(*key, "side", "id"))
        best = rows.mapInArrow(_reranked(self.k), "query bigint, id bigint, score double").groupBy("query", "id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        return (best.withColumn("rank", rank).where(F.col("rank") <= self.k)
                .select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score"))


def _reranked(k):
    """Queries of a bucket block against its members; the members (at most a block) come first."""
    def rows(batches):
        at, ids, vs, best = None, [], [], Best(k)

        def kept():
            if found := best.taken():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query", "id", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.column_stack([b.column(i).to_numpy() for i in range(5)])
            side, ident = b.column(5).to_numpy(), b.column(6).to_numpy()
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1) | (side[1:] != side[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(side)]):
                if at != tuple(keys[lo]):
                    at, ids, vs = tuple(keys[lo]), [], []
                v = _matrix(b.column(7).slice(lo, hi - lo), int(keys[lo, 1]))
                if side[lo] == 0:
                    ids.append(ident[lo:hi])
                    vs.append(v)
                elif ids:
                    ids, vs = [np.concatenate(ids)], [np.concatenate(vs)]
                    r, c, s = nearest(v, ident[lo:hi], vs[0], ids[0], k)
                    best.add(ident[lo:hi][r], ids[0][c], s)
            if best.full():
                yield from kept()
        yield from kept()
    return rows


def neighbours(vectors: DataFrame, every: int = 50, **how) -> DataFrame:
    """The nearest of all rows for the queries, the rows whose id is divisible by ``every``."""
    index = Index(vectors, **how)
    return index.search(index.all.where(F.col("id") % every == 0).dropDuplicates(["id", "v"]))
