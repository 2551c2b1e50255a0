"""Hard-negative mining with anchor spanning-tree bounds.

Rows are (id, label, integer vector); a score is the inner product of a candidate
with an anchor.  An anchor's positives are its ``positives`` best other rows of the
same label; for each positive the best ``negatives`` rows of other labels are mined
whose score lies in a window, ``low`` to ``high`` hundredths of the positive's score.

Anchors are dealt to blocks of at most ``block`` alike ones (in order of the signs of
random projections), and the anchors of a block are joined by a minimum spanning
tree of their distances.  A task takes a block and streams a slice of the candidates
through it, one Arrow batch at a time.  The root scores every candidate.  For a child
at distance d of its parent, a candidate's score is that at the parent plus or minus d
times the candidate's norm (Cauchy-Schwarz); where the parent was not scored itself,
its bounds are carried on.  Only candidates whose bounds overlap what the child still
wants are scored: its windows, from below cut off at the ``negatives``-th best score
found so far.  Positives are found by the same walk with one open window, among the
candidates of the anchor's label.  Bounds are widened by more than the rounding of
doubles, and scores are exact integers, so nothing is lost.

Skew: a label of a third of all rows, or all rows of one label, only makes more
anchor blocks; candidates are dealt to slices by a hash whatever their label.  A
task holds one block and one batch, and hands on the best of its anchors only.
Equal rows (id, label and vector) are one row.

Cases: rows with a null id, label or vector, or a null or non-finite component,
take no part; vectors of different lengths are no candidates of each other; a row
with the anchor's id is never its positive or negative (rows that share an id but
differ are candidates each, but for equal scores, and anchors each, under one id); ties go to smaller
ids; an anchor without positives or with empty windows has no rows; a positive's
score below 0 leaves no window, and one of 0 asks for scores of 0; an empty table
gives an empty result; only id, label and vector are read, so other columns cannot
clash.  Scores must fit in 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.llm.tables import stored

_SIGNS = 40


def rows_of(vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, v) of the rows that take part; ``v`` holds floor(scale * component)."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(finite)
            .select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
                    F.transform(v, lambda x: F.floor(x * scale).cast("bigint")).alias("v")))


def _matrix(col: pa.Array, length: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), length)


def _signs(seed: int):
    """Signs of projections: rows with equal leading bits point alike."""
    def run(col: pa.Array) -> pa.Array:
        out = np.zeros(len(col), np.int64)
        size = np.diff(col.offsets.to_numpy())
        for n in np.unique(size):
            if n:
                own = size == n
                a = np.random.default_rng([seed, int(n)]).normal(size=(int(n), _SIGNS))
                bits = _matrix(col.filter(pa.array(own)), int(n)).astype(float) @ a > 0
                out[own] = bits @ (1 << np.arange(_SIGNS)[::-1])
        return pa.array(out)
    run.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "bigint")


def blocks(anchors: DataFrame, by: list[str], block: int, seed: int = 3) -> DataFrame:
    """``anchors`` with ``block``: at most about ``block`` rows of a ``by`` group, alike ones together.

    A group's anchors are dealt by their sign bits, as many of the leading ones as
    the group needs; what still overflows (copies, alike rows) by a hash.
    """
    coded = anchors.withColumn("code", _signs(seed)(F.col("v")))
    size = anchors.groupBy(by).agg(F.count("*").alias("_n"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / block))).cast("int")
    coded = coded.join(size, by).withColumn("_bits", bits)
    coded = coded.withColumn("code", F.expr(f"shiftright(code, greatest(0, {_SIGNS} - _bits))")).drop("_n", "_bits")
    over = coded.groupBy([*by, "code"]).agg(F.ceil(F.count("*") / block).alias("_parts"))
    part = F.pmod(F.xxhash64("id", "v"), F.col("_parts"))
    return coded.join(over, [*by, "code"]).withColumn("block", F.xxhash64(*by, "code", part)).drop("code", "_parts")


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, parent (of each row; -1: the root) and edge length of a minimum spanning tree (Prim)."""
    n = len(v)
    x = v.astype(float)
    norm = (x * x).sum(1)
    dist, parent = np.full(n, np.inf), np.full(n, -1)
    order, at, done = np.empty(n, np.int64), 0, np.zeros(n, bool)
    for k in range(n):
        order[k], done[at] = at, True
        d = norm + norm[at] - 2 * (x @ x[at])
        near = ~done & (d < dist)
        dist[near], parent[near] = d[near], at
        if k + 1 < n:
            at = int(np.where(done, np.inf, dist).argmin())
    far = np.zeros(n)
    child = parent >= 0
    far[child] = np.sqrt(((x[child] - x[parent[child]]) ** 2).sum(1))
    return order, parent, far


class Block:
    """The anchors of one block, their tree, and the best candidates met so far."""

    def __init__(self, ids, labels, v, lows, highs, k: int, same: bool):
        self.ids, self.labels, self.k, self.same = ids, labels, k, same
        self.v = v.astype(np.int64)
        self.most = float(np.abs(self.v).max(initial=0))
        self.lows, self.highs = lows, highs  # a list of window bounds for each anchor
        self.order, self.parent, self.far = spanning_tree(self.v)
        self.best = [[(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in w] for w in lows]
        self.scored = self.seen = 0

    def scores(self, j: int, c: np.ndarray, c_float: np.ndarray | None) -> np.ndarray:
        if c_float is None:  # too large for exact doubles
            return c @ self.v[j]
        return (c_float @ self.v[j].astype(float)).astype(np.int64)

    def _wanted(self, j: int) -> tuple[float, float]:
        """Scores that the anchor can still use."""
        low = min((max(lo, int(best[0][-1])) if len(best[0]) == self.k else lo
                   for lo, hi, best in zip(self.lows[j], self.highs[j], self.best[j]) if lo <= hi), default=np.inf)
        return low, max((hi for lo, hi in zip(self.lows[j], self.highs[j]) if lo <= hi), default=-np.inf)

    def _keep(self, j: int, s: np.ndarray, ident: np.ndarray) -> None:
        for w, (lo, hi) in enumerate(zip(self.lows[j], self.highs[j])):
            held_s, held_i = self.best[j][w]
            if len(held_s) == self.k:
                lo = max(lo, int(held_s[-1]))
            ok = (s >= lo) & (s <= hi)
            if ok.any():
                all_s, all_i = np.concatenate([held_s, s[ok]]), np.concatenate([held_i, ident[ok]])
                first = np.lexsort((all_i, -all_s))
                all_s, all_i = all_s[first], all_i[first]
                new = np.ones(len(first), bool)  # an id with the same score counts once
                new[1:] = (all_s[1:] != all_s[:-1]) | (all_i[1:] != all_i[:-1])
                self.best[j][w] = all_s[new][:self.k], all_i[new][:self.k]

    def meet(self, ident: np.ndarray, label: np.ndarray, c: np.ndarray) -> None:
        """One batch of candidates walks down the tree."""
        c = c.astype(np.int64)
        small = self.most * float(np.abs(c).max(initial=0)) * max(1, c.shape[1]) < 2 ** 53
        c_float = c.astype(float) if small else None
        norm = np.sqrt((c.astype(float) ** 2).sum(1))
        low, high = {}, {}
        waiting = np.bincount(self.parent[self.parent >= 0], minlength=len(self.ids))
        for j in self.order.tolist():
            p = int(self.parent[j])
            fits = (label == self.labels[j]) == self.same
            fits &= ident != self.ids[j]
            if p < 0:
                s = self.scores(j, c, c_float)
                lo = hi = s.astype(float)
                at = np.flatnonzero(fits)
                self.scored += len(s)
                s = s[at]
            else:
                reach = norm * self.far[j]
                reach = reach * (1 + 1e-9) + 1 + 1e-9 * (np.abs(low[p]) + np.abs(high[p]))
                lo, hi = low[p] - reach, high[p] + reach
                least, most = self._wanted(j)
                at = np.flatnonzero(fits & (hi >= least) & (lo <= most))
                s = self.scores(j, c[at], None if c_float is None else c_float[at])
                lo[at] = hi[at] = s
                self.scored += len(at)
                waiting[p] -= 1
                if not waiting[p]:
                    del low[p], high[p]
            self.seen += len(c)
            if waiting[j]:
                low[j], high[j] = lo, hi
            self._keep(j, s, ident[at])

    def rows(self, extra) -> pa.RecordBatch:
        """(anchor, extra, id, score) of what is best for some window, each once."""
        out = [(j, i, s) for j, each in enumerate(self.best)
               for i, s in {(i, s) for ss, ii in each for i, s in zip(ii.tolist(), ss.tolist())}]
        j = np.array([x[0] for x in out], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[j]), pa.array(extra[j]), pa.array([x[1] for x in out], pa.int64()),
                                           pa.array([x[2] for x in out], pa.int64())], names=["anchor", "twin", "id", "score"])


def _walked(k: int, same: bool, tally):
    """Groups of (block, slice, side, twin, id, label, v, lows, highs), anchors (side 0) first."""
    def rows(batches):
        at, anchors, block, twins = None, [], None, None

        def ready():
            ids, labels, twin, v, lows, highs = (np.concatenate([a[i] for a in anchors]) if i < 4 else sum((a[i] for a in anchors), [])
                                                 for i in range(6))
            return Block(ids, labels, v, lows, highs, k, same), twin

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.column_stack([b.column(i).to_numpy() for i in range(4)])
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(keys)]):
                part = b.slice(lo, hi - lo)
                twin, ident, label = (part.column(i).to_numpy(zero_copy_only=False) for i in (4, 5, 6))
                v = _matrix(part.column(7), int(keys[lo, 2]))
                if at != tuple(keys[lo, :3]):
                    if block is not None:
                        yield block.rows(twins)
                    at, anchors, block = tuple(keys[lo, :3]), [], None
                if keys[lo, 3] == 0:
                    anchors.append((ident, label, twin, v, part.column(8).to_pylist(), part.column(9).to_pylist()))
                elif anchors:
                    if block is None:
                        block, twins = ready()
                    before = block.scored, block.seen
                    block.meet(ident, label, v)
                    if tally is not None:
                        tally[0].add(block.scored - before[0])
                        tally[1].add(block.seen - before[1])
        if block is not None:
            yield block.rows(twins)
    return rows


def _walk(anchors: DataFrame, candidates: DataFrame, by: list[str], k: int, same: bool, slices: int, tally=None) -> DataFrame:
    """(anchor, twin, id, score): anchors (with block, lows, highs) against the candidates of their ``by`` group."""
    where = ["block", "slice", "d", "side"]
    part = anchors.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("side", F.lit(0))
    met = part.groupBy([*by, "slice", "block"]).agg(F.count("*").alias("_")).select(*by, "slice", "block")
    sliced = candidates.withColumn("slice", F.pmod(F.xxhash64("id", "label", "v"), F.lit(slices)).cast("int"))
    other = (sliced.join(met, [*by, "slice"])
             .select("block", "slice", "d", F.lit(1).alias("side"), F.lit(0).cast("bigint").alias("twin"), "id", "label", "v",
                     F.lit(None).cast("array<bigint>").alias("lows"), F.lit(None).cast("array<bigint>").alias("highs")))
    rows = (part.select(*where, "twin", "id", "label", "v", "lows", "highs").unionByName(other)
            .repartition("block", "slice", "d").sortWithinPartitions(*where))
    return rows.mapInArrow(_walked(k, same, tally), "anchor bigint, twin bigint, id bigint, score bigint").distinct()


def mined(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
          block: int = 512, slice_rows: int = 1 << 16, tally=None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows (id, label, v).

    ``is_anchor`` is a condition on id and label.  ``tally`` may be two accumulators:
    scores computed, and scores that a walk without bounds would compute.
    """
    rows = stored(rows.dropDuplicates(["id", "label", "v"]).withColumn("d", F.size("v")), "mine-rows")
    slices = max(1, -(-rows.count() // slice_rows))
    anchors = rows.where(is_anchor).withColumn("twin", F.xxhash64("label", "v"))  # tells rows of one id apart
    open_window = [F.array(F.lit(-(1 << 62))).alias("lows"), F.array(F.lit(1 << 62)).alias("highs")]
    own = stored(blocks(anchors, ["label", "d"], block).select("*", *open_window), "mine-anchors")
    near = stored(_walk(own, rows, ["label", "d"], positives, True, slices, tally), "mine-near")
    top = Window.partitionBy("anchor", "twin").orderBy(F.desc("score"), "id")
    pairs = (near.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= positives)
             .select("anchor", "twin", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    p = F.col("positive_score").cast("decimal(38,0)")
    pairs = stored(pairs.withColumn("low", F.ceil(p * low / 100).cast("bigint")).withColumn("high", F.floor(p * high / 100).cast("bigint")),
                   "mine-positives")
    windows = pairs.where("low <= high").groupBy("anchor", "twin").agg(F.collect_list(F.struct("low", "high")).alias("_w"))
    wanted = (anchors.join(windows.withColumnRenamed("anchor", "id"), ["id", "twin"])
              .select("id", "twin", "label", "v", "d", F.col("_w.low").alias("lows"), F.col("_w.high").alias("highs")))
    asked = stored(blocks(wanted, ["d"], block), "mine-asked")
    found = stored(_walk(asked, rows, ["d"], negatives, False, slices, tally), "mine-found")
    inside = F.col("score").between(F.col("low"), F.col("high"))
    order = Window.partitionBy("anchor", "twin", "positive_id", "positive_score").orderBy(F.desc("score"), "id")
    return (found.join(pairs, ["anchor", "twin"]).where(inside).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= negatives)
            .select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
