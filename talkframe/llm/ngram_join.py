"""N-gram Jaccard join by sketch routing and signature leaves.

A document's set is its distinct ``n``-word shingles (64-bit hashes of words
with A-Z lower-cased).  Equal sets form a class, and classes are joined when
``100 * |intersection| >= percent * |union|``.

Routing: a class sits under one node for each pair of
neighbours among its ``sketch_size`` smallest shingles.  Pairs of common
shingles would route unrelated documents to one node: a document leaves the
nodes of more than ``HOT`` members if these are at most ``SPARE`` of its nodes
(fewer for a set smaller than a sketch).  So two sets are missed only if all the
nodes they share are hot and at most ``SPARE``.  For sets at the threshold the
probability of sharing no more than that, whichever nodes are hot, is below 2e-11
(each shingle of their union is shared with a probability of the threshold, and
a node is shared if both of its shingles are); sets no larger than a sketch never
miss.

The tree has one level below a routing node: leaves by size band and, if a band is
still large, by hash.  A leaf holds the OR of its members' token bitmaps, their
size range and the largest number of bitmap collisions; routing nodes and bands
hold only counts and their smallest and largest component root.

Dual traversal: the leaves of a routing node are joined with each other (an
equi-join on the node), and a pair of leaves goes on only if

    min(|OR_a AND OR_b| + min(collisions), largest sizes)

can still reach the required overlap and they do not lie in one component
already.  OR bitmaps of full leaves prune little, as their members are dealt by
hash; what is left is compared member by member by the same bound, each pair at
the first routing node that its documents share, and the pairs that pass are
verified exactly on their whole shingle sets.

Before the traversal every routing node links its members to one member drawn
at random (verified exactly as well), so that a large group of near copies
costs links in proportion to its size: its members then share one component
and their node pairs are pruned.

Cases: a null, empty or blank text has an empty set and is linked with
nothing; with fewer than ``n`` words the whole sequence is one shingle; rows
that share an id are documents of their own under one id; a null id is
never the smallest unless it is alone in its component (then null).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from talkframe.llm import words as W
from talkframe.llm.components import components
from talkframe.llm.tables import release, stored

MISS = 2e-11
SPARE = 3
HOT = 256
BITS = 2048
WORDS64 = BITS // 64
LEAF = 512
_NO_KEY = np.iinfo(np.int64).max
_U = np.uint64


def sketch_size(percent: int) -> int:
    """Shingles of a sketch so that a pair at the threshold shares more than ``SPARE`` nodes but for ``MISS``.

    It takes 70 % or more: below, small sets may meet nowhere.
    """
    if not 70 <= percent <= 100:
        raise ValueError("percent must lie between 70 and 100")
    p = percent / 100
    # probabilities by number of shared nodes (0 to SPARE), with the last shingle not shared and shared
    off, on = np.zeros(SPARE + 1), np.zeros(SPARE + 1)
    off[0], on[0] = 1 - p, p
    size = 1
    while size < SPARE + 2 or off.sum() + on.sum() > MISS:
        off, on = (1 - p) * (off + on), p * (off + np.append(0, on[:-1]))
        size += 1
    return size


def _sets(data, offs, n):
    """Sorted distinct shingle hashes of each row (None: empty)."""
    doc, _, _, h = W.scan(data, offs, lower=True)
    g, inside = W.grams(h, doc, n)
    base = np.searchsorted(doc, np.arange(len(offs)))
    for i in range(len(offs) - 1):
        a, b = base[i], base[i + 1]
        if a == b:
            yield None
        elif b - a < n:
            whole = _U(b - a)
            for x in h[a:b]:
                whole = W.mix(np.array([whole]) * _U(W._BASE) + x)[0]
            yield np.array([whole])
        else:
            yield np.unique(g[a:b - n + 1])


def _identity(s: np.ndarray) -> bytes:
    """128-bit fingerprint of a set."""
    return np.array([W.mix(s ^ _U(0x243F6A8885A308D3)).sum(), W.mix(s ^ _U(0x13198A2E03707344)).sum() + _U(len(s))]).tobytes()


def _signature(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, np.uint8)
    bits[(s >> _U(11)) & _U(BITS - 1)] = 1
    return np.packbits(bits).view(np.int64)


def _sketches(n, width):
    def rows(batches):
        for b in batches:
            for first, data, offs in W.slices(b.column(1)):
                size, ident, keys, sig = [], [], [], []
                for s in _sets(data, offs, n):
                    if s is None:
                        size.append(0)
                        ident.append(None)
                        keys.append(None)
                        sig.append(None)
                        continue
                    low = s[:width]
                    size.append(len(s))
                    ident.append(_identity(s))
                    keys.append(np.unique(W.mix(low[:-1] * _U(3) ^ W.mix(low[1:]))).view(np.int64))
                    sig.append(_signature(s))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(size)), pa.array(size, pa.int64()), pa.array(ident, pa.binary()),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.list_(pa.int64()))],
                    names=["doc", "n", "node", "keys", "sig"])
    return rows


def _overlap(a: str, b: str):
    """Bits that two signatures share."""
    return " + ".join(f"bit_count({a}[{i}] & {b}[{i}])" for i in range(WORDS64))


def _collisions(sig: str, n: str):
    return f"({n} - ({' + '.join(f'bit_count({sig}[{i}])' for i in range(WORDS64))}))"


class Join:
    def __init__(self, docs: DataFrame, n: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text"):
        self.n, self.percent = n, percent
        self.docs = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
        self.spark = docs.sparkSession

    def _enough(self, inter: str, sizes: str) -> str:
        """inter / (sizes - inter) >= percent / 100."""
        return f"(100 + {self.percent}) * ({inter}) >= {self.percent} * ({sizes})"

    def sketched(self) -> DataFrame:
        kind = "doc bigint, n bigint, node binary, keys array<bigint>, sig array<bigint>"
        return stored(self.docs.mapInArrow(_sketches(self.n, sketch_size(self.percent)), kind), "ngram-sketches")

    def classes(self, sketches: DataFrame) -> DataFrame:
        """One row for each distinct set; ``doc``: the smallest id that has it."""
        one = sketches.where("node is not null").groupBy("node").agg(F.min("doc").alias("doc"), F.first("n").alias("n"),
                                                                       F.first("keys").alias("keys"), F.first("sig").alias("sig"))
        return stored(one, "ngram-classes")

    def routed(self, classes: DataFrame) -> DataFrame:
        """(key, node, n) of the routing nodes with two members or more."""
        rows = classes.select(F.explode("keys").alias("key"), "node", "n", F.size("keys").alias("all"))
        # aggregates are written before they are joined back: Spark may then split a hot key
        many = stored(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "ngram-counts")
        rows = stored(rows.join(many, "key"), "ngram-keys")
        hot = rows.where(F.col("c") > HOT)
        need = sketch_size(self.percent) - 1 - SPARE
        bound = (hot.groupBy("node").agg((F.first("all") - F.count("*")).alias("light")).where(F.col("light") < need)
                 .select("node"))
        cols = ["key", "node", "n"]
        return stored(rows.where(F.col("c") <= HOT).select(cols).unionByName(hot.join(bound, "node").select(cols)), "ngram-routes")

    def star_pairs(self, routes: DataFrame, classes: DataFrame) -> DataFrame:
        hubs = stored(routes.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "node").alias("r"), "node", "n")).alias("h")), "ngram-hubs")
        pairs = (routes.join(hubs, "key").where("node <> h.node")
                 .where(f"100 * least(n, h.n) >= {self.percent} * greatest(n, h.n)")
                 .select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b")).distinct())
        sig = lambda s: classes.select(F.col("node").alias(s), F.col("sig").alias(f"{s}_sig"), F.col("n").alias(f"{s}_n"))
        bound = (f"least({_overlap('a_sig', 'b_sig')} + least({_collisions('a_sig', 'a_n')}, {_collisions('b_sig', 'b_n')}), a_n, b_n)")
        return pairs.join(sig("a"), "a").join(sig("b"), "b").where(self._enough(bound, "a_n + b_n")).select("a", "b")

    def tree_pairs(self, routes: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs of different components that the dual traversal cannot prune."""
        named = labels.select("node", "root")
        band = F.floor(-F.log("n") / F.log(F.lit(self.percent / 100.0 - 1e-9)))
        routes = stored(routes.join(named, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("band", band),
                        "ngram-rooted")
        sizes = routes.groupBy("key", "band").agg(F.ceil(F.count("*") / LEAF).alias("parts"), F.min("root").alias("r0"), F.max("root").alias("r1"))
        bands = Window.partitionBy("key")  # one row for each band of a node
        parts = stored(sizes.withColumn("open", F.min("r0").over(bands) != F.max("r1").over(bands)).where("open")
                       .select("key", "band", "parts"), "ngram-parts")
        keys = routes.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # a sketch's keys at most
        members = (routes.join(parts, ["key", "band"]).join(classes.select("node", "sig").join(keys, "node"), "node")
                   .withColumn("leaf", F.struct("band", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")))
                   .select("key", "leaf", "node", "n", "root", "sig", "keys"))
        members = stored(members, "ngram-members")
        nodes = members.groupBy("key", "leaf").agg(
            F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("root").alias("r0"), F.max("root").alias("r1"),
            F.expr(f"max({_collisions('sig', 'n')})").alias("coll"),
            F.array(*[F.bit_or(F.col("sig")[i]) for i in range(WORDS64)]).alias("sig"))
        nodes = stored(nodes, "ngram-nodes")
        side = lambda s: nodes.select("key", *[F.col(c).alias(f"{s}_{c}") for c in nodes.columns if c != "key"])
        bound = f"least({_overlap('a_sig', 'b_sig')} + least(a_coll, b_coll), a_hi, b_hi)"
        pairs = (side("a").join(side("b"), "key")
                 .where("a_leaf <= b_leaf and b_leaf.band - a_leaf.band <= 1")
                 .where(f"100 * a_hi >= {self.percent} * b_lo and 100 * b_hi >= {self.percent} * a_lo")
                 .where("not (a_r0 = a_r1 and b_r0 = b_r1 and a_r0 = b_r0)")
                 .where(self._enough(bound, "a_lo + b_lo"))
                 .select("key", F.col("a_leaf"), F.col("b_leaf"), F.xxhash64("key", "a_leaf", "b_leaf").alias("pair")))
        left = members.join(pairs.select("key", F.col("a_leaf").alias("leaf"), "b_leaf", "pair"), ["key", "leaf"])
        right = members.join(pairs.where("a_leaf <> b_leaf").select("key", F.col("b_leaf").alias("leaf"), "a_leaf", "pair"), ["key", "leaf"])
        cols = ["key", "pair", "node", "n", "root", "sig", "keys"]
        dealt = (left.select(F.lit(0).alias("side"), *cols).unionByName(right.select(F.lit(1).alias("side"), *cols))
                 .repartition("key", "pair").sortWithinPartitions("key", "pair", "side", "node"))
        return dealt.mapInArrow(_compared(self.percent), "a binary, b binary").distinct()

    def verified(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """The pairs that reach the threshold on their whole sets."""
        pairs = stored(pairs, "ngram-pairs")
        used = (pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
                .join(classes.select("node", "doc"), "node").select(F.col("doc").alias("_doc")).distinct())
        texts = self.docs.join(used, F.col("doc").eqNullSafe(F.col("_doc"))).select("doc", "text")
        n = self.n

        def sets(batches):
            for b in batches:
                for _, data, offs in W.slices(b.column(1)):
                    rows = [s for s in _sets(data, offs, n) if s is not None]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([_identity(s) for s in rows], pa.binary()),
                         pa.array([s.view(np.int64) for s in rows], pa.list_(pa.int64()))], names=["node", "shingles"])

        found = stored(texts.mapInArrow(sets, "node binary, shingles array<bigint>").dropDuplicates(["node"]), "ngram-sets")
        side = lambda s: found.select(F.col("node").alias(s), F.col("shingles").alias(f"{s}_s"))
        inter = "size(array_intersect(a_s, b_s))"
        return stored(pairs.join(side("a"), "a").join(side("b"), "b")
                      .where(self._enough(inter, "size(a_s) + size(b_s)")).select("a", "b"), "ngram-links")

    def result(self) -> DataFrame:
        """(doc, n, node, component): one row for each document."""
        sketches = self.sketched()
        classes = self.classes(sketches)
        routes = self.routed(classes)
        links = self.verified(self.star_pairs(routes, classes), classes)
        labels = components(links)
        labels = stored(labels, "ngram-labels")
        more = self.verified(self.tree_pairs(routes, classes, labels), classes)
        # what the traversal adds links whole components: only their roots are joined again
        for side in ("a", "b"):
            more = (more.join(labels.withColumnRenamed("node", side), side, "left")
                    .withColumn(side, F.coalesce("root", side)).drop("root"))
        merged = stored(components(more), "ngram-components").toDF("root", "top")
        release(self.spark)
        rooted = (classes.select("node", "doc").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
                  .join(merged, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top"))
        least = rooted.groupBy("root").agg(F.min("doc").alias("component"))
        named = rooted.join(least, "root").select("node", "component")
        return (sketches.select("doc", "n", "node").join(named, "node", "left")
                .select("doc", "n", "node", F.coalesce("component", "doc").alias("component")))


def _compared(percent):
    """Candidate pairs between the two sides of each node pair."""
    def first_shared(keys, i, j, key):
        """Whether ``key`` is the smallest that rows i and j have in common."""
        out = np.zeros(len(i), bool)
        for lo in range(0, len(i), 4096):
            a, b = keys[i[lo:lo + 4096]], keys[j[lo:lo + 4096]]
            common = (a[:, :, None] == b[:, None, :]).any(2) & (a != _NO_KEY)
            out[lo:lo + 4096] = np.where(common, a, _NO_KEY).min(1) == key
        return out

    def one(key, side, node, n, root, sig, keys):
        cut = int(np.searchsorted(side, 1))
        a, b = slice(0, cut), slice(cut, len(side)) if cut < len(side) else slice(0, cut)
        pop = np.bitwise_count(sig).sum(1).astype(np.int64)
        coll = n - pop
        same = cut == len(side)
        out = []
        ai, bi = np.arange(len(n))[a], np.arange(len(n))[b]
        for lo in range(0, len(ai), 64):
            i = ai[lo:lo + 64]
            inter = np.bitwise_count(sig[i][:, None, :] & sig[bi][None, :, :]).sum(2).astype(np.int64)
            bound = np.minimum(inter + np.minimum(coll[i][:, None], coll[bi][None, :]), np.minimum(n[i][:, None], n[bi][None, :]))
            ok = ((100 + percent) * bound >= percent * (n[i][:, None] + n[bi][None, :])) & (root[i][:, None] != root[bi][None, :])
            if same:
                ok &= i[:, None] < bi[None, :]
            x, y = np.nonzero(ok)
            mine = first_shared(keys, i[x], bi[y], key)
            out += zip(node[i[x[mine]]], node[bi[y[mine]]])
        return out

    def rows(batches):
        held, at = [], None

        def flush():
            if not held:
                return []
            side, node, n, root, sig = (np.concatenate(x) for x in list(zip(*held))[:5])
            lists = [k for h in held for k in h[5]]
            keys = np.full((len(lists), max(map(len, lists))), _NO_KEY)
            for i, k in enumerate(lists):
                keys[i, :len(k)] = k
            _, codes = np.unique(root, return_inverse=True)
            return one(at[0], side, node, n, codes, sig, keys)

        def batch(found):
            a = [min(x) for x in found]
            b = [max(x) for x in found]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            side, key, pair = (b.column(i).to_numpy() for i in range(3))
            node = np.array(b.column(3).to_pylist(), object)
            n = b.column(4).to_numpy()
            root = np.array(b.column(5).to_pylist(), object)
            sig = b.column(6).flatten().to_numpy().view(np.uint64).reshape(-1, WORDS64)
            own, ends = b.column(7).flatten().to_numpy(), np.cumsum(b.column(7).value_lengths().to_numpy())
            keys = np.split(own, ends[:-1])
            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(pair) != 0)) + 1
            out = []
            for lo, hi in zip([0, *cut], [*cut, len(key)]):
                if at != (key[lo], pair[lo]):
                    out += flush()
                    held, at = [], (key[lo], pair[lo])
                held.append((side[lo:hi], node[lo:hi], n[lo:hi], root[lo:hi], sig[lo:hi], keys[lo:hi]))
            if out:
                yield batch(out)
        out = flush()
        if out:
            yield batch(out)
    return rows


def representatives(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id.

    Rows that share an id (null included) go only if all of them would; rows
    that share id and text are one document.
    """
    found = groups(docs, n, percent, key, text)
    verdict = stored(found.groupBy("doc").agg(F.min((~F.col("doc").eqNullSafe(F.col("component"))).cast("int")).alias("_drop"),
                                              F.count("*").alias("_rows")).withColumnRenamed("doc", "_doc"), "ngram-verdict")
    release(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names))
    rows = docs.toDF(*names)
    joined = rows.join(verdict, F.col(of[key]).cast("bigint").eqNullSafe(F.col("_doc"))).where("_drop = 0")
    once = joined.where("_rows = 1").select(*names)
    more = joined.where("_rows > 1").select(*names).dropDuplicates([of[key], of[text]])
    return once.unionByName(more).toDF(*docs.columns)


def groups(docs: DataFrame, n: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n, node, component) of every row of ``docs``."""
    return Join(docs, n, percent, key, text).result()
