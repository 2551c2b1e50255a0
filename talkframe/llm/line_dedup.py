"""Line dedup: sharded cuckoo filters over exact reference-count tables.

A line's key is the line stripped of space and \\t..\\r at both ends with A-Z
lower-cased (128-bit hash).  Keys of at least ``min_chars`` code points in at
least ``min_docs`` documents lose their lines everywhere but in the largest
document id that holds them.

The index has three tables: ``postings`` (key, doc_id), ``counts`` (key,
n_docs, holder, layer) and ``filters`` (shard, bytes, newest), cuckoo filters of
the keys that are common enough to drop.  Lines probe their shard's filter first;
only those that it lets through meet the exact counts.  ``insert`` adds counts,
``delete`` recounts the keys that the documents held, and both change the filters
only by the keys that became common or ceased to be.  The counts keep the filter
layer that holds a common key, and a deletion takes it out of that layer alone, so
no key that stays is lost and deletions undo insertions exactly.  A shard takes
about ``shard_keys`` keys: where an insertion brings more than four times that, the
filters are built anew from the exact counts, dealt to more shards (or to fewer,
where deletions leave less than a quarter).  Every table of a state is written, so
the plan does not grow with the number of increments.

Skew: counts are pre-aggregated before the shuffle; rows probing a shard are
salted and the small filter is repeated for each salt.

Cases: a null or empty text is one empty line; a null doc_id is no document
(its lines neither count nor drop); rows that share a doc_id count as one
document; other columns pass through whatever their names; an empty table gives
an empty result and an index of empty tables, and deleting unknown ids or
inserting known documents changes nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.llm.cuckoo import Cuckoo, halves
from talkframe.llm.tables import stored
from talkframe.llm.words import buffers

_STRIP = b" \t\n\v\f\r"


def _key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of a line's key, or None if the key is too short."""
    k = line.strip(_STRIP)
    if len(k) < min_chars or (len(k) < 4 * min_chars and len(k.decode()) < min_chars):
        return None
    return hashlib.blake2b(k.lower(), digest_size=16).digest()


def _texts(col: pa.Array):
    data, offs = buffers(col)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        yield data[a:b].tobytes()


def postings(docs: DataFrame, min_chars: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct (key, doc_id) of the long lines."""
    def keys(col: pa.Array) -> pa.Array:
        found = ({k for line in t.split(b"\n") if (k := _key(line, min_chars))} for t in _texts(col))
        return pa.array([list(x) for x in found], pa.list_(pa.binary()))
    long = docs.where(F.col(key).isNotNull() & (F.length(text) >= min_chars))
    return (long.select(F.explode(F.arrow_udf(keys, "array<binary>")(text)).alias("key"), F.col(key).alias("doc_id"))
            .distinct())


@dataclass
class LineIndex:
    """Immutable: ``insert`` and ``delete`` return the next state."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    min_docs: int = 5
    min_chars: int = 40
    shards: int = 0
    salts: int = 16
    shard_keys: int = 1 << 15

    @classmethod
    def empty(cls, spark: SparkSession, **how) -> LineIndex:
        return cls(spark.createDataFrame([], "key binary, doc_id bigint"),
                   spark.createDataFrame([], "key binary, n_docs bigint, holder bigint, layer int"),
                   spark.createDataFrame([], "shard int, filter binary, newest int"), **how)

    def _shard(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")

    @staticmethod
    def _counted(postings: DataFrame) -> DataFrame:
        return postings.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("holder"))

    def load(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> LineIndex:
        """The first documents of an empty index: nothing to merge with."""
        new = stored(postings(docs, self.min_chars, key, text), "line-postings")
        counts = stored(self._counted(new).withColumn("layer", F.lit(None).cast("int")), "line-counts")
        return replace(self, postings=new)._rebuilt(counts)

    def insert(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> LineIndex:
        """Documents that come: their new postings are added to the counts."""
        new = stored(postings(docs, self.min_chars, key, text).join(self.postings, ["key", "doc_id"], "left_anti"), "line-new")
        both = self.counts.unionByName(self._counted(new), allowMissingColumns=True)
        counts = both.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"), F.max("layer").alias("layer"))
        return self._advanced(stored(self.postings.unionByName(new), "line-postings"), counts)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Documents that go: only the keys that they hold are counted again."""
        gone = ids.select(F.col(ids.columns[0]).alias("doc_id")).distinct()
        touched = stored(self.postings.join(gone, "doc_id", "left_semi").select("key").distinct(), "line-touched")
        after = stored(self.postings.join(gone, "doc_id", "left_anti").select("key", "doc_id"), "line-postings")
        again = self._counted(after.join(touched, "key", "left_semi"))
        held = self.counts.join(touched, "key", "left_semi").select("key", "layer")
        again = held.join(again, "key", "left").select("key", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "holder", "layer")
        return self._advanced(after, self.counts.join(touched, "key", "left_anti").unionByName(again))

    def _shards_for(self, counts: DataFrame) -> int:
        common = counts.where(F.col("n_docs") >= self.min_docs).count()
        return 1 << max(4, int(np.ceil(np.log2(max(1, common) / self.shard_keys))))

    def _rebuilt(self, counts: DataFrame, shards: int | None = None) -> LineIndex:
        """Filters of all common keys of ``counts``, whatever was there."""
        fresh = replace(self, shards=shards or self.shards or self._shards_for(counts), filters=self.filters.where("false"))
        common = F.col("n_docs") >= self.min_docs
        filters = fresh._refiltered(counts.where(common).select("key", F.lit(1).alias("step"), F.lit(0).alias("layer")))
        layer = F.when(common, 0).cast("int")  # the first insertion of a filter makes its first layer
        return replace(fresh, counts=counts.withColumn("layer", layer), filters=filters)

    def _advanced(self, after: DataFrame, counts: DataFrame) -> LineIndex:
        """The next state from its postings and its counts, these with the layers of before."""
        counts = stored(counts, "line-counts")
        alive, common, had = counts.where("n_docs > 0"), F.col("n_docs") >= self.min_docs, F.col("layer").isNotNull()
        shards = self._shards_for(alive)
        if shards > 4 * self.shards or 4 * shards < self.shards:
            return replace(self, postings=after)._rebuilt(alive, shards)
        changed = counts.where(common != had).select("key", F.when(had, -1).otherwise(1).alias("step"), F.coalesce("layer", F.lit(0)).alias("layer"))
        filters = self._refiltered(changed)
        newest = filters.select(F.col("shard").alias("_shard"), "newest")  # a row for each shard
        placed = alive.join(newest, self._shard() == F.col("_shard"), "left")
        layer = F.when(common, F.coalesce("layer", "newest"))
        return replace(self, postings=after, counts=placed.select("key", "n_docs", "holder", layer.alias("layer")), filters=filters)

    def _refiltered(self, changed: DataFrame) -> DataFrame:
        """Filters with keys added (step 1) and taken out of their layers (step -1), shard by shard.

        ``newest`` is the layer that took the shard's added keys.
        """
        rows = (changed.select(self._shard().alias("shard"), F.col("step").cast("int"), "layer", F.col("key").alias("value"))
                .unionByName(self.filters.select("shard", F.lit(-2).alias("step"), F.lit(0).alias("layer"), F.col("filter").alias("value"))))

        def update(batches):
            for (shard,), state in _by_group(batches, 1, 2):
                f, newest = Cuckoo(), 0
                for (step, layer), values in state:
                    if step == -2:
                        f = Cuckoo.from_bytes(values[0])
                    elif step == -1:
                        f.delete(halves(values), layer)
                    else:
                        newest = f.insert(halves(values))
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f.to_bytes()], pa.binary()), pa.array([newest], pa.int32())],
                                                 names=["shard", "filter", "newest"])

        dealt = rows.repartition("shard").sortWithinPartitions("shard", "step", "layer").select("shard", "step", "layer", "value")
        return stored(dealt.mapInArrow(update, "shard int, filter binary, newest int"), "line-filters")

    def candidates(self, lines: DataFrame) -> DataFrame:
        """(key, doc_id) rows that their shard's filter lets through."""
        probes = lines.select(self._shard().alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(self.salts)).cast("int").alias("salt"),
                              F.lit(1).alias("step"), F.col("key").alias("value"), "doc_id")
        blobs = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))).alias("salt"),
                                    F.lit(0).alias("step"), F.col("filter").alias("value"),
                                    F.lit(None).cast("bigint").alias("doc_id"))

        def probe(batches):
            at, f = None, None
            for b in batches:
                shard, salt, step = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                cut = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0)) + 1
                for lo, hi in zip([0, *cut], [*cut, len(shard)]):
                    if hi <= lo:
                        continue
                    if at != (shard[lo], salt[lo]):
                        at, f = (shard[lo], salt[lo]), None
                    if step[lo] == 0:
                        f = Cuckoo.from_bytes(b.column(3)[lo].as_py())
                        lo += 1
                    if f is None or hi <= lo:
                        continue
                    rows = b.slice(lo, hi - lo)
                    hit = pa.array(f.contains(halves(rows.column(3).to_pylist())))
                    yield pa.RecordBatch.from_arrays([rows.column(3).filter(hit), rows.column(4).filter(hit)], names=["key", "doc_id"])

        dealt = probes.unionByName(blobs).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "step")
        return dealt.mapInArrow(probe, "key binary, doc_id bigint")

    def drops(self) -> DataFrame:
        """Per document the keys whose lines go."""
        common = self.counts.where(F.col("n_docs") >= self.min_docs).select("key", "holder")
        return (self.candidates(self.postings).join(common, "key").where(F.col("doc_id") != F.col("holder"))
                .groupBy("doc_id").agg(F.collect_list("key").alias("keys")))

    def cleaned(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """``docs`` without the dropped lines, plus ``_n_lines`` and ``_n_dropped``."""
        names = [f"c{i}" for i in range(len(docs.columns))]
        inner = docs.toDF(*names)
        k, t = F.col(names[docs.columns.index(key)]), names[docs.columns.index(text)]
        chars = self.min_chars

        def strip(texts: pa.Array, keys: pa.Array) -> pa.Array:
            kept, dropped = [], []
            for raw, gone in zip(_texts(texts), keys.to_pylist()):
                if gone is None:
                    kept.append(None)
                    dropped.append(0)
                    continue
                gone, lines = set(gone), raw.split(b"\n")
                stay = [x for x in lines if _key(x, chars) not in gone]
                kept.append(b"\n".join(stay).decode())
                dropped.append(len(lines) - len(stay))
            return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(dropped, pa.int64())], names=["text", "n"])

        drops = self.drops().select(F.col("doc_id").alias("_doc"), "keys")
        joined = inner.join(drops, k == F.col("_doc"), "left")
        udf = F.arrow_udf(strip, "struct<text:string,n:bigint>")
        out = joined.withColumn("_out", udf(F.when(F.col("keys").isNotNull(), F.col(t)), F.col("keys")))
        line_breaks = F.length(t) - F.length(F.replace(F.col(t), F.lit("\n"), F.lit("")))
        return out.select(*[(F.when(F.col("_out.n") > 0, F.col("_out.text")).otherwise(F.col(c)) if c == t else F.col(c)).alias(n)
                            for c, n in zip(names, docs.columns)],
                          (F.coalesce(line_breaks, F.lit(0)) + 1).cast("bigint").alias("_n_lines"),
                          F.col("_out.n").alias("_n_dropped"))


def _by_group(batches, n_keys: int, n_steps: int):
    """Groups of a sorted stream of (keys..., steps..., value): key and [(steps, values)]."""
    at, state = None, []
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(n_keys + n_steps + 1)]
        for k, step, value in zip(zip(*cols[:n_keys]), zip(*cols[n_keys:-1]), cols[-1]):
            if k != at:
                if at is not None:
                    yield at, state
                at, state = k, []
            if not state or state[-1][0] != step:
                state.append((step, []))
            state[-1][1].append(value)
    if at is not None:
        yield at, state


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One pass over ``docs`` against an index of themselves."""
    return LineIndex.empty(docs.sparkSession, **how).load(docs, key, text).cleaned(docs, key, text)
