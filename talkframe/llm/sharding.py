"""Reproducible shuffling into shards by a Feistel permutation of row numbers.

Rows get global numbers 0 .. n - 1 in the order of id, size and CRC of the text.
A Feistel network of ``ROUNDS`` rounds permutes the numbers of as many bits as n
needs (an even number of them); a number that leaves 0 .. n - 1 walks on along its
cycle until it is back inside, so the whole is a permutation of the rows.  Place
p of the shuffle is slot ``p // shards`` of shard ``p % shards``: counts of shards
are at most one apart and slots have no gaps.  ``place`` and ``row_at`` compute
shard and slot of a row number, and the row of a shard and slot, without the data.

Law: ``rows``.  Copies of a text are rows like others and are not kept together (no
law of equal counts could); ``text_crc32`` tells them apart.

Numbering: the narrow columns are range-partitioned, sorted and written once; a
row's number is its place in its partition plus the rows of earlier partitions,
out of a table of one row per partition.  Rows that agree in all of the order (a
third of a table may be one repeated row, or have no id) are dealt on by their
place in the input, so they do not meet in one task; which of them gets which of
their numbers makes no difference to the result.

Cases: a null text has no bytes (size 1, CRC 0), a null id comes first and is a row
like others; repeated rows each get a slot of their own; an empty table gives an
empty result, and no slots; texts of any length stay whole and, but in ``written``,
where they are; extra columns are kept by ``keep`` within a struct, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkframe.llm.tables import stored

ROUNDS = 6
SHARDS = 16
SEED = 13
_LOW = 0xFFFFFFFF
#: Multipliers of the public 32-bit finaliser "lowbias32" (fixed values).
_FIRST, _SECOND = 0x7FEB352D, 0x846CA68B


def scrambled(x: np.ndarray) -> np.ndarray:
    """32-bit finaliser of unsigned 64-bit integers below 2^32."""
    x = x ^ (x >> np.uint64(16))
    x = (x * np.uint64(_FIRST)) & np.uint64(_LOW)
    x = x ^ (x >> np.uint64(15))
    x = (x * np.uint64(_SECOND)) & np.uint64(_LOW)
    return x ^ (x >> np.uint64(16))


def round_keys(seed: int) -> list[int]:
    each = [(seed + r * 0x9E3779B9) & _LOW for r in range(1, ROUNDS + 1)]
    return scrambled(np.array(each, np.uint64)).tolist()


def half_bits(n: int) -> int:
    """Bits of each half of a number below ``n``."""
    return max(1, ((max(n, 1) - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, keys, bits: int, back: bool) -> np.ndarray:
    b, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    left, right = x >> b, x & mask
    for k in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (scrambled(left ^ np.uint64(k)) & mask), left
        else:
            left, right = right, left ^ (scrambled(right ^ np.uint64(k)) & mask)
    return (left << b) | right


def permuted(x: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """Places of row numbers in the shuffle of 0 .. n - 1, or with ``back`` row numbers of places."""
    keys, bits = round_keys(seed), half_bits(n)
    x = _network(np.asarray(x, np.uint64), keys, bits, back)
    while (out := x >= n).any():
        x[out] = _network(x[out], keys, bits, back)
    return x.astype(np.int64)


def place(row: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of a row number."""
    if not 0 <= row < n:
        raise ValueError(f"rows are 0 to {n - 1}")
    p = int(permuted(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number that a slot holds."""
    p = slot * shards + shard
    if not (0 <= shard < shards and 0 <= p < n):
        raise ValueError("no such slot")
    return int(permuted(np.array([p]), n, seed, back=True)[0])


def numbered(docs: DataFrame, key: str = "doc_id", text: str = "text", keep=()) -> DataFrame:
    """(doc, size, crc, kept, row, total): global row numbers; ``kept`` is a struct of the columns ``keep``."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("int")
    rows = docs.select(F.col(key).alias("doc"), (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("crc"),
                       kept.alias("kept"), F.monotonically_increasing_id().alias("_at"))
    order = ["doc", "size", "crc", "_at"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # what follows reads partitions and places twice: written, so that both see the same
    dealt = stored(dealt.select("doc", "size", "crc", "kept", F.spark_partition_id().alias("_part"),
                                F.monotonically_increasing_id().alias("_place")), "shard-rows")
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                         F.sum("_n").over(Window.partitionBy()).alias("total"))
    out = dealt.join(F.broadcast(parts), "_part")
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return out.select("doc", "size", "crc", "kept", (F.col("_before") + inside).cast("bigint").alias("row"), F.col("total").cast("bigint"))


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id", text: str = "text", keep=()) -> DataFrame:
    """(doc, size, crc, kept, row, shard, slot) of every row."""
    if shards < 1:
        raise ValueError("there must be a shard")

    def run(row: pa.Array, total: pa.Array) -> pa.Array:
        if not len(row):
            return pa.array([], pa.int64())
        return pa.array(permuted(row.to_numpy(), total[0].as_py(), seed))
    run.__annotations__ = {"row": pa.Array, "total": pa.Array, "return": pa.Array}
    p = F.arrow_udf(run, "bigint")(F.col("row"), F.col("total"))
    out = numbered(docs, key, text, keep).withColumn("_p", p)
    return out.select("doc", "size", "crc", "kept", "row", (F.col("_p") % shards).cast("int").alias("shard"),
                      F.expr(f"_p div {shards}").alias("slot"))


def written(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id", text: str = "text",
            slots: int = 1 << 16) -> None:
    """Write whole rows as Parquet folders ``shard=s/part=p``: ``slots`` consecutive slots of a shard each, in order.

    A shard may be far larger than a task, so it is dealt by runs of slots.
    """
    out = sharded(docs, shards, seed, key, text, keep=docs.columns).withColumn("part", F.expr(f"slot div {slots}"))
    (out.select("shard", "part", "slot", F.col("kept").alias("row")).repartition("shard", "part")
     .sortWithinPartitions("shard", "part", "slot").write.partitionBy("shard", "part").parquet(path))
