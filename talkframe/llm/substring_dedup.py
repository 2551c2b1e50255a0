"""Substring dedup: repeated token spans by De Bruijn compaction.

Every window of ``window`` words is a path of k-word edges.  Its smallest edge
(by hash, leftmost on ties) is its anchor; consecutive windows with one anchor
occurrence form a nonbranching path, a row (anchor, path hash, document,
start, windows).  Joins on the anchor keep what occurs twice:

* an anchor with one distinct path: all its copies agree word for word, so the
  first coordinates keep their words and every other copy is repeated whole;
* an anchor with several paths branches: the windows of those paths are read
  again from the source coordinates and compared one by one, by two independent
  hashes (128 bits): these are compared over the whole corpus, and 64 bits
  would take different ones for equal from some 10^10 windows on.  An anchor's
  paths are compared among themselves only (64 bits after the anchor's 64).

Equal windows have equal anchors at equal offsets, so no repeat is missed, and
unique text (nearly all edges) leaves at the first join as one narrow row for
about eight windows.

Skew: counts and first coordinates are pre-aggregated before each shuffle and
written; the joins back then read two plain shuffles, which Spark may split.  A
window that a text repeats (one word over and over) leaves the text once.
Documents are never gathered by content.

Cases: a null or empty text has no words; a text shorter than the window loses
nothing; a null id sorts before all others; rows that share an id are one
document, and a word position removed in one of them is removed in each;
repeated rows (same id, same text) are not copies of each other.  An empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.llm import words as W
from talkframe.llm.tables import release, stored

EDGE = 6
#: Base of the windows' second hash (the 64-bit FNV prime, a public constant).
SECOND = 0x100000001B3


def _windows(h, doc, window):
    g, inside = W.grams(h, doc, window)
    return g, inside


def _paths(data, offs, window):
    """Paths of a slice: row, first window (word index in the row), windows, anchor, path hash."""
    doc, _, _, h = W.scan(data, offs)
    g, inside = _windows(h, doc, window)
    if not inside.any():
        return None
    edge, _ = W.grams(h, doc, EDGE)
    view = np.lib.stride_tricks.sliding_window_view(edge, window - EDGE + 1)[:len(g)]
    at = np.arange(len(g)) + view.argmin(1)
    p = np.flatnonzero(inside)
    first = np.ones(len(p), bool)
    first[1:] = (at[p[1:]] != at[p[:-1]]) | (np.diff(p) != 1)
    begin = np.flatnonzero(first)
    count = np.diff(np.append(begin, len(p)))
    # position-dependent sum of the window hashes; count and offset take part
    rank = np.arange(len(p)) - np.repeat(begin, count)
    weighted = g[p] * (rank.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    path = W.mix(np.add.reduceat(weighted, begin) ^ W.mix(count.astype(np.uint64)))
    row = doc[p[begin]]
    base = np.searchsorted(doc, np.arange(len(offs)))
    return row, (p[begin] - base[row]), count, edge[at[p[begin]]], path


def _path_rows(window):
    def rows(batches):
        for b in batches:
            for i, data, offs in W.slices(b.column(1)):
                found = _paths(data, offs, window)
                if found:
                    row, start, count, anchor, path = found
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor.view(np.int64)), pa.array(path.view(np.int64)),
                         b.column(0).take(pa.array(row + i)), pa.array(start.astype(np.int32)),
                         pa.array(count.astype(np.int32))], names=["anchor", "path", "doc", "start", "n"])
    return rows


def _window_rows(window):
    """Both hashes and position of the windows at the given spans of each text,
    and whether the same window starts earlier in that text."""
    def rows(batches):
        for b in batches:
            at, spans = b.column(2).values, b.column(2).offsets.to_numpy()
            start, n = at.field(0).to_numpy(), at.field(1).to_numpy()
            for i, data, offs in W.slices(b.column(1)):
                doc, _, _, h = W.scan(data, offs)
                g, _ = _windows(h, doc, window)
                g2, _ = W.grams(h, doc, window, SECOND)
                base = np.searchsorted(doc, np.arange(len(offs)))
                lo, hi = spans[i], spans[i + len(offs) - 1]
                row = np.repeat(np.arange(len(offs) - 1), np.diff(spans[i:i + len(offs)]))
                count = n[lo:hi].astype(np.int64)
                if not len(count):
                    continue
                within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                pos = np.repeat(start[lo:hi], count) + within
                row = np.repeat(row, count)
                # rows that share an id carry each other's spans: those past a text's end are void
                ok = base[row] + pos + window <= np.append(base[1:], len(doc))[row]
                row, pos = row[ok], pos[ok]
                key, key2 = g[base[row] + pos], g2[base[row] + pos]
                order = np.lexsort((pos, key2, key, row))
                again = np.zeros(len(order), bool)
                a, z = order[1:], order[:-1]
                again[a] = (key[a] == key[z]) & (key2[a] == key2[z]) & (row[a] == row[z])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(key2.view(np.int64)), b.column(0).take(pa.array(row + i)),
                     pa.array(pos.astype(np.int32)), pa.array(again)], names=["window", "second", "doc", "start", "again"])
    return rows


def _first():
    return F.min(F.struct("doc", "start")).alias("first")


_LATER = "struct(doc, start) > first"


def _repeated_paths(docs: DataFrame, window: int) -> DataFrame:
    """Paths whose anchor occurs twice or more."""
    paths = docs.mapInArrow(_path_rows(window), "anchor bigint, path bigint, doc bigint, start int, n int")
    twice = stored(paths.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "substring-anchors")
    return stored(paths.join(twice, "anchor"), "substring-paths")


def _branching(paths: DataFrame) -> DataFrame:
    """Repeated paths, each with whether its anchor branches and the first copy's place."""
    kinds = stored(paths.groupBy("anchor").agg((F.min("path") != F.max("path")).alias("branches"), _first()), "substring-kinds")
    return stored(paths.join(kinds, "anchor").where("branches or struct(doc, start) > first")
                  .select("doc", "start", "n", "branches"), "substring-spans")


def _of_document(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def repeated_spans(docs: DataFrame, window: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, start, n): windows start .. start + n - 1 of the document also start earlier."""
    texts = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).where(F.length("text") >= 2 * window - 1)
    spans = _branching(_repeated_paths(texts, window))
    open_ = _of_document(spans.where("branches")).withColumnRenamed("doc", "_doc")
    looked = (texts.join(open_, F.col("doc").eqNullSafe(F.col("_doc"))).select("doc", "text", "spans")
              .mapInArrow(_window_rows(window), "window bigint, second bigint, doc bigint, start int, again boolean"))
    looked = stored(looked, "substring-windows")
    own = looked.where("not again")
    firsts = stored(own.groupBy("window", "second").agg(_first(), F.count("*").alias("c")).where("c > 1").drop("c"), "substring-firsts")
    later = own.join(firsts, ["window", "second"]).where(_LATER).unionByName(looked.where("again"), allowMissingColumns=True)
    later = later.select("doc", "start", F.lit(1).alias("n"))
    return stored(spans.where("not branches").select("doc", "start", "n").unionByName(later), "substring-repeats")


def dedup(docs: DataFrame, window: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kept, n_words, n_removed); ``kept``: the remaining words joined by one space."""
    repeats = _of_document(repeated_spans(docs, window, key, text)).withColumnRenamed("doc", "_doc")
    release(docs.sparkSession)

    def cut(col: pa.Array, spans: pa.Array) -> pa.Array:
        spans = spans.combine_chunks() if isinstance(spans, pa.ChunkedArray) else spans
        kept, total, removed = [], [], []
        data, offs = W.buffers(col)
        for i, at in enumerate(spans.to_pylist()):
            words = data[offs[i]:offs[i + 1]].tobytes().split()
            total.append(len(words))
            if at:
                gone = np.zeros(len(words) + 1, np.int64)
                start = np.array([s["start"] for s in at])
                end = start + np.array([s["n"] for s in at]) + window - 1
                np.add.at(gone, np.minimum(start, len(words)), 1)
                np.add.at(gone, np.minimum(end, len(words)), -1)
                stay = np.cumsum(gone)[:-1] == 0
                words = [w for w, s in zip(words, stay.tolist()) if s]
            removed.append(total[-1] - len(words))
            kept.append(b" ".join(words).decode())
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())],
                                          names=["kept", "n_words", "n_removed"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    joined = rows.join(repeats, F.col("_key").cast("bigint").eqNullSafe(F.col("_doc")), "left")
    out = joined.select("_key", F.arrow_udf(cut, "struct<kept:string,n_words:bigint,n_removed:bigint>")("_text", "spans").alias("_out"))
    return out.select(F.col("_key").alias(key), "_out.*")
