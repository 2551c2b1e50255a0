"""Periodic runs of words: suffix trees, constant-time LCE, Lyndon-root candidates.

A run is a stretch of consecutive words with smallest period q that holds at least
two periods (and ``min_length`` words) and that no neighbouring word extends.

* Suffix trees of a stretch and of its reversal are built by Ukkonen's algorithm.
  An Euler tour of each, of which the visits between two children are kept, with a
  sparse table of its string depths answers any longest common extension (LCE) by
  two look-ups: the depth of the lowest common ancestor of two leaves.
* Candidates are the longest Lyndon words that start at each word, under the order
  of the alphabet and under its reverse (next smaller and next greater suffix in
  leaf order).  Every run has a period that is such a word (the runs theorem), so
  two candidates a word are enough.
* A candidate is extended to the right by the LCE of its two ends in the tree and to
  the left by that in the tree of the reversal.  A Lyndon word has no smaller
  period, so a run that is found has its smallest one.

Only words that may lie in a run get trees.  A run of ``min_length`` words or more
matches itself, one period on, over at least half of its length; so each of its
words lies in a ``gram`` (half of ``min_length`` words) that the stretch holds
twice.  Documents are cut at the words of which that is not true, again and again
until nothing more can be cut.  A run is never cut by this, and a run of a piece is
one of the document.  64-bit hashes find the grams; two that collide only leave a
piece longer.  Trees compare the words themselves.

Memory: a document is worked on by one task; the trees take about 0.5 KB for each
word of its longest piece.

Cases: a null or empty text, or one without words, has no words, no runs and an
empty collapsed text; rows that share an id, or have none, each get their own
result; of the input only the id and the text are returned, under fixed names, so
other columns cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.llm.words import grams, mix, scan, slices

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_FOUND = pa.struct([("n_words", pa.int64()), ("runs", _RUNS), ("collapsed", pa.string())])
_FOUND_TYPE = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def _ukkonen(s: list[int], letters: int):
    """Suffix tree of ``s``, whose last letter occurs once.

    Node 0 is the root; ``child[node * letters + first letter]`` is a node, the edge
    to it is ``s[start:stop]``, and ``leaves[i]`` is the leaf of suffix ``i``.
    """
    n = len(s)
    start, stop, link, child, leaves = [0], [0], [0], {}, []
    node = edge = length = left = 0
    for i, c in enumerate(s):
        left += 1
        fresh = 0  # an inner node of this step that has no suffix link yet
        while left:
            if not length:
                edge = i
            key = node * letters + s[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                leaves.append(len(start))
                start.append(i)
                stop.append(n)
                link.append(0)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                a = start[below]
                size = min(stop[below], i + 1) - a
                if length >= size:  # walk down
                    edge += size
                    length -= size
                    node = below
                    continue
                if s[a + length] == c:
                    length += 1
                    if fresh:
                        link[fresh] = node
                    break
                split = len(start)
                start += (a, i)
                stop += (a + length, n)
                link += (0, 0)
                child[key] = split
                child[split * letters + c] = split + 1
                child[split * letters + s[a + length]] = below
                start[below] = a + length
                leaves.append(split + 1)
                if fresh:
                    link[fresh] = split
                fresh = split
            left -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - left + 1
    return start, stop, child, leaves


class Extensions:
    """Longest common extensions of the suffixes of a list of letters (1, 2, ...)."""

    def __init__(self, word: list[int], letters: int):
        s = [*word, 0]
        start, stop, child, leaves = _ukkonen(s, letters)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        below = np.fromiter(child.values(), np.int64, len(child))
        order = np.argsort(keys)  # by parent, then first letter
        first = np.searchsorted(keys[order], np.arange(len(start) + 1, dtype=np.int64) * letters).tolist()
        below = below[order].tolist()
        del child, keys, order
        depth, todo = [0] * len(start), [0]
        tour, met = [], []
        while todo:
            v = todo.pop()
            if v < 0:  # not the first child: the tour has come by its parent again
                v = -v
                tour.append(depth[v] - stop[v] + start[v])
            a, b = first[v], first[v + 1]
            if a == b:
                met.append(v)
                continue
            d = depth[v]
            for w in below[b - 1:a:-1]:
                depth[w] = d + stop[w] - start[w]
                todo.append(-w)
            w = below[a]
            depth[w] = d + stop[w] - start[w]
            todo.append(w)
        place = np.empty(len(start), np.int64)
        place[met] = np.arange(len(met))
        #: Place of each suffix among all in order of the alphabet (the empty one, at the end, first).
        self.rank = place[leaves]
        rows = [np.array(tour, np.int32)]
        while 2 << (len(rows) - 1) <= len(tour):
            last, step = rows[-1], 1 << (len(rows) - 1)
            rows.append(np.minimum(last[:-step], last[step:]))
        self.rows = rows

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Letters that the suffixes at ``i`` and ``j`` (different ones) share."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(hi - lo)[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.rows[k][lo[own]], self.rows[k][hi[own] - (1 << int(k))])
        return out


def _next_less(rank: list[int]) -> list[int]:
    """For each place the next one with a smaller rank (the length where there is none)."""
    out, waiting = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while waiting and rank[waiting[-1]] > r:
            out[waiting.pop()] = i
        waiting.append(i)
    return out


def runs(word: list[int], min_length: int = 12) -> np.ndarray:
    """(start, length, period) of all runs of a list of letters (1, 2, ...), in order."""
    m, letters = len(word), max(word, default=0) + 1
    if m < max(2, min_length):
        return np.zeros((0, 3), np.int64)
    ahead, back = Extensions(word, letters), Extensions(word[::-1], letters)
    rank = ahead.rank
    i = np.arange(m)
    ends = [np.array(_next_less(rank.tolist())[:m]), np.array(_next_less((-rank).tolist())[:m])]
    i, j = np.concatenate([i, i]), np.concatenate(ends)
    i, j = i[j < m], j[j < m]  # what only the end of the text closes extends to nothing
    period = j - i
    left = back.common(m - i, m - j)
    length = left + period + ahead.common(i, j)
    ok = length >= np.maximum(min_length, 2 * period)
    return np.unique(np.column_stack([i - left, length, period])[ok], axis=0)


def pieces(h: np.ndarray, doc: np.ndarray, gram: int, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words (hashes, sorted rows) outside of which there is no run."""
    g, inside = grams(h, doc, gram)
    at = np.flatnonzero(inside)
    g, group = g[at], doc[at].astype(np.uint64)
    while True:
        key = g ^ mix(group + np.uint64(1))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        gone = not twice.all()
        at, g = at[twice], g[twice]
        cut = np.ones(len(at), bool)
        cut[1:] = (np.diff(at) > gram) | (doc[at[1:]] != doc[at[:-1]])
        group = np.cumsum(cut).astype(np.uint64)
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(at))[:len(first)] - 1
        a, b = at[first], at[last] + gram
        long = b - a >= min_length
        if not long.all():
            stay = long[group.astype(np.int64) - 1]
            at, g, group = at[stay], g[stay], group[stay]
        elif not gone:
            return a, b


def _found(data: np.ndarray, offs: np.ndarray, min_length: int):
    """(words, runs, collapsed text) of each text of a slice."""
    doc, _, _, h = scan(data, offs)
    a, b = pieces(h, doc, max(1, min_length // 2), min_length)
    head = np.searchsorted(doc, np.arange(len(offs)))  # the first word of each text
    owner = doc[a]
    for t in range(len(offs) - 1):
        words = data[offs[t]:offs[t + 1]].tobytes().split()
        own = np.flatnonzero(owner == t) if len(owner) else []
        got, kept = [], words
        if len(own):
            for lo, hi in zip(a[own] - head[t], b[own] - head[t]):
                number: dict[bytes, int] = {}
                part = [number.setdefault(w, len(number) + 1) for w in words[lo:hi]]
                r = runs(part, min_length)
                r[:, 0] += lo
                got.append(r)
            got = np.concatenate(got)
            got = got[np.lexsort((got[:, 2], got[:, 0]))]
            step = np.zeros(len(words) + 1, np.int64)
            np.add.at(step, got[:, 0] + got[:, 2], 1)
            np.add.at(step, got[:, 0] + got[:, 1], -1)
            kept = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
        yield len(words), got, b" ".join(kept)


def detected(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 12) -> DataFrame:
    """(doc, n_words, runs, collapsed): all runs by start and period, and the words outside their repeats.

    A word is left out of ``collapsed`` if a run holds it after the run's first period.
    """
    if min_length < 2:
        raise ValueError("a run has two words at least")

    def run(col: pa.Array) -> pa.Array:
        n_words, each, rows, kept = [], [0], [], []
        for _, data, offs in slices(col):
            for n, r, t in _found(data, offs, min_length):
                n_words.append(n)
                each.append(each[-1] + len(r))
                if len(r):
                    rows.append(r)
                kept.append(t.decode())
        flat = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
        found = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], names=["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(each, pa.int32()), found)
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), lists.cast(_RUNS), pa.array(kept, pa.string())], fields=list(_FOUND))
    run.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return docs.select(F.col(key).alias("doc"), F.arrow_udf(run, _FOUND_TYPE)(F.col(text)).alias("_f")).select("doc", "_f.*")


def longest(found: str = "runs"):
    """The run of the greatest length of a ``runs`` column; ties: smallest start, then period; null without runs."""
    by = F.transform(F.col(found), lambda r: F.struct(r.length.alias("length"), (-r.start).alias("back"), (-r.period).alias("less")))
    top = F.array_max(by)
    return F.when(top.isNotNull(), F.struct((-top.back).alias("start"), top.length.alias("length"), (-top.less).alias("period")))
