"""MTLD (measure of textual lexical diversity) as an Arrow UDF.

MTLD is a sequential fold with resets (a factor closes when the running
type/token ratio drops to the threshold), which built-in SQL cannot express
without a per-element ``aggregate`` over a growing set — exact but several
times slower.  The UDF receives whole Arrow batches of word arrays; the loop
below is the small per-row helper.

Definition (both directions averaged):
* walk the words, keep the set of types since the last reset; after each word
  ttr = |types| / count; when ttr <= threshold a factor closes and the state resets;
* a trailing partial segment adds (1 - ttr) / (1 - threshold);
* if no factor at all: 1 when the whole text has ttr = 1, else the partial formula
  on the whole text;
* MTLD = n_words / factors; empty input → null.

``prefix_mtld`` scores every prefix of a text that ends with a message.  Forwards one
fold carries its factors on.  Backwards each prefix starts at its own last word, but a
factor that starts at a word ends at the same word for all prefixes: a table of jumps
from the words where factors start to those where they end is filled as prefixes need
it, and prefixes that meet at a word share the rest of their way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

THRESHOLD = 0.72


def mtld_one_way(words, threshold: float = THRESHOLD) -> float:
    terms: set = set()
    count = 0
    factors = 0.0
    ttr = 1.0
    for w in words:
        count += 1
        terms.add(w)
        ttr = len(terms) / count
        if ttr <= threshold:
            count = 0
            terms = set()
            factors += 1
    if count > 0:
        factors += (1 - ttr) / (1 - threshold)
    if factors == 0:
        whole = len(set(words)) / len(words)
        factors = 1.0 if whole == 1 else (1 - whole) / (1 - threshold)
    return len(words) / factors


def mtld(words, threshold: float = THRESHOLD):
    """Bidirectional MTLD of a word sequence; None when empty."""
    if words is None or len(words) == 0:
        return None
    words = list(words)
    return (mtld_one_way(words, threshold) + mtld_one_way(words[::-1], threshold)) / 2.0


#: Words that a factor is looked for one by one; from there on in leaps.
_STEPS = 256


def _factor_back(ids, later, i: int, threshold: float):
    """(last word of the factor that starts at word ``i`` and goes backwards, -1 if it does not end; its ttr).

    ``later[x]`` is the next place of the word at ``x``.  D types can only come down
    to the threshold at D / threshold words, so what lies before that is leapt over.
    """
    seen, count = set(), 0
    while count <= i and count < _STEPS:
        seen.add(ids[i - count])
        count += 1
        if len(seen) / count <= threshold:
            return i - count + 1, len(seen) / count
    types = len(seen)
    while count <= i:
        least = max(count + 1, int(types / threshold) - 1)
        while types / least > threshold:
            least += 1
        least = min(least, i + 1)
        types += int(np.count_nonzero(later[i + 1 - least:i + 1 - count] > i))
        count = least
        if types / count <= threshold:
            return i - count + 1, types / count
    return -1, types / count


def prefix_mtld(words, ends, threshold: float = THRESHOLD) -> list:
    """MTLD of ``words[:e]`` for each of the growing ``ends``; None where it is empty."""
    number: dict = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    later = np.full(len(ids), len(ids), np.int64)
    last: dict = {}
    for x in range(len(ids) - 1, -1, -1):
        later[x] = last.get(ids[x], len(ids))
        last[ids[x]] = x
    part = lambda ttr: (1 - ttr) / (1 - threshold)
    jumps: dict[int, tuple[int, float]] = {}   # word -> whole factors and the rest of the way back from it
    out, at, factors, seen, count = [], 0, 0, set(), 0
    for e in ends:
        while at < e:
            count += 1
            seen.add(ids[at])
            at += 1
            if len(seen) / count <= threshold:
                factors, seen, count = factors + 1, set(), 0
        if not e:
            out.append(None)
            continue
        ahead = factors + (part(len(seen) / count) if count else 0)
        way, i = [], e - 1
        while i >= 0 and i not in jumps:
            end, ttr = _factor_back(ids, later, i, threshold)
            if end < 0:
                jumps[i] = 0, part(ttr)
                break
            way.append(i)
            i = end - 1
        whole, rest = jumps[i] if i >= 0 else (0, 0.0)
        for i in reversed(way):
            whole += 1
            jumps[i] = whole, rest
        back = whole + rest
        # no factor at all means that no word came twice
        out.append((e / (ahead or 1.0) + e / (back or 1.0)) / 2.0)
    return out


#: Words that are Python objects at once (a longer row is taken alone).
_SLICE_WORDS = 1 << 15


def _numbered(col: pa.Array):
    """Per row of a column of word arrays: its words as numbers, equal where the words are.

    Rows are taken in slices of a bounded number of words, so memory follows the
    longest row, not the batch."""
    offs, i = col.offsets.to_numpy(), 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + _SLICE_WORDS, side="right")) - 1)
        words = col.values.slice(offs[i], offs[j] - offs[i]).dictionary_encode("encode").indices.to_numpy()
        for a, b in zip(offs[i:j] - offs[i], offs[i + 1:j + 1] - offs[i]):
            yield words[a:b].tolist()
        i = j


def make_prefix_mtld_udf(threshold: float = THRESHOLD):
    """Per message of a session (an array of word arrays): words so far and their MTLD."""
    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("token_count", T.LongType()), T.StructField("mtld", T.DoubleType())])))
    def prefix_mtld_udf(parts: pa.Array) -> pa.Array:
        first, ends = parts.offsets.to_numpy(), parts.values.offsets.to_numpy()
        # a session's words are those of its messages, one after the other
        sessions = pa.ListArray.from_arrays(pa.array(ends[first], pa.int32()), parts.values.values)
        counts, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
        for words, a, b in zip(_numbered(sessions), first[:-1], first[1:]):
            so_far = ends[a + 1:b + 1].astype(np.int64) - ends[a]
            counts.append(so_far)
            scores.append(np.array(prefix_mtld(words, so_far.tolist(), threshold), np.float64))  # None is NaN
        rows = pa.StructArray.from_arrays([pa.array(np.concatenate(counts)), pa.array(np.concatenate(scores), from_pandas=True)],
                                          names=["token_count", "mtld"])
        return pa.ListArray.from_arrays(pa.array(first - first[0], pa.int32()), rows)
    return prefix_mtld_udf


def make_mtld_udf(threshold: float = THRESHOLD):
    @F.arrow_udf(T.DoubleType())
    def mtld_udf(words: pa.Array) -> pa.Array:
        return pa.array([mtld(w, threshold) for w in _numbered(words)], pa.float64())
    return mtld_udf


mtld_udf = make_mtld_udf()
prefix_mtld_udf = make_prefix_mtld_udf()
