"""Document statistics shared by the quality rules and the quality classifier.

One Arrow UDF returns a struct of whole-text counts per row; a null or empty
text counts zero everywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from talkframe.llm import words as W

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_chars_all", "n_lines", "n_upper", "n_digits", "n_punct", "n_distinct_words", "n_top_word",
          "n_ascii_letters", "n_stops")
TYPE = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"


def _flag(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[list(chars)] = 1
    return t


_SYMBOL = _flag(b"#*$%&|<>")
_UPPER = _flag(bytes(range(65, 91)))
_DIGIT = _flag(bytes(range(48, 58)))
_LETTER = _flag(bytes(range(65, 91)) + bytes(range(97, 123)))
_PUNCT = _flag(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
_STOP = _flag(b".!?")
_LINE = _flag(b"\n")
_POINT = np.ones(256, np.int64)
_POINT[0x80:0xC0] = 0


def _per_row(flags: np.ndarray, data, offs) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(flags[data], out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _chunked(flags, data, offs):
    if len(data) <= 4 * W.SLICE_BYTES:
        return _per_row(flags, data, offs)
    step, out = W.SLICE_BYTES, np.zeros(len(offs) - 1, np.int64)
    for a in range(0, len(data), step):
        b = min(len(data), a + step)
        out += _per_row(flags, data[a:b], np.clip(offs, a, b) - a)
    return out


def _distinct_per_row(key, row, n):
    """Distinct keys of each row and the count of its commonest key."""
    both = W.mix(key ^ W.mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(both, kind="stable")
    s = both[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(s)))
    of = row[order[at]]
    top = np.zeros(n, np.int64)
    np.maximum.at(top, of, size)
    return np.bincount(of, minlength=n), top


def _repeated_words(h, doc, n):
    g, inside = W.grams(h, doc, 3)
    covered = np.zeros(len(h) + 2, bool)
    if len(g):
        both = W.mix(g ^ W.mix(doc[:len(g)].astype(np.uint64) + np.uint64(1)))
        s = np.sort(both[inside])
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):
            at = np.minimum(np.searchsorted(twice, both), len(twice) - 1)
            hit = inside & (twice[at] == both)
            for j in range(3):
                covered[j:j + len(hit)] |= hit
    return np.bincount(doc[covered[:len(h)]], minlength=n)


def _dup_lines(data, offs, doc, start, n):
    """Lines with a word that equal an earlier line of their row."""
    if not len(start):
        return np.zeros(n, np.int64)
    begin = np.unique(np.concatenate([offs[:-1], np.flatnonzero(data == 10) + 1]))
    begin = begin[begin < len(data)]
    with_word = np.unique(np.searchsorted(begin, start, side="right") - 1)
    keys = np.zeros(len(with_word), np.uint64)
    end = np.append(begin[1:], len(data))
    value = W._VALUES[False]
    # a block of lines at a time: the per-byte arrays stay bounded
    a = 0
    while a < len(with_word):
        b = int(np.searchsorted(begin[with_word], begin[with_word[a]] + W.SLICE_BYTES))
        b = max(a + 1, b)
        lo, hi = begin[with_word[a]], end[with_word[b - 1]]
        v = value[data[lo:hi]]
        v *= W._power(W._BASE, hi - lo)
        v[data[lo:hi] == 10] = 0
        at = begin[with_word[a:b]] - lo
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(v, out=total[1:])
        keys[a:b] = (total[end[with_word[a:b]] - lo] - total[at]) * W._power(W._BASE_INVERSE, hi - lo)[at]
        a = b
    row = np.searchsorted(offs, begin[with_word], side="right") - 1
    return np.bincount(row, minlength=n) - _distinct_per_row(W.mix(keys), row, n)[0]


def counts(col: pa.Array) -> pa.StructArray:
    parts = []
    for _, data, offs in W.slices(col):
        n = len(offs) - 1
        doc, start, end, h = W.scan(data, offs)
        distinct, top = _distinct_per_row(h, doc, n) if len(h) else (np.zeros(n, np.int64),) * 2
        parts.append((
            np.bincount(doc, minlength=n), _chunked(_POINT * ~W._SEP, data, offs), _chunked(_SYMBOL, data, offs),
            _dup_lines(data, offs, doc, start, n), _repeated_words(h, doc, n),
            _chunked(_POINT, data, offs), _chunked(_LINE, data, offs) + 1,
            _chunked(_UPPER, data, offs), _chunked(_DIGIT, data, offs), _chunked(_PUNCT, data, offs),
            distinct, top, _chunked(_LETTER, data, offs), _chunked(_STOP, data, offs)))
    cols = [np.concatenate(x).astype(np.int64) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(COUNTS)
    return W.struct_of(len(col), **dict(zip(COUNTS, cols)))


def _counts_of(text: pa.Array) -> pa.Array:
    return counts(text)


def with_counts(df, text: str = "text", out: str = "_counts"):
    """``df`` plus a struct column of counts; each text is scanned once however
    often the struct is used."""
    once = F.arrow_udf(_counts_of, TYPE).asNondeterministic()
    return df.withColumn(out, once(F.col(f"`{text}`")))


def ratios(of) -> dict[str, Column]:
    """Interpretable features of one document; ``of(name)`` gives a count."""
    def part(a, b):
        return F.coalesce(a / F.when(b > 0, b), F.lit(0.0))
    n, c = of("n_words"), of("word_chars")
    return {
        "n_words": n.cast("double"),
        "mean_word_chars": part(c, n),
        "symbols_per_word": part(of("n_symbols"), n),
        "dup_line_share": part(of("n_dup_lines"), of("n_lines")),
        "repeat_word_share": part(of("n_repeat_words"), n),
        "upper_share": part(of("n_upper"), of("n_ascii_letters")),
        "digit_share": part(of("n_digits"), c),
        "punct_per_word": part(of("n_punct"), n),
        "distinct_share": part(of("n_distinct_words"), n),
        "top_word_share": part(of("n_top_word"), n),
        "words_per_line": part(n, of("n_lines")),
        "stops_per_word": part(of("n_stops"), n),
    }
