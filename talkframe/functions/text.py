"""Text column expressions.

All helpers return ``Column`` built from Spark built-ins so they stay inside
whole-stage codegen.  Semantics follow Python's ``str`` methods where the
reference relies on them:

* ``strip()`` removes every Unicode whitespace, Spark ``trim`` only spaces,
  hence the regex form.
* ``split()`` without arguments drops empty tokens, hence the ``filter``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: ASCII punctuation as Python's ``string.punctuation``.
ASCII_PUNCTUATION = string.punctuation


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: drop leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def collapse_ws(c) -> Column:
    """Collapse whitespace runs to one space and strip the ends."""
    return py_strip(F.regexp_replace(_c(c), r"(?U)\s+", " "))


def words(c) -> Column:
    """Python ``str.split()``: whitespace tokens, empties dropped."""
    return F.filter(F.split(F.coalesce(_c(c), F.lit("")), r"(?U)\s+"), lambda x: x != "")


def word_count(c) -> Column:
    return F.size(words(c)).cast("bigint")


def approx_tokens(c) -> Column:
    """``len(text) // 4``."""
    return F.floor(F.length(F.coalesce(_c(c), F.lit(""))) / 4).cast("bigint")


def strict_words(c, stop_words=None) -> Column:
    """Strict preprocess: lower, drop ``[^\\w\\s]``, split, drop stop words."""
    cleaned = F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), r"(?U)[^\w\s]", "")
    toks = words(cleaned)
    if stop_words:
        # ``NOT IN`` a literal list becomes a hash-set lookup (InSet) in the optimizer
        stop = sorted(set(stop_words))
        toks = F.filter(toks, lambda x: ~x.isin(*stop))
    return toks


def clean_words(c, stop_words=None) -> Column:
    """Similarity clean: lower, delete ASCII punctuation, split, drop stop words."""
    cleaned = F.translate(F.lower(F.coalesce(_c(c), F.lit(""))), ASCII_PUNCTUATION, "")
    toks = words(cleaned)
    if stop_words:
        # ``NOT IN`` a literal list becomes a hash-set lookup (InSet) in the optimizer
        stop = sorted(set(stop_words))
        toks = F.filter(toks, lambda x: ~x.isin(*stop))
    return toks


def rouge_tokens(c) -> Column:
    """ROUGE default tokenizer without stemming: lower, ``[a-z0-9]+`` runs."""
    spaced = F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), "[^a-z0-9]+", " ")
    return F.filter(F.split(spaced, " "), lambda x: x != "")


def ngrams(arr, n: int) -> Column:
    """Array of n-grams (each joined by a space); empty when size < n.

    Built by zipping n shifted slices (no per-position sequence/slice lambdas)."""
    arr = _c(arr)
    k = F.size(arr) - (n - 1)
    shifted = [F.slice(arr, i + 1, F.greatest(k, F.lit(0))) for i in range(n)]
    grams = F.zip_with(shifted[0], shifted[1], lambda x, y: F.concat(x, F.lit(" "), y))
    for nxt in shifted[2:]:
        grams = F.zip_with(grams, nxt, lambda x, y: F.concat(x, F.lit(" "), y))
    return F.when(k > 0, grams).otherwise(F.array().cast("array<string>"))


def jaccard_pct(a, b) -> Column:
    """|set(a) ∩ set(b)| / |set(a) ∪ set(b)| × 100, 0 when both are empty.

    |union| = |set(a)| + |set(b)| − |intersection|: three hash passes, no union array."""
    a, b = _c(a), _c(b)
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - inter
    return F.when(union > 0, inter / union * 100.0).otherwise(F.lit(0.0))
