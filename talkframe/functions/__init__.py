"""Column-expression helpers (all JVM-side built-ins) plus the one Arrow UDF (MTLD)."""

from talkframe.functions.text import (  # noqa: F401
    py_strip, words, word_count, approx_tokens, strict_words, clean_words,
    rouge_tokens, collapse_ws, ngrams, jaccard_pct,
)
