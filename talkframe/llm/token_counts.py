"""Token counts by offset-mapped attribution.

A document is encoded once as a whole; tokens of a byte-level vocabulary cover
consecutive bytes, so their lengths give their spans.  Token spans and section
spans are both sorted and meet in one interval join (binary search, no pairs).
A token inside a section belongs to it; a token that crosses a boundary goes by
``rule``:

* ``"start"``: to the section of its first byte;
* ``"end"``: to the section of its last byte;
* ``"most"``: to the section that holds most of its bytes, the earlier on ties;
* ``"split"``: to every section it touches, by its share of the bytes (doubles).

Sections are the lines of a text (each with its line break), or any spans that
``sections`` returns.  The counts of a document's sections add up to its tokens.

Cases: a null or empty text is one empty section with no tokens; an empty
section (possible in callers' spans only) gets none; strings of special tokens
count as ordinary text; repeated rows count alike; a text of one unbroken run
of bytes is encoded whole; white space of any length is one piece of the
vocabulary's pattern and, from ``RUN`` characters, is handed over as such, because
the library's pattern engine overflows at about a million; an empty table has
no rows.  Of the input only ``key`` is returned, so other columns cannot clash; the
key may not be called like a column of the result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.llm.words import buffers

RULES = ("start", "end", "most", "split")
RUN = 4096
#: What ``\s`` is in the vocabulary's pattern: the White_Space property of Unicode.
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN)
_coders: dict[str, tuple] = {}


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def coder(path: str):
    """(encoding, byte length of each token) of this worker process."""
    if path not in _coders:
        import base64

        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            size[i] = len(token)
        _coders[path] = (tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), size)
    return _coders[path]


def encode(encoding, text: str) -> list[int]:
    """The library's tokens of a whole text, whatever the length of its white space.

    A run of white space is one piece, without its last character when something
    follows (``\\s+(?!\\S)``), and nothing before or after it reaches into it, so
    the text may be cut at both ends of the piece.
    """
    out, at = [], 0
    for run in _SPACES.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += encoding.encode_ordinary(text[at:run.start()])
        out += encoding._encode_single_piece(text[run.start():end])
        at = end
    return out + encoding.encode_ordinary(text[at:])


def lines(text: bytes) -> np.ndarray:
    """Byte offsets of the lines: first 0, last the length."""
    breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.concatenate([[0], breaks, [len(text)]])


def attributed(ends: np.ndarray, edges: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section: ``ends`` of the tokens, ``edges`` of the sections, both in bytes."""
    n = len(edges) - 1
    if not len(ends):
        return np.zeros(n)
    starts = np.concatenate([[0], ends[:-1]])
    first = np.minimum(np.searchsorted(edges, starts, side="right") - 1, n - 1)
    last = np.minimum(np.searchsorted(edges, ends - 1, side="right") - 1, n - 1)
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float)
    if rule == "end":
        return np.bincount(last, minlength=n).astype(float)
    whole = first == last
    out = np.bincount(first[whole], minlength=n).astype(float)
    for a, b, s, e in zip(starts[~whole], ends[~whole], first[~whole], last[~whole]):
        part = np.minimum(b, edges[s + 1:e + 2]) - np.maximum(a, edges[s:e + 1])
        if rule == "most":
            out[s + int(part.argmax())] += 1
        else:
            out[s:e + 1] += part / (b - a)
    return out


def counted(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", rule: str = "most",
            sections=lines) -> DataFrame:
    """(key, section, section_bytes, n_tokens, doc_tokens), one row for each section of each row."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if key in ("section", "section_bytes", "n_tokens", "doc_tokens"):
        raise ValueError(f"a key called {key} would clash with the result; rename it")
    path = path or vocabulary()

    def run(col: pa.Array) -> pa.Array:
        encoding, size = coder(path)
        data, offs = buffers(col)
        each, numbers, bytes_, tokens, totals = [0], [], [], [], []
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
            raw = data[a:b].tobytes()
            ends = np.cumsum(size[np.array(encode(encoding, raw.decode()), np.int64)])
            edges = sections(raw)
            n = len(edges) - 1
            numbers.append(np.arange(n))
            bytes_.append(np.diff(edges))
            tokens.append(attributed(ends, edges, rule))
            totals.append(np.full(n, len(ends)))
            each.append(each[-1] + n)
        flat = [np.concatenate(x) if x else np.zeros(0) for x in (numbers, bytes_, tokens, totals)]
        rows = pa.StructArray.from_arrays([pa.array(flat[0].astype(np.int32)), pa.array(flat[1].astype(np.int64)),
                                           pa.array(flat[2].astype(float)), pa.array(flat[3].astype(np.int64))],
                                          names=["section", "section_bytes", "n_tokens", "doc_tokens"])
        return pa.ListArray.from_arrays(pa.array(each, pa.int32()), rows)
    run.__annotations__ = {"col": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(run, "array<struct<section:int,section_bytes:bigint,n_tokens:double,doc_tokens:bigint>>")
    out = docs.select(F.col(key).alias(key), F.explode(udf(F.col(text))).alias("_s")).select(key, "_s.*")
    return out if rule == "split" else out.withColumn("n_tokens", F.col("n_tokens").cast("bigint"))
