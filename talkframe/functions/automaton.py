"""Counts of many literals in one pass over a text.

A pass per pattern costs the text times the lexicon, and thousands of patterns
outgrow generated code.  Here all literals of a lexicon are one Aho-Corasick
automaton, built once per worker process and run over Arrow columns.  It reports
overlapping occurrences; each literal then counts those that do not overlap its own
last one, left to right, as counting by replacement does.

``substring`` entries match anywhere, as written.  ``word`` entries match where no
word character touches them (letters, marks, digits, connectors, joiners: the Unicode
classes of the regular expression they stand for), by default whatever their case.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_built: dict = {}


@lru_cache(maxsize=1 << 16)
def _is_word(ch: str) -> bool:
    kind = unicodedata.category(ch)
    return kind[0] in "LM" or kind in ("Nl", "Nd", "Pc") or ch in "‌‍" or 0x24B6 <= ord(ch) <= 0x24E9


@lru_cache(maxsize=1 << 16)
def _folded(ch: str) -> str:
    up = ch.upper()
    ch = up if len(up) == 1 else ch
    low = ch.lower()
    return low if len(low) == 1 else ch


def fold(text: str) -> str:
    """Case folded character by character, so that places stay."""
    return text.lower() if text.isascii() else "".join(map(_folded, text))


class Counter:
    """Counts per category of the literals ``(category number, kind, pattern)``."""

    def __init__(self, entries, categories: int, ignore_case: bool):
        import ahocorasick
        self.categories, self.ignore_case = categories, ignore_case
        grouped: dict = {}
        for category, kind, pattern in entries:
            if not pattern:
                raise ValueError("a literal must have a character")
            word = kind == "word"
            key = (word, fold(pattern) if word and ignore_case else pattern)
            grouped.setdefault(key, []).append(category)
        self.machines = []
        for word in (False, True):
            own = [(p, c) for (w, p), c in grouped.items() if w == word]
            if own:
                machine = ahocorasick.Automaton()
                for i, (p, c) in enumerate(own):
                    machine.add_word(p, (i, len(p), c))
                machine.make_automaton()
                self.machines.append((word, machine))

    def count(self, text: str) -> list[int]:
        out = [0] * self.categories
        for word, machine in self.machines:
            t = fold(text) if word and self.ignore_case else text
            free: dict[int, int] = {}  # literal -> where its last occurrence ended
            for end, (i, size, cats) in machine.iter(t):
                start = end + 1 - size
                if start < free.get(i, 0):
                    continue
                if word and ((start and _is_word(t[start - 1])) or (end + 1 < len(t) and _is_word(t[end + 1]))):
                    continue
                free[i] = end + 1
                for c in cats:
                    out[c] += 1
        return out


def literal_counts(text: Column, entries, categories: int, ignore_case: bool = True) -> Column:
    """``array<bigint>``: the count of each category's literals in ``text`` (null: null)."""
    entries = tuple(entries)
    key = (entries, categories, ignore_case)

    def run(col: pa.Array) -> pa.Array:
        if key not in _built:
            _built[key] = Counter(*key)
        counter = _built[key]
        return pa.array([None if t is None else counter.count(t) for t in col.to_pylist()], pa.list_(pa.int64()))
    run.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<bigint>")(text)
