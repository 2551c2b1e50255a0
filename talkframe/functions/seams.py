"""Counting patterns over joined messages without joining them (A3).

Messages of a session are joined by one space.  A match lies in one message unless
it takes that space, or looks at it.  So a pattern that cannot meet a space is counted message
by message: ``\\b`` and ``(?!\\w)`` see no difference between a space and an end.

A pattern of bounded length with spaces in it (a *phrase*) may cross from a message
into the next ones.  ``pieces`` looks at the words around each seam and glues two
messages only where a phrase occurs there.  Where none does, no match can cover the
seam, the scan of the joined text stands at the seam in the same state as a fresh
scan, and counts on either side add up.  This is exact also where matches overlap
and compete; a chain of them becomes one piece.

Only a pattern that meets spaces and has no bound on its length (``\\s+``, ``.*``,
``^``) needs the joined text: then the session is one piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Escapes that stand for one character or a place, and never for a space.
_NO_SPACE = set("wSdbB")
#: Escapes of one character that may be a space.
_MAYBE_SPACE = set("sWDhHVNpPxutnrfae")


def reach(kind: str, pattern: str) -> tuple[int, int] | None:
    """(spaces, characters) that a match has at most, looks around it included, if it
    has a space; (0, 0) if it can have none; None if its length has no known bound."""
    if kind != "regex":
        n = pattern.count(" ")
        return (n, len(pattern)) if n else (0, 0)
    spaces, unbounded, in_set, i = 0, False, False, 0
    while i < len(pattern):
        ch, nxt = pattern[i], pattern[i + 1:i + 2]
        if ch == "\\":
            if nxt.isspace() or nxt in _MAYBE_SPACE:
                spaces += 1
            elif nxt.isalnum() and nxt not in _NO_SPACE:
                return None   # an end of the text, a group again, a quotation, ...
            i += 2
            continue
        if ch.isspace() or ch == "." and not in_set:
            spaces += 1
        elif ch == "[":
            in_set, spaces = True, spaces + (nxt == "^")
        elif ch == "]":
            in_set = False
        elif in_set:
            # a range may run over the space
            spaces += ch == "-"
        elif ch in "^$" or pattern.startswith("(?x", i):
            return None
        elif ch in "*+{":
            unbounded = True
        i += 1
    if not spaces:
        return 0, 0
    return None if unbounded else (spaces, len(pattern))


def pieces(msgs: DataFrame, by, order, text: str, found, spaces: int, width: int) -> DataFrame:
    """``msgs`` with ``_piece`` (number inside the group) and ``_glued`` (whether the
    piece may have other messages).

    ``found``: Column → Column, whether a phrase occurs in a text; ``spaces`` and
    ``width``: the greatest reach of the phrases.  Rows of a group are put in the order of
    ``order``.  A match that starts in a message ends at most ``spaces`` messages later.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    side = width + 1   # what looks one character further sees it
    ahead = F.collect_list(F.left(F.col(text), F.lit(side))).over(w.rowsBetween(1, spaces))
    df = msgs.withColumn("_ahead", ahead)
    around: Column = F.concat_ws(" ", F.right(F.col(text), F.lit(side)), F.array_join("_ahead", " "))
    df = df.withColumn("_hit", (F.size("_ahead") > 0) & found(around)).drop("_ahead")
    before = F.coalesce(F.max("_hit").over(w.rowsBetween(-spaces, -1)), F.lit(False))
    df = df.withColumn("_before", before).withColumn("_glued", F.max("_hit").over(w.rowsBetween(-spaces, 0)))
    number = F.sum((~F.col("_before")).cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_piece", number).drop("_before", "_hit")
