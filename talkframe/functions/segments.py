"""Scans over groups too long for one task.

A window over ``(corpus, session_id)`` holds one conversation in one task.  Here a
group is cut into segments of ``size`` consecutive places of its order column (the
turn number): windows run inside ``(group, segment)``, so a conversation with a third
of all rows spreads over as many tasks as it has segments, and what a segment must
know of the others comes from a *carry*: one row per segment of the groups that have
more than one, scanned in segment order.

The carry is read from the narrow columns only, and only for groups with a place
beyond the first segment, a condition that reaches the scan.  Where there is no such
group its stages are empty and adaptive execution drops them with the join, so
ordinary conversations are dealt and scanned once, as before.  Rows keep the
partitioning by (group, segment); the carry joins on exactly those keys, so the text
moves once.

The order column must be numeric; places may be missing, and rows without one form a
segment of their own in front.  Group keys must not be null.

The scans are SQL (``{turns}`` stands for the rows): one statement instead of dozens
of calls, which is what planning time is made of.
"""

from __future__ import annotations

#: Places of the order column in a segment.
SEGMENT = 4096
SEG = "_seg"


def segment_of(order: str, size: int = SEGMENT) -> str:
    """The segment of a place, as an expression."""
    return f"CAST(coalesce(floor({order} / {size}), {-(1 << 62)}) AS BIGINT)"


def segmented(rows: str, order: str, size: int = SEGMENT) -> str:
    """``rows`` (a table or a query in brackets) with their segment."""
    return f"(SELECT *, {segment_of(order, size)} AS {SEG} FROM {rows})"


def long_groups(rows: str, by: str, order: str, size: int = SEGMENT) -> str:
    """Rows of the groups with more than the first segment."""
    beyond = f"{order} >= {size} OR {order} < 0 OR {order} IS NULL"
    return f"(SELECT * FROM {rows} LEFT SEMI JOIN (SELECT DISTINCT {by} FROM {rows} WHERE {beyond}) USING ({by}))"


def inside(by: str, order: str = "") -> str:
    """The window of one segment of a group."""
    return f"(PARTITION BY {by}, {SEG}" + (f" ORDER BY {order}" if order else "")


def carried_sums(rows: str, by: str, order: str, size: int = SEGMENT, **sums: str) -> str:
    """(by, segment, name_before, name_after) of long groups: sums over the group's other segments."""
    w = f"(PARTITION BY {by} ORDER BY {SEG} ROWS BETWEEN"
    out = ", ".join(f"sum({n}) OVER {w} UNBOUNDED PRECEDING AND 1 PRECEDING) AS {n}_before, "
                    f"sum({n}) OVER {w} 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS {n}_after" for n in sums)
    narrow = ", ".join(f"{c} AS {n}" for n, c in sums.items())
    total = ", ".join(f"sum({n}) AS {n}" for n in sums)
    return (f"(SELECT {by}, {SEG}, {out} FROM (SELECT {by}, {SEG}, {total} FROM (SELECT {by}, {segment_of(order, size)} AS {SEG}, {narrow} "
            f"FROM {long_groups(rows, by, order, size)}) GROUP BY {by}, {SEG}))")
