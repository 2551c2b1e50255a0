"""Labels aligned to turns by content (J9, quirk Q7).

Labels come back as a list in the order of the patient turns; pairing them by
position goes wrong from the first turn that the labeler left out or added.  Labels
carry the message that they label, so they can be paired by it:

* *anchors* pair the k-th label whose content begins like a message with the k-th
  patient turn that begins so (``prefix`` characters, stripped; more of them where
  many messages of a session begin alike);
* of a session's anchors the longest run that goes forward in both is kept (of
  several, the one that takes the earliest label at each step), so that a message
  repeated elsewhere does not pull a label out of order;
* a label without an anchor is placed between its neighbours where they leave
  exactly as many turns as labels, else at the distance of the nearest side where
  only one side has an anchor, else by position where the session has no anchor at
  all.  Otherwise it stays unplaced.

Texts meet in one equi-join on (session, prefix, occurrence); what is gathered per
session is two numbers per label, and the later windows hold no text.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkframe.functions.text import py_strip
from talkframe.operators.turns import SESSION, patient_turns


def _ending(values) -> list[int]:
    """Length of the longest increasing subsequence that ends at each value."""
    tails, out = [], []
    for v in values:
        i = bisect_left(tails, v)
        tails[i:i + 1] = [v]
        out.append(i + 1)
    return out


def longest_run(turns: list[int]) -> list[int]:
    """Places of the longest increasing subsequence that is first in order."""
    up = _ending(turns)
    down = _ending([-x for x in reversed(turns)])[::-1]
    most, kept = max(up, default=0), []
    for i, (x, a, b) in enumerate(zip(turns, up, down)):
        if a == len(kept) + 1 and a + b - 1 == most and (not kept or x > turns[kept[-1]]):
            kept.append(i)
    return kept


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _kept(turns: pd.Series) -> pd.Series:
    return turns.map(lambda x: longest_run(list(x)))


def _keyed(df: DataFrame, text: str, order: str, prefix: int) -> DataFrame:
    key = F.substring(py_strip(text), 1, prefix)
    w = Window.partitionBy(*SESSION, "_key").orderBy(order)
    return df.withColumn("_key", key).where(F.length("_key") > 0).withColumn("_nth", F.row_number().over(w))


def aligned_labels(labels: DataFrame, turns: DataFrame, prefix: int = 30) -> DataFrame:
    """``labels(corpus, session_id, label_idx, label, content)`` with the patient turn of each.

    Adds ``patient_idx`` and ``turn`` (null where unplaced), ``method`` (``content``,
    ``between``, ``beside``, ``position`` or ``unplaced``) and ``shift``
    (``patient_idx - label_idx``).  Labels need a distinct ``label_idx`` in a session.
    """
    patient = patient_turns(turns)
    said = _keyed(patient.select(*SESSION, "text", "patient_idx"), "text", "patient_idx", prefix)
    named = _keyed(labels.select(*SESSION, "label_idx", "content"), "content", "label_idx", prefix)
    pairs = (named.select(*SESSION, "_key", "_nth", "label_idx").join(said.select(*SESSION, "_key", "_nth", "patient_idx"), [*SESSION, "_key", "_nth"])
             .groupBy(*SESSION).agg(F.array_sort(F.collect_list(F.struct("label_idx", "patient_idx"))).alias("_a")))
    pairs = pairs.withColumn("_i", _kept(F.col("_a.patient_idx")))
    anchors = pairs.select(*SESSION, F.inline(F.transform("_i", lambda i: F.get("_a", i)))).withColumnRenamed("patient_idx", "_p")
    w = Window.partitionBy(*SESSION).orderBy("label_idx")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    own = labels.select(*SESSION, "label_idx", "label").join(anchors, [*SESSION, "label_idx"], "left")
    at = F.when(F.col("_p").isNotNull(), F.struct(F.col("label_idx").alias("l"), F.col("_p").alias("p")))
    own = own.withColumn("_b", F.last(at, ignorenulls=True).over(back)).withColumn("_f", F.first(at, ignorenulls=True).over(ahead))
    here, b, f = F.col("label_idx"), F.col("_b"), F.col("_f")
    even = (f.l - b.l) == (f.p - b.p)
    method = (F.when(F.col("_p").isNotNull(), "content").when(b.isNotNull() & f.isNotNull() & even, "between")
              .when(b.isNull() & f.isNull(), "position").when(b.isNull() | f.isNull(), "beside"))
    place = (F.when(F.col("_p").isNotNull(), F.col("_p")).when(b.isNotNull() & f.isNotNull(), F.when(even, b.p + (here - b.l)))
             .when(b.isNotNull(), b.p + (here - b.l)).when(f.isNotNull(), f.p - (f.l - here)).otherwise(here))
    own = own.select(*SESSION, "label_idx", "label", method.alias("method"), place.cast("bigint").alias("patient_idx"))
    out = own.join(patient.select(*SESSION, "patient_idx", "turn"), [*SESSION, "patient_idx"], "left")
    found = F.col("turn").isNotNull()
    return out.select(*SESSION, "label_idx", "label", F.when(found, F.col("patient_idx")).alias("patient_idx"), "turn",
                      F.when(found, F.col("method")).otherwise("unplaced").alias("method"),
                      F.when(found, F.col("patient_idx") - F.col("label_idx")).alias("shift"))
