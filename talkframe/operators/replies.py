"""Parsing of model replies (P20, P21, P22, P30) as column expressions.

Replies are data: the (costly, non-deterministic) reply table is persisted
first, then parsed here with built-ins so re-parsing never re-runs a model.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkframe.functions.text import py_strip

LABELS = ["P", "T", "C", "F"]


def split_thinking(reply: Column) -> list[Column]:
    """P20: text before the first ``</think>`` (any case) is thinking, the rest the
    response; both stripped.  No tag → thinking null, response = whole text."""
    has = reply.rlike("(?i)</think>")
    thinking = F.when(has, py_strip(F.regexp_extract(reply, r"(?is)^(.*?)</think>", 1)))
    response = F.when(has, py_strip(F.regexp_extract(reply, r"(?is)</think>(.*)$", 1))).otherwise(py_strip(reply))
    return [thinking.alias("thinking"), response.alias("response")]


def parse_letter(reply: Column, strict: bool = False) -> Column:
    """First label letter **in the order P, T, C, F** occurring anywhere in the
    upper-cased reply (so "NOT SURE" → T); null when none.  ``strict`` accepts
    only a bare one-letter reply."""
    u = F.upper(py_strip(reply))
    if strict:
        return F.when(u.isin(*LABELS), u)
    expr = None
    for letter in LABELS:
        cond = F.contains(u, F.lit(letter))
        expr = F.when(cond, F.lit(letter)) if expr is None else expr.when(cond, F.lit(letter))
    return expr


def parse_label_json(reply: Column) -> Column:
    """A JSON reply → ``array<struct<content, classification>>``, null if it is
    not JSON.

    Parsed once, as a variant whose types are tested: an object stands for the
    list under the first of classifications / turns / labels that is one; a list
    of strings is a list of labels; of a list of lists the first is taken.  Items
    that are not objects with a string ``classification`` are dropped, so the
    positions of the result are those of the valid items.  A reply without a
    list gives an empty array.
    """
    body = py_strip(F.regexp_replace(py_strip(reply), r"^```(?:json)?|```$", ""))
    v = F.try_parse_json(body)
    as_list = lambda x: F.try_variant_get(x, "$", "array<variant>")
    is_string = lambda x: F.schema_of_variant(x) == "STRING"
    named = [as_list(F.try_variant_get(v, f"$.{k}", "variant")) for k in ("classifications", "turns", "labels")]
    top = F.coalesce(as_list(v), *named)
    lists = (F.size(top) > 0) & F.forall(top, lambda x: as_list(x).isNotNull())
    objects = F.filter(F.when(lists, as_list(F.try_element_at(top, F.lit(1)))).otherwise(top),
                       lambda x: F.coalesce(is_string(F.try_variant_get(x, "$.classification", "variant")), F.lit(False)))
    item = lambda content, label: F.struct(content.alias("content"), label.alias("classification"))
    from_strings = F.transform(top, lambda x: item(F.lit(None).cast("string"), F.try_variant_get(x, "$", "string")))
    from_objects = F.transform(objects, lambda x: item(F.try_variant_get(x, "$.content", "string"),
                                                       F.try_variant_get(x, "$.classification", "string")))
    found = F.when(F.forall(top, is_string), from_strings).otherwise(from_objects)
    return F.when(v.isNotNull(), F.coalesce(found, F.array().cast("array<struct<content:string,classification:string>>")))


def grab_json_object(reply: Column, schema) -> Column:
    """Outermost ``{...}`` of a reply parsed with ``schema`` (null on failure)."""
    obj = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(obj != "", F.from_json(obj, schema))
