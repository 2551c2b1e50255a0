"""Query registry: ``name -> (spark builder, oracle SQL or None)``.

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names match its oracle.  Doubles are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (the oracles round the same way)."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floating:
        return df
    return df.selectExpr(*[f"round(CAST(`{c}` AS DOUBLE), {digits}) AS `{c}`" if c in floating else f"`{c}`" for c in df.columns])


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark, sf_dir):
            from talkframe.session import ship_package
            ship_package(spark)  # workers import talkframe for UDFs / hooks
            return rounded(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        _REGISTRY[name] = (run, sql)
        return fn
    return deco


def _load_all():
    """Import every query module once (registration happens at import)."""
    from talkframe.plans import (  # noqa: F401
        q_diversity, q_emotion, q_labels, q_lengths, q_markers, q_misc, q_scores, q_similarity, q_sinks, q_turns,
    )


def queries() -> dict[str, Callable]:
    _load_all()
    return {k: v[0] for k, v in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v[1] for k, v in _REGISTRY.items() if v[1] is not None}
