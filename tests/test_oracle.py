"""Every registered query against its DuckDB oracle (the driver's gate, locally)."""

import pytest

from oracle_check import compare
from talkframe.plans import catalog

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert len(df.columns) > 0 and df.count() >= 0


def test_all_queries_match_oracle(spark):
    res = compare(spark, SF, set(catalog.queries()), verbose=False)
    bad = {k: v for k, v in res.items() if not (v.startswith("OK") or v.startswith("rows-only"))}
    assert not bad, bad


def test_every_query_has_oracle_or_reason():
    missing = set(catalog.queries()) - set(catalog.oracle_sql())
    assert not missing
