import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from talkframe.session import checkpoint_dir, get_spark
    wh = tempfile.mkdtemp(prefix="talkframe-warehouse-", dir="/tmp")
    s = get_spark(master="local[4]", shuffle_partitions=4, extra={"spark.sql.warehouse.dir": wh})
    checkpoint_dir(s)
    yield s


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="talkframe-test-", dir="/tmp")


def turns_df(spark, rows):
    """rows: (corpus, session_id, turn, role, text)."""
    return spark.createDataFrame(rows, "corpus string, session_id bigint, turn bigint, role string, text string")
