"""Registered queries: writers checked by reading back what they wrote."""

import uuid

from pyspark.sql import functions as F

from talkframe.plans.catalog import query
from talkframe.plans.sqlfrag import with_turns
from talkframe.plans.testview import turns_only
from talkframe.session import checkpoint_dir
from talkframe.sources import sinks


def _folder(spark, label):
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query("s12_csv_round_trip", with_turns() + """
SELECT corpus, session_id, turn, role, text AS message, '"' || role || '", ' || chr(10) || text AS quoted, length(text) AS n_chars,
       CASE WHEN turn % 3 <> 0 THEN turn / 4 END AS score FROM turns WHERE length(text) > 0""")
def s12_csv_round_trip(spark, sf_dir):
    """A result table of messages written as CSV with a header and read back: commas,
    quotes and line breaks inside a text, and missing numbers, come back as they were."""
    t = turns_only(spark, sf_dir, dealt=False).where(F.length("text") > 0)
    out = t.select("corpus", "session_id", "turn", "role", F.col("text").alias("message"),
                   F.concat(F.lit('"'), "role", F.lit('", \n'), "text").alias("quoted"), F.length("text").cast("bigint").alias("n_chars"),
                   F.when(F.col("turn") % 3 != 0, F.col("turn") / 4).alias("score"))
    path = _folder(spark, "csv")
    sinks.write_csv(out, path)
    return sinks.read_csv(spark, path, out.schema)


@query("s13_session_json_round_trip", with_turns() + """
SELECT corpus, session_id, count(*) AS n_messages, sum(length(text)) AS n_chars, max(text) AS last_text FROM turns GROUP BY corpus, session_id""")
def s13_session_json_round_trip(spark, sf_dir):
    """One JSON record per session, in folders by corpus, read back with its folder as a column."""
    g = turns_only(spark, sf_dir, dealt=False).groupBy("corpus", "session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    path = _folder(spark, "sessions")
    sinks.write_session_json(g, path)
    back = spark.read.schema(g.schema).json(path)
    texts = F.col("messages.text")
    return back.select("corpus", "session_id", F.size("messages").cast("bigint").alias("n_messages"),
                       F.aggregate(texts, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("n_chars"), F.array_max(texts).alias("last_text"))
