"""talkframe: conversation-corpus analytics as Spark DataFrame operators.

Every operator is a function ``f(df, ...) -> DataFrame`` over the canonical
turn table ``turns(corpus, session_id, turn, role, text)``.  Nothing is
collected to the driver; the optimizer sees one declarative plan.
"""

from talkframe.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
