"""Turn normalisation, patient-turn indexing, history windows (P1-P6, P11, P17-P19,
P24, P28, P29, W1-W8).

Input everywhere: ``turns(corpus, session_id, turn, role, text)``.  Turn numbers
(P3/W1), merged messages (P1/W7) and context budgets (P18/W6) are scanned in
segments of a conversation with a carry between them (``functions/segments.py``),
so one conversation may be longer than a task can hold; the other windows are
partitioned by ``(corpus, session_id)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.functions.segments import SEG, SEGMENT, carried_sums, inside, long_groups, segmented
from talkframe.functions.text import approx_tokens, collapse_ws, py_strip

SESSION = ["corpus", "session_id"]
_SESSION = ", ".join(SESSION)
PATIENT_ROLE = "assistant"
THERAPIST_ROLE = "user"


def _session_window(order="turn"):
    return Window.partitionBy(*SESSION).orderBy(order)


# --- P2 --------------------------------------------------------------------

def patient_messages(turns: DataFrame, role: str = PATIENT_ROLE) -> DataFrame:
    """Patient messages, stripped, empties removed."""
    return (turns.where(F.col("role") == role)
            .withColumn("text", py_strip("text"))
            .where(F.length("text") > 0))


def patient_messages_raw(turns: DataFrame, role: str = PATIENT_ROLE) -> DataFrame:
    """Patient messages, role compared lower-cased, empties kept."""
    return turns.where(F.lower("role") == role).withColumn("text", F.coalesce("text", F.lit("")))


def is_patient_role(role_col="role") -> Column:
    """P2d: role set used when counting patient turns."""
    return F.col(role_col).isin("assistant", "patient")


# --- P3 / W1 ---------------------------------------------------------------

def patient_turns(turns: DataFrame, max_turns: int | None = None, segment: int = SEGMENT) -> DataFrame:
    """Non-empty stripped patient messages with a 0-based ``patient_idx``."""
    return number_turns(patient_messages(turns), max_turns, segment)


def number_turns(msgs: DataFrame, max_turns: int | None = None, segment: int = SEGMENT) -> DataFrame:
    """``msgs`` (one row per message, any columns) with a 0-based ``patient_idx`` in each session."""
    before = carried_sums("{msgs}", _SESSION, "turn", segment, n="1")
    numbered = f"SELECT *, row_number() OVER {inside(_SESSION, 'turn')}) AS _in FROM {segmented('{msgs}', 'turn', segment)}"
    if max_turns is not None:  # a segment's first rows are enough
        numbered = f"SELECT * FROM ({numbered}) WHERE _in <= {int(max_turns)}"
    few = "" if max_turns is None else f"WHERE patient_idx < {int(max_turns)}"
    return msgs.sparkSession.sql(f"""
        SELECT * FROM (
          SELECT * EXCEPT ({SEG}, _in, n_before, n_after), CAST(coalesce(n_before, 0) + _in - 1 AS BIGINT) AS patient_idx
          FROM ({numbered}) LEFT JOIN {before} USING ({_SESSION}, {SEG})) {few}""", msgs=msgs)


# --- P1 / W7 ---------------------------------------------------------------

def _islands(rows: str, segment: int) -> str:
    """``rows`` with the number (from 1) of the run of one role within the segment."""
    w = inside(_SESSION, "turn")
    goes_on = f"row_number() OVER {w}) > 1 AND lag(role) OVER {w}) <=> role"
    return (f"(SELECT * EXCEPT (_new), sum(_new) OVER {w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _island "
            f"FROM (SELECT *, IF({goes_on}, 0, 1) AS _new FROM {segmented(rows, 'turn', segment)}))")


def _island_carry(segment: int) -> str:
    """Per segment of a long conversation: runs before it (``_offset``), whether its
    first run goes on from the segment before (``_goes_on``), its number of runs and
    the messages of later segments that go on with its last run (``_more``)."""
    rows = _islands(long_groups(f"(SELECT {_SESSION}, turn, role, text FROM {{turns}})", _SESSION, "turn", segment), segment)
    w = f"(PARTITION BY {_SESSION} ORDER BY {SEG}"
    earlier = f"{w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    per = f"""(
      SELECT *, coalesce(sum(_runs - CAST(_goes_on AS INT)) OVER {earlier}, 0) AS _offset,
             last(IF(_runs > 1 OR NOT _goes_on, {SEG}, NULL), true) OVER {earlier} AS _home
      FROM (SELECT *, row_number() OVER {w}) > 1 AND lag(_last) OVER {w}) <=> _first AS _goes_on
            FROM (SELECT {_SESSION}, {SEG}, max(_island) AS _runs, min_by(role, turn) AS _first, max_by(role, turn) AS _last
                  FROM {rows} GROUP BY {_SESSION}, {SEG})))"""
    more = f"""(
      SELECT {_SESSION}, _home AS {SEG}, array_sort(collect_list(struct(turn, text))) AS _more
      FROM (SELECT * FROM {rows} WHERE _island = 1) JOIN (SELECT {_SESSION}, {SEG}, _home FROM {per} WHERE _goes_on) USING ({_SESSION}, {SEG})
      GROUP BY {_SESSION}, _home)"""
    return f"(SELECT {_SESSION}, {SEG}, _runs, _goes_on, _offset, _more FROM {per} LEFT JOIN {more} USING ({_SESSION}, {SEG}))"


def merge_consecutive(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Merge runs of same-role messages, contents joined by newline.

    Gaps and islands inside segments: a change flag from ``lag(role)``, a running
    sum gives the run, and the aggregate reuses the window's partitioning.  Runs
    that cross segments are put together by the carry: what goes on in later
    segments is appended where the run starts, and left out there.
    """
    goes_on = "coalesce(_goes_on, false)"
    return turns.sparkSession.sql(f"""
        SELECT {_SESSION}, CAST(coalesce(_offset, 0) - CAST({goes_on} AS INT) + _island - 1 AS BIGINT) AS turn, role,
               array_join(transform(_all, p -> coalesce(p.text, '')), '\n') AS text, CAST(size(_all) AS BIGINT) AS n_merged
        FROM (SELECT *, IF(_island = _runs AND _more IS NOT NULL, concat(_parts, _more), _parts) AS _all
              FROM (SELECT {_SESSION}, {SEG}, _island, first(role) AS role, array_sort(collect_list(struct(turn, text))) AS _parts
                    FROM {_islands('{turns}', segment)} GROUP BY {_SESSION}, {SEG}, _island)
              LEFT JOIN {_island_carry(segment)} USING ({_SESSION}, {SEG}))
        WHERE NOT ({goes_on} AND _island = 1)""", turns=turns)


# --- P4 / P5 / P6 ----------------------------------------------------------

def _capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def relabel_role(role: Column, style: str = "judge") -> Column:
    """P4 role relabelling styles.

    judge:   user → THERAPIST, anything else → PATIENT
    client:  user → Therapist, assistant → Client, else Capitalised or Unknown
    plain:   text replace user → therapist, assistant → patient
    swapped: assistant → User, anything else → Assistant (therapist's view)
    capital: Python ``str.capitalize``
    speaker: seeker → assistant, supporter → user (raw dialogue files)
    """
    if style == "judge":
        return F.when(role == "user", "THERAPIST").otherwise("PATIENT")
    if style == "client":
        return (F.when(role == "user", "Therapist").when(role == "assistant", "Client")
                .otherwise(F.when(F.coalesce(role, F.lit("")) == "", "Unknown").otherwise(_capitalize(role))))
    if style == "plain":
        return F.replace(F.replace(role, F.lit("user"), F.lit("therapist")), F.lit("assistant"), F.lit("patient"))
    if style == "swapped":
        return F.when(role == "assistant", "User").otherwise("Assistant")
    if style == "capital":
        return _capitalize(role)
    if style == "speaker":
        return F.when(role == "seeker", "assistant").when(role == "supporter", "user").otherwise(role)
    raise ValueError(f"unknown role style {style!r}")


def format_messages(turns: DataFrame) -> DataFrame:
    """P5: whitespace collapsed to single spaces, role upper-cased."""
    return turns.withColumn("role", F.upper("role")).withColumn("text", collapse_ws("text"))


def normalize_backend(name: Column) -> Column:
    """Strip ``hosted_vllm_`` then at most one vendor prefix."""
    # Hosting prefix and vendor prefixes, tried in this order.
    no_host = F.regexp_replace(name, "^hosted_vllm_", "")
    return F.regexp_replace(no_host, "^(openai_|Qwen_|meta-llama_|llama_)", "")


def safe_name(name: Column) -> Column:
    """``/``, ``:`` and space replaced by ``_``."""
    return F.translate(name, "/: ", "___")


# --- P11 -------------------------------------------------------------------

def session_turn_counts(turns: DataFrame, non_empty: bool = False) -> DataFrame:
    """Patient messages per (corpus, session).  ``non_empty`` = PTC rule."""
    src = patient_messages(turns) if non_empty else patient_messages_raw(turns)
    return src.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("n_patient"))


def sessions_in_turn_range(turns: DataFrame, corpora=("real", "synthetic"),
                           turn_min: int | None = None, turn_max: int | None = None,
                           non_empty: bool = False) -> DataFrame:
    """Sessions present in every corpus with patient count in range on **all** sides."""
    counts = session_turn_counts(turns, non_empty)
    wide = counts.groupBy("session_id").pivot("corpus", list(corpora)).agg(F.first("n_patient"))
    cond = F.lit(True)
    for c in corpora:
        cond = cond & F.col(f"`{c}`").isNotNull()
        if turn_min is not None:
            cond = cond & (F.col(f"`{c}`") >= turn_min)
        if turn_max is not None:
            cond = cond & (F.col(f"`{c}`") <= turn_max)
    return wide.where(cond).select(
        "session_id", *[F.col(f"`{c}`").cast("bigint").alias(f"n_{c}") for c in corpora])


# --- P17 / P18 / P19 -------------------------------------------------------

def transcript_line(role: Column, text: Column, style: str = "judge") -> Column:
    """One line of a transcript.  ``client`` compares the stripped, lower-cased
    role, strips the text and puts it on one line; ``plain`` has no space after
    the colon; the other styles keep the text as it is."""
    if style == "client":
        name = relabel_role(py_strip(F.lower(F.coalesce(role, F.lit("")))), "client")
        return F.concat(name, F.lit(": "), F.replace(py_strip(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(" ")))
    return F.concat(relabel_role(role, style), F.lit(":" if style == "plain" else ": "), text)


def transcripts(turns: DataFrame, history_limit: int | None = None, style: str = "judge",
                skip_empty: bool = True, empty_text: str = "") -> DataFrame:
    """One ordered ``ROLE: text`` transcript per session; a session left
    without messages has the transcript ``empty_text`` and 0 messages.

    With ``history_limit`` the first messages are picked by row number before
    they are collected (the window and the aggregate share one shuffle), so a
    long session never gathers more than the limit; ``n_messages`` still counts
    every (non-empty) message."""
    kept = F.length(py_strip("text")) > 0 if skip_empty else F.lit(True)
    src = turns.withColumn("_keep", F.coalesce(kept, F.lit(False)))
    if history_limit is not None:
        seen = F.sum(F.col("_keep").cast("int")).over(_session_window().rowsBetween(Window.unboundedPreceding, 0))
        picked = F.col("_keep") & (seen <= history_limit)
    else:
        picked = F.col("_keep")
    lines = src.withColumn("_pick", picked).groupBy(*SESSION).agg(
        F.array_sort(F.collect_list(F.when(F.col("_pick"), F.struct("turn", "role", "text")))).alias("_msgs"),
        F.count_if("_keep").alias("_n"))
    text = F.array_join(F.transform("_msgs", lambda m: transcript_line(m["role"], m["text"], style)), "\n")
    return lines.select(*SESSION, F.when(F.size("_msgs") > 0, text).otherwise(F.lit(empty_text)).alias("transcript"),
                        F.col("_n").cast("bigint").alias("n_messages"))


def context_budget(turns: DataFrame, budget_tokens: int, min_messages: int = 10, segment: int = SEGMENT) -> DataFrame:
    """Newest suffix of each session whose ⌊chars/4⌋ sum fits the budget.

    Applies only when the session has more than ``min_messages`` messages and the
    whole history exceeds the budget (⌊Σchars/4⌋).  The reverse running sum is
    monotone, so ``running <= budget`` is exactly the loop's break rule.
    """
    chars = "length(coalesce(text, ''))"
    tokens = f"CAST(floor({chars} / 4) AS BIGINT)"
    others = carried_sums("{turns}", _SESSION, "turn", segment, n="1", chars=chars, tokens=tokens)
    own = inside(_SESSION)
    scanned = f"""
        SELECT *, {tokens} AS msg_tokens, count(*) OVER {own}) AS _n, sum({chars}) OVER {own}) AS _chars,
               sum({tokens}) OVER {inside(_SESSION, 'turn DESC')} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _later
        FROM {segmented('{turns}', 'turn', segment)}"""
    z = lambda c: f"coalesce({c}, 0)"
    total = f"floor((_chars + {z('chars_before')} + {z('chars_after')}) / 4)"
    return turns.sparkSession.sql(f"""
        SELECT {_SESSION}, turn, role, text, msg_tokens, truncated, n_messages
        FROM (SELECT *, n_messages > {int(min_messages)} AND {total} > {int(budget_tokens)} AS truncated
              FROM (SELECT *, _n + {z('n_before')} + {z('n_after')} AS n_messages
                    FROM ({scanned}) LEFT JOIN {others} USING ({_SESSION}, {SEG})))
        WHERE NOT truncated OR _later + {z('tokens_after')} <= {int(budget_tokens)}""", turns=turns)


def render_history(kept: DataFrame) -> DataFrame:
    """P18 rendering: ``Role: text`` lines, with the truncation marker first only
    when messages were actually dropped (the per-message ⌊chars/4⌋ sum can fit
    the budget even when the whole history's ⌊Σchars/4⌋ does not)."""
    g = kept.groupBy(*SESSION).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_m"),
        F.max("n_messages").alias("_n"))
    lines = F.transform("_m", lambda m: F.concat(_capitalize(m["role"]), F.lit(": "), m["text"]))
    cut = F.size("_m") < F.col("_n")
    lines = F.when(cut, F.concat(F.array(F.lit("[Earlier messages truncated...]")), lines)).otherwise(lines)
    return g.select(*SESSION, F.array_join(lines, "\n").alias("history"))


def prompt_size(turns: DataFrame) -> DataFrame:
    """Messages, characters and ⌊chars/4⌋ per session."""
    return turns.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).cast("bigint").alias("n_chars"),
        F.floor(F.sum(F.length(F.coalesce("text", F.lit("")))) / 4).cast("bigint").alias("approx_tokens"))


# --- W2 / W3 / W4 ----------------------------------------------------------

def history_windows(turns: DataFrame, k: int | None = 6, style: str = "judge",
                    history_limit: int | None = None) -> DataFrame:
    """For each non-empty patient turn, the ``k`` messages before it
    (``k=None``: all earlier messages), empties dropped after the frame,
    rendered as ``ROLE: text`` lines; ``(No previous history)`` for the first
    message, "" when the earlier messages are all blank.
    """
    w = _session_window()
    frame = w.rowsBetween(Window.unboundedPreceding if k is None else -k, -1)
    hist = F.collect_list(F.struct("turn", "role", "text")).over(frame)
    df = turns.withColumn("_hist", hist).withColumn("_stripped", py_strip("text"))
    df = df.where((F.col("role") == PATIENT_ROLE) & (F.length("_stripped") > 0))
    kept = F.filter("_hist", lambda m: F.length(py_strip(m["text"])) > 0)
    rendered = F.transform(kept, lambda m: F.concat(relabel_role(m["role"], style), F.lit(": "), m["text"]))
    if history_limit is not None:
        rendered = F.slice(rendered, 1, history_limit)
    return df.select(
        *SESSION, "turn", F.col("text").alias("message"),
        F.when(F.size("_hist") > 0, F.array_join(rendered, "\n")).otherwise(F.lit("(No previous history)")).alias("history"),
        F.size(kept).cast("bigint").alias("n_history"))


def perplexity_contexts(turns: DataFrame, max_patient_turns: int = 20) -> DataFrame:
    """For each patient turn (first ``max_patient_turns``) the newline-joined
    contents of all earlier messages.

    Messages after the last scored patient turn are dropped before the frames
    are collected (same partitioning, no extra shuffle), so a long session
    costs O(kept²), not O(n²)."""
    w = _session_window()
    pidx = F.sum(F.when(F.col("role") == PATIENT_ROLE, 1).otherwise(0)).over(
        w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    df = turns.withColumn("patient_idx", pidx.cast("bigint")).where(F.col("patient_idx") < max_patient_turns)
    earlier = F.collect_list(F.coalesce("text", F.lit(""))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("context", F.array_join(earlier, "\n"))
    return (df.where(F.col("role") == PATIENT_ROLE)
            .select(*SESSION, "turn", "patient_idx", "context", F.col("text").alias("response")))


# --- P24 / P28 / P29 / W8 --------------------------------------------------

def turn_buckets(df: DataFrame, idx_col: str = "patient_idx", size: int = 3, limit: int = 15) -> DataFrame:
    """Turn → ``size``-turn bucket, first ``limit`` turns only."""
    return df.where(F.col(idx_col) < limit).withColumn("bucket", F.floor(F.col(idx_col) / size).cast("bigint"))


def turn_budget(turns: DataFrame, max_turns: int = 20) -> DataFrame:
    """Patient replies to generate per session.

    ``min(#patient turns, max_turns)``; when the session opens with the patient,
    one fewer, and the simulated talk starts with a blank opening message.
    """
    g = turns.groupBy(*SESSION).agg(
        F.sum(is_patient_role().cast("int")).cast("bigint").alias("n_patient"),
        F.min_by("role", "turn").alias("first_role"))
    opens = F.col("first_role").isin("assistant", "patient")
    return g.select(*SESSION, "n_patient", "first_role",
                    (F.least("n_patient", F.lit(max_turns)) - opens.cast("bigint")).alias("turn_budget"),
                    opens.alias("blank_opening"))


def next_turn_examples(turns: DataFrame, start_turn: int = 0) -> DataFrame:
    """One example per patient turn whose previous message is the
    therapist's: all earlier messages as history, the therapist message, the
    patient reply as target.  ``pair_idx`` counts examples from 0."""
    w = _session_window()
    df = (turns.withColumn("_prev_role", F.lag("role").over(w))
          .withColumn("_prev_text", F.lag("text").over(w))
          .withColumn("_hist", F.collect_list(F.struct("turn", "role", "text"))
                      .over(w.rowsBetween(Window.unboundedPreceding, -2))))
    ex = df.where((F.col("role") == PATIENT_ROLE) & (F.col("_prev_role") == THERAPIST_ROLE))
    ex = ex.withColumn("pair_idx", (F.row_number().over(_session_window()) - 1).cast("bigint"))
    rendered = F.transform("_hist", lambda m: F.concat(relabel_role(m["role"], "judge"), F.lit(": "), m["text"]))
    return ex.where(F.col("pair_idx") >= start_turn).select(
        *SESSION, "turn", "pair_idx",
        F.array_join(rendered, "\n").alias("history"),
        F.size("_hist").cast("bigint").alias("n_history"),
        F.col("_prev_text").alias("therapist_message"),
        F.col("text").alias("target"))
