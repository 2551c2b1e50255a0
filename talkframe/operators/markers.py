"""Lexicon marker analytics.

The lexicon × text theta join is unrolled: each (small) lexicon row becomes a
literal ``regexp_count`` / substring-count column, so the whole feature
projection is one codegen'd stage and every pattern is compiled once per task.
The literals of a lexicon with more than ``PASSES`` of them are counted by one
automaton in one pass (``functions/automaton.py``); regexes stay as they are.
Counts are computed once into a wide message/session feature table; every
report below is a cheap aggregate of it.

Grains (trap T9): A3 counts on the space-joined patient text of a session
(matches may span two messages); A5/A10/A11 count per message.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.functions.automaton import literal_counts
from talkframe.functions.quantiles import count_stats
from talkframe.functions.seams import pieces, reach
from talkframe.functions.text import approx_tokens, py_strip, word_count
from talkframe.lexicons import PRONOUN_CATEGORIES, as_rows
from talkframe.operators.turns import PATIENT_ROLE, SESSION, patient_messages, patient_turns
from talkframe.session import cut_lineage


def _col_name(cat: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in cat)


def categories(lexicon) -> list[str]:
    seen = []
    for e in as_rows(lexicon):
        if e.category not in seen:
            seen.append(e.category)
    return seen


#: Literals of a lexicon that get a pass each; more of them share one.
PASSES = 64


def _literals(lexicon):
    """(category number, kind, pattern) of the literals, if there are too many for a pass each."""
    rows = as_rows(lexicon)
    number = {c: i for i, c in enumerate(categories(rows))}
    found = [(number[e.category], e.kind, e.pattern) for e in rows if e.kind in ("substring", "word")]
    return (found, number) if len(found) > PASSES else (None, number)


def count_expr(text: Column, lexicon, category: str, case_insensitive: bool = True,
               lower_text: bool = False) -> Column:
    """Σ over the category's patterns of non-overlapping matches in ``text``."""
    t = F.lower(text) if lower_text else text
    terms = []
    literals, number = _literals(lexicon)
    if literals and any(c == number[category] for c, _, _ in literals):
        # the same expression for every category: Spark runs it once
        terms.append(F.get(literal_counts(t, literals, len(number), case_insensitive), number[category]))
    for e in as_rows(lexicon):
        if e.category != category or (literals and e.kind in ("substring", "word")):
            continue
        if e.kind == "substring":
            d = e.pattern
            terms.append(F.floor((F.length(t) - F.length(F.replace(t, F.lit(d), F.lit("")))) / len(d)))
        elif e.kind == "regex":
            flags = "(?iU)" if case_insensitive else "(?U)"
            terms.append(F.regexp_count(t, F.lit(flags + e.pattern)))
        elif e.kind == "word":
            # whole-word occurrences of a literal (quirk Q6's ``mode='word'``)
            flags = "(?iU)" if case_insensitive else "(?U)"
            terms.append(F.regexp_count(t, F.lit(flags + r"(?<!\w)" + re.escape(e.pattern) + r"(?!\w)")))
        else:
            raise ValueError(f"unknown lexicon kind {e.kind!r}")
    expr = terms[0]
    for x in terms[1:]:
        expr = expr + x
    return expr.cast("bigint")


def count_columns(text: Column, lexicon, prefix: str = "cnt_", **kw) -> list[Column]:
    return [count_expr(text, lexicon, c, **kw).alias(prefix + _col_name(c)) for c in categories(lexicon)]


# --- A3 / A4 / A5 / A7 / A9 ----------------------------------------------------

def session_markers(turns: DataFrame, lexicon, max_turns: int | None = None,
                    case_insensitive: bool = True) -> DataFrame:
    """Per (corpus, session) with patient text: joined-text counts (A3), messages
    with ≥1 hit per category (A5), words / ⌊chars/4⌋ of the joined text, utterances.

    The text is not joined: messages are counted one by one and added up, and only
    those around a seam where a phrase occurs are put together (``functions/seams.py``).

    Patient turns are numbered only where ``max_turns`` asks for the first ones.
    """
    cats, rows = categories(lexicon), as_rows(lexicon)
    names = [_col_name(c) for c in cats]
    pt = patient_messages(turns) if max_turns is None else patient_turns(turns, max_turns)
    msg = pt.select(*SESSION, "turn", "text", word_count("text").alias("words"), F.length("text").cast("bigint").alias("chars"),
                    *count_columns(F.col("text"), rows, "n_", case_insensitive=case_insensitive))
    counted = [F.sum("n_" + n).alias("cnt_" + n) for n in names]
    sums = [F.count(F.lit(1)).alias("utterances"), F.sum("words").alias("words"), F.sum("chars").alias("chars"), *counted,
            *[F.sum((F.col("n_" + n) > 0).cast("bigint")).alias("msgs_" + n) for n in names]]
    crossing = [e for e in rows if reach(e.kind, e.pattern) != (0, 0)]
    if not crossing:
        sess = msg.groupBy(*SESSION).agg(*sums)
    else:
        sess = _glued_counts(msg, sums, crossing, names, case_insensitive)
    # the joined text has a space between two messages
    tokens = F.floor((F.col("chars") + F.col("utterances") - 1) / 4).cast("bigint")
    return sess.select(*SESSION, "utterances", "words", tokens.alias("tokens"),
                       *["cnt_" + n for n in names], *["msgs_" + n for n in names])


def _glued_counts(msg: DataFrame, sums, crossing, names, case_insensitive: bool) -> DataFrame:
    """The sums of messages by session, with the matches that cross from message to
    message: what a piece of several messages has beyond the sum of its messages."""
    cats = categories(crossing)
    count = lambda t, c: count_expr(t, crossing, c, case_insensitive)
    bounds = [reach(e.kind, e.pattern) for e in crossing]
    if None in bounds:
        cut = msg.withColumn("_piece", F.lit(0).cast("bigint")).withColumn("_glued", F.lit(True))
    else:
        found = lambda t: reduce(add, [count(t, c) for c in cats]) > 0
        cut = pieces(msg, SESSION, ["turn", "text"], "text", found, max(b[0] for b in bounds), max(b[1] for b in bounds))
    own = [F.sum(F.when(F.col("_glued"), count(F.col("text"), c))).alias("own_" + _col_name(c)) for c in cats]
    parts = F.array_sort(F.collect_list(F.when(F.col("_glued"), F.struct("turn", "text")))).alias("_parts")
    piece = cut.groupBy(*SESSION, "_piece").agg(*sums, *own, parts)
    piece = piece.withColumn("_full", F.array_join(F.transform("_parts", lambda p: p["text"]), " "))
    more = {_col_name(c): F.when(F.size("_parts") > 1, count(F.col("_full"), c) - F.col("own_" + _col_name(c))).otherwise(F.lit(0)) for c in cats}
    total = lambda c: F.sum(c).alias(c)
    return piece.groupBy(*SESSION).agg(
        total("utterances"), total("words"), total("chars"),
        *[F.sum(F.col("cnt_" + n) + more[n] if n in more else F.col("cnt_" + n)).alias("cnt_" + n) for n in names],
        *[total("msgs_" + n) for n in names])


def corpus_totals(turns: DataFrame, sess: DataFrame, lexicon) -> DataFrame:
    """Corpus totals; conversation count includes sessions without patient text (Q12)."""
    cats = categories(lexicon)
    conv = turns.groupBy("corpus").agg(F.countDistinct("session_id").alias("conversations"))
    tot = sess.groupBy("corpus").agg(
        F.sum("utterances").alias("utterances"), F.sum("words").alias("words"), F.sum("tokens").alias("tokens"),
        *[F.sum("cnt_" + _col_name(c)).alias("cnt_" + _col_name(c)) for c in cats],
        *[F.sum("msgs_" + _col_name(c)).alias("msgs_" + _col_name(c)) for c in cats])
    j = conv.join(tot, "corpus", "left")
    fill = ["utterances", "words", "tokens"] + [p + _col_name(c) for c in cats for p in ("cnt_", "msgs_")]
    return j.select("corpus", F.col("conversations").cast("bigint").alias("conversations"),
                    *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in fill])


def dataset_statistics(totals: DataFrame) -> DataFrame:
    """Conversations, utterances, words and per-conversation averages."""
    n = F.col("conversations")
    return totals.select("corpus", "conversations", "utterances", "words",
                         F.when(n > 0, F.col("words") / n).otherwise(F.lit(0.0)).alias("words_per_conv"),
                         F.when(n > 0, F.col("utterances") / n).otherwise(F.lit(0.0)).alias("utterances_per_conv"))


def normalized_metrics(totals: DataFrame, lexicon, token_scale: int = 100,
                       first_person: str = "first_person_singular", social: str = "social_pronouns") -> DataFrame:
    """Per ``token_scale`` tokens and % of messages for non-pronoun categories,
    plus the self-focus ratio (first-person / social; ∞ if only first-person, 0 if neither)."""
    cats = [c for c in categories(lexicon) if c not in PRONOUN_CATEGORIES]
    tok, utt = F.col("tokens"), F.col("utterances")
    rows = []
    for c in cats:
        n = _col_name(c)
        rows.append(F.struct(F.lit(c).alias("metric"),
                             F.when(tok > 0, F.col("cnt_" + n) / tok * token_scale).otherwise(F.lit(0.0)).alias("per_tokens"),
                             F.when(utt > 0, F.col("msgs_" + n) / utt * 100.0).otherwise(F.lit(0.0)).alias("percentage_messages")))
    fp = F.col("cnt_" + _col_name(first_person)) if first_person in categories(lexicon) else F.lit(0)
    so = F.col("cnt_" + _col_name(social)) if social in categories(lexicon) else F.lit(0)
    ratio = (F.when(so > 0, fp / so).when(fp > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))
    rows.append(F.struct(F.lit("self_focus_ratio").alias("metric"), ratio.alias("per_tokens"),
                         ratio.alias("percentage_messages")))
    return totals.select("corpus", F.inline(F.array(*rows)))


def per_conversation_stats(sess: DataFrame, lexicon) -> DataFrame:
    """Mean, population std, median, min, max of per-conversation counts."""
    cats = categories(lexicon)
    long = sess.select("corpus", F.inline(F.array(*[
        F.struct(F.lit(c).alias("marker"), F.col("cnt_" + _col_name(c)).alias("n")) for c in cats])))
    stats = count_stats(long, "n", ["corpus", "marker"], [0.5])
    return stats.select("corpus", "marker", "mean", "std", F.col("q0").alias("median"), "min", "max")


def marker_matrix(metrics: DataFrame, corpora, value: str = "per_tokens") -> DataFrame:
    """Marker × corpus matrix (pivot values listed: no extra distinct job)."""
    return metrics.groupBy("metric").pivot("corpus", list(corpora)).agg(F.first(value))


# --- A10-A18: paired per-session disfluency / marker table ---------------------

def paired_sessions(turns: DataFrame, left: str = "real", right: str = "synthetic") -> DataFrame:
    """Session ids present in both corpora."""
    s = turns.groupBy("session_id").agg(
        F.max((F.col("corpus") == left).cast("int")).alias("_l"),
        F.max((F.col("corpus") == right).cast("int")).alias("_r"))
    return s.where((F.col("_l") == 1) & (F.col("_r") == 1)).select("session_id")


def message_disfluency(turns: DataFrame, disfluencies, markers=None) -> DataFrame:
    """A10/A11 at message grain: substring disfluency counts (lower text), total,
    regex marker counts on lower text, whitespace tokens."""
    pt = patient_turns(turns)
    dcats = categories(disfluencies)
    cols = count_columns(F.lower("text"), disfluencies, prefix="dis_")
    total = None
    for c in dcats:
        e = count_expr(F.lower("text"), disfluencies, c)
        total = e if total is None else total + e
    mcols = count_columns(F.lower("text"), markers, prefix="mk_", case_insensitive=False) if markers else []
    return pt.select(*SESSION, "turn", "patient_idx", word_count("text").alias("tokens"),
                     total.alias("dis_total"), *cols, *mcols)


def paired_disfluency(turns: DataFrame, disfluencies, markers=None,
                      left: str = "real", right: str = "synthetic") -> DataFrame:
    """Per paired session totals for both sides, rates with max(tokens, 1), differences."""
    mcats = categories(markers) if markers else []
    text = py_strip("text")
    spoken = (F.col("role") == PATIENT_ROLE) & (F.length(text) > 0)
    low = F.lower(text)
    dis = reduce(add, [count_expr(low, disfluencies, c) for c in categories(disfluencies)])
    counts = {"dis": dis, "tokens": word_count(text)}
    counts |= {"mk_" + _col_name(c): count_expr(low, markers, c, case_insensitive=False) for c in mcats}
    # one scan and one shuffle: both sides are conditional sums of one aggregate;
    # the patterns run on patient messages only
    msg = turns.select("corpus", "session_id", *[F.when(spoken, e).alias(c) for c, e in counts.items()])
    of = lambda side, c: F.coalesce(F.sum(F.when(F.col("corpus") == side, F.col(c))), F.lit(0)).cast("bigint")
    j = msg.groupBy("session_id").agg(
        *[of(side, c).alias(f"{side}_{c}") for side in (left, right) for c in counts],
        *[F.bool_or(F.col("corpus") == side).alias(f"_{side}") for side in (left, right)])
    j = j.where(F.col(f"_{left}") & F.col(f"_{right}")).drop(f"_{left}", f"_{right}")
    ln = F.col(f"{left}_dis") / F.greatest(F.col(f"{left}_tokens"), F.lit(1))
    rn = F.col(f"{right}_dis") / F.greatest(F.col(f"{right}_tokens"), F.lit(1))
    return j.select("*", (F.col(f"{left}_dis") - F.col(f"{right}_dis")).alias("diff_dis"),
                    ln.alias(f"{left}_dis_norm"), rn.alias(f"{right}_dis_norm"), (ln - rn).alias("diff_norm"))


def macro_rates(paired: DataFrame, left: str = "real", right: str = "synthetic") -> DataFrame:
    """Mean of per-session rates and of their difference."""
    return paired.agg(F.avg(f"{left}_dis_norm").alias(f"{left}_mean_norm"),
                      F.avg(f"{right}_dis_norm").alias(f"{right}_mean_norm"),
                      F.avg("diff_norm").alias("mean_diff_norm"), F.count(F.lit(1)).alias("sessions"))


def marker_totals(paired: DataFrame, markers, left: str = "real", right: str = "synthetic") -> DataFrame:
    """Total disfluency and per-marker totals per side; ``ALL`` = every marker,
    ``disfluency`` = the substring total.  One aggregate over the sessions, then
    one row is turned into one for each marker."""
    mcats = categories(markers)
    col = lambda side, m: F.sum(f"{side}_mk_{_col_name(m)}")
    sums = {m: (col(left, m), col(right, m)) for m in mcats}
    sums["ALL"] = tuple(reduce(add, [col(side, m) for m in mcats]) for side in (left, right))
    sums["disfluency"] = (F.sum(f"{left}_dis"), F.sum(f"{right}_dis"))
    out = paired.agg(F.array(*[F.struct(F.lit(m).alias("marker"), l.alias(f"{left}_total"), r.alias(f"{right}_total"))
                               for m, (l, r) in sums.items()]).alias("_t")).select(F.inline("_t"))
    return out.withColumn("difference", F.col(f"{left}_total") - F.col(f"{right}_total"))


def micro_marker_rate(paired: DataFrame, markers, left: str = "real", right: str = "synthetic") -> DataFrame:
    """All markers per token, Σcount / max(Σtokens, 1), per side and difference."""
    mcats = categories(markers)

    def total(side):
        e = None
        for m in mcats:
            c = F.col(f"{side}_mk_{_col_name(m)}")
            e = c if e is None else e + c
        return e

    g = paired.agg(F.sum(total(left)).alias("l"), F.sum(total(right)).alias("r"),
                   F.sum(f"{left}_tokens").alias("lt"), F.sum(f"{right}_tokens").alias("rt"))
    ln = F.col("l") / F.greatest("lt", F.lit(1))
    rn = F.col("r") / F.greatest("rt", F.lit(1))
    return g.select(ln.alias(f"{left}_per_token"), rn.alias(f"{right}_per_token"), (ln - rn).alias("difference"))


def section_rates(paired: DataFrame, markers, exclude=None, keep=None,
                  left: str = "real", right: str = "synthetic") -> DataFrame:
    """Markers per 100 tokens by section (unmapped → Other), optionally
    excluding sections or keeping only some."""
    rows = as_rows(markers)
    section = {}
    for e in rows:
        section.setdefault(e.category, e.section or "Other")
    total = lambda side, m: F.sum(f"{side}_mk_{_col_name(m)}")
    tokens = [F.sum(f"{side}_tokens").alias(n) for side, n in ((left, "lt"), (right, "rt"))]
    parts = [F.struct(F.lit(section[m]).alias("section"), total(left, m).alias("l"), total(right, m).alias("r"), *tokens)
             for m in categories(markers)]
    # one aggregate over the sessions; what follows is one row for each marker
    one = paired.agg(F.array(*parts).alias("_p")).select(F.inline("_p"))
    g = one.groupBy("section").agg(F.sum("l").alias("l"), F.sum("r").alias("r"), F.max("lt").alias("lt"), F.max("rt").alias("rt"))
    if exclude:
        g = g.where(~F.col("section").isin(*exclude))
    if keep:
        g = g.where(F.col("section").isin(*keep))
    return g.select("section", (F.col("l") / F.nullif("lt", F.lit(0)) * 100.0).alias(f"{left}_per_100"),
                    (F.col("r") / F.nullif("rt", F.lit(0)) * 100.0).alias(f"{right}_per_100"))


def density_histogram(df: DataFrame, series_cols, bins: int = 10) -> DataFrame:
    """``bins`` equal bins between each series' own min and max (±0.5 when
    min = max), count and density = count / (n × width); all bins reported.
    The series are written once: their range and their bins need two passes."""
    df = cut_lineage(df.select(*series_cols))
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("x"))
                                        for c in series_cols]))).where(F.col("x").isNotNull())
    rng = long.groupBy("series").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))
    rng = rng.select("series", "n",
                     F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                     F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    rng = rng.withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    # rng has one row per series: a fixed-size broadcast side
    b = long.join(F.broadcast(rng), "series").select(
        "series", F.least(F.floor((F.col("x") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("bigint").alias("bin"))
    counts = b.groupBy("series", "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select("series", "n", "lo", "width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    grid = grid.withColumn("bin", F.col("bin").cast("bigint"))
    out = grid.join(counts, ["series", "bin"], "left").select(
        "series", "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
    return out.join(F.broadcast(rng.select("series", "n", "width")), "series").select(
        "series", "bin", "bin_start", "count", (F.col("count") / (F.col("n") * F.col("width"))).alias("density"))


def per_turn_disfluency(turns: DataFrame, disfluencies, max_turns: int = 12,
                        left: str = "real", right: str = "synthetic") -> DataFrame:
    """Per patient-turn index (first ``max_turns``, 1-based) the number of paired
    conversations reaching it and the mean disfluency rate (missing → 0.0)."""
    msg = message_disfluency(turns, disfluencies).where(F.col("patient_idx") < max_turns)
    msg = msg.join(paired_sessions(turns, left, right), "session_id", "left_semi")
    rate = F.col("dis_total") / F.greatest("tokens", F.lit(1))
    g = msg.groupBy("patient_idx").agg(
        F.sum((F.col("corpus") == left).cast("bigint")).alias(f"{left}_n_convos"),
        F.sum((F.col("corpus") == right).cast("bigint")).alias(f"{right}_n_convos"),
        F.avg(F.when(F.col("corpus") == left, rate)).alias("_l"),
        F.avg(F.when(F.col("corpus") == right, rate)).alias("_r"))
    return g.select((F.col("patient_idx") + 1).alias("turn_index"), f"{left}_n_convos", f"{right}_n_convos",
                    F.coalesce("_l", F.lit(0.0)).alias(f"{left}_mean_dis_norm"),
                    F.coalesce("_r", F.lit(0.0)).alias(f"{right}_mean_dis_norm"))


def marker_report(turns: DataFrame, lexicon, corpora=("real", "synthetic"), token_scale: int = 100,
                  max_turns: int | None = None) -> dict:
    """A3-A9 as one report: the session feature table (the only pass over the
    turn text) is persisted once and every table below is a small aggregate of
    it.  Call ``report["features"].unpersist()`` when done."""
    from pyspark import StorageLevel
    sess = session_markers(turns, lexicon, max_turns).persist(StorageLevel.MEMORY_AND_DISK)
    totals = corpus_totals(turns, sess, lexicon)
    metrics = normalized_metrics(totals, lexicon, token_scale)
    return {
        "features": sess,
        "totals": totals,
        "normalized": metrics,
        "per_conversation": per_conversation_stats(sess, lexicon),
        "matrix": marker_matrix(metrics, corpora),
        "dataset": dataset_statistics(totals),
    }
