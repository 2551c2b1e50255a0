"""Situation ↔ conversation similarity.

Per session: the patient messages (role ``assistant``, empties kept) joined by a
space, and the session's situation text, both cleaned (P8).  Word-set and
n-gram-set Jaccard are row-local array set operations; ROUGE-1 recall counts
tokens with one shuffle on (session, token) instead of a per-row nested scan,
so it stays linear in text length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkframe.functions.text import clean_words, jaccard_pct, ngrams, rouge_tokens
from talkframe.lexicons import ENGLISH_STOP_WORDS
from talkframe.operators.turns import SESSION
from talkframe.session import written


def patient_text(turns: DataFrame) -> DataFrame:
    """Patient messages of each session joined by a space (conversation-bounded)."""
    p = turns.where(F.col("role") == "assistant").select(*SESSION, "turn", F.coalesce("text", F.lit("")).alias("text"))
    g = p.groupBy(*SESSION).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("_m"))
    return g.select(*SESSION, F.array_join(F.transform("_m", lambda m: m["text"]), " ").alias("patient_text"))


def with_situation(texts: DataFrame, situations: DataFrame, key: str = "session_id") -> DataFrame:
    """Attach the situation text; sessions with an empty situation are skipped
    (the reference tests emptiness, not blankness).  Plain equi-join: AQE
    broadcasts a side only when it is small at run time."""
    s = situations.select(F.col(key).alias("session_id"), F.col("situation"))
    return texts.join(s, "session_id", "inner").where(F.col("situation") != "")


def cleaned(df: DataFrame, stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    return df.withColumn("cand_words", clean_words("patient_text", stop_words)).withColumn(
        "target_words", clean_words("situation", stop_words))


def rouge1_recall(df: DataFrame) -> DataFrame:
    """Clipped unigram overlap / max(#target tokens, 1) per session; ROUGE
    tokenizer (lower-case ``[a-z0-9]+``, no stemming) on the cleaned texts.

    Both token lists become rows with a count for either side, partially
    aggregated per (session, token); the clipped overlap is the sum of the
    smaller counts."""
    side = lambda c, t: F.transform(rouge_tokens(F.array_join(c, " ")),
                                    lambda x: F.struct(x.alias("tok"), F.lit(t).alias("t"), F.lit(1 - t).alias("c")))
    tokens = df.select(*SESSION, F.inline_outer(F.concat(side("target_words", 1), side("cand_words", 0))))
    per = tokens.groupBy(*SESSION, "tok").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    g = per.groupBy(*SESSION).agg(F.sum(F.least("t", "c")).alias("o"), F.sum("t").alias("n"))
    return g.select(*SESSION, (F.coalesce("o", F.lit(0)) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("rouge1_recall"))


def similarity_metrics(turns: DataFrame, situations: DataFrame, ngram_n: int = 2,
                       stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """A50 + A51 + A52 per session with a situation.  The patient side is cleaned
    where it is aggregated (before the join), the situation side after the join
    (only matched documents are cleaned); the Jaccards are one projection, the
    ROUGE counts one aggregate over the tokens."""
    texts = patient_text(turns).withColumn("cand_words", clean_words("patient_text", stop_words))
    df = with_situation(texts, situations).withColumn("target_words", clean_words("situation", stop_words))
    jaccards = df.select(*SESSION, jaccard_pct("cand_words", "target_words").alias("word_overlap_percentage"),
                         jaccard_pct(ngrams("cand_words", ngram_n), ngrams("target_words", ngram_n)).alias("ngram_overlap_percentage"))
    return jaccards.join(rouge1_recall(df), SESSION)


def describe(metrics: DataFrame, cols, digits: int = 5) -> DataFrame:
    """Mean, min, max, sample std per metric, rounded."""
    long = metrics.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in cols])))
    g = long.groupBy("metric").agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"),
                                   F.stddev_samp("v").alias("std"))
    return g.select("metric", *[F.round(c, digits).alias(c) for c in ("mean", "min", "max", "std")])


# --- A53: embedding-match recall ------------------------------------------------

@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _block_max_cosine(targets: pd.Series, cands: pd.Series) -> pd.Series:
    """For each target vector of a block, the max cosine to the candidate block."""
    out = []
    for tb, cb in zip(targets, cands):
        out.append((_unit(tb) @ _unit(cb).T).max(axis=1).tolist())
    return pd.Series(out)


#: Signs of random projections that order vectors; alike ones share the leading ones.
_SIGNS = 24
#: Added to angles, so that rounding prunes nothing that counts.
_SLACK = 1e-6


@F.pandas_udf(T.LongType())
def _signs(vecs: pd.Series) -> pd.Series:
    planes: dict = {}
    out = []
    for v in vecs:
        if len(v) not in planes:
            planes[len(v)] = np.random.default_rng([11, len(v)]).normal(size=(len(v), _SIGNS))
        out.append(int(((np.asarray(v, np.float64) @ planes[len(v)]) > 0) @ (1 << np.arange(_SIGNS)[::-1])))
    return pd.Series(out, dtype="int64")


def _unit(vecs) -> np.ndarray:
    a = np.asarray([np.asarray(v, np.float64) for v in vecs])
    n = np.linalg.norm(a, axis=1, keepdims=True)
    return np.divide(a, n, out=np.zeros_like(a), where=n > 0)


_BLOCK = T.StructType([T.StructField("rows", T.ArrayType(T.IntegerType())), T.StructField("center", T.ArrayType(T.DoubleType())),
                       T.StructField("radius", T.DoubleType())])
#: Blocks that a group of alike vectors is cut into, about.
_CUTS = 16


def _balls(u: np.ndarray, size: int) -> list:
    """Unit vectors cut into blocks around pivots: (rows, center, greatest angle) each.

    Each pivot is the vector farthest from those before it, and vectors go to the
    nearest pivot; a pivot of more than ``size`` vectors gets several blocks.  A
    vector without length is at a right angle to all."""
    near, home, pivot = np.full(len(u), -np.inf), np.zeros(len(u), np.int64), 0
    for k in range(-(-len(u) // size)):
        dot = u @ u[pivot]
        home[dot > near] = k
        near = np.maximum(near, dot)
        pivot = int(near.argmin())
    out = []
    for k in range(home.max(initial=-1) + 1):
        own = np.flatnonzero(home == k)
        for rows in np.array_split(own, -(-len(own) // size)) if len(own) else []:
            c = u[rows].sum(axis=0)
            c = c / np.linalg.norm(c) if np.linalg.norm(c) > 0 else np.eye(1, u.shape[1])[0]
            angle = np.where(u[rows].any(axis=1), np.arccos(np.clip(u[rows] @ c, -1, 1)), np.pi / 2)
            out.append({"rows": rows.tolist(), "center": c.tolist(), "radius": float(angle.max())})
    return out


def _cut(size: int):
    @F.pandas_udf(T.ArrayType(_BLOCK))
    def cut(groups: pd.Series) -> pd.Series:
        return groups.map(lambda vecs: _balls(_unit(vecs), size))
    return cut


def _blocks(targets: DataFrame, candidates: DataFrame, doc: str, vid: str, vec: str, block_size: int) -> DataFrame:
    """(doc, side, blk, ids, vecs, center, radius): blocks of at most ``block_size`` vectors of a
    document's targets (side 0) or candidates (1) around pivots.  Vectors first go to groups
    of about ``_CUTS`` blocks, alike ones together (as many signs as the document needs; what
    overflows by a hash), so a huge document spreads over many tasks, and each group is
    cut into its blocks."""
    both = targets.selectExpr(f"`{doc}` AS doc", "0 AS side", f"`{vid}` AS id", f"`{vec}` AS v").unionByName(
        candidates.selectExpr(f"`{doc}` AS doc", "1 AS side", f"`{vid}` AS id", f"`{vec}` AS v"))
    group = block_size * _CUTS
    groups = both.sparkSession.sql(f"""
        WITH sizes AS (SELECT doc, side, count(*) AS n FROM {{both}} GROUP BY doc, side),
        coded AS (
          SELECT doc, side, id, v, shiftright(code, {_SIGNS} - CAST(greatest(0, least({_SIGNS}, ceil(log2(n / {group})))) AS INT)) AS code
          FROM {{coded}} JOIN sizes USING (doc, side)),
        parts AS (SELECT doc, side, code, ceil(count(*) / {group}) AS parts FROM coded GROUP BY doc, side, code)
        SELECT doc, side, struct(code, pmod(xxhash64(id), parts) AS part) AS grp, collect_list(struct(id, v)) AS m
        FROM coded JOIN parts USING (doc, side, code) GROUP BY doc, side, grp""",
                                      both=both, coded=both.withColumn("code", _signs("v")))
    cut = groups.select("doc", "side", "grp", "m", F.posexplode(_cut(block_size)(F.col("m.v"))).alias("cut", "b"))
    return cut.selectExpr("doc", "side", "struct(grp, cut) AS blk", "transform(b.rows, i -> m[i].id) AS ids",
                          "transform(b.rows, i -> m[i].v) AS vecs", "b.center", "b.radius")


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(doc, t_blk, c_blk, kept) of all pairs of a document's target and candidate blocks.

    Angles between members differ from the angle of the centers by the two radii at
    most.  So each target finds a candidate at the least of the greatest angles of its
    block's pairs, and a pair whose least angle is greater than that is not needed.
    Only centers meet here; a document's are dealt by its target blocks."""
    return blocks.sparkSession.sql(f"""
        WITH n AS (SELECT doc, CAST(ceil(count(*) / 64) AS INT) AS deals FROM {{b}} WHERE side = 0 GROUP BY doc),
        t AS (SELECT doc, CAST(pmod(xxhash64(blk), deals) AS INT) AS deal, blk AS t_blk, center AS tc, radius AS tr FROM {{b}} JOIN n USING (doc) WHERE side = 0),
        c AS (SELECT doc, explode(sequence(0, deals - 1)) AS deal, blk AS c_blk, center AS cc, radius AS cr FROM {{b}} JOIN n USING (doc) WHERE side = 1),
        j AS (SELECT doc, t_blk, c_blk, tr + cr + {_SLACK} AS spread,
                     acos(greatest(-1, least(1, aggregate(zip_with(tc, cc, (x, y) -> x * y), 0D, (s, x) -> s + x)))) AS angle
              FROM t JOIN c USING (doc, deal))
        SELECT doc, t_blk, c_blk, angle - spread <= min(angle + spread) OVER (PARTITION BY doc, t_blk) AS kept FROM j""", b=blocks)


def embedding_recall(targets: DataFrame, candidates: DataFrame, doc: str = "doc_id", vid: str = "vec_id",
                     vec: str = "embedding", block_size: int = 256) -> DataFrame:
    """Per document, mean over target vectors of the max cosine similarity to
    the document's candidate vectors (greedy matching, no idf).

    Exact: blocks of alike vectors meet, one row per (target block, candidate block)
    scored by one numpy matrix product, but for the pairs that an angle bound rules
    out (``block_pairs``).  The cosine with a vector without length is 0.
    """
    # written once: centers, targets and candidates are read of it in turn
    b = written(_blocks(targets, candidates, doc, vid, vec, block_size), "recall-blocks")
    j = targets.sparkSession.sql("""
        SELECT doc, t.ids AS t_ids, t.vecs AS t_vecs, c.vecs AS c_vecs FROM (SELECT * FROM {pairs} WHERE kept) p
        JOIN (SELECT doc, blk AS t_blk, ids, vecs FROM {b} WHERE side = 0) t USING (doc, t_blk)
        JOIN (SELECT doc, blk AS c_blk, vecs FROM {b} WHERE side = 1) c USING (doc, c_blk)""", pairs=block_pairs(b), b=b)
    scored = j.select("doc", "t_ids", _block_max_cosine("t_vecs", "c_vecs").alias("m"))
    return scored.sparkSession.sql(f"""
        SELECT doc AS `{doc}`, avg(best) AS embedding_recall, count(*) AS n_targets
        FROM (SELECT doc, z.t_ids, max(z.m) AS best FROM (SELECT doc, explode(arrays_zip(t_ids, m)) AS z FROM {{scored}}) GROUP BY doc, z.t_ids)
        GROUP BY doc""", scored=scored)
