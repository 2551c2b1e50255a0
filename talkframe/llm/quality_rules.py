"""Quality rules: a learned decision list over document statistics.

Sequential covering on labelled statistics: a rule (a conjunction of threshold
tests) is grown on two thirds of the sample by information gain, pruned from
its end on the other third, kept if it is precise there, and the rows that it
covers leave the sample; then the next rule is learned.  The result is an
ordered list that turns into one Spark conditional expression.

Learning uses a bounded sample (``sample_rows`` labelled rows, the smallest by
a hash of the id); applying it is one scan of the texts with no shuffle.

Cases: a null or empty text has zero counts; rows with a null label teach
nothing; with no labels, or none of the class to reject, the list is empty and
rejects nothing.  Repeated rows are judged alike; a label is learned once from the
rows that share its id (the least of their statistics).  Input columns of any name
are kept: what is added has a name that the input does not use.  An empty table
has no sample, no rules and no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.llm import doc_stats


@dataclass(frozen=True)
class Test:
    feature: str
    op: str  # ">=" or "<="
    threshold: float


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    precision: float
    covered: int


def _holds(x: np.ndarray, names, tests) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for t in tests:
        v = x[:, names.index(t.feature)]
        hit &= v >= t.threshold if t.op == ">=" else v <= t.threshold
    return hit


def _gain(p, n, p0, n0):
    """FOIL's information gain of covering p of p0 positives, n of n0 negatives."""
    before = np.log2((p0 + 1e-9) / (p0 + n0 + 1e-9))
    return p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - before)


def _grow(x, y, names, max_tests, cuts):
    tests, inside = [], np.ones(len(x), bool)
    while len(tests) < max_tests and inside.any() and (~y[inside]).any():
        p0, n0 = int(y[inside].sum()), int((~y[inside]).sum())
        best = (1e-6, None)
        for j, name in enumerate(names):
            v = x[inside, j]
            order = np.argsort(v, kind="stable")
            s, pos = v[order], np.cumsum(y[inside][order])
            for c in cuts[j]:
                below = int(np.searchsorted(s, c, side="right"))
                above = int(np.searchsorted(s, c, side="left"))
                p_low = int(pos[below - 1]) if below else 0
                p_high = p0 - (int(pos[above - 1]) if above else 0)
                for op, p, m in (("<=", p_low, below), (">=", p_high, len(s) - above)):
                    g = _gain(p, m - p, p0, n0)
                    if m < len(s) and g > best[0]:
                        best = (g, Test(name, op, float(c)))
        if best[1] is None:
            break
        tests.append(best[1])
        inside = _holds(x, names, tests)
    return tests


def _prune(x, y, names, tests):
    """Cut tests off the end while that raises (p - n) / (p + n) on held rows."""
    def worth(ts):
        hit = _holds(x, names, ts)
        p, n = int(y[hit].sum()), int((~y[hit]).sum())
        return (p - n) / (p + n) if p + n else -1.0
    best = max(range(1, len(tests) + 1), key=lambda k: (worth(tests[:k]), -k))
    return tests[:best]


def learn(x: np.ndarray, reject: np.ndarray, names: list[str], max_rules: int = 12, max_tests: int = 4,
          min_precision: float = 0.9, min_cover: int = 5, seed: int = 7) -> list[Rule]:
    """Ordered rules for the rows to reject, from a local sample."""
    names, rules = list(names), []
    order = np.random.default_rng(seed).permutation(len(x))
    x, y = x[order], reject[order].astype(bool)
    held = np.arange(len(x)) % 3 == 2
    while len(rules) < max_rules and y[~held].sum() >= min_cover:
        cuts = [np.unique(np.quantile(x[~held, j], np.linspace(0, 1, 65))) for j in range(len(names))]
        positive = [np.unique(np.quantile(x[~held & y, j], np.linspace(0, 1, 33))) for j in range(len(names))]
        tests = _grow(x[~held], y[~held], names, max_tests,
                      [np.unique(np.concatenate(c)) for c in zip(cuts, positive)])
        if not tests:
            break
        tests = _prune(x[held], y[held], names, tests)
        hit = _holds(x, names, tests)
        p, covered = int(y[hit].sum()), int(hit.sum())
        if covered < min_cover or p < min_precision * covered:
            break
        rules.append(Rule(tuple(tests), p / covered, covered))
        x, y, held = x[~hit], y[~hit], held[~hit]
    return rules


def reject_column(rules: list[Rule], features: dict[str, Column]) -> Column:
    """The number of the first rule that a row meets, or null."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        cond = F.lit(True)
        for t in rules[i].tests:
            f = features[t.feature]
            cond = cond & ((f >= t.threshold) if t.op == ">=" else (f <= t.threshold))
        out = F.when(cond, F.lit(i + 1)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        sample_rows: int = 20_000, **how) -> list[Rule]:
    """Learn the list from ``labels`` (``label`` 0: to reject) on ``docs``.

    The sample has ``sample_rows`` rows at most, so it is broadcast: the texts
    are filtered where they are read and none is shuffled.
    """
    sample = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
              .select(F.col(key).alias("_key"), F.col(label).alias("_label"))
              .orderBy(F.xxhash64("_key"), "_key", "_label").limit(sample_rows))
    picked = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(sample), "_key")
    counted = doc_stats.with_counts(picked, "_text")
    features = doc_stats.ratios(lambda c: F.col(f"_counts.{c}"))
    each = F.struct(*[c.alias(n) for n, c in features.items()])
    once = counted.groupBy("_key", "_label").agg(F.min(each).alias("_f"))  # so no more rows than the sample has
    rows = once.select((F.col("_label") == 0).alias("reject"), "_f.*").toPandas()
    rows = rows.sort_values(list(rows.columns)).to_numpy(float)  # the order of arrival must not matter
    return learn(rows[:, 1:], rows[:, 0] > 0, list(features), **how)


def base_failed(of) -> Column:
    return (of("n_words") < 50) | (100 * of("n_repeat_words") > 50 * of("n_words"))


def judged(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``docs`` plus a struct of ``counts``, ``rule`` (the rejecting rule) and ``base_failed``,
    the last column, called ``_judged`` (with more underscores while ``docs`` has that name)."""
    name = "_judged"
    while name in docs.columns:
        name = f"_{name}"
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    out = doc_stats.with_counts(inner, inner.columns[docs.columns.index(text)])
    of = lambda c: F.col(f"_counts.{c}")
    verdict = F.struct(F.col("_counts").alias("counts"), reject_column(rules, doc_stats.ratios(of)).alias("rule"), base_failed(of).alias("base_failed"))
    return out.select(*[F.col(i).alias(c) for i, c in zip(inner.columns, docs.columns)], verdict.alias(name))


def kept(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    out = judged(docs, rules, text)
    verdict = F.col(out.columns[-1])
    return out.where(~verdict.base_failed & verdict.rule.isNull()).drop(out.columns[-1])
