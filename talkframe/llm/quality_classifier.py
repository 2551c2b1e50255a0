"""Quality classifier: random Fourier features, ridge, isotonic calibration.

Document statistics are standardised with the moments of the training rows and
mapped to ``width`` random cosine features, which approximate a Gaussian
kernel.  Every task sums the normal equations of its rows; the sums are added
by matrix row in Spark and one width x width system is solved on the driver
(its size does not depend on the data).  Raw scores are calibrated by pooling
adjacent violators over fixed-width score bins of other labelled rows.

Training rows: labelled and not held out.  Held out: crc32 of the key as text
mod 3 is 1.  Of the rest, remainder 0 fits the ridge and 2 the calibration.

Cases: null or empty texts have zero statistics and get a score; a null key is
never held out nor used for training; rows whose label is null teach nothing;
with no training rows (or one class only) every score is the known share of
label 1, or 0.5.  Repeated rows score alike.  An empty table has no scores and
teaches nothing.  Of the input only the key and the text are read and returned, the
key as ``_key``, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.llm import doc_stats

BINS = 512


@dataclass
class Model:
    names: list[str]
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    grid: np.ndarray
    level: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale, self.omega, self.phase) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.grid, self.level)


def fourier(z: np.ndarray, omega: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Cosine features of clipped standardised rows, plus a constant."""
    f = np.sqrt(2.0 / len(phase)) * np.cos(np.clip(z, -6, 6) @ omega + phase)
    return np.hstack([f, np.ones((len(z), 1))])


def features() -> list[Column]:
    """Statistics as doubles; counts enter by their logarithm."""
    of = lambda c: F.col(f"_counts.{c}")
    ratio = doc_stats.ratios(of)
    ratio["n_words"] = F.log1p(ratio["n_words"])
    ratio["words_per_line"] = F.log1p(ratio["words_per_line"])
    return [c.alias(n) for n, c in ratio.items()]


def fold(key: str) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3


def pool(total: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Isotonic means of weighted bins (pool adjacent violators)."""
    stack: list[list[float]] = []
    for w, s in zip(total, good):
        stack.append([w, s, 1])
        while len(stack) > 1 and stack[-2][1] * stack[-1][0] >= stack[-1][1] * stack[-2][0]:
            w1, s1, k1 = stack.pop()
            stack[-1] = [stack[-1][0] + w1, stack[-1][1] + s1, stack[-1][2] + k1]
    return np.concatenate([np.full(k, s / w) for w, s, k in stack])


def _matrix(batch, n):
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)]).astype(float)


def _normal_rows(train: DataFrame, names, mean, scale, omega, phase) -> tuple[np.ndarray, np.ndarray]:
    """Sums of f f' and f y over the rows, added up in Spark by matrix row."""
    size, n = len(phase) + 1, len(names)

    def partial(batches):
        a = np.zeros((size, size + 1))
        for b in batches:
            if b.num_rows:
                f = fourier((_matrix(b, n) - mean) / scale, omega, phase)
                a += f.T @ np.column_stack([f, b.column(n).to_numpy(zero_copy_only=False)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(list(a))], names=["i", "v"])

    def added(batches):
        a = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                v = v.values.to_numpy(zero_copy_only=False)
                a[i] = a[i] + v if i in a else v.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(a), pa.int64()), pa.array(list(a.values()), pa.list_(pa.float64()))], names=["i", "v"])

    kind = "i bigint, v array<double>"
    rows = train.mapInArrow(partial, kind).repartition("i").mapInArrow(added, kind).collect()
    out = np.zeros((size, size + 1))
    for r in rows:
        out[r.i] += r.v
    return out[:, :-1], out[:, -1]


def fit(stats: DataFrame, names: list[str], width: int = 192, gamma: float = 0.35, ridge: float = 1e-3,
        seed: int = 11) -> Model:
    """``stats``: the named features, ``y`` (0 or 1) and ``fold`` (0 fits, 2 calibrates)."""
    rng = np.random.default_rng(seed)
    omega = rng.normal(0, np.sqrt(2 * gamma / max(1, len(names))), (len(names), width))
    phase = rng.uniform(0, 2 * np.pi, width)
    base = stats.where("fold = 0")
    m = base.agg(F.count("y").alias("n"), F.avg("y").alias("p"),
                 *[f(c).alias(f"{k}_{c}") for c in names for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    known = stats.where("fold <> 1").agg(F.avg("y").alias("p")).first().p
    flat = Model(names, np.zeros(len(names)), np.ones(len(names)), omega, phase, np.zeros(width + 1),
                 np.array([0.0]), np.array([0.5 if known is None else known]))
    if not m.n or m.p in (0.0, 1.0):
        return flat
    mean = np.array([m[f"m_{c}"] for c in names])
    scale = np.array([m[f"s_{c}"] or 1.0 for c in names])
    a, b = _normal_rows(base.select(*names, F.col("y").cast("double")), names, mean, scale, omega, phase)
    a[np.diag_indices(width)] += ridge * m.n / width
    model = Model(names, mean, scale, omega, phase, np.linalg.lstsq(a, b, rcond=None)[0], flat.grid, flat.level)
    raw = score_column(model, raw=True)
    bins = (stats.where("fold = 2").select(raw.alias("r"), F.col("y").cast("double").alias("y"))
            .groupBy(F.least(F.lit(BINS), F.greatest(F.lit(-1), F.floor((F.col("r") + 0.5) * (BINS / 2)))).alias("bin"))
            .agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.avg("r").alias("r")).orderBy("bin").collect())
    if not bins:
        model.grid, model.level = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    level = pool(np.array([r.n for r in bins], float), np.array([r.s for r in bins], float))
    model.grid, model.level = np.array([r.r for r in bins]), level
    return model


def score_column(model: Model, raw: bool = False) -> Column:
    """The score of a row that has the model's feature columns."""
    def score(*cols: pa.Array) -> pa.Array:
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in cols])
        return pa.array(model.raw(x) if raw else model.score(x), pa.float64())
    score.__annotations__ = {}
    from collections.abc import Iterator

    def batches(it):
        for cols in it:
            yield score(*cols)
    batches.__annotations__ = {"it": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, "double")(*[F.col(n) for n in model.names])


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and features of every row; one scan of the whole texts."""
    picked = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return doc_stats.with_counts(picked, "_text").select("_key", *features())


def training(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Labelled rows that are not held out, with their fold."""
    marks = (labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
             .select(F.col(key).alias("_key"), F.col(label).alias("y")))
    return (stats.withColumn("fold", fold("_key")).where("fold <> 1").join(marks, "_key")
            .drop("_key"))
