"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= j | text) = sigmoid(w.x - theta_j) with one weight vector for all
grades and ordered thresholds theta_1 < theta_2 < ..  x holds the presence of
hashed lower-cased words (runs of letters, which are A-Z, a-z and all bytes beyond
ASCII) and of hashed marks (runs of anything else but ASCII white space), so a
word is the same one beside any mark.  Each is scaled by how surely it tells the rated grades
apart (a capped power of a z-score), so that the many words that stand in a few
rated texts by chance weigh little; it is not divided by the length, so one
telling word counts the same in a long text.  The expected
grade is the sum of the tail probabilities.

Fitting uses a bounded sample of the rated rows: those with the least hashes of
their ids, about ``max_rows`` of them, and of these again the least hashes whose
features together are at most ``max_features``.  Which rows that are is known
before any feature leaves the cluster, and does not depend on the order in which
rows arrive.  Scoring covers every row.

Defined cases: null and empty texts have only the bias and get the score of an
empty text; repeated rows get equal scores, and each counts in the fit; ratings
without a document and documents without a rating are fine; with fewer than two
grades rated every document gets the middle grade; an empty table gives an empty
result; other columns are ignored; texts may have any length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .shared import stage

BITS = 18
_MARK = np.ones(256, bool)
_MARK[65:91] = _MARK[97:123] = _MARK[128:] = False
_NO_MARK = ~_MARK | T._WS


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), .. of linear scores."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -500, 500)))


def _features(data, off):
    """Distinct feature numbers of each document, flat, with bounds."""
    runs = [T.Words(data, off, space) for space in (_MARK, _NO_MARK)]
    key = np.unique(np.concatenate([w.doc() << BITS | (w.hashes() >> np.uint64(64 - BITS)).astype(np.int64) for w in runs]))
    return key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(len(off)))


def _gather(batches):
    for b in batches:
        for lo, hi, data, off in T.slices(T.column(b, "text")):
            f, at = _features(data, off)
            same = [T.column(b, c).slice(lo, hi - lo) for c in ("hash", "grade")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(f.astype(np.int32)))], names=["hash", "grade", "n", "features"])


def _scales(features: list[np.ndarray], grades: np.ndarray, n_grades: int, sure: float = 6.0) -> np.ndarray:
    """Scale of each feature: the greatest z-score of its shares above and below any threshold, over ``sure``, at most 1, to the fourth power."""
    flat, owner = np.concatenate(features), np.repeat(grades, [len(f) for f in features])
    best = np.zeros(1 << BITS)
    for j in range(1, n_grades):
        above = int((grades >= j).sum())
        below = len(grades) - above
        if not above or not below:
            continue
        a, b = (np.bincount(flat[owner >= j if up else owner < j], minlength=1 << BITS) for up in (True, False))
        p = (a + b + 1) / (len(grades) + 2)
        best = np.maximum(best, np.abs(a / above - b / below) / np.sqrt(p * (1 - p) * (1 / above + 1 / below)))
    return np.minimum(best / sure, 1) ** 4


def slopes(z: float, y: int, theta: np.ndarray):
    """(-log P(y), its slope in z, [(j, its slope in theta_j)]).

    P(y) = s(z - theta_y) - s(z - theta_{y+1}), with theta_0 = -inf and theta_n = inf.
    """
    up = 1.0 if y == 0 else 1 / (1 + np.exp(np.clip(theta[y - 1] - z, -30, 30)))
    down = 0.0 if y == len(theta) else 1 / (1 + np.exp(np.clip(theta[y] - z, -30, 30)))
    p = max(up - down, 1e-9)
    du, dd = up * (1 - up), down * (1 - down)
    return -np.log(p), -(du - dd) / p, [(j, d) for j, d in ((y - 1, du / p), (y, -dd / p)) if 0 <= j < len(theta)]


def ordered(theta: np.ndarray) -> np.ndarray:
    """The nearest ordered thresholds: neighbours in the wrong order become their mean."""
    runs: list[tuple[float, int]] = []
    for t in theta.tolist():
        mean, k = t, 1
        while runs and runs[-1][0] > mean:
            before, n = runs.pop()
            mean, k = (before * n + mean * k) / (n + k), n + k
        runs.append((mean, k))
    return np.repeat([m for m, _ in runs], [k for _, k in runs])


def fit_arrays(features: list[np.ndarray], grades: np.ndarray, n_grades: int, epochs: int = 30, rate: float = 0.3, l2: float = 2e-5, seed: int = 11) -> Ordinal:
    """Adagrad on the negative log-likelihood of the cumulative-link model."""
    weights, square = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2)
    if len(set(grades.tolist())) < 2:
        return Ordinal(weights, np.zeros(n_grades - 1))
    share = np.array([(grades >= j).mean() for j in range(1, n_grades)]).clip(0.01, 0.99)
    theta = np.minimum.accumulate(-np.log(share / (1 - share))[::-1])[::-1].copy() if len(share) else share
    theta = np.maximum.accumulate(theta + np.arange(len(theta)) * 1e-3)
    t_square = np.full(len(theta), 1.0)
    scale = _scales(features, grades, n_grades)
    r = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in r.permutation(len(grades)):
            f, y = features[i], int(grades[i])
            x = scale[f]
            _, slope, steps = slopes((weights[f] * x).sum(), y, theta)
            g = slope * x + l2 * weights[f]
            square[f] += g * g
            weights[f] -= rate * g / np.sqrt(square[f])
            for j, d in steps:
                t_square[j] += d * d
                theta[j] -= rate * d / np.sqrt(t_square[j])
            theta = ordered(theta)
    return Ordinal(weights * scale, theta)


def fit(
    docs: DataFrame, ratings: DataFrame, n_grades: int, max_rows: int = 12_000, max_features: int = 8_000_000,
    id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", **args,
) -> Ordinal:
    """Model from ratings (id, grade 0 .. n_grades-1) of docs; see the module's text for ``max_rows`` and ``max_features``."""
    rated = ratings.where(F.col(grade_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(grade_col).cast("long").alias("grade"))
    share = int(min(1.0, max_rows / max(1, rated.count())) * 1_000_000)
    some = rated.withColumn("hash", F.xxhash64("id")).where(F.pmod("hash", F.lit(1_000_000)) < share)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(some), "id").select("hash", "grade", "text")
    rows = stage(rows.mapInArrow(_gather, "hash long, grade long, n long, features array<int>"), "rated")
    # the order and sizes of about max_rows rows tell which of them fit
    told = rows.select("hash", "n").toPandas().sort_values(["hash", "n"])
    fits = told["hash"][told["n"].cumsum() <= max_features]
    last = int(fits.iloc[-1]) if len(fits) < len(told) and len(fits) else None
    taken = rows if len(fits) == len(told) else rows.where(F.lit(False)) if last is None else rows.where(F.col("hash") <= last)
    told = taken.select("hash", "grade", "features").toArrow()
    order = np.lexsort((told["grade"].to_numpy(), told["hash"].to_numpy()))
    grades = told["grade"].to_numpy()[order]
    lists = told["features"]
    features = [lists[int(i)].values.to_numpy().astype(np.int64) for i in order]
    return fit_arrays(features, grades, n_grades, **args)


def _apply(model):
    def run(batches):
        m = model.value
        for b in batches:
            ids = T.column(b, "doc_id")
            for lo, hi, data, off in T.slices(T.column(b, "text")):
                f, at = _features(data, off)
                tails = m.tails(T.seg_sum(m.weights[f], at))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64()))], names=["doc_id", "expected_grade", "tails"])

    return run


def grade(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, tails) of each row: tails[j] is P(grade > j)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_apply(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, expected_grade double, tails array<double>")
