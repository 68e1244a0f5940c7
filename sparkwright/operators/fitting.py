"""Fitting and choice of models: L2 logistic regression by Newton steps over sums of tasks, Platt scaling, and the simplest
candidate whose out-of-fold Brier score is within one standard error of the best.

Rows are (label, weight, fold, features): 0 or 1, a positive weight, a fold from 0 to ``FOLDS`` - 1, and numbers. A step of all
fits, those of every fold left out and every strength, is one pass: each task adds up gradient and curvature of its rows for
each fit, Spark sums these by fit and place, and the driver solves systems as large as the features, which are few.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.sources.scratch import materialize

FOLDS, STEPS, TOLERANCE, FLOOR = 5, 50, 1e-10, 1e-9
#: Strengths that are tried, that of Platt scaling, and the labels of each class that a regression needs.
STRENGTHS, PLATT, LEAST = (0.1, 0.3, 1.0, 3.0), 100.0, 10


@dataclass(frozen=True)
class Fit:
    """A regression on some of the features, of the rows outside some folds, at a strength."""

    columns: tuple[int, ...]
    without: tuple[int, ...]
    c: float


def _sums(fits: list[Fit], found: list[np.ndarray]):
    """Per fit: gradient and curvature of the loss of this task's rows, as one list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(len(b) * (len(b) + 1)) for b in found]
        for batch in batches:
            if not batch.num_rows:
                continue
            y, w, fold = (np.array(batch.column(c).to_numpy(zero_copy_only=False), float) for c in ("label", "weight", "fold"))
            x = np.array(batch.column("features").to_pylist(), float)
            for total, fit, beta in zip(totals, fits, found, strict=True):
                part = ~np.isin(fold, fit.without)
                d = np.c_[x[part][:, fit.columns], np.ones(part.sum())]
                p = 1 / (1 + np.exp(-np.clip(d @ beta, -500, 500)))
                v = w[part] * np.maximum(p * (1 - p), FLOOR)
                total += np.r_[d.T @ (w[part] * (p - y[part])), ((d * v[:, None]).T @ d).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(fits)), pa.int32()), pa.array([t.tolist() for t in totals], pa.list_(pa.float64()))], names=["fit", "sums"])

    return run


def newton(rows: DataFrame, fits: list[Fit]) -> list[np.ndarray]:
    """Weights and bias of each fit: the least of half the squared weights plus c times the weighted losses.

    Steps of a fit that no longer moves are no-ops; with separable classes the penalty keeps weights finite. Without rows
    all weights are 0.
    """
    found = [np.zeros(len(f.columns) + 1) for f in fits]
    narrow = rows.select("label", "weight", "fold", "features")
    moving = set(range(len(fits)))
    for _ in range(STEPS):
        at = sorted(moving)
        parts = narrow.mapInArrow(_sums([fits[i] for i in at], [found[i] for i in at]), "fit int, sums array<double>")
        summed = parts.select("fit", F.posexplode("sums").alias("place", "value")).groupBy("fit", "place").agg(F.sum("value").alias("value")).toArrow()
        table: dict[int, np.ndarray] = {k: np.zeros(len(found[i]) * (len(found[i]) + 1)) for k, i in enumerate(at)}
        for k, place, value in zip(*(summed[c].to_pylist() for c in ("fit", "place", "value")), strict=True):
            table[k][place] = value
        for k, i in enumerate(at):
            beta, n = found[i], len(found[i])
            penalty = np.r_[np.ones(n - 1), 0.0]
            gradient = fits[i].c * table[k][:n] + penalty * beta
            curvature = fits[i].c * table[k][n:].reshape(n, n) + np.diag(penalty)
            step = np.linalg.lstsq(curvature, gradient, rcond=None)[0]
            found[i] = beta - step
            if np.abs(step).max() < TOLERANCE:
                moving.discard(i)
        if not moving:
            break
    return found


def score(columns: tuple[int, ...], beta: np.ndarray) -> Column:
    """The logit of a row's features."""
    total = F.lit(float(beta[-1]))
    for c, b in zip(columns, beta[:-1], strict=True):
        total = total + F.get("features", F.lit(c)) * F.lit(float(b))
    return total


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


@dataclass(frozen=True)
class Model:
    """P(label 1) of a row; without columns it is ``rate`` for all."""

    rate: float
    columns: tuple[int, ...] = ()
    beta: tuple[float, ...] = ()
    c: float = 0.0
    a: float = 1.0
    b: float = 0.0

    def probability(self) -> Column:
        return sigmoid(F.lit(self.a) * score(self.columns, np.array(self.beta)) + F.lit(self.b)) if self.columns else F.lit(self.rate)


@dataclass(frozen=True)
class Candidate:
    name: str
    brier: float | None
    error: float | None
    skipped: str | None = None


def _prior(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum(F.col("weight") * F.col("label")).alias("fails"), F.sum("weight").alias("all"))


def _regression(rows: DataFrame, columns: tuple[int, ...], folds: list[int]) -> tuple[Model, Column]:
    """The model fitted on all rows, and a column with what models fitted without a row's own fold say of it.

    A model's strength and calibration come from its own rows by folds within them: for a model without fold k, from fits
    without k and another fold.
    """
    outer = [(), *((k,) for k in folds)]
    fits = {}
    for left in outer:
        for c in STRENGTHS:
            fits[left, c] = Fit(columns, left, c)
            fits |= {(tuple(sorted((*left, j))), c): Fit(columns, tuple(sorted((*left, j))), c) for j in folds if j not in left}
    betas = dict(zip(fits, newton(rows, list(fits.values())), strict=True))

    def raw(left: tuple[int, ...], c: float) -> Column:
        """What is said of a row of fold j by the fit without ``left`` and j."""
        out = F.lit(None).cast("double")
        for j in folds:
            if j not in left:
                out = F.when(F.col("fold") == j, score(columns, betas[tuple(sorted((*left, j))), c])).otherwise(out)
        return out

    errors = []
    for i, left in enumerate(outer):
        part = ~F.col("fold").isin(*left) if left else F.lit(True)
        for j, c in enumerate(STRENGTHS):
            e = F.when(part, F.pow(sigmoid(raw(left, c)) - F.col("label"), 2) * F.col("weight"))
            errors.append(F.sum(e).alias(f"e{i}_{j}"))
    sums = rows.agg(*errors).first()
    best = [STRENGTHS[min(range(len(STRENGTHS)), key=lambda j: (sums[f"e{i}_{j}"] or 0.0, j))] for i in range(len(outer))]
    raws = materialize(rows.select("label", "weight", "fold", F.array(*(F.coalesce(raw(left, c), F.lit(0.0)) for left, c in zip(outer, best, strict=True))).alias("features")))
    scales = newton(raws, [Fit((i,), left, PLATT) for i, left in enumerate(outer)])
    said = F.lit(None).cast("double")
    for (k,), c, (a, b) in zip(outer[1:], best[1:], scales[1:], strict=True):
        said = F.when(F.col("fold") == k, sigmoid(F.lit(float(a)) * score(columns, betas[(k,), c]) + F.lit(float(b)))).otherwise(said)
    return Model(0.5, columns, tuple(map(float, betas[(), best[0]])), best[0], *map(float, scales[0])), said


def choose(rows: DataFrame, candidates: list[tuple[str, tuple[int, ...]]]) -> tuple[str, Model, list[Candidate]]:
    """The chosen candidate's name, the model fitted on all rows, and how all candidates did.

    Candidates are names with the features that they read, simplest first; the first of all is the rate, which reads none.
    One that can't be fitted, with under LEAST labels of a class or rows of one fold only, is skipped. Rows without a label
    or with weight 0 or less are left out; without any row the rate is a half.
    """
    rows = materialize(rows.where("label is not null and weight > 0"))
    by_fold = {r.fold: (r.fails, r.all, r.n1, r.n) for r in rows.groupBy("fold").agg(F.sum(F.col("weight") * F.col("label")).alias("fails"), F.sum("weight").alias("all"), F.sum(F.col("label").cast("long")).alias("n1"), F.count("*").alias("n")).collect()}
    folds = sorted(by_fold)
    total = lambda i, out=None: sum(v[i] for k, v in by_fold.items() if k != out)
    prior = lambda out=None: (total(0, out) + 0.5) / (total(1, out) + 1.0)
    rate = F.lit(0.5)
    for k in folds:
        rate = F.when(F.col("fold") == k, F.lit(float(prior(k)))).otherwise(rate)
    fitted = [("rate", Model(float(prior())), rate)]
    skipped = []
    few = min(total(2), total(3) - total(2)) < LEAST
    for name, columns in candidates:
        if few or len(folds) < 3:
            skipped.append(Candidate(name, None, None, f"fewer than {LEAST} labels per class" if few else "fewer than 3 folds"))
        else:
            fitted.append((name, *_regression(rows, columns, folds)))
    weight, error = F.col("weight"), lambda p: F.pow(p - F.col("label"), 2)
    firsts = [F.sum(weight * error(p)).alias(f"s{i}") for i, (_, _, p) in enumerate(fitted)]
    seconds = [F.sum(weight * error(p) * error(p)).alias(f"q{i}") for i, (_, _, p) in enumerate(fitted)]
    sums = rows.agg(F.sum(weight).alias("w"), F.count("*").alias("n"), *firsts, *seconds).first()
    if not sums.n:
        return "rate", fitted[0][1], [Candidate("rate", None, None), *skipped]
    done = []
    for i, (name, _, _) in enumerate(fitted):
        mean = sums[f"s{i}"] / sums.w
        done.append(Candidate(name, mean, float(np.sqrt(max(0.0, sums[f"q{i}"] / sums.w - mean * mean) / sums.n))))
    best = min(done, key=lambda d: d.brier)
    at = next(i for i, d in enumerate(done) if d.brier <= best.brier + best.error)
    return done[at].name, fitted[at][1], [*done, *skipped]
