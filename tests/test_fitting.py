"""Fits against plain NumPy on the same rows."""

import numpy as np
import pytest

from sparkwright.operators import fitting
from sparkwright.plans import fitting as plans

KIND = "label double, weight double, fold int, features array<double>"
STRENGTHS = fitting.STRENGTHS


def plain_fit(x, y, w, c):
    d, beta = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    keep = np.r_[np.ones(x.shape[1]), 0.0]
    for _ in range(200):
        p = 1 / (1 + np.exp(-(d @ beta)))
        step = np.linalg.solve(c * (d.T * (w * np.maximum(p * (1 - p), 1e-9))) @ d + np.diag(keep), c * d.T @ (w * (p - y)) + keep * beta)
        beta = beta - step
        if np.abs(step).max() < 1e-12:
            break
    return beta


def plain_model(x, y, w, fold):
    """(weights, strength, platt) with both chosen by the folds of the rows given."""
    say = lambda b, x: np.c_[x, np.ones(len(x))] @ b
    raws = []
    for c in STRENGTHS:
        raw = np.zeros(len(y))
        for k in np.unique(fold):
            raw[fold == k] = say(plain_fit(x[fold != k], y[fold != k], w[fold != k], c), x[fold == k])
        raws.append(raw)
    at = int(np.argmin([(w * (1 / (1 + np.exp(-r)) - y) ** 2).sum() for r in raws]))
    return plain_fit(x, y, w, STRENGTHS[at]), STRENGTHS[at], plain_fit(raws[at][:, None], y, w, 100.0)


def plain_choice(x, y, w, fold, candidates):
    said = {"rate": np.array([(w[fold != k] @ y[fold != k] + 0.5) / (w[fold != k].sum() + 1) for k in fold])}
    for name, columns in candidates:
        p = np.zeros(len(y))
        for k in np.unique(fold):
            out = fold != k
            beta, _, (a, b) = plain_model(x[out][:, columns], y[out], w[out], fold[out])
            p[~out] = 1 / (1 + np.exp(-(a * (np.c_[x[~out][:, columns], np.ones((~out).sum())] @ beta) + b)))
        said[name] = p
    table = {}
    for name, p in said.items():
        e = (p - y) ** 2
        mean = w @ e / w.sum()
        table[name] = (mean, np.sqrt(w @ (e - mean) ** 2 / w.sum() / len(y)))
    best = min(table.values())
    return next(n for n, (m, _) in table.items() if m <= best[0] + best[1]), table


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(260, 4))
    y = (rng.random(260) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 3] + 0.3)))).astype(float)
    return x, y, rng.choice([0.5, 1.0, 2.0], 260), rng.integers(0, 5, 260)


def frame(spark, x, y, w, fold):
    return spark.createDataFrame([(float(b), float(c), int(d), a.tolist()) for a, b, c, d in zip(x, y, w, fold, strict=True)], KIND).repartition(5)


def test_coefficients_equal_numpy(spark, data):
    x, y, w, fold = data
    fits = [fitting.Fit((0, 1, 2, 3), (), 1.0), fitting.Fit((0, 3), (1, 4), 0.1), fitting.Fit((2,), (0,), 100.0)]
    for fit, beta in zip(fits, fitting.newton(frame(spark, *data), fits), strict=True):
        part = ~np.isin(fold, fit.without)
        assert np.abs(beta - plain_fit(x[part][:, fit.columns], y[part], w[part], fit.c)).max() < 1e-8


def test_choice_equals_numpy(spark, data):
    x, y, w, fold = data
    candidates = [("weak", (1, 2)), ("strong", (0, 1, 2, 3))]
    name, model, done = fitting.choose(frame(spark, *data), candidates)
    want, table = plain_choice(x, y, w, fold, candidates)
    assert name == want == "strong" and [d.name for d in done] == list(table)
    for d in done:
        assert abs(d.brier - table[d.name][0]) < 1e-8 and abs(d.error - table[d.name][1]) < 1e-8
    beta, c, (a, b) = plain_model(x, y, w, fold)
    assert np.abs(np.array(model.beta) - beta).max() < 1e-8 and model.c == c and abs(model.a - a) < 1e-6 and abs(model.b - b) < 1e-6
    got = sorted(r.p for r in frame(spark, *data).select(model.probability().alias("p")).collect())
    assert np.abs(np.array(got) - np.sort(1 / (1 + np.exp(-(a * (np.c_[x, np.ones(len(x))] @ beta) + b))))).max() < 1e-6


def test_what_cannot_be_fitted_is_skipped(spark, data):
    x, y, w, fold = data
    few = frame(spark, x[:12], np.r_[np.ones(11), 0], w[:12], fold[:12])
    name, model, done = fitting.choose(few, [("all", (0,))])
    assert name == "rate" and model.columns == () and done[1].skipped
    name, model, done = fitting.choose(few.limit(0), [("all", (0,))])
    assert (name, model.rate) == ("rate", 0.5)
    separable = frame(spark, x, (x[:, 0] > 0).astype(float), w, fold)
    assert np.isfinite(fitting.newton(separable, [fitting.Fit((0,), (), 3.0)])[0]).all()


def test_queries_on_documents(spark):
    rows = {r.name: r for r in plans.model_candidates(spark, "/root/testdata/sf0.01").collect()}
    assert set(rows) == {"rate", "lengths", "shape"} and sum(r.chosen for r in rows.values()) == 1
    assert min(r.brier for r in rows.values()) < rows["rate"].brier
    assert all(0 <= r.p <= 1 for r in plans.model_scores(spark, "/root/testdata/sf0.01").collect())
