"""Batched regression: many models fitted together over one frame.

A model is a set of design columns on one completed data set. Each Newton step is one Spark job
for all models at once: every task adds up its rows' small cross-product matrices, Spark sums
them per model, and only those matrices reach the driver. Models are never fitted in a loop of
jobs, and data rows are never copied per model.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.distributions import normal_two_sided
from cohortloom.session import materialize

SUMS_SCHEMA = "model int, k int, v double"
COEF_SCHEMA = (
    "model_id string, imp int, term string, estimate double, std_error double, statistic double, "
    "p_value double, exp_estimate double, loglik double, aic double, n bigint, converged boolean")


@dataclass(frozen=True)
class ModelSpec:
    """Name, design columns and, unless the frame has one data set only, the imputation."""

    model_id: str
    columns: tuple[str, ...]
    imp: int | None = None


@dataclass
class Fit:
    """Estimates of one model, with the inverse information as covariance."""

    spec: ModelSpec
    terms: list[str]
    beta: np.ndarray
    cov: np.ndarray
    loglik: float
    n: int
    converged: bool
    extra: dict = field(default_factory=dict)

    @property
    def aic(self) -> float:
        return -2.0 * self.loglik + 2.0 * len(self.beta)


#: ``evaluate(active, betas)`` gives (loglik, score, information, n) of the models with these numbers.
Evaluate = Callable[[list[int], list[np.ndarray]], list[tuple]]


def unpack(values: np.ndarray, q: int) -> np.ndarray:
    """Symmetric matrix from its upper triangle."""
    out = np.zeros((q, q))
    out[np.triu_indices(q)] = values
    return out + np.triu(out, 1).T


def solve(info: np.ndarray, score: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(info, score)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(info) @ score


def design_frame(df: DataFrame, specs: Sequence[ModelSpec], outcomes: Sequence[str],
                 imp: str | None) -> DataFrame:
    """The needed columns as numbers, written once since every step scans them again."""
    used = list(dict.fromkeys(c for s in specs for c in s.columns))
    cols = [F.col(f"`{c}`").cast("double").alias(c) for c in [*outcomes, *used]]
    imp_col = F.col(imp).cast("int") if imp else F.lit(0)
    return materialize(df.select(imp_col.alias("_imp"), *cols))


def model_rows(pdf: pd.DataFrame, spec: ModelSpec, outcomes: Sequence[str],
               intercept: bool) -> tuple[np.ndarray, np.ndarray]:
    """Outcome and design arrays of the complete rows that belong to a model."""
    own = slice(None) if spec.imp is None else pdf["_imp"].to_numpy() == spec.imp

    def part(columns: Sequence[str]) -> np.ndarray:
        return np.column_stack([np.zeros((len(pdf), 0)), *[pdf[c].to_numpy("float64") for c in columns]])[own]

    y, x = part(outcomes), part(spec.columns)
    ok = ~(np.isnan(y).any(axis=1) | np.isnan(x).any(axis=1))
    y, x = y[ok], x[ok]
    return y, np.column_stack([np.ones(len(x)), x]) if intercept else x


def batch_rows(frame: DataFrame, sizes: Sequence[int], add: Callable[[pd.DataFrame, int], np.ndarray]) -> DataFrame:
    """Sums of ``add(batch, model)`` over all rows for every model, one row per number: model, k, v."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = [np.zeros(n) for n in sizes]
        for pdf in batches:
            for i, total in enumerate(totals):
                total += add(pdf, i)
        yield pd.DataFrame({
            "model": np.repeat(np.arange(len(sizes)), sizes).astype("int32"),
            "k": np.concatenate([np.arange(n) for n in sizes]).astype("int32"),
            "v": np.concatenate(totals),
        })

    return frame.mapInPandas(task, SUMS_SCHEMA).groupBy("model", "k").agg(F.sum("v").alias("v"))


def batch_sums(frame: DataFrame, specs: Sequence[ModelSpec], sizes: Sequence[int],
               add: Callable[[pd.DataFrame, int], np.ndarray]) -> list[np.ndarray]:
    """Sum ``add(batch, model)`` over all rows for every model."""
    out = [np.zeros(n) for n in sizes]
    for r in batch_rows(frame, sizes, add).collect():
        out[r["model"]][r["k"]] = r["v"]
    return out


def newton(specs: Sequence[ModelSpec], dims: Sequence[int],
           evaluate: Callable[[list[int], list[np.ndarray]], list[tuple]],
           max_iter: int, tol: float, starts: Sequence[np.ndarray] | None = None, known: Sequence[tuple | None] = ()) -> list[tuple]:
    """Newton-Raphson with step halving for all models side by side.

    ``evaluate(active, betas)`` returns ``(loglik, score, information, n)`` per active model.
    Converged models drop out of the later jobs; ``starts`` are guesses to begin from. ``known`` has what ``evaluate`` would return
    there, or None, for each model: those it has begin without a job.
    """
    given = {i: state for i, state in enumerate(known) if state is not None}
    beta = [np.zeros(d) for d in dims] if starts is None else [np.array(b, float) for b in starts]
    step = [np.zeros(d) for d in dims]
    best: list[tuple | None] = [None] * len(specs)
    done = [False] * len(specs)
    halvings = [0] * len(specs)
    active = list(range(len(specs)))
    for _ in range(max_iter):
        trial = {i: beta[i] + step[i] for i in active}
        asked = [i for i in active if i not in given]
        states = given | (dict(zip(asked, evaluate(asked, [trial[i] for i in asked]))) if asked else {})
        given = {}
        for i in active:
            b, state = trial[i], states[i]
            ll, score, info, _n = state
            old = best[i]
            if old is not None and not ll >= old[0] - 1e-9 * (abs(old[0]) + 1.0) and halvings[i] < 30:
                step[i] = step[i] / 2.0
                halvings[i] += 1
                continue
            halvings[i] = 0
            beta[i], best[i] = b, state
            step[i] = solve(info, score)
            gain = float(score @ step[i]) if len(score) else 0.0
            done[i] = len(score) == 0 or gain < tol
            if done[i]:
                # the last step is taken without a job; half the gain is its rise in likelihood
                beta[i] = b + step[i]
                best[i] = (ll + gain / 2.0, score, info, _n)
        active = [i for i in active if not done[i]]
        if not active:
            break
    return [(beta[i], best[i], done[i]) for i in range(len(specs))]


def _finish(specs, results, terms_of) -> list[Fit]:
    fits = []
    for spec, (beta, state, done) in zip(specs, results):
        ll, _score, info, n = state
        cov = np.linalg.pinv(info) if len(beta) else np.zeros((0, 0))
        singular = len(beta) > 0 and np.linalg.matrix_rank(info) < len(beta)
        fits.append(Fit(spec, terms_of(spec), beta, cov, float(ll), int(n), done and not singular))
    return fits


def logistic_evaluator(frame: DataFrame, y: str, specs: Sequence[ModelSpec]) -> Evaluate:
    """Likelihood, score, information and row count of logistic models at given coefficients, in one job for all."""
    dims = [len(s.columns) + 1 for s in specs]

    def evaluate(active: list[int], betas: list[np.ndarray]) -> list[tuple]:
        chosen = [specs[i] for i in active]
        q = [dims[i] for i in active]
        sizes = [d * (d + 1) // 2 + d + 2 for d in q]

        def add(pdf: pd.DataFrame, m: int) -> np.ndarray:
            obs, x = model_rows(pdf, chosen[m], [y], True)
            eta = x @ betas[m]
            prob = np.exp(-np.logaddexp(0.0, -eta))
            weight = prob * (1.0 - prob)
            info = x.T @ (x * weight[:, None])
            ll = float(np.sum(obs[:, 0] * eta - np.logaddexp(0.0, eta)))
            return np.concatenate([info[np.triu_indices(q[m])], x.T @ (obs[:, 0] - prob), [ll, len(x)]])

        out = []
        for d, v in zip(q, batch_sums(frame, chosen, sizes, add)):
            t = d * (d + 1) // 2
            out.append((v[t + d], v[t:t + d], unpack(v[:t], d), v[t + d + 1]))
        return out

    return evaluate


def fit_logistic(df: DataFrame, y: str, specs: Sequence[ModelSpec], imp: str | None = None,
                 max_iter: int = 50, tol: float = 1e-12, prepared: bool = False,
                 starts: Sequence[np.ndarray] | None = None, known: Sequence[tuple | None] = ()) -> list[Fit]:
    """Logistic regression of every spec; rows with a missing value are left out per model. ``known`` as in ``newton``."""
    specs = list(specs)
    frame = df if prepared else design_frame(df, specs, [y], imp)
    results = newton(specs, [len(s.columns) + 1 for s in specs], logistic_evaluator(frame, y, specs), max_iter, tol, starts, known)
    return _finish(specs, results, lambda s: ["(Intercept)", *s.columns])


def fit_linear(df: DataFrame, y: str, specs: Sequence[ModelSpec], imp: str | None = None,
               prepared: bool = False) -> list[Fit]:
    """Least squares of every spec in one pass over the rows."""
    specs = list(specs)
    frame = df if prepared else design_frame(df, specs, [y], imp)
    dims = [len(s.columns) + 1 for s in specs]
    sizes = [d * (d + 1) // 2 + d + 2 for d in dims]

    def add(pdf: pd.DataFrame, m: int) -> np.ndarray:
        obs, x = model_rows(pdf, specs[m], [y], True)
        gram = x.T @ x
        return np.concatenate([gram[np.triu_indices(dims[m])], x.T @ obs[:, 0],
                               [float(obs[:, 0] @ obs[:, 0]), len(x)]])

    fits = []
    for spec, d, v in zip(specs, dims, batch_sums(frame, specs, sizes, add)):
        t = d * (d + 1) // 2
        gram, moment, yy, n = unpack(v[:t], d), v[t:t + d], v[t + d], v[t + d + 1]
        beta = solve(gram, moment)
        rss = max(float(yy - beta @ moment), 0.0)
        sigma2 = rss / (n - d) if n > d else np.nan
        ll = -0.5 * n * (np.log(2 * np.pi * rss / n) + 1) if rss > 0 else np.inf
        fits.append(Fit(spec, ["(Intercept)", *spec.columns], beta, np.linalg.pinv(gram) * sigma2,
                        float(ll), int(n), True))
    return fits


def coefficients(spark: SparkSession, fits: Sequence[Fit], intercept: bool = False) -> DataFrame:
    """Coefficient table of the fits; normal tail for the p-value."""
    rows = []
    for f in fits:
        se = np.sqrt(np.clip(np.diag(f.cov), 0, None))
        for term, b, s in zip(f.terms, f.beta, se):
            if term == "(Intercept)" and not intercept:
                continue
            z = float(b / s) if s > 0 else float("nan")
            ratio = math.exp(b) if b < 700 else math.inf
            rows.append((f.spec.model_id, f.spec.imp, term, float(b), float(s), z,
                         normal_two_sided(z), ratio, f.loglik, f.aic, f.n, f.converged))
    return spark.createDataFrame(rows, COEF_SCHEMA)


def univariate_specs(terms: dict[str, Sequence[str]], imps: Sequence[int | None] = (None,)) -> list[ModelSpec]:
    """One model per variable and imputation; a factor brings all its columns."""
    return [ModelSpec(v, tuple(cols), i) for v, cols in terms.items() for i in imps]


def joint_specs(name: str, terms: dict[str, Sequence[str]], imps: Sequence[int | None] = (None,)) -> list[ModelSpec]:
    """The model with all variables, once per imputation."""
    columns = tuple(c for cols in terms.values() for c in cols)
    return [ModelSpec(name, columns, i) for i in imps]
