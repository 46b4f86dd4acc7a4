"""Bidirectional stepwise selection by AIC: score and Wald tests of all moves at once, then fits of the likely ones."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from cohortloom.operators.cox import cox_evaluator, fit_cox, risk_frame
from cohortloom.operators.models import Evaluate, Fit, ModelSpec, design_frame, fit_logistic, logistic_evaluator

SEARCH_TOL = 1e-6
FINAL_TOL = 1e-12
PATH_SCHEMA = "imp int, step int, action string, aic double"


@dataclass
class Selection:
    """Chosen variables of one data set, its final fit and the way there."""

    imp: int | None
    variables: list[str]
    fit: Fit
    path: list[tuple[str, float]] = field(default_factory=list)


def _carried(spec: ModelSpec, fit: Fit) -> np.ndarray:
    """Starting values of a candidate: the current coefficients, zero for new columns."""
    known = dict(zip(fit.terms, fit.beta))
    terms = (["(Intercept)"] if "(Intercept)" in known else []) + list(spec.columns)
    return np.array([known.get(t, 0.0) for t in terms])


def sweep(matrix: np.ndarray, pivots: Sequence[int]) -> np.ndarray:
    """The matrix swept on the pivots: their block inverted, the others' block less what the pivots explain.

    A pivot that the earlier ones explain is left out.
    """
    out = matrix.astype("float64").copy()
    for k in pivots:
        d = out[k, k]
        if d <= 1e-12 * max(abs(matrix[k, k]), 1e-300):
            continue
        row, column = out[k].copy(), out[:, k].copy()
        out -= np.outer(column, row) / d
        out[k], out[:, k], out[k, k] = row / d, -column / d, 1.0 / d
    return out


def expected_changes(beta: np.ndarray, score: np.ndarray, info: np.ndarray, inside: Sequence[int],
                     columns: Mapping[str, Sequence[int]]) -> dict[str, float]:
    """AIC changes to expect of adding or dropping each variable, from one augmented information matrix.

    ``inside`` are the places of the current model's columns, ``columns`` those of each variable. One sweep gives the score statistic
    of every variable outside, adjusted for the model, and the Wald statistic of every one inside.
    """
    n = len(score)
    full = np.zeros((n + 1, n + 1))
    full[:n, :n], full[:n, n], full[n, :n] = info, score, score
    swept, within, out = sweep(full, inside), set(inside), {}
    for v, at in columns.items():
        at = list(at)
        block = np.linalg.pinv(swept[np.ix_(at, at)], hermitian=True)
        if within.issuperset(at):
            out[v] = float(beta[at] @ block @ beta[at]) - 2.0 * len(at)
        else:
            out[v] = 2.0 * len(at) - float(swept[at, n] @ block @ swept[at, n])
    return out


def _likely(expected: Mapping[str, float]) -> set[str]:
    """Variables whose move may be the best: expected within half the best change, and two, of it."""
    best = min(expected.values())
    return {v for v, e in expected.items() if e <= best + 2.0 + 0.5 * abs(best)}


def stepwise_aic(fit_many: Callable[..., list[Fit]], terms: Mapping[str, Sequence[str]],
                 imps: Sequence[int | None] = (None,), max_steps: int = 200,
                 evaluator: Callable[[Sequence[ModelSpec]], Evaluate] | None = None) -> list[Selection]:
    """Start from the model without variables; add or drop one variable while AIC falls.

    ``fit_many(specs, starts, tol)`` fits a batch, with an ``evaluator`` also ``known`` evaluations at the starts (as in ``newton``). Every data set follows its own way, but the
    moves of all of them share each batch. A factor enters or leaves with all its columns.
    With an ``evaluator``, one evaluation of all columns at the current coefficients tells how much each move should change AIC; only
    those near the best are fitted, and AIC of the fits decides. Before a search ends, all moves whose expected change
    falls short of an improvement by less than one a column are fitted too. Where the columns outside the model lack values, so that
    the evaluation is of other rows than the model's, and without an evaluator, every move is fitted.
    Candidates start from the coefficients of the model they change and stop as soon as their
    likelihood is settled; the chosen models are fitted to full precision at the end. A candidate that does not converge never wins.
    """
    everything = [c for v in terms for c in terms[v]]

    def spec(variables: Sequence[str], imp: int | None) -> ModelSpec:
        cols = tuple(c for v in variables for c in terms[v])
        return ModelSpec("+".join(variables) or "1", cols, imp)

    def expectations(running: Sequence[Selection]) -> list[tuple[dict[str, float], Callable | None] | None]:
        """Expected changes of each search and what an added variable's model evaluates to at the current coefficients."""
        if evaluator is None or not everything:
            return [None] * len(running)
        specs = [spec(list(terms), sel.imp) for sel in running]
        betas = [_carried(s, sel.fit) for s, sel in zip(specs, running)]
        out = []
        for sel, b, (ll, score, info, n) in zip(running, betas, evaluator(specs)(list(range(len(specs))), betas)):
            first = len(b) - len(everything)
            places = {c: first + k for k, c in enumerate(everything)}
            columns = {v: [places[c] for c in terms[v]] for v in terms}
            inside = [*range(first), *(k for v in sel.variables for k in columns[v])]
            same_rows = n == sel.fit.n and abs(ll - sel.fit.loglik) <= 1e-3 + 1e-6 * abs(ll)

            def begin(variables, first=first, columns=columns, state=(ll, score, info, n)):
                at = [*range(first), *(k for v in variables for k in columns[v])]
                return state[0], state[1][at], state[2][np.ix_(at, at)], state[3]

            # near is enough to rank moves, but a start must be of the very rows: one row less at risk shows in the likelihood
            exact = abs(ll - sel.fit.loglik) <= 1e-6 + 1e-10 * abs(ll)
            out.append((expected_changes(b, score, info, inside, columns), begin if exact else None) if same_rows else None)
        return out

    def tried(moves: list[tuple[Selection, str]], begins: Mapping[int, Callable]) -> list[tuple[float, Selection, str, list[str], Fit]]:
        sets = [[u for u in sel.variables if u != v] if v in sel.variables else [*sel.variables, v] for sel, v in moves]
        specs = [spec(vs, sel.imp) for (sel, _v), vs in zip(moves, sets)]
        # a model that gains a variable starts where all columns were evaluated: its part of that is known
        known = [begins[id(sel)](vs) if id(sel) in begins and v not in sel.variables else None for (sel, v), vs in zip(moves, sets)]
        more = {"known": known} if any(k is not None for k in known) else {}
        fits = fit_many(specs, [_carried(s, sel.fit) for s, (sel, _v) in zip(specs, moves)], SEARCH_TOL, **more) if moves else []
        # a separated or singular candidate has no likelihood to compare
        return [(f.aic, sel, v, vs, f) for (sel, v), vs, f in zip(moves, sets, fits) if f.converged]

    def best_of(sel: Selection, done: list[tuple]) -> tuple | None:
        own = [(d[0], n) for n, d in enumerate(done) if d[1] is sel and d[0] < sel.fit.aic - 1e-7]
        return done[min(own)[1]] if own else None

    fits = fit_many([spec([], i) for i in imps], None, SEARCH_TOL)
    state = [Selection(i, [], f, [("start", f.aic)]) for i, f in zip(imps, fits)]
    running = list(state)
    for _ in range(max_steps):
        if not running or not terms:
            break
        evaluated = expectations(running)
        expected = [e and e[0] for e in evaluated]
        begins = {id(sel): e[1] for sel, e in zip(running, evaluated) if e is not None and e[1] is not None}
        likely = [set(terms) if e is None else _likely(e) for e in expected]
        done = tried([(sel, v) for sel, some in zip(running, likely) for v in terms if v in some], begins)
        stuck = [k for k, sel in enumerate(running) if expected[k] is not None and best_of(sel, done) is None]
        done += tried([(running[k], v) for k in stuck for v in terms if v not in likely[k] and expected[k][v] < len(terms[v])], begins)
        moved = []
        for sel in running:
            move = best_of(sel, done)
            if move is not None:
                aic, _sel, v, vs, fit = move
                sel.path.append((f"- {v}" if v in sel.variables else f"+ {v}", aic))
                sel.variables, sel.fit = vs, fit
                moved.append(sel)
        running = moved
    else:
        raise RuntimeError(f"the search has not ended after {max_steps} steps")
    final = fit_many([sel.fit.spec for sel in state], [sel.fit.beta for sel in state], FINAL_TOL)
    for sel, fit in zip(state, final):
        sel.fit = fit
    return state


def _all_columns(terms: Mapping[str, Sequence[str]]) -> list[ModelSpec]:
    return [ModelSpec("all", tuple(c for cols in terms.values() for c in cols))]


def stepwise_logistic(df: DataFrame, y: str, terms: Mapping[str, Sequence[str]],
                      imp: str | None = None, imps: Sequence[int | None] = (None,)) -> list[Selection]:
    frame = design_frame(df, _all_columns(terms), [y], imp)
    return stepwise_aic(
        lambda specs, starts, tol, known=(): fit_logistic(frame, y, specs, tol=tol, prepared=True, starts=starts, known=known), terms, imps,
        evaluator=lambda specs: logistic_evaluator(frame, y, specs))


def stepwise_cox(df: DataFrame, time: str, status: str, terms: Mapping[str, Sequence[str]],
                 imp: str | None = None, imps: Sequence[int | None] = (None,)) -> list[Selection]:
    frame = risk_frame(design_frame(df, _all_columns(terms), [time, status], imp), time, status)
    return stepwise_aic(
        lambda specs, starts, tol, known=(): fit_cox(frame, time, status, specs, tol=tol, prepared=True, starts=starts, known=known), terms, imps,
        evaluator=lambda specs: cox_evaluator(frame, time, status, specs))


def selection_path(spark: SparkSession, selections: Sequence[Selection]) -> DataFrame:
    rows = [(s.imp, n, action, float(aic))
            for s in selections for n, (action, aic) in enumerate(s.path)]
    return spark.createDataFrame(rows, PATH_SCHEMA)
