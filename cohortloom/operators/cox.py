"""Batched proportional-hazards regression with Efron's handling of ties.

Every row is placed once at the last event day it is at risk on. A Newton step then takes two passes over the rows. The
first sums 1 and x, weighted by exp(xb), per (model, event day): a running sum over days gives the risk sets, and these
the likelihood, the score, and the hazard of each day. The second joins the running hazard to the rows and adds up the
weighted xx' into one matrix per model: summed over event days, a row's weight is what the risk sets up to its own day
give it. So no second moment is held by day, and nothing by day reaches the driver: only one vector and one matrix a model do.
Models of few columns take one pass instead: their second moments by day are no more than SECOND numbers, summed with the first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.scans import in_blocks, neighbours
from cohortloom.operators.models import (
    Evaluate,
    Fit,
    ModelSpec,
    _finish,
    batch_rows,
    design_frame,
    model_rows,
    newton,
    unpack,
)
from cohortloom.session import materialize

#: Terms of a tied day that are added one by one.
TAIL = 64
#: Numbers a task of the first pass holds (8 bytes each) before it gives its sums out.
HELD = 1 << 23
#: Second moments of a model that are summed by day; with more, the rows are gone through a second time.
SECOND = 36


def _series(x: np.ndarray) -> np.ndarray:
    """(1 - x) log(1 - x) + x without cancellation for small x."""
    small = np.minimum(x, 0.05)
    total = sum(small**k / (k * (k - 1)) for k in range(2, 14))
    rest = np.clip(1.0 - x, 1e-300, None)
    return np.where(x < 0.05, total, rest * np.log(rest) + x)


def efron_sums(s0: np.ndarray, e0: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over r < d of log, reciprocal and squared reciprocal of ``s0 - r/d * e0``.

    With ``s0`` taken out, the terms are those of ``1 - c r`` for ``c = e0 / (s0 d)``. The last
    TAIL of them, nearest to the singularity, are added one by one; those before by the
    Euler-Maclaurin formula, so a day costs the same whatever the number of tied events.
    """
    d = d.astype("float64")
    head = np.maximum(d - TAIL, 0.0)
    share = e0 / s0
    c = share / d
    free = (s0 - e0) / s0  # 1 - c r is this and c (d - r): no difference of near equals
    q = free + c * (d - head)
    x = c * head
    log_q = np.where(x < 0.5, np.log1p(-np.minimum(x, 0.5)), np.log(q))
    ends = lambda f, at: f(at) - f(np.ones_like(at))
    logs = np.where(head > 0, -_series(x) / c - log_q / 2 + ends(lambda u: -c / u, q) / 12
                    + ends(lambda u: 2 * c**3 / u**3, q) / 720 - ends(lambda u: 24 * c**5 / u**5, q) / 30240, 0.0)
    inv = np.where(head > 0, -log_q / c - ends(lambda u: 1 / u, q) / 2 + ends(lambda u: c / u**2, q) / 12
                   - ends(lambda u: 6 * c**3 / u**4, q) / 720 + ends(lambda u: 120 * c**5 / u**6, q) / 30240, 0.0)
    inv2 = np.where(head > 0, head / q - ends(lambda u: 1 / u**2, q) / 2 + ends(lambda u: 2 * c / u**3, q) / 12
                    - ends(lambda u: 24 * c**3 / u**5, q) / 720 + ends(lambda u: 720 * c**5 / u**7, q) / 30240, 0.0)
    for back in range(1, TAIL + 1):
        on = d >= back
        phi = free[on] + c[on] * back
        logs[on] += np.log(phi)
        inv[on] += 1.0 / phi
        inv2[on] += 1.0 / phi**2
    return d * np.log(s0) + logs, inv / s0, inv2 / s0**2


def risk_frame(frame: DataFrame, time: str, status: str) -> DataFrame:
    """The rows of a design frame with ``_day``, the last event time of any data set at or before their own; written once.

    Rows that end before the first event are in no risk set and left out. Times go by ranges with carries, events before
    the others of their time and rows of one time over several ranges, so a time at which very many end is no single task.
    """
    ends, event = F.col(f"`{time}`"), F.col(f"`{status}`") > 0
    placed = frame.withColumns({"_event": F.when(event & ~F.isnan(ends), ends), "_late": F.when(event, 0).otherwise(1),
                                "_row": F.monotonically_increasing_id()})
    order = [time, "_late", "_row"]
    days = neighbours(in_blocks(placed, [], order), [], order, "_event", "_day", "_next")
    return materialize(days.filter("_day IS NOT NULL").select(*frame.columns, "_day"))


def _numbers(q: int, second: bool) -> int:
    """Sums over a risk set of a model with ``q`` columns: 1, x and, if ``second``, the upper triangle of xx'."""
    return 1 + q + (q * (q + 1) // 2 if second else 0)


def _add_by_day(day: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct days and the sums of their rows."""
    order = np.argsort(day, kind="stable")
    day, values = day[order], values[order]
    start = np.flatnonzero(np.r_[True, day[1:] != day[:-1]])
    return day[start], np.add.reduceat(values, start, axis=0)


def _risk_terms(frame: DataFrame, time: str, status: str, specs: Sequence[ModelSpec], betas: Sequence[np.ndarray],
                second: bool = False) -> DataFrame:
    """One row per (model, day) and task with the sums of its rows; what a task holds is given out above HELD numbers.

    ``v``: 1 and x (and, if ``second``, the upper triangle of xx') weighted by exp(xb), over all rows; the same over event
    rows; number of events, their sum of xb, their sum of x.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pd.DataFrame]:
            for m, (day, sums) in held.items():
                yield pd.DataFrame({"model": np.full(len(day), m, dtype="int32"), "day": day, "v": list(sums)})
            held.clear()

        for pdf in batches:
            for m, spec in enumerate(specs):
                y, x = model_rows(pdf, spec, [time, status, "_day"], False)
                if not len(y):
                    continue
                eta = x @ betas[m]
                with np.errstate(over="ignore"):  # an overflow is a step too far: Newton halves it
                    weight = np.exp(eta)
                one = np.column_stack([np.ones(len(x)), x])
                if second:
                    i, j = np.triu_indices(x.shape[1])
                    one = np.column_stack([one, x[:, i] * x[:, j]])
                risk = one * weight[:, None]
                with np.errstate(invalid="ignore"):
                    event = risk * y[:, 1:2]
                seen = np.column_stack([np.ones(len(x)), eta, x]) * y[:, 1:2]
                day, sums = _add_by_day(y[:, 2], np.column_stack([risk, event, seen]))
                if m in held:
                    day, sums = _add_by_day(np.concatenate([held[m][0], day]), np.concatenate([held[m][1], sums]))
                held[m] = day, sums
            if sum(sums.size for _, sums in held.values()) > HELD:
                yield from out()
        yield from out()

    return frame.mapInPandas(task, "model int, day double, v array<double>")


def _event_day_sums(per_day: DataFrame, dims: Sequence[int], second: bool = False) -> DataFrame:
    """Contributions of the event days, summed per model (numbered by k), and each day's hazard and tie share (k -1).

    A day on which a model has no event of its own has neither. With ``second`` moments by day the matrix is that of the model,
    and the days are not given.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for pdf in batches:
            for m, part in pdf.groupby("model"):
                q = dims[m]
                w = _numbers(q, second)
                v = np.array([r[:2 * w + q + 2] for r in part["v"]], dtype="float64")
                n = len(part)
                out = np.zeros((n, 2))
                on = v[:, 2 * w] > 0
                if on.any():
                    risk = np.array([r[:w] for r in part["risk"]], dtype="float64")[on]
                    event, seen = v[on, w:2 * w], v[on, 2 * w:]
                    d, eta, sum_x = seen[:, 0], seen[:, 1], seen[:, 2:]
                    s0, e0, s1, e1 = risk[:, 0], event[:, 0], risk[:, 1:q + 1], event[:, 1:q + 1]
                    logs, inv, inv2 = efron_sums(s0, e0, d)
                    # (s - f*e) / (s0 - f*e0) = a + b / (s0 - f*e0), linear in the reciprocal
                    a1 = e1 / e0[:, None]
                    b1 = s1 - a1 * s0[:, None]
                    score = sum_x - (a1 * d[:, None] + b1 * inv[:, None])
                    i, j = np.triu_indices(q)
                    outer = (a1[:, i] * a1[:, j] * d[:, None]
                             + (a1[:, i] * b1[:, j] + b1[:, i] * a1[:, j]) * inv[:, None]
                             + b1[:, i] * b1[:, j] * inv2[:, None])
                    own = (s0 * inv - d) / e0
                    if second:
                        outer = risk[:, q + 1:] * inv[:, None] - event[:, q + 1:] * own[:, None] - outer
                    totals[m] = totals.get(m, 0.0) + np.concatenate([outer.sum(0), score.sum(0), [(eta - logs).sum(), d.sum()]])
                    out[on] = np.column_stack([inv, own])
                if second:
                    continue
                yield pd.DataFrame({"model": np.full(n, m, dtype="int32"), "day": part["day"].to_numpy("float64"),
                                    "k": np.full(n, -1, dtype="int32"), "v": out[:, 0], "own": out[:, 1]})
        for m, v in totals.items():
            yield pd.DataFrame({"model": np.full(len(v), m, dtype="int32"), "day": np.zeros(len(v)),
                                "k": np.arange(len(v), dtype="int32"), "v": v, "own": np.zeros(len(v))})

    return per_day.mapInPandas(task, "model int, day double, k int, v double, own double")


def _running_hazard(sums: DataFrame, specs: Sequence[ModelSpec]) -> tuple[DataFrame, list[int], list[str]]:
    """One row per day (and data set): each model's hazard up to that day and tie share of it, in columns by slot.

    Models of different data sets share slots, unless one of them reads all data sets.
    """
    apart = all(s.imp is not None for s in specs)
    slots, used = [], {}
    for s in specs:
        key = s.imp if apart else None
        slots.append(used.get(key, 0))
        used[key] = slots[-1] + 1
    upto = Window.partitionBy("model").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_day = sums.filter("k < 0").select("model", "day", F.sum("v").over(upto).alias("h"), "own")
    number = F.col("model") + 1
    slot = F.element_at(F.array(*[F.lit(n) for n in slots]), number)
    keys = ["_imp", "_day"] if apart else ["_day"]
    named = by_day.withColumns({"slot": slot, "_day": F.col("day")} | ({"_imp": F.element_at(F.array(*[F.lit(s.imp) for s in specs]), number)} if apart else {}))
    at = lambda n, c: F.coalesce(F.max(F.when(F.col("slot") == n, F.col(c))), F.lit(0.0))
    wide = named.groupBy(*keys).agg(*[at(n, c).alias(f"_{c}{n}") for n in range(max(used.values())) for c in ("h", "own")])
    return wide, slots, keys


def cox_evaluator(frame: DataFrame, time: str, status: str, specs: Sequence[ModelSpec]) -> Evaluate:
    """Partial likelihood, score, information and event count of Cox models at given coefficients, for all in two passes, or in one (SECOND).

    ``frame`` comes from ``risk_frame``.
    """
    dims = [len(s.columns) for s in specs]

    def evaluate(active: list[int], betas: list[np.ndarray]) -> list[tuple]:
        chosen = [specs[i] for i in active]
        q = [dims[i] for i in active]
        sizes = [d * (d + 1) // 2 for d in q]
        one_pass = max(sizes) <= SECOND
        width = max(_numbers(d, one_pass) for d in q)
        added = F.array(*[F.sum(F.get("v", F.lit(k))) for k in range(2 * width + max(q) + 2)])
        sums = _risk_terms(frame, time, status, chosen, betas, one_pass).groupBy("model", "day").agg(added.alias("v"))
        later = (Window.partitionBy("model").orderBy(F.col("day").desc())
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        at_risk = F.array(*[F.sum(F.get("v", F.lit(k))).over(later) for k in range(width)])
        by_day = _event_day_sums(sums.withColumn("risk", at_risk), q, one_pass)
        first = by_day.filter("k >= 0").groupBy("model", "k").agg(F.sum("v").alias("v"))
        if one_pass:
            found = [np.zeros(n + d + 2) for n, d in zip(sizes, q)]
            for r in first.collect():
                found[r["model"]][r["k"]] = r["v"]
            return [(v[t + d], v[t:t + d], unpack(v[:t], d), v[t + d + 1]) for d, t, v in zip(q, sizes, found)]
        hazard, slots, keys = _running_hazard(by_day, chosen)

        def add(pdf: pd.DataFrame, m: int) -> np.ndarray:
            y, x = model_rows(pdf, chosen[m], [time, status, f"_h{slots[m]}", f"_own{slots[m]}"], False)
            with np.errstate(over="ignore", invalid="ignore"):
                weight = np.exp(x @ betas[m]) * (y[:, 2] - y[:, 1] * y[:, 3])
                return (x.T @ (x * weight[:, None]))[np.triu_indices(q[m])]

        # one query: both parts read the same shuffle of sums by day
        second = batch_rows(frame.join(hazard, keys), sizes, add).withColumn("part", F.lit(1))
        found = [[np.zeros(n + d + 2) for n, d in zip(sizes, q)], [np.zeros(n) for n in sizes]]
        for r in first.withColumn("part", F.lit(0)).unionByName(second).collect():
            found[r["part"]][r["model"]][r["k"]] = r["v"]
        out = []
        for d, t, v, whole in zip(q, sizes, *found):
            out.append((v[t + d], v[t:t + d], unpack(whole - v[:t], d), v[t + d + 1]))
        return out

    return evaluate


def fit_cox(df: DataFrame, time: str, status: str, specs: Sequence[ModelSpec],
            imp: str | None = None, max_iter: int = 50, tol: float = 1e-12,
            prepared: bool = False, starts: Sequence[np.ndarray] | None = None, known: Sequence[tuple | None] = ()) -> list[Fit]:
    """Log hazard ratios of every spec; ``n`` counts the events. A ``prepared`` frame comes from ``risk_frame``; ``known`` as in ``newton``."""
    specs = list(specs)
    frame = df if prepared else risk_frame(design_frame(df, specs, [time, status], imp), time, status)
    results = newton(specs, [len(s.columns) for s in specs], cox_evaluator(frame, time, status, specs), max_iter, tol, starts, known)
    return _finish(specs, results, lambda s: list(s.columns))
