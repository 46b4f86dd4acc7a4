"""Models against independent solutions: MLlib, brute force and closed forms."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from cohortloom.functions.distributions import betainc, chi2_upper, f_upper, t_quantile, t_two_sided
from cohortloom.operators import cox
from cohortloom.operators.cox import cox_evaluator, efron_sums, fit_cox, risk_frame
from cohortloom.operators.design import dummy_code, select_terms
from cohortloom.operators.impute import mice_impute
from cohortloom.operators.models import ModelSpec, coefficients, design_frame, fit_linear, fit_logistic, newton
from cohortloom.operators.pooling import rubin_pool
from cohortloom.operators.stepwise import expected_changes, stepwise_aic, stepwise_cox, stepwise_logistic
from cohortloom.operators.summaries import univariate_summary


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    n = 400
    x = rng.normal(size=n)
    z = rng.integers(0, 2, n).astype(float)
    w = rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.2 + 0.9 * x - 0.7 * z)))).astype(float)
    t = np.ceil(rng.exponential(20 * np.exp(-0.5 * x + 0.3 * z))).astype(int)
    s = (rng.random(n) < 0.7).astype(int)
    return pd.DataFrame({"id": np.arange(n), "x": x, "z": z, "w": w, "y": y, "t": t, "s": s})


def test_logistic_equals_glm(spark, data):
    df = spark.createDataFrame(data)
    fit, = fit_logistic(df, "y", [ModelSpec("m", ("x", "z"))])
    glm = GeneralizedLinearRegression(family="binomial", labelCol="y", maxIter=100, tol=1e-12).fit(
        VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(df))
    assert fit.converged
    assert fit.beta[1:] == pytest.approx(list(glm.coefficients), abs=1e-6)
    assert fit.beta[0] == pytest.approx(glm.intercept, abs=1e-6)
    se = np.sqrt(np.diag(fit.cov))
    assert list(se[1:]) + [se[0]] == pytest.approx(list(glm.summary.coefficientStandardErrors), abs=1e-6)
    assert fit.aic == pytest.approx(glm.summary.aic, abs=1e-5)


def test_missing_rows_leave_only_their_models(spark, data):
    holes = data.copy()
    holes["x"] = holes["x"].where(holes.index % 4 != 0)
    df = spark.createDataFrame(holes)
    with_x, without = fit_logistic(df, "y", [ModelSpec("a", ("x",)), ModelSpec("b", ("z",))])
    assert (with_x.n, without.n) == (300, 400)


def test_linear_equals_lstsq(spark, data):
    fit, = fit_linear(spark.createDataFrame(data), "w", [ModelSpec("m", ("x", "z"))])
    design = np.column_stack([np.ones(len(data)), data["x"], data["z"]])
    assert fit.beta == pytest.approx(np.linalg.lstsq(design, data["w"], rcond=None)[0], abs=1e-9)


def efron_loglik(beta, t, s, x):
    eta = x @ beta
    total = 0.0
    for day in np.unique(t[s == 1]):
        dead = (t == day) & (s == 1)
        d = dead.sum()
        s0, e0 = np.exp(eta[t >= day]).sum(), np.exp(eta[dead]).sum()
        total += eta[dead].sum() - sum(math.log(s0 - r / d * e0) for r in range(d))
    return total


def test_cox_hand_example(spark):
    df = spark.createDataFrame([(5, 1, 1.0), (6, 0, 0.0), (7, 1, 1.0), (7, 1, 0.0), (9, 0, 1.0), (10, 1, 0.0)],
                               "t int, s int, x double")
    fit, null = fit_cox(df, "t", "s", [ModelSpec("m", ("x",)), ModelSpec("null", ())])
    assert fit.beta[0] == pytest.approx(0.693147, abs=1e-6)
    assert math.sqrt(fit.cov[0, 0]) == pytest.approx(1.224745, abs=1e-6)
    assert fit.loglik == pytest.approx(-4.106767, abs=1e-6)
    assert null.loglik == pytest.approx(efron_loglik(np.zeros(0), np.array([5, 6, 7, 7, 9, 10]),
                                                     np.array([1, 0, 1, 1, 0, 1]), np.zeros((6, 0))))


def test_cox_is_the_maximum(spark, data):
    df = spark.createDataFrame(data)
    fit, = fit_cox(df, "t", "s", [ModelSpec("m", ("x", "z"))])
    t, s, x = data["t"].to_numpy(), data["s"].to_numpy(), data[["x", "z"]].to_numpy()
    top = efron_loglik(fit.beta, t, s, x)
    assert fit.loglik == pytest.approx(top, abs=1e-6)
    h = 1e-4
    hess = np.zeros((2, 2))
    for i in range(2):
        e = np.eye(2)[i] * h
        assert efron_loglik(fit.beta + e, t, s, x) < top
        assert efron_loglik(fit.beta - e, t, s, x) < top
        for j in range(2):
            g = np.eye(2)[j] * h
            hess[i, j] = (efron_loglik(fit.beta + e + g, t, s, x) - efron_loglik(fit.beta + e - g, t, s, x)
                          - efron_loglik(fit.beta - e + g, t, s, x) + efron_loglik(fit.beta - e - g, t, s, x)) / (4 * h * h)
    assert np.diag(fit.cov) == pytest.approx(np.diag(np.linalg.inv(-hess)), rel=1e-3)


@pytest.mark.parametrize("d", [1, 5, 33, 400])
def test_tied_event_sums(d):
    s0, e0 = np.array([1000.0, 2.0 * d]), np.array([0.7 * d, 2.0 * d])
    terms = s0[:, None] - np.arange(d) / d * e0[:, None]
    logs, inv, inv2 = efron_sums(s0, e0, np.array([float(d)] * 2))
    assert logs == pytest.approx(np.log(terms).sum(1), rel=1e-9)
    assert inv == pytest.approx((1 / terms).sum(1), rel=1e-9)
    assert inv2 == pytest.approx((1 / terms**2).sum(1), rel=1e-9)


def stepwise_by_hand(aic, names):
    chosen, best = [], aic(())
    while True:
        moves = [tuple(v for v in chosen if v != n) if n in chosen else (*chosen, n) for n in names]
        scores = [aic(m) for m in moves]
        if min(scores) >= best - 1e-7:
            return set(chosen), best
        best = min(scores)
        chosen = list(moves[scores.index(best)])


def test_stepwise_logistic_equals_one_by_one(spark, data):
    df = spark.createDataFrame(data)
    names = ["x", "z", "w"]
    sel, = stepwise_logistic(df, "y", {n: [n] for n in names})
    want, aic = stepwise_by_hand(lambda vs: fit_logistic(df, "y", [ModelSpec("m", tuple(vs))])[0].aic, names)
    assert set(sel.variables) == want
    assert sel.fit.aic == pytest.approx(aic)
    assert {"x", "z"} <= want


def test_one_sweep_gives_all_score_and_wald_tests():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 6))
    info, score, beta = x.T @ x, rng.normal(size=6), rng.normal(size=6)
    score[[0, 2]] = 0  # at the estimates of the model inside
    got = expected_changes(beta, score, info, [0, 2], {"a": [0], "c": [2], "b": [1], "de": [3, 4], "f": [5]})
    inner = np.linalg.inv(info[np.ix_([0, 2], [0, 2])])
    assert got["a"] == pytest.approx(beta[0] ** 2 / inner[0, 0] - 2) and got["c"] == pytest.approx(beta[2] ** 2 / inner[1, 1] - 2)
    for name, at in (("b", [1]), ("de", [3, 4]), ("f", [5])):
        left = info[np.ix_(at, at)] - info[np.ix_(at, [0, 2])] @ inner @ info[np.ix_([0, 2], at)]
        assert got[name] == pytest.approx(2 * len(at) - score[at] @ np.linalg.solve(left, score[at]))


@pytest.fixture(scope="module")
def many(spark):
    """Nineteen variables, some of them telling, in ten data sets that differ a little."""
    rng, n = np.random.default_rng(8), 150
    base = rng.normal(size=(n, 19))
    t = np.ceil(rng.exponential(30 * np.exp(-0.7 * base[:, 0] + 0.6 * base[:, 1] - 0.5 * base[:, 2]))).astype(int)
    s = (rng.random(n) < 0.8).astype(int)
    parts = []
    for imp in range(1, 11):
        x = base + 0.15 * rng.normal(size=base.shape) * (np.arange(19) % 4 == 1)
        parts.append(pd.DataFrame(x, columns=[f"v{k}" for k in range(19)]).assign(imp=imp, t=t, s=s, y=(base[:, 0] + rng.normal(size=n) > 0).astype(float)))
    return spark.createDataFrame(pd.concat(parts)), {f"v{k}": [f"v{k}"] for k in range(19)}


def test_cox_search_over_ten_data_sets(many):
    """The likely moves alone lead to a model that no single change improves."""
    df, terms = many
    found = stepwise_cox(df, "t", "s", terms, "imp", range(1, 11))
    assert all({"v0", "v1", "v2"} <= set(s.variables) and s.fit.converged for s in found)
    for sel in (found[0], found[9]):
        near = [[u for u in sel.variables if u != v] if v in sel.variables else [*sel.variables, v] for v in terms]
        fits = fit_cox(df, "t", "s", [ModelSpec("m", tuple(vs), sel.imp) for vs in near], "imp")
        assert min(f.aic for f in fits) >= sel.fit.aic - 1e-6


def test_likely_moves_walk_the_same_path(many):
    df, terms = many
    few = dict(list(terms.items())[:8])
    frame = design_frame(df, [ModelSpec("all", tuple(few))], ["y"], "imp")
    fit_many = lambda specs, starts, tol: fit_logistic(frame, "y", specs, tol=tol, prepared=True, starts=starts)
    every = stepwise_aic(fit_many, few, [1, 2, 3])
    likely = stepwise_logistic(df, "y", few, "imp", [1, 2, 3])
    assert [[a for a, _ in s.path] for s in likely] == [[a for a, _ in s.path] for s in every]


def test_missing_values_turn_off_the_shortcut(spark, data):
    """Columns outside the model that lack values: every move is fitted on its own rows, as one by one."""
    holes = data.assign(w=data["w"].where(data["id"] % 3 > 0), z=data["z"].where(data["id"] % 5 > 0))
    df, names = spark.createDataFrame(holes), ["x", "z", "w"]
    frame = design_frame(df, [ModelSpec("all", tuple(names))], ["y"], None)
    fit_many = lambda specs, starts, tol: fit_logistic(frame, "y", specs, tol=tol, prepared=True, starts=starts)
    every, = stepwise_aic(fit_many, {n: [n] for n in names})
    likely, = stepwise_logistic(df, "y", {n: [n] for n in names})
    assert [a for a, _ in likely.path] == [a for a, _ in every.path]


def test_stepwise_cox_equals_brute_force(spark, data):
    df = spark.createDataFrame(data)
    sel, = stepwise_cox(df, "t", "s", {n: [n] for n in ("x", "w")})
    t, s = data["t"].to_numpy(), data["s"].to_numpy()

    def aic(vs):
        x = data[list(vs)].to_numpy() if vs else np.zeros((len(t), 0))
        beta = fit_cox(df, "t", "s", [ModelSpec("m", tuple(vs))])[0].beta
        return -2 * efron_loglik(beta, t, s, x) + 2 * len(vs)

    want, best = stepwise_by_hand(aic, ["x", "w"])
    assert set(sel.variables) == want
    assert sel.fit.aic == pytest.approx(best, abs=1e-5)


def test_hand_selection():
    assert select_terms(["a", "raceX", "ESR"], "race|ESR", ["race", "a"]) == ["a", "race"]


def test_dummy_codes_keep_missing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("c",)], "f string")
    out, terms = dummy_code(df, {"f": "b"})
    assert terms == {"f": ["fa", "fc"]}
    assert [tuple(r) for r in out.select("fa", "fc").collect()] == [(1, 0), (0, 0), (None, None), (0, 1)]


def test_rubin_rules(spark):
    c = spark.createDataFrame([("a", 1.0, 0.5), ("a", 2.0, 0.5), ("a", 3.0, 0.5), ("b", 2.0, 0.5), ("b", 2.0, 0.5),
                               ("b", 2.0, 0.5)], "term string, estimate double, std_error double")
    rows = {r["term"]: r for r in rubin_pool(c, 100).collect()}
    a, b = rows["a"], rows["b"]
    assert a["var_total"] == pytest.approx(1.583333, abs=1e-6)
    assert a["lambda"] == pytest.approx(0.842105, abs=1e-6)
    assert a["df_old"] == pytest.approx(2.820313, abs=1e-6)
    assert a["df_obs"] == pytest.approx(15.167275, abs=1e-6)
    assert a["df_adj"] == pytest.approx(2.378110, abs=1e-6)
    assert a["wald"] == pytest.approx(1.589439, abs=1e-6)
    assert b["lambda"] == 0 and b["df_adj"] == b["df_obs"]
    assert b["ratio_lower"] < b["ratio"] < b["ratio_upper"]


def test_tabulated_tails():
    assert t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-6)
    assert t_quantile(0.975, 2.5) == pytest.approx(3.558, abs=2e-2)
    assert t_two_sided(1.812461, 10) == pytest.approx(0.1, abs=1e-6)
    assert t_two_sided(1.959964, math.inf) == pytest.approx(0.05, abs=1e-6)
    assert chi2_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert chi2_upper(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert f_upper(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert betainc(2, 3, 0.5) == pytest.approx(0.6875)


def test_imputation_properties(spark, data):
    rng = np.random.default_rng(3)
    holes = data[["id", "x", "z"]].copy()
    holes["lin"] = 3 * holes["x"] + holes["z"]
    holes["cat"] = np.round(holes["x"] ** 2, 1)
    full = holes.copy()
    for c in ("lin", "cat"):
        holes.loc[rng.random(len(holes)) < 0.25, c] = np.nan
    df = spark.createDataFrame(holes).replace(float("nan"), None)
    run = lambda: mice_impute(df, "id", {"lin": "norm.predict", "cat": "rf"}, ["x", "z"], m=2, sweeps=2,
                              trees=4, seed=5).orderBy("imp", "id").toPandas()
    out = run()
    assert len(out) == 2 * len(holes)
    for _imp, part in out.groupby("imp"):
        part = part.sort_values("id").reset_index(drop=True)
        assert part[["lin", "cat"]].notna().all().all()
        for c in ("lin", "cat"):
            seen = holes[c].notna()
            assert (part.loc[seen, c] == holes.loc[seen, c]).all()
        assert part["lin"].to_numpy() == pytest.approx(full["lin"].to_numpy(), abs=1e-6)
        assert set(part["cat"]) <= set(holes["cat"].dropna())
    assert run().equals(out)


def test_chain_of_three_columns(spark, data):
    """Both methods in one chain; the column visited last fits the completed others, in each data set with its own donors."""
    rng = np.random.default_rng(8)
    holes = data[["id", "x", "z"]].copy()
    holes["cat"] = np.round(holes["x"] ** 2, 1)
    holes["lin"] = holes["x"] - 2 * holes["z"] + rng.normal(size=len(holes))
    holes["wt"] = holes["lin"] + holes["cat"] + rng.normal(size=len(holes))
    for c in ("cat", "lin", "wt"):
        holes.loc[rng.random(len(holes)) < 0.2, c] = np.nan
    df = spark.createDataFrame(holes).replace(float("nan"), None)
    out = mice_impute(df, "id", {"cat": "rf", "lin": "norm.predict", "wt": "norm.predict"}, ["x", "z"], m=2, sweeps=2, trees=3, seed=4,
                      starts={"lin": 0.5}).orderBy("imp", "id").toPandas()
    holes = holes.sort_values("id").reset_index(drop=True)
    parts = [part.reset_index(drop=True) for _, part in out.groupby("imp")]
    assert len(parts) == 2 and not parts[0]["wt"].equals(parts[1]["wt"])
    for part in parts:
        for c in ("cat", "lin", "wt"):
            assert part[c].notna().all() and (part[c] == holes[c])[holes[c].notna()].all()
        x = np.column_stack([np.ones(len(part)), part[["x", "z", "cat", "lin"]].astype(float)])
        seen = holes["wt"].notna().to_numpy()
        beta = np.linalg.lstsq(x[seen], holes["wt"][seen].to_numpy(), rcond=None)[0]
        assert part["wt"].to_numpy()[~seen] == pytest.approx((x @ beta)[~seen], abs=1e-6)


def test_contrast_statistics(spark, data):
    df = spark.createDataFrame(data.assign(g=data["s"].astype(str), c=np.where(data["x"] > 0, "hi", "lo")))
    out = {(r["var"], r["level"], r["grp"]): r for r in
           univariate_summary(df, ["x", "c"], ["c"], "g").collect()}
    x = data["x"].to_numpy()
    parts = [x[data["s"] == k] for k in (0, 1)]
    between = sum(len(p) * (p.mean() - x.mean()) ** 2 for p in parts)
    within = sum(((p - p.mean()) ** 2).sum() for p in parts)
    row = out["x", None, "ALL"]
    assert row["statistic"] == pytest.approx(between / (within / (len(x) - 2)))
    assert row["p_value"] == pytest.approx(f_upper(row["statistic"], 1, len(x) - 2))
    table = pd.crosstab(np.where(x > 0, "hi", "lo"), data["s"]).to_numpy()
    expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    row = out["c", "hi", "ALL"]
    assert row["statistic"] == pytest.approx(((table - expected) ** 2 / expected).sum())
    assert row["p_value"] == pytest.approx(chi2_upper(row["statistic"], 1))


def test_coefficient_table(spark, data):
    fits = fit_logistic(spark.createDataFrame(data), "y", [ModelSpec("m", ("x",))])
    row = coefficients(spark, fits).collect()[0]
    assert row["exp_estimate"] == pytest.approx(math.exp(row["estimate"]))
    assert coefficients(spark, fits, intercept=True).filter(F.col("term") == "(Intercept)").count() == 1


def test_cox_sums_given_out_early_and_shared_slots(spark, monkeypatch):
    """Many rows end at one time, a task gives its sums out again and again, and a model of all sets stands beside one set's."""
    rng = np.random.default_rng(11)
    rows = [(int(rng.integers(1, 3)), 40.0 if rng.random() < 0.4 else float(rng.integers(1, 40)), float(rng.normal())) for _ in range(400)]
    df = spark.createDataFrame([(i, t, float(t < 40 and rng.random() < 0.6), x) for i, t, x in rows] + [(1, None, 1.0, 0.3), (2, 0.5, 0.0, None)],
                               "imp int, t double, s double, x double")
    specs = [ModelSpec("one", ("x",), 1), ModelSpec("all", ("x",)), ModelSpec("two", ("x",), 2)]
    apart = [fit_cox(df, "t", "s", [s], "imp")[0] for s in specs]
    monkeypatch.setattr("cohortloom.operators.cox.HELD", 10)
    for fit, own in zip(fit_cox(df, "t", "s", specs, "imp"), apart):
        assert fit.converged and fit.n == own.n and fit.n > 0
        assert np.allclose(fit.beta, own.beta, rtol=1e-9) and np.allclose(fit.cov, own.cov, rtol=1e-7)


def test_cox_without_events(spark):
    fit, = fit_cox(spark.createDataFrame([(1.0, 0.0, 2.0), (2.0, 0.0, 1.0)], "t double, s double, x double"), "t", "s", [ModelSpec("m", ("x",))])
    assert fit.n == 0 and not fit.converged


def test_cox_models_of_few_columns_take_one_pass(spark, data, monkeypatch):
    """Likelihood, score, information and events are those of two passes, with ties, data sets and an empty model."""
    both = pd.concat([data.assign(imp=i, x=data["x"] + 0.1 * i) for i in (1, 2)])
    specs = [ModelSpec("0", (), 1), ModelSpec("x", ("x",), 1), ModelSpec("xz", ("x", "z"), 2), ModelSpec("xzw", ("x", "z", "w"), 2)]
    frame = risk_frame(design_frame(spark.createDataFrame(both), specs, ["t", "s"], "imp"), "t", "s")
    betas = [np.array([0.3, -0.2, 0.1])[:len(s.columns)] for s in specs]
    passes, joined = [], cox._running_hazard
    monkeypatch.setattr(cox, "_running_hazard", lambda *a: passes.append(1) or joined(*a))
    evaluate = cox_evaluator(frame, "t", "s", specs)
    one = evaluate([0, 1, 2, 3], betas)
    assert not passes
    monkeypatch.setattr(cox, "SECOND", 5)
    two = evaluate([0, 1, 2, 3], betas)
    assert passes
    for a, b in zip(one, two):
        assert all(np.asarray(u) == pytest.approx(np.asarray(v), rel=1e-9, abs=1e-9) for u, v in zip(a, b))


def test_known_starts_are_not_evaluated():
    asked = []

    def evaluate(active, betas):
        asked.append(list(active))
        return [(-float((b[0] - i) ** 2), np.array([-2 * (b[0] - i)]), np.array([[2.0]]), 5) for i, b in zip(active, betas)]

    known = [(-0.0, np.array([0.0]), np.array([[2.0]]), 5), None, (-4.0, np.array([4.0]), np.array([[2.0]]), 5)]
    out = newton([None] * 3, [1] * 3, evaluate, 20, 1e-9, known=known)
    assert [float(b[0]) for b, _, _ in out] == pytest.approx([0, 1, 2]) and all(done for *_, done in out)
    assert asked == [[1], [1, 2]]


def test_search_starts_added_variables_from_the_evaluation(spark, data, monkeypatch):
    """A search evaluates no model that the evaluation of all columns holds already, and ends where the whole search does."""
    asked, evaluator = [], cox_evaluator
    monkeypatch.setattr(cox, "cox_evaluator", lambda *a: (lambda at, betas, run=evaluator(*a): asked.append((len(at), betas)) or run(at, betas)))
    terms = {n: [n] for n in ("x", "z", "w")}
    df = spark.createDataFrame(data)
    found, = stepwise_cox(df, "t", "s", terms)
    assert not any(len(b) and not b.any() for _, betas in asked for b in betas)
    frame = risk_frame(design_frame(df, [ModelSpec("all", tuple(terms))], ["t", "s"], None), "t", "s")
    whole, = stepwise_aic(lambda specs, starts, tol: fit_cox(frame, "t", "s", specs, tol=tol, prepared=True, starts=starts), terms)
    assert found.variables == whole.variables and [a for _, a in found.path] == pytest.approx([a for _, a in whole.path], abs=1e-5)
