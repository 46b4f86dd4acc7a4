"""SQL text of Newton steps for logistic and Cox models over all subsets of their terms, for the statements that check the fits."""

from __future__ import annotations

from collections.abc import Sequence


def _eliminated(inner: str, keep: Sequence[str], k: int, inverse: bool) -> str:
    """Gauss-Jordan elimination written out: ``g`` becomes the solution, ``e`` on demand the inverse."""
    for t in range(k):
        out = list(keep)
        for r in range(k):
            for c in range(t + 1, k):
                out.append(f"a{t}_{c} / a{t}_{t} AS a{r}_{c}" if r == t else f"a{r}_{c} - a{r}_{t} / a{t}_{t} * a{t}_{c} AS a{r}_{c}")
            out.append(f"g{t} / a{t}_{t} AS g{r}" if r == t else f"g{r} - a{r}_{t} / a{t}_{t} * g{t} AS g{r}")
            for c in range(t + 1) if inverse else ():
                pivot = "1" if c == t else f"e{t}_{c}"
                own = "0" if c == t else f"e{r}_{c}"
                out.append(f"{pivot} / a{t}_{t} AS e{r}_{c}" if r == t else f"{own} - a{r}_{t} / a{t}_{t} * {pivot} AS e{r}_{c}")
        inner = f"SELECT {', '.join(out)} FROM ({inner})"
    return inner


def _models(points: str, columns: Sequence[Sequence[int]], k: int, always: Sequence[int], sums, steps: int, name: str) -> str:
    """Newton steps over all subsets of the terms; ``sums(where)`` gives the matrix, the score and loglik per fit."""
    sets, js = range(1 << len(columns)), range(k)
    used = [[int(j in always or any(m >> t & 1 and j in c for t, c in enumerate(columns))) for j in js] for m in sets]
    b, u = ", ".join(f"b{j}" for j in js), ", ".join(f"u{j}" for j in js)
    masks = ", ".join(f"({m}, {', '.join(map(str, used[m]))})" for m in sets)
    step = _eliminated(sums(f"f.i < {steps}"), ["i", "imp", "mask", *[f"b{j}" for j in js]], k, False)
    keep = ["imp", "mask", *[f"b{j}" for j in js], *[f"u{j}" for j in js], "loglik"]
    last = _eliminated(sums(f"f.i = {steps}"), keep, k, True)
    rows = " UNION ALL ".join(f"SELECT imp, mask, {j} AS place, b{j} AS b, sqrt(e{j}_{j}) AS se FROM {name}ended WHERE u{j} = 1" for j in js)
    return f"""
{name}masks(mask, {u}) AS (VALUES {masks}),
{name}fit(i, imp, mask, {b}) AS (
  SELECT 0, imp, mask, {', '.join('CAST(0 AS DOUBLE)' for _ in js)} FROM (SELECT DISTINCT imp FROM {points}), {name}masks
  UNION ALL
  SELECT i + 1, imp, mask, {', '.join(f'b{j} + g{j}' for j in js)} FROM ({step})),
{name}ended AS ({last}),
{name}fitted AS ({rows}),
{name}scores AS (SELECT imp, mask, -2 * loglik + 2 * ({' + '.join(f'u{j}' for j in js)}) AS aic FROM {name}ended)
"""


def logistic_subsets(points: str, columns: Sequence[Sequence[int]], k: int, steps: int = 14, name: str = "") -> str:
    """Tables ``fitted`` (imp, mask, place, b, se) and ``scores`` (imp, mask, aic) of logistic models, after ``name``.

    ``points`` has imp, y, x0 (ones) to x{k-1}. Bit t of a mask takes in the columns of term t; columns left out get a
    unit diagonal and no score, so they stay at zero.
    """
    js = range(k)
    both = ", ".join(f"b{j}, u{j}" for j in js)
    info = ", ".join(f"sum(p * (1 - p) * z{r} * z{c}) + {f'(1 - u{r})' if r == c else 0} AS a{r}_{c}" for r in js for c in js)
    score = ", ".join(f"sum((y - p) * z{j}) AS g{j}" for j in js)

    def sums(where: str) -> str:
        return f"""SELECT i, imp, mask, {both}, {info}, {score}, sum(y * eta - ln(1 + exp(eta))) AS loglik FROM (
          SELECT *, 1 / (1 + exp(-eta)) AS p FROM (
            SELECT f.i, f.imp, f.mask, {', '.join(f'f.b{j}, m.u{j}, q.x{j} * m.u{j} AS z{j}' for j in js)}, q.y,
                   {' + '.join(f'f.b{j} * q.x{j}' for j in js)} AS eta
            FROM {name}fit f JOIN {name}masks m ON m.mask = f.mask JOIN {points} q ON q.imp = f.imp WHERE {where}))
          GROUP BY i, imp, mask, {both}"""

    return _models(points, columns, k, [0], sums, steps, name)


def cox_subsets(points: str, columns: Sequence[Sequence[int]], k: int, steps: int = 8, name: str = "") -> str:
    """The same for Cox models with Efron's ties; ``points`` has imp, t, s, x0 to x{k-1}.

    Risk sets are a join of event days with the rows not over before; tied events are counted out one by one.
    """
    js = range(k)
    pairs = [(r, c) for r in js for c in range(r, k)]
    both = ", ".join(f"b{j}, u{j}" for j in js)
    z = ", ".join(f"f.b{j}, m.u{j}, q.x{j} * m.u{j} AS z{j}" for j in js)
    eta = " + ".join(f"f.b{j} * q.x{j}" for j in js)
    first = ", ".join(f"sum(w * z{j}) AS s{j}, sum(w * z{j} * ev) AS e{j}, sum(z{j} * ev) AS n{j}" for j in js)
    second = ", ".join(f"sum(w * z{r} * z{c}) AS s{r}_{c}, sum(w * z{r} * z{c} * ev) AS e{r}_{c}" for r, c in pairs)
    mean = ", ".join(f"(s{j} - f * e{j}) / (s_ - f * e_) AS m{j}" for j in js)
    spread = ", ".join(f"(s{r}_{c} - f * e{r}_{c}) / (s_ - f * e_) AS m{r}_{c}" for r, c in pairs)
    info = ", ".join(f"sum(m{min(r, c)}_{max(r, c)} - m{r} * m{c}) + {f'(1 - u{r})' if r == c else 0} AS a{r}_{c}" for r in js for c in js)
    score = ", ".join(f"sum(n{j} / d - m{j}) AS g{j}" for j in js)

    def sums(where: str) -> str:
        return f"""SELECT i, imp, mask, {both}, {info}, {score}, sum(eta / d - ln(s_ - f * e_)) AS loglik FROM (
          SELECT *, {mean}, {spread} FROM (
            SELECT *, r / d AS f FROM (
              SELECT *, unnest(range(CAST(d AS BIGINT))) AS r FROM (
                SELECT i, imp, mask, {both}, t, sum(w) AS s_, sum(w * ev) AS e_, sum(ev) AS d, sum(eta * ev) AS eta, {first}, {second} FROM (
                  SELECT *, exp(eta) AS w FROM (
                    SELECT f.i, f.imp, f.mask, {z}, {eta} AS eta, o.t, CAST(q.t = o.t AND q.s = 1 AS INTEGER) AS ev
                    FROM {name}fit f JOIN {name}masks m ON m.mask = f.mask JOIN event_days o ON o.imp = f.imp
                    JOIN {points} q ON q.imp = f.imp AND q.t >= o.t WHERE {where}))
                GROUP BY i, imp, mask, {both}, t))))
          GROUP BY i, imp, mask, {both}"""

    return f"event_days AS (SELECT DISTINCT imp, t FROM {points} WHERE s = 1)," + _models(points, columns, k, [], sums, steps, name)


def aic_walk(names: Sequence[str]) -> str:
    """Table ``walk`` (imp, step, mask, aic, action): from the empty model, the best single change while AIC falls."""
    bits = ", ".join(f"({1 << t}, '{n}')" for t, n in enumerate(names))
    return f"""
bits(bit, name) AS (VALUES {bits}),
walk(imp, step, mask, aic, action) AS (
  SELECT imp, 0, mask, aic, 'start' FROM scores WHERE mask = 0
  UNION ALL
  SELECT w.imp, w.step + 1, arg_min(s.mask, s.aic), min(s.aic),
         arg_min(CASE WHEN w.mask & t.bit > 0 THEN '- ' ELSE '+ ' END || t.name, s.aic)
  FROM walk w JOIN bits t ON true JOIN scores s ON s.imp = w.imp AND s.mask = xor(w.mask, t.bit)
  WHERE s.aic < w.aic - 1e-7 GROUP BY w.imp, w.step)
"""


def _t_mass(w: str, df: str) -> str:
    """Probability of t between 0 and ``w``, by Simpson's rule over 2,000 steps."""
    weight = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return (f"(list_sum(list_transform(range(0, 2001), lambda i: ({weight}) * pow(1 + pow(i * ({w}) / 2000, 2) / ({df}), -(({df}) + 1) / 2)))"
            f" * ({w}) / 6000 * {_t_height(df)})")


def _t_height(df: str) -> str:
    return f"(exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(({df}) * pi()))"


def pooled(estimates: str, rows: str, m: int, name: str) -> str:
    """Table ``{name}pooled`` (term, ratio, lower, upper, p) from (term, b, se): Rubin's rules with t intervals.

    ``rows`` is the number of rows of one data set. The quantile comes from Newton steps on the t distribution.
    """
    return f"""
{name}parts AS (
  SELECT term, avg(b) AS est, avg(se * se) AS vw, var_pop(b) * count(b) / {m - 1} AS vb, ({rows}) - 2 AS dof FROM ({estimates}) GROUP BY 1),
{name}sums AS (SELECT *, vw + vb + vb / {m} AS vt, (vb + vb / {m}) / (vw + vb + vb / {m}) AS lam FROM {name}parts),
{name}free AS (SELECT *, (dof + 1) / (dof + 3) * dof * (1 - lam) AS df_obs FROM {name}sums),
{name}tests AS (SELECT *, df_obs / (1 + df_obs * lam * lam / {m - 1}) AS df, est / sqrt(vt) AS wald FROM {name}free),
{name}quantile(i, term, df, q) AS (
  SELECT 0, term, df, CAST(1.96 AS DOUBLE) FROM {name}tests
  UNION ALL
  SELECT i + 1, term, df, q - ({_t_mass('q', 'df')} - 0.475) / ({_t_height('df')} * pow(1 + q * q / df, -(df + 1) / 2))
  FROM {name}quantile WHERE i < 12),
{name}pooled AS (
  SELECT t.term, exp(est) AS ratio, exp(est - q * sqrt(vt)) AS lower, exp(est + q * sqrt(vt)) AS upper,
         1 - 2 * {_t_mass('abs(wald)', 't.df')} AS p
  FROM {name}tests t JOIN {name}quantile k ON k.term = t.term AND k.i = 12)
"""
