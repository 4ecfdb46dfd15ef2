"""DuckDB SQL of the models: normal equations, their inverse, and Newton's method for many fits at once."""

from __future__ import annotations

from collections.abc import Sequence


def inverse(source: str, p: int, carried: Sequence[str] = ()) -> str:
    """SELECT of columns v<i>_<j>: the inverse of the symmetric matrix in columns h<i>_<j> (i <= j) of `source`, by elimination."""
    keep = ", ".join(carried) + ", " if carried else ""
    first = [f"h{min(i, j)}_{max(i, j)} AS m{i}_{j}" for i in range(p) for j in range(p)] + [f"{float(i == j)} AS m{i}_{p + j}" for i in range(p) for j in range(p)]
    sql = f"(SELECT {keep}{', '.join(first)} FROM {source})"
    for k in range(p):
        cells = [f"m{k}_{j} / m{k}_{k} AS m{k}_{j}" for j in range(2 * p)]
        cells += [f"m{i}_{j} - m{i}_{k} * m{k}_{j} / m{k}_{k} AS m{i}_{j}" for i in range(p) if i != k for j in range(2 * p)]
        sql = f"(SELECT {keep}{', '.join(cells)} FROM {sql})"
    return f"(SELECT {keep}{', '.join(f'm{i}_{p + j} AS v{i}_{j}' for i in range(p) for j in range(p))} FROM {sql})"


def newton(rows: str, xs: Sequence[str], family: str, by: str = "0", y: str = "y", w: str = "1", rounds: int = 14, name: str = "fit", more: Sequence[str] = ()) -> str:
    """CTEs `<name>_it` and `<name>`: one row for each value of `by`, with coefficients b0, b1, ... and the inverse information v<i>_<j>.

    `rows` has the outcome and columns of the design (`xs`, without intercept); `more` are further sums kept with the fit.
    """
    x, p = ["1", *xs], len(xs) + 1
    eta = " + ".join(f"b{i} * {c}" for i, c in enumerate(x))
    mean = {"binomial": "1 / (1 + exp(-e))", "poisson": "exp(e)", "gaussian": "e"}[family]
    curve = {"binomial": "m * (1 - m)", "poisson": "m", "gaussian": "1"}[family]
    bs = [f"b{i}" for i in range(p)]
    sums = [f"sum(_w * ({curve}) * {x[i]} * {x[j]}) AS h{i}_{j}" for i in range(p) for j in range(i, p)]
    sums += [f"sum(_w * (_y - m) * {c}) AS g{i}" for i, c in enumerate(x)]
    start = ["CAST(0 AS DOUBLE) AS b0" if family != "poisson" else f"ln(sum({w} * {y}) / sum({w})) AS b0", *[f"CAST(0 AS DOUBLE) AS b{i}" for i in range(1, p)]]

    def at(source: str) -> str:
        inner = f"SELECT r.*, r.{by} AS _by, {w} AS _w, {y} AS _y, s.k, {', '.join(f's.{b}' for b in bs)} FROM {source} s JOIN {rows} r ON r.{by} = s._by" if by != "0" else f"SELECT r.*, 0 AS _by, {w} AS _w, {y} AS _y, s.k, {', '.join(f's.{b}' for b in bs)} FROM {source} s, {rows} r"
        return f"(SELECT _by, k, {', '.join(bs)}, {', '.join([*sums, *more])} FROM (SELECT *, {mean} AS m FROM (SELECT *, {eta} AS e FROM ({inner}))) GROUP BY ALL)"

    gs = [f"g{i}" for i in range(p)]
    names = [m.rsplit(" AS ", 1)[1] for m in more]
    step = ", ".join(f"b{i} + {' + '.join(f'v{i}_{j} * g{j}' for j in range(p))} AS b{i}" for i in range(p))
    begin = f"SELECT {by} AS _by, 0 AS k, {', '.join(start)} FROM {rows} GROUP BY 1" if by != "0" else f"SELECT 0 AS _by, 0 AS k, {', '.join(start)} FROM {rows}"
    loop = f"SELECT _by, k + 1, {step} FROM {inverse(at(f'{name}_it'), p, ['_by', 'k', *bs, *gs])} WHERE k < {rounds}"
    last = inverse(at(f"(SELECT * FROM {name}_it WHERE k = {rounds})"), p, ["_by", *bs, *names])
    return f"{name}_it AS ({begin} UNION ALL {loop}), {name} AS (SELECT * FROM {last})"


def normal_tail(z: str) -> str:
    """Two-sided p of z, by the continued fraction and series of the complementary error function (error under 1e-7)."""
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1 / (1 + 0.3275911 * {x}))"
    return f"(((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-{x} * {x}))"
