"""SQL text for the checks: tails by numerical integration, least squares by sweeping.

Deliberately a different route from the library (which uses continued fractions and a dense
solve), so that agreement means something.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..operators.features import _A, _B, _C, _D, _E, _F

PANELS = 2000
Z975 = "1.959963984540054"


def _simpson(lo: str, hi: str, integrand) -> str:
    """Integral by Simpson's rule as one list expression; ``integrand`` maps SQL to SQL."""
    h = f"((({hi}) - ({lo})) / {PANELS}.0)"
    x = f"(({lo}) + i * {h})"
    weight = f"(CASE WHEN i = 0 OR i = {PANELS} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)"
    return f"(list_sum(list_transform(range(0, {PANELS + 1}), lambda i: {weight} * {integrand(x)})) * {h} / 3.0)"


def f_p(f: str, d1: str, d2: str) -> str:
    """Upper tail of F: integral of cos^(d2-1) sin^(d1-1)."""
    f, d1, d2 = f"({f})::DOUBLE", f"({d1})::DOUBLE", f"({d2})::DOUBLE"
    lo = f"atan(sqrt({d1} * {f} / {d2}))"
    hi = f"least(pi() / 2, {lo} + (14.0 + sqrt({d1})) / sqrt({d2}))"
    const = f"(2.0 * exp(lgamma(({d1} + {d2}) / 2) - lgamma({d1} / 2) - lgamma({d2} / 2)))"
    body = _simpson(lo, hi, lambda x: f"pow(greatest(cos({x}), 0.0), {d2} - 1) * pow(sin({x}), {d1} - 1)")
    return f"({const} * {body})"


def t_p(t: str, df: str) -> str:
    return f_p(f"({t}) * ({t})", "1", df)


def chi2_p(x: str, k: str) -> str:
    x, k = f"({x})::DOUBLE", f"({k})::DOUBLE"
    lo, hi = f"sqrt({x})", f"(sqrt({x}) + 14.0 + sqrt({k}))"
    const = f"exp(ln(2.0) - {k} / 2 * ln(2.0) - lgamma({k} / 2))"
    return f"({const} * {_simpson(lo, hi, lambda z: f'pow({z}, {k} - 1) * exp(-{z} * {z} / 2)')})"


def normal_p2(z: str) -> str:
    """Two-sided normal tail."""
    return f"least(1.0, {chi2_p(f'({z}) * ({z})', '1')})"


def normal_sf(z: str) -> str:
    return f"(CASE WHEN ({z}) >= 0 THEN {chi2_p(f'({z}) * ({z})', '1')} / 2 ELSE 1 - {chi2_p(f'({z}) * ({z})', '1')} / 2 END)"


def _horner(c: Sequence[float], x: str) -> str:
    out = repr(c[-1])
    for v in reversed(c[:-1]):
        out = f"({out} * ({x}) + {v!r})"
    return out


def normal_quantile(p: str) -> str:
    """Rational approximation of the normal quantile, in three ranges."""
    q, mid = f"(({p}) - 0.5)", f"(0.180625 - (({p}) - 0.5) * (({p}) - 0.5))"
    r = f"sqrt(-ln(least(({p}), 1 - ({p}))))"
    inner = f"{q} * {_horner(_A, mid)} / {_horner(_B, mid)}"
    near = f"{_horner(_C, f'{r} - 1.6')} / {_horner(_D, f'{r} - 1.6')}"
    far = f"{_horner(_E, f'{r} - 5.0')} / {_horner(_F, f'{r} - 5.0')}"
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {inner} ELSE sign({q}) * CASE WHEN {r} <= 5 THEN {near} ELSE {far} END END)"


def gram_cte(name: str, source: str, xs: Sequence[str], y: str, by: Sequence[str] = ()) -> str:
    cols = [*xs, y]
    head = "".join(f"{b}, " for b in by)
    parts = ["count(*)::DOUBLE AS n"] + [f"avg({c}) AS m{i}" for i, c in enumerate(cols)]
    parts += [
        f"covar_pop({cols[i]}, {cols[j]}) * count(*) AS a{i}_{j}" for i in range(len(cols)) for j in range(i, len(cols))
    ]
    complete = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    return f"{name} AS MATERIALIZED (SELECT {head}{', '.join(parts)} FROM {source} WHERE {complete}{group})"


def sweep_ctes(name: str, source: str, p: int, by: Sequence[str] = (), diag_add: Sequence[str] | None = None) -> list[str]:
    """Sweep the p predictor columns of a Gram CTE: coefficients b0..bp, sse, syy, inverse v{i}_{j}.

    ``diag_add`` adds a SQL expression to each predictor's diagonal (ridge); ``sse`` is then the
    penalised value.
    """
    keep = "".join(f"{b}, " for b in by) + "n, " + ", ".join(f"m{i}" for i in range(p + 1))
    idx = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    out = []
    first = ", ".join(
        f"a{i}_{j}" + (f" + {diag_add[i]}" if diag_add and i == j and i < p else "") + f" AS a{i}_{j}" for i, j in idx
    )
    out.append(f"{name}_s0 AS (SELECT {keep}, a{p}_{p} AS syy, {first} FROM {source})")
    cell = lambda i, j: f"a{min(i, j)}_{max(i, j)}"
    for k in range(p):
        cols = []
        for i, j in idx:
            if i == k and j == k:
                e = f"-1.0 / a{k}_{k}"
            elif i == k or j == k:
                e = f"a{i}_{j} / a{k}_{k}"
            else:
                e = f"a{i}_{j} - {cell(i, k)} * {cell(k, j)} / a{k}_{k}"
            cols.append(f"{e} AS a{i}_{j}")
        out.append(f"{name}_s{k + 1} AS (SELECT {keep}, syy, {', '.join(cols)} FROM {name}_s{k})")
    slopes = ", ".join(f"a{i}_{p} AS b{i + 1}" for i in range(p))
    b0 = f"m{p} - (" + " + ".join(f"a{i}_{p} * m{i}" for i in range(p)) + ") AS b0"
    inv = ", ".join(f"-a{i}_{j} AS v{i}_{j}" for i in range(p) for j in range(i, p))
    out.append(f"{name} AS MATERIALIZED (SELECT {keep}, syy, {b0}, {slopes}, a{p}_{p} AS sse, {inv} FROM {name}_s{p})")
    return out


def newton_ctes(name: str, source: str, p: int, steps: int, penalty: float = 1.0) -> list[str]:
    """Logistic regression of y on x1..xp with weight w: coefficients b0..bp in ``name`` after so many Newton steps from 0."""
    size = p + 1
    x = ["1.0", *(f"x{i}" for i in range(1, size))]
    cells = [(i, j) for i in range(size) for j in range(i, size + 1)]
    cell = lambda i, j: f"a{min(i, j)}_{max(i, j)}"
    out = [f"{name}_b0 AS MATERIALIZED (SELECT " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(size)) + ")"]
    for s in range(1, steps + 1):
        eta = " + ".join(f"b{i} * {x[i]}" for i in range(size))
        out.append(f"{name}_p{s} AS (SELECT *, 1 / (1 + exp(-({eta}))) AS p FROM {source}, {name}_b{s - 1})")
        sums = []
        for i, j in cells:
            if j < size:
                sums.append(f"sum(w * p * (1 - p) * {x[i]} * {x[j]}) + {penalty if i == j and i else 0.0} AS a{i}_{j}")
            else:
                sums.append(f"sum(w * (y - p) * {x[i]}) - {penalty if i else 0.0} * any_value(b{i}) AS a{i}_{j}")
        out.append(f"{name}_{s}_s0 AS MATERIALIZED (SELECT {', '.join(sums)} FROM {name}_p{s})")
        for k in range(size):
            cols = []
            for i, j in cells:
                if i == k and j == k:
                    e = f"-1.0 / a{k}_{k}"
                elif i == k or j == k:
                    e = f"a{i}_{j} / a{k}_{k}"
                else:
                    e = f"a{i}_{j} - {cell(i, k)} * {cell(k, j)} / a{k}_{k}"
                cols.append(f"{e} AS a{i}_{j}")
            out.append(f"{name}_{s}_s{k + 1} AS MATERIALIZED (SELECT {', '.join(cols)} FROM {name}_{s}_s{k})")
        last = name if s == steps else f"{name}_b{s}"
        moved = ", ".join(f"b{i} + a{i}_{size} AS b{i}" for i in range(size))
        out.append(f"{last} AS MATERIALIZED (SELECT {moved} FROM {name}_{s}_s{size}, {name}_b{s - 1})")
    return out


def ols_ctes(name: str, source: str, xs: Sequence[str], y: str, by: Sequence[str] = ()) -> list[str]:
    return [gram_cte(f"{name}_g", source, xs, y, by), *sweep_ctes(name, f"{name}_g", len(xs), by)]


def inv0(p: int) -> str:
    """(X'X)^-1 element of the intercept."""
    terms = [
        f"{'2 * ' if i != j else ''}v{i}_{j} * m{i} * m{j}" for i in range(p) for j in range(i, p)
    ]
    return "(1.0 / n + " + " + ".join(terms) + ")"


def term_rows(fit: str, xs: Sequence[str], names: Sequence[str] | None = None, const: bool = True, extra: str = "") -> str:
    """SELECT ... UNION ALL of (term, coef, se, t): the caller adds p outside."""
    p = len(xs)
    s2 = f"(sse / (n - {p + 1}))"
    rows = []
    if const:
        rows.append(f"SELECT {extra}'const' AS term, b0 AS coef, sqrt({s2} * {inv0(p)}) AS se, n - {p + 1} AS df FROM {fit}")
    for i, x in enumerate(names or xs):
        rows.append(f"SELECT {extra}'{x}' AS term, b{i + 1} AS coef, sqrt({s2} * v{i}_{i}) AS se, n - {p + 1} AS df FROM {fit}")
    return " UNION ALL ".join(rows)


def with_ctes(ctes: Sequence[str], final: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + final
