"""Tail probabilities as SQL column expressions (no UDF, no scipy).

Regularised incomplete beta and gamma functions are evaluated by their
continued fractions / series inside a fold over ``sequence(1, n)``
(``aggregate`` in Spark, ``list_reduce`` in DuckDB), so a p-value is an
ordinary lazy column next to the statistic it belongs to and runs in the
JVM. The iteration count grows with the shape parameters (convergence needs
about sqrt(max(a, b)) steps), so large samples stay accurate.

One generator writes the expression text for both engines: Spark gets it
through a single ``F.expr`` call (cheap to build, parsed on the JVM), DuckDB
gets the same algorithm as oracle SQL text (with its native ``lgamma``).

Arguments are SQL snippets: column names, literals or small expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos approximation, g = 7, nine coefficients (public
# standard values; relative error about 1e-15 for x >= 0.5).
LANCZOS_G = 7.0
LANCZOS_COEF = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028,
    771.32342877765313, -176.61502916214059, 12.507343278686905,
    -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]
FPMIN = 1e-300
MIN_STEPS = 200
# Shapes above this use an asymptotic expansion (or, for a beta function with
# two such shapes, give NULL); the step count below it is never cut short.
LARGE = 1e8
# Denominator degrees of freedom, per numerator degree, from which t and F
# tails come from the incomplete gamma function.
LARGE_RATIO = 1e5


class _Spark:
    @staticmethod
    def struct(**kv) -> str:
        return "named_struct(" + ", ".join(f"'{k}', CAST({v} AS DOUBLE)" for k, v in kv.items()) + ")"

    @staticmethod
    def fold(n: str, init: str, acc: str, el: str, body: str, field: str) -> str:
        return (f"aggregate(sequence(1, CAST({n} AS INT)), {init}, ({acc}, {el}) -> {body}, "
                f"{acc} -> {acc}.{field})")

    @staticmethod
    def fold_all(n: str, init: str, acc: str, el: str, body: str, finish: str) -> str:
        return (f"aggregate(sequence(1, CAST({n} AS INT)), {init}, ({acc}, {el}) -> {body}, "
                f"{acc} -> {finish})")

    @staticmethod
    def el(name: str) -> str:
        return f"CAST({name} AS DOUBLE)"

    @staticmethod
    def lgamma(x: str) -> str:
        z = f"(({x}) - 1.0)"
        a = " + ".join([repr(LANCZOS_COEF[0])] +
                       [f"{LANCZOS_COEF[i]!r} / ({z} + {i}.0)" for i in range(1, len(LANCZOS_COEF))])
        t = f"({z} + {LANCZOS_G + 0.5!r})"
        return f"({0.5 * math.log(2 * math.pi)!r} + ({z} + 0.5) * ln({t}) - {t} + ln({a}))"

    @staticmethod
    def let(name: str, body: Callable[..., str], **values: str) -> str:
        """``body`` of the values, worked out once a row and named, so that the
        text that repeats them stays short and flat (the SQL parser's time
        grows steeply with nested parentheses)."""
        fields = ", ".join(f"'{k}', {v}" for k, v in values.items())
        return f"(transform(array(named_struct({fields})), {name} -> {body(*(f'{name}.{k}' for k in values))})[0])"


class _Duck:
    @staticmethod
    def struct(**kv) -> str:
        return "{" + ", ".join(f"'{k}': CAST({v} AS DOUBLE)" for k, v in kv.items()) + "}"

    @staticmethod
    def fold(n: str, init: str, acc: str, el: str, body: str, field: str) -> str:
        return (f"(list_reduce(range(1, CAST({n} AS BIGINT) + 1), lambda {acc}, {el}: {body}, "
                f"{init})).{field}")

    @staticmethod
    def fold_all(n: str, init: str, acc: str, el: str, body: str, finish: str) -> str:
        fin = finish.replace(f"{acc}.", "r.")
        return (f"(SELECT {fin} FROM (SELECT list_reduce(range(1, CAST({n} AS BIGINT) + 1), "
                f"lambda {acc}, {el}: {body}, {init}) AS r))")

    @staticmethod
    def el(name: str) -> str:
        return f"CAST({name} AS DOUBLE)"

    @staticmethod
    def lgamma(x: str) -> str:
        return f"lgamma({x})"

    @staticmethod
    def let(name: str, body: Callable[..., str], **values: str) -> str:
        return body(*values.values())


def _steps(*shape: str) -> str:
    big = f"greatest({', '.join(f'abs({s})' for s in shape)})" if len(shape) > 1 else f"abs({shape[0]})"
    return f"(CAST(ceil(sqrt(least({big}, {LARGE!r})) * 10.0) AS INT) + {MIN_STEPS})"


def _guard(v: str) -> str:
    return f"(CASE WHEN abs({v}) < {FPMIN} THEN {FPMIN} ELSE {v} END)"


def _betacf(d, a: str, b: str, x: str) -> str:
    """Continued fraction of the incomplete beta (modified Lentz).

    One fold step per partial numerator (odd steps use the 'even' term of
    the usual pairing, even steps the 'odd' one). The product update of step
    k is applied at step k+1 from the stored (c, d), so no sub-expression is
    repeated inside the step and the expression text stays linear in size.
    """
    j = d.el("j")
    m = f"floor(({j} + 1.0) / 2.0)"
    even = f"({m} * ({b} - {m}) * ({x}) / (({a} - 1.0 + 2.0 * {m}) * ({a} + 2.0 * {m})))"
    odd = f"(-({a} + {m}) * ({a} + {b} + {m}) * ({x}) / (({a} + 2.0 * {m}) * ({a} + 1.0 + 2.0 * {m})))"
    aa = f"(CASE WHEN {j} % 2.0 = 1.0 THEN {even} ELSE {odd} END)"
    body = d.struct(c=_guard(f"1.0 + {aa} / acc.c"),
                    d=f"1.0 / {_guard(f'1.0 + {aa} * acc.d')}",
                    h="acc.h * acc.d * acc.c")
    d0 = f"(1.0 / {_guard(f'1.0 - ({a} + {b}) * ({x}) / ({a} + 1.0)')})"
    init = d.struct(c="1.0", d=d0, h="1.0")
    steps = f"(2 * {_steps(a, b)})"
    return f"({d.fold_all(steps, init, 'acc', 'j', body, 'acc.h * acc.d * acc.c')})"


def _betainc(d, a: str, b: str, x: str) -> str:
    a, b, x = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)", f"CAST({x} AS DOUBLE)"

    def front(a_, b_, x_):
        return (f"exp({d.lgamma(f'{a_} + {b_}')} - {d.lgamma(a_)} - {d.lgamma(b_)} "
                f"+ {a_} * ln({x_}) + {b_} * ln(1.0 - {x_}))")

    def tail(a: str, b: str, x: str) -> str:
        one_minus = f"(1.0 - {x})"
        direct = f"{front(a, b, x)} * {_betacf(d, a, b, x)} / {a}"
        flipped = f"1.0 - {front(b, a, one_minus)} * {_betacf(d, b, a, one_minus)} / {b}"
        return (f"(CASE WHEN {x} IS NULL OR {a} IS NULL OR {b} IS NULL OR {a} <= 0 OR {b} <= 0 OR greatest({a}, {b}) > {LARGE!r} "
                f"THEN CAST(NULL AS DOUBLE) WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 "
                f"WHEN {x} < ({a} + 1.0) / ({a} + {b} + 2.0) THEN {direct} ELSE {flipped} END)")

    return d.let("of_beta", tail, a=a, b=b, x=x)


def _gamma_parts(d, a: str, x: str) -> tuple[str, str, str]:
    """(series for P, continued fraction for Q, common prefactor)."""
    n = d.el("n")
    series_body = d.struct(term=f"acc.term * {x} / ({a} + {n})", sum=f"acc.sum + acc.term * {x} / ({a} + {n})")
    series = d.fold(_steps(a, x), d.struct(term=f"1.0 / {a}", sum=f"1.0 / {a}"), "acc", "n", series_body, "sum")
    i = d.el("i")
    an = f"(-{i} * ({i} - {a}))"
    # Deferred product update, as in _betacf: step i applies the factor of
    # step i-1 from the stored (c, d).
    cf_body = d.struct(b="acc.b + 2.0", c=_guard(f"acc.b + 2.0 + {an} / acc.c"),
                       d=f"1.0 / {_guard(f'{an} * acc.d + acc.b + 2.0')}",
                       h="acc.h * acc.d * acc.c")
    b0 = f"({x} + 1.0 - {a})"
    cf_init = d.struct(b=b0, c=str(1.0 / FPMIN), d=f"1.0 / {_guard(b0)}", h=f"{FPMIN}")
    cf = d.fold_all(_steps(a, x), cf_init, "acc", "i", cf_body, "acc.h * acc.d * acc.c")
    pref = f"exp(-{x} + {a} * ln({x}) - {d.lgamma(a)})"
    return series, cf, pref


def _gammainc_upper(d, a: str, x: str) -> str:
    """Q(a, x); for a above LARGE by the cube-root normal approximation
    (Wilson and Hilferty), whose error there is below 1e-9."""
    a, x = f"CAST({a} AS DOUBLE)", f"CAST({x} AS DOUBLE)"
    small = _is_small(a)

    def tail(a: str, x: str) -> str:
        series, cf, pref = _gamma_parts(d, a, x)
        large = ""
        if not small:
            root = f"((power({x} / {a}, 1.0 / 3.0) - 1.0 + 1.0 / (9.0 * {a})) * 3.0 * sqrt({a}))"
            large = f"WHEN {a} > {LARGE!r} THEN {_norm_sf(d, root)} "
        return (f"(CASE WHEN {x} IS NULL OR {a} IS NULL OR {a} <= 0 THEN CAST(NULL AS DOUBLE) WHEN {x} <= 0 THEN 1.0 {large}"
                f"WHEN {x} < {a} + 1.0 THEN 1.0 - {series} * {pref} ELSE {pref} * {cf} END)")

    return d.let("of_half" if small else "of_gamma", tail, a=a, x=x)


def _is_small(a: str) -> bool:
    """A literal shape needs no branch for large ones."""
    return a == "CAST(0.5 AS DOUBLE)"


def _norm_sf(d, z: str) -> str:
    z = f"CAST({z} AS DOUBLE)"
    upper = _gammainc_upper(d, "0.5", f"({z} * {z} / 2.0)")
    return f"(CASE WHEN {z} IS NULL THEN CAST(NULL AS DOUBLE) WHEN {z} >= 0 THEN 0.5 * {upper} ELSE 1.0 - 0.5 * {upper} END)"


def _chi2_sf(d, x: str, df: str) -> str:
    return _gammainc_upper(d, f"(({df}) / 2.0)", f"(({x}) / 2.0)")


def _log1p(y: str) -> str:
    """ln(1 + y) for y >= 0 without losing the digits of a small y."""
    return f"(CASE WHEN {y} < 1e-3 THEN {y} * (1.0 - {y} * (1.0 / 2.0 - {y} * (1.0 / 3.0 - {y} * (1.0 / 4.0 - {y} / 5.0)))) ELSE ln(1.0 + {y}) END)"


def _many_df(d, y: str, d1: str, d2: str) -> str:
    """F (or squared t) tail for d2 much larger than d1, y = d1 F / d2: the
    incomplete beta I_x(a, b) with a = d2/2, b = d1/2 is Q(b, N ln(1 + y))
    with N = a + b/2 - 1/2, up to a relative error of order b/N^2 (Wise)."""
    n = f"(({d2}) / 2.0 + ({d1}) / 4.0 - 0.5)"
    return _gammainc_upper(d, "0.5" if d1 == "1.0" else f"(({d1}) / 2.0)", f"({n} * {_log1p(y)})")


def _t_sf_two_sided(d, t: str, df: str) -> str:
    few = _t_few(d, t, df)
    return f"(CASE WHEN ({df}) >= {LARGE_RATIO!r} THEN {_many_df(d, f'(({t}) * ({t}) / ({df}))', '1.0', df)} ELSE {few} END)"


def _t_few(d, t: str, df: str) -> str:
    return _betainc(d, f"(({df}) / 2.0)", "0.5", f"(({df}) / (({df}) + ({t}) * ({t})))")


def _f_sf(d, f: str, d1: str, d2: str) -> str:
    many = _many_df(d, f"(({d1}) * ({f}) / ({d2}))", d1, d2)
    return (f"(CASE WHEN ({f}) <= 0 THEN 1.0 WHEN ({d2}) >= {LARGE_RATIO!r} * greatest(1.0, ({d1})) THEN {many} ELSE "
            + _betainc(d, f"(({d2}) / 2.0)", f"(({d1}) / 2.0)", f"(({d2}) / (({d2}) + ({d1}) * ({f})))")
            + " END)")


def _arg(x) -> str:
    if isinstance(x, Column):
        raise TypeError("pass a column name or SQL text; compute Column arguments into a column first")
    if isinstance(x, (int, float)):
        return repr(float(x))
    return f"({x})"


# ------------------------------------------------------------ Spark columns
def lgamma(x) -> Column:
    """log Gamma(x) for x >= 0.5 (Lanczos)."""
    return F.expr(_Spark.lgamma(_arg(x)))


def betainc(a, b, x) -> Column:
    """Regularised incomplete beta I_x(a, b), 0 <= x <= 1."""
    return F.expr(_betainc(_Spark, _arg(a), _arg(b), _arg(x)))


def gammainc_upper(a, x) -> Column:
    """Regularised upper incomplete gamma Q(a, x)."""
    return F.expr(_gammainc_upper(_Spark, _arg(a), _arg(x)))


def norm_sf(z) -> Column:
    """P(Z > z) for a standard normal Z."""
    return F.expr(_norm_sf(_Spark, _arg(z)))


def norm_cdf(z) -> Column:
    return F.expr(_norm_sf(_Spark, f"(-{_arg(z)})"))


def chi2_sf(x, df) -> Column:
    """P(X > x) for chi-square with ``df`` degrees of freedom."""
    return F.expr(_chi2_sf(_Spark, _arg(x), _arg(df)))


def t_sf_two_sided(t, df) -> Column:
    """P(|T| > |t|) for Student t with ``df`` degrees of freedom."""
    return F.expr(_t_sf_two_sided(_Spark, _arg(t), _arg(df)))


def f_sf(f, d1, d2) -> Column:
    """P(F > f) for Fisher F with (d1, d2) degrees of freedom."""
    return F.expr(_f_sf(_Spark, _arg(f), _arg(d1), _arg(d2)))


# ------------------------------------------------------------ DuckDB text
def sql_chi2_sf(x: str, df: str) -> str:
    return _chi2_sf(_Duck, f"({x})", f"({df})")


def sql_t_sf_two_sided(t: str, df: str) -> str:
    return _t_sf_two_sided(_Duck, f"({t})", f"({df})")


def sql_f_sf(f: str, d1: str, d2: str) -> str:
    return _f_sf(_Duck, f"({f})", f"({d1})", f"({d2})")


def sql_norm_sf(z: str) -> str:
    return _norm_sf(_Duck, f"({z})")
