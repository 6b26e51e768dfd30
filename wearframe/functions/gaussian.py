"""Normal distribution as SQL text, so any SQL engine evaluates the same formula."""

from statistics import NormalDist

from pyspark.sql import functions as F

# Rational approximation of the normal cdf (Hart 1968), error below 1e-14.
_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
        112.079291497871, 221.213596169931, 220.206867912376)
_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
        296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)

Z95 = 1.959964


def _d(x):
    return f"CAST({x!r} AS DOUBLE)"


def _horner(coefficients, x):
    out = _d(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {_d(c)})"
    return out


def cdf_sql(z: str) -> str:
    """P(Z <= z) for a SQL expression ``z``."""
    a = f"abs({z})"
    body = f"exp(-({z}) * ({z}) / 2) * {_horner(_NUM, a)} / {_horner(_DEN, a)}"
    frac = f"({a} + 0.65)"
    for k in (4, 3, 2, 1):
        frac = f"({a} + {k} / {frac})"
    far = f"exp(-({z}) * ({z}) / 2) / {frac} / CAST(2.506628274631 AS DOUBLE)"
    tail = f"(CASE WHEN {a} > 37 THEN CAST(0 AS DOUBLE) WHEN {a} < 7.07106781186547 THEN {body} ELSE {far} END)"
    return f"(CASE WHEN ({z}) > 0 THEN 1 - {tail} ELSE {tail} END)"


def pdf_sql(z: str) -> str:
    return f"(exp(-({z}) * ({z}) / 2) * {_d(0.3989422804014327)})"


def crps_sql(y: str, mean: str, sd: str) -> str:
    """Continuous ranked probability score of a normal forecast; sd is floored at 1e-9."""
    s = f"greatest({sd}, CAST(1e-9 AS DOUBLE))"
    z = f"(({y} - {mean}) / {s})"
    return f"({s} * ({z} * (2 * {cdf_sql(z)} - 1) + 2 * {pdf_sql(z)} - {_d(0.5641895835477563)}))"


def cdf(z):
    """P(Z <= z) for the named column or SQL text."""
    return F.expr(cdf_sql(z))


def ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)
