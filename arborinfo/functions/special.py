"""Special functions Spark does not ship, as SQL text that stays in codegen.

Each function takes SQL text (best a column name: the argument appears several times in the
result) and returns SQL text for ``F.expr``. One parsed text is far cheaper to build than the
same tree of Column objects.

Gamma-family functions move the argument up by eight with the recurrence and then use the
asymptotic series. Bessel functions use the power series below ``BESSEL_SPLIT`` and the
large-argument series above it.
"""

from __future__ import annotations

import math
from functools import reduce

# Bernoulli-number coefficients of the asymptotic series.
DIGAMMA_SERIES = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132, 691 / 32760)
TRIGAMMA_SERIES = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730)
LGAMMA_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)

BESSEL_SPLIT = 12.0


def number(x: float) -> str:
    """A double literal."""
    return f"{float(x)!r}D"


def quoted(x: str) -> str:
    """A string literal."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def horner(x: str, coefficients) -> str:
    """c0 + c1 x + c2 x^2 + ..."""
    c = [number(v) for v in coefficients]
    return reduce(lambda acc, v: f"({acc} * {x} + {v})", c[-2::-1], c[-1])


def _products(x: str) -> list[str]:
    # x (x+7), (x+1)(x+6), (x+2)(x+5), (x+3)(x+4): the eight recurrence factors in pairs.
    q = f"({x}) * (({x}) + 7D)"
    return [f"({q})", f"({q} + 6D)", f"({q} + 10D)", f"({q} + 12D)"]


def digamma(x: str) -> str:
    """psi(x) for x > 0."""
    y = f"(({x}) + 8D)"
    inv2 = f"(1D / ({y} * {y}))"
    drop = " + ".join(f"1D / {q}" for q in _products(x))
    return (
        f"(ln({y}) - 0.5D / {y} + {inv2} * {horner(inv2, DIGAMMA_SERIES)}"
        f" - (2D * ({x}) + 7D) * ({drop}))"
    )


def trigamma(x: str) -> str:
    """psi'(x) for x > 0."""
    inv = f"(1D / (({x}) + 8D))"
    inv2 = f"({inv} * {inv})"
    drop = " + ".join(f"1D / ((({x}) + {k}D) * (({x}) + {k}D))" for k in range(8))
    return f"({drop} + {inv} + 0.5D * {inv2} + {inv} * {inv2} * {horner(inv2, TRIGAMMA_SERIES)})"


def lgamma(x: str) -> str:
    """ln Gamma(x) for x > 0."""
    y = f"(({x}) + 8D)"
    series = f"{horner(f'(1D / ({y} * {y}))', LGAMMA_SERIES)} / {y}"
    lift = " + ".join(f"ln({q})" for q in _products(x))
    return f"(({y} - 0.5D) * ln({y}) - {y} + {number(0.5 * math.log(2 * math.pi))} + {series} - ({lift}))"


def _bessel_tail(order: int, terms: int = 15) -> list[float]:
    # Coefficients of 1/x^k in sqrt(2 pi x) exp(-x) I_order(x).
    out, mu = [1.0], 4.0 * order * order
    for k in range(1, terms):
        out.append(-out[-1] * (mu - (2 * k - 1) ** 2) / (8.0 * k))
    return out


def _bessel_power(order: int, terms: int = 34) -> list[float]:
    # Coefficients of (x/2)^(2k) in I_order(x) / (x/2)^order.
    return [1.0 / (math.factorial(k) * math.factorial(k + order)) for k in range(terms)]


def _quotient(top: list[float], bottom: list[float]) -> list[float]:
    # Coefficients of the quotient of two power series; bottom starts with 1.
    out = []
    for k, t in enumerate(top):
        out.append(t - sum(out[i] * bottom[k - i] for i in range(k)))
    return out


def log_i0(x: str) -> str:
    """ln I0(x), x >= 0."""
    half2 = f"(({x}) * ({x}) / 4D)"
    small = f"ln({horner(half2, _bessel_power(0))})"
    large = f"(({x}) - 0.5D * ln({number(2 * math.pi)} * ({x})) + ln({horner(f'(1D / ({x}))', _bessel_tail(0))}))"
    return f"(CASE WHEN ({x}) < {number(BESSEL_SPLIT)} THEN {small} ELSE {large} END)"


def bessel_ratio(x: str) -> str:
    """A(x) = I1(x) / I0(x), x >= 0: the mean resultant length of a von Mises law."""
    half2 = f"(({x}) * ({x}) / 4D)"
    small = f"(({x}) / 2D * {horner(half2, _bessel_power(1))} / {horner(half2, _bessel_power(0))})"
    inv = f"(1D / ({x}))"
    large = f"({horner(inv, _bessel_tail(1))} / {horner(inv, _bessel_tail(0))})"
    return f"(CASE WHEN ({x}) < {number(BESSEL_SPLIT)} THEN {small} ELSE {large} END)"


#: Coefficients of A(x) in 1/x for x >= 10 (error below 1e-7 at 10, far less above).
BESSEL_RATIO = _quotient(_bessel_tail(1, 12), _bessel_tail(0, 12))


def bessel_ratio_large(x: str) -> str:
    """A(x) for x >= 10 as one series in 1/x."""
    return horner(f"(1D / ({x}))", BESSEL_RATIO)


def xlogx(x: str) -> str:
    """x ln x with 0 at x = 0."""
    return f"(CASE WHEN ({x}) > 0 THEN ({x}) * ln({x}) ELSE 0D END)"


def entr(p: str) -> str:
    """-p ln p with 0 at p = 0."""
    return f"(-{xlogx(p)})"


def xlogy(x: str, y: str) -> str:
    """x ln y with 0 at x = 0."""
    return f"(CASE WHEN ({x}) = 0 THEN 0D ELSE ({x}) * ln({y}) END)"
