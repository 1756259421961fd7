"""Circular statistics as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborinfo.functions.special import bessel_ratio, bessel_ratio_large, log_i0, number

# The range every concentration is held in.
MIN_KAPPA = 10.0
MAX_KAPPA = 600.0


def wrap_angle(x: Column, mask: Column | None = None) -> Column:
    """``x`` in (-pi, pi]; 0 where ``mask`` is false."""
    turned = F.pmod(x, F.lit(2 * math.pi))
    wrapped = turned - F.when(turned > math.pi, 2 * math.pi).otherwise(0.0)
    return wrapped if mask is None else F.when(mask, wrapped).otherwise(0.0)


def clamp_kappa(kappa: Column, mask: Column | None = None) -> Column:
    """Concentration within its range; 0 where ``mask`` is false."""
    held = F.least(F.greatest(kappa, F.lit(MIN_KAPPA)), F.lit(MAX_KAPPA))
    return held if mask is None else F.when(mask, held).otherwise(0.0)


def mean_angle(cosines: Column, sines: Column) -> Column:
    """Direction of a resultant; 0 if it has no length."""
    return F.when(cosines * cosines + sines * sines > 0, F.atan2(sines, cosines)).otherwise(0.0)


def von_mises_log_density(x: str, mu: str, kappa: str) -> str:
    """SQL for ln of the von Mises density of one angle; arguments are column names."""
    return f"({kappa} * cos({x} - {mu}) - {number(math.log(2 * math.pi))} - {log_i0(kappa)})"


def von_mises_kl(mu0: str, kappa0: str, mu1: str, kappa1: str) -> str:
    """SQL for the divergence of one von Mises law from another; sum over features for a
    product law."""
    return (
        f"({log_i0(kappa1)} - {log_i0(kappa0)}"
        f" + {bessel_ratio(kappa0)} * ({kappa0} - {kappa1} * cos({mu0} - {mu1})))"
    )


def kappa_of_resultant(df: DataFrame, resultant: str, out: str, steps: int = 4) -> DataFrame:
    """Add the concentration whose mean resultant length is ``resultant``, held in its range.

    Newton steps on A(kappa) = resultant, kept inside the range, where A is a short series.
    One projection per step, so that no step is computed twice.
    """
    r = resultant
    held = lambda k: F.expr(f"least(greatest({k}, {number(MIN_KAPPA)}), {number(MAX_KAPPA)})")
    start = f"coalesce(try_divide({r} * (2D - {r} * {r}), 1D - {r} * {r}), {number(MAX_KAPPA)})"
    df = df.withColumn(out, held(start))
    ratio = F.expr(bessel_ratio_large(out))
    step = held(f"{out} - (_ratio - {r}) / (1D - _ratio * _ratio - _ratio / {out})")
    for _ in range(steps):
        df = df.withColumn("_ratio", ratio).withColumn(out, step)
    return df.drop("_ratio")
