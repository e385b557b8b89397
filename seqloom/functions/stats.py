"""Statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: bit score constants
K, LAMBDA = 0.035, 0.252
# fixed values: Abramowitz and Stegun 7.1.26
P, A1, A2, A3, A4, A5 = 0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429


def bit_score(raw: Column) -> Column:
    """A raw alignment score in bits."""
    return (F.lit(LAMBDA) * raw - F.lit(math.log(K))) / F.lit(math.log(2))


def phi(z: Column) -> Column:
    """The normal distribution function; absolute error below 1e-7."""
    x = F.abs(z) / F.lit(math.sqrt(2))
    t = 1 / (1 + F.lit(P) * x)
    poly = t * (F.lit(A1) + t * (F.lit(A2) + t * (F.lit(A3) + t * (F.lit(A4) + t * F.lit(A5)))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def phi_sql(z: str) -> str:
    """:func:`phi` as SQL text."""
    x = f"(abs({z}) / {math.sqrt(2)!r})"
    t = f"(1 / (1 + {P!r} * {x}))"
    poly = f"{t} * ({A1!r} + {t} * (({A2!r}) + {t} * ({A3!r} + {t} * (({A4!r}) + {t} * {A5!r}))))"
    erf = f"(1 - {poly} * exp(-{x} * {x}))"
    return f"(CASE WHEN {z} >= 0 THEN 0.5 * (1 + {erf}) ELSE 0.5 * (1 - {erf}) END)"


def gaussian(x: Column, mean: Column, sd: Column) -> Column:
    """The normal density."""
    z = (x - mean) / sd
    return F.exp(-z * z / 2) / (sd * F.lit(math.sqrt(2 * math.pi)))


def reflected(x: Column, low: Column, high: Column) -> Column:
    """A value folded back into [low, high] as often as needed."""
    width = high - low
    away = F.pmod(x - low, 2 * width)
    return F.when(width == 0, low).otherwise(low + F.least(away, 2 * width - away))


def kde_mass(samples: Column, low: Column, high: Column, bandwidth: Column) -> Column:
    """An aggregate: the mass of a Gaussian kernel density over a column, between two bounds."""
    return F.avg(phi((high - samples) / bandwidth) - phi((low - samples) / bandwidth))


def scott(samples: Column) -> Column:
    """An aggregate: Scott's bandwidth."""
    return F.stddev_samp(samples) * F.pow(F.count(samples).cast("double"), F.lit(-0.2))


def silverman(samples: Column) -> Column:
    """An aggregate: Silverman's bandwidth."""
    return F.stddev_samp(samples) * F.pow(F.count(samples) * 0.75, F.lit(-0.2))
