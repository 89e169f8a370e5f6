"""Numeric functions: size scales, rounding, hashes and directions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GOLDEN_ANGLE = math.pi * (3 - math.sqrt(5))


def citation_diameter(count: Column, least: float = 14, most: float = 44, reference: float = 64) -> Column:
    """Diameter whose area grows with log(1 + count) up to ``reference``; negative and NaN count as 0."""
    if not (0 < least <= most and reference > 0):
        raise ValueError("sizes must be positive and ordered")
    count = F.when(F.isnan(count.cast("double")) | (count < 0), F.lit(0.0)).otherwise(count.cast("double"))
    progress = F.least(F.lit(1.0), F.log1p(count) / math.log1p(reference))
    return F.sqrt(F.lit(float(least**2)) + F.lit(float(most**2 - least**2)) * progress)


#: Fixed diameters of the uniform map.
OBSERVATION_DIAMETER, OTHER_DIAMETER = 28.0, 16.0


def map_diameter(mode: Column, observation: Column, citations: Column) -> Column:
    """A paper's diameter: by its citations in the mode 'citations', by its role in any other."""
    uniform = F.when(observation, F.lit(OBSERVATION_DIAMETER)).otherwise(F.lit(OTHER_DIAMETER))
    return F.when(mode == "citations", citation_diameter(citations)).otherwise(uniform)


def collision_radius(diameter: Column, halo: float = 5, scale: float = 1.12) -> Column:
    return (diameter / 2 + F.lit(float(halo))) * F.lit(scale)


def round_half_up(c: Column, places: int = 3) -> Column:
    """Halves go toward plus infinity, as in scripting languages of the web."""
    k = float(10**places)
    return F.floor(c * k + 0.5) / k


def clamp(c: Column, low: float | Column, high: float | Column) -> Column:
    col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.greatest(col(low), F.least(c, col(high)))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over an ASCII text, as a long."""
    codes = F.transform(F.split(c, ""), F.ascii)
    codes = F.filter(codes, lambda x: x > 0)
    return F.aggregate(
        codes, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x.cast("long")) * 16777619).bitwiseAND(F.lit(4294967295))
    )


def direction(first: Column, second: Column) -> Column:
    """Angle in radians drawn from two ids."""
    return fnv1a(F.concat(first, F.lit(":"), second)) / F.lit(4294967295.0) * F.lit(2 * math.pi)


def fold_angle(a: Column) -> Column:
    """An angle folded to [-pi, pi)."""
    turn = F.lit(2 * math.pi)
    return a - turn * F.floor((a + math.pi) / turn)
