"""Column functions of the measurement pipeline; all run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def n_decimals(text: Column) -> Column:
    """Digits after the point of a number as written, without trailing zeros; 0 without a point."""
    return F.length(F.rtrim(F.split_part(text, F.lit("."), F.lit(2)), F.lit("0")))


def round_half_even(c: Column, places: int) -> Column:
    """The rounding of scientific libraries: ties go to the even digit."""
    return F.bround(c, places)


def mole_fraction_to_log(x: Column, density: Column, weight: Column) -> Column:
    """log10 of x / (1 - x) * density * 1000 / weight for 0 < x < 1; null elsewhere or without density or weight."""
    inside = (x > 0) & (x < 1) & (density > 0) & (weight > 0)
    return F.when(inside, F.log10(F.try_divide(x, 1 - x) * density * 1000 / F.when(weight > 0, weight)))


def recovery_reason(x: Column, density: Column, weight: Column) -> Column:
    return F.when(x.isNull() | (x <= 0) | (x >= 1), "bad_x").when(density.isNull() | (density <= 0), "no_density").when(weight.isNull() | (weight <= 0), "no_weight").otherwise("ok")


def concentration_to_mole_fraction(s: Column, density: Column, weight: Column) -> Column:
    """k s / (1 + k s) with k = weight / (1000 density)."""
    k = F.try_divide(weight, 1000 * density)
    return k * s / (1 + k * s)


def temperature_features(t: Column) -> list[Column]:
    """T/300, 1000/T, (T/300) squared, ln(T/300)."""
    r = t / 300
    return [r.alias("t_scaled"), F.try_divide(F.lit(1000.0), t).alias("t_inverse"), (r * r).alias("t_squared"), F.log(r).alias("t_log")]


def finite_or_zero(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def esol(logp: Column, weight: Column, rotatable: Column, aromatic: Column) -> Column:
    return 0.16 - 0.63 * logp - 0.0062 * weight + 0.066 * rotatable - 0.74 * aromatic


def general_solubility(logp: Column) -> Column:
    return 0.5 - logp


def has_tetrahedral_mark(key: Column) -> Column:
    return F.contains(key, F.lit("@"))


def has_double_bond_mark(key: Column) -> Column:
    return F.contains(key, F.lit("/")) | F.contains(key, F.lit("\\"))


def stamp_temperature(nodes: Column, t: Column) -> Column:
    """An array of node vectors, each with the four temperature features after its own."""
    tail = F.array(*[c.cast("double") for c in temperature_features(t)])
    return F.transform(nodes, lambda n: F.concat(n.cast("array<double>"), tail))
