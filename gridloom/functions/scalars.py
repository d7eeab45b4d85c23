"""Column expressions: weights, unit conversions, predictions, projections, texts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Densities of ice and sea water (kg/m3), seconds of a year (365 and 365.25 days), area of the oceans (m2).
ICE, SEA = 910.0, 1028.0
YEAR_S, JULIAN_YEAR_S = 365.0 * 24 * 3600, 3.15576e7
OCEAN_M2 = 3.62e14


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def draft_weight(melt, draft, a: float = 1.0) -> Column:
    """|draft|**a; null where melt is."""
    return F.when(_c(melt).isNotNull(), F.pow(F.abs(_c(draft)), F.lit(a)))


def threshold_weight(draft, threshold: float | Column = 1000.0) -> Column:
    """1 above the threshold, else 0; null without a draft."""
    return F.when(_c(draft) > threshold, 1.0).when(_c(draft).isNotNull(), 0.0)


def inverse_distance_weight(distance, a: float = 1.0) -> Column:
    return F.pow(1.0 / (_c(distance) + 1e-6), F.lit(a))


def gaussian_weight(draft, mu: float | Column = 1200.0, sigma: float | Column = 300.0) -> Column:
    return F.exp(-0.5 * F.pow((_c(draft) - mu) / sigma, F.lit(2)))


def gaussian_weight_of(draft: str) -> Column:
    """The Gaussian weight with the key's own mean and deviation, as ``regress.with_moments`` adds them."""
    return gaussian_weight(draft, F.col(f"{draft}_mean"), F.col(f"{draft}_std"))


def sigmoid_weight(draft, mu: float | Column, k: float = 0.005, a: float = 1.0) -> Column:
    return F.pow(1.0 / (1.0 + F.exp(-k * (_c(draft) - mu))), F.lit(a))


def sigmoid_weight_of(draft: str, k: float = 0.005, a: float = 1.0) -> Column:
    """The sigmoid weight around the key's own mean draft, as ``regress.with_moments`` adds it."""
    return sigmoid_weight(draft, F.col(f"{draft}_mean"), k, a)


def uniform_weight(melt) -> Column:
    return F.when(_c(melt).isNotNull(), 1.0)


def melt_weight(melt, a: float = 1.0) -> Column:
    return F.pow(F.abs(_c(melt)), F.lit(a))


def product(*weights: Column) -> Column:
    out = weights[0]
    for w in weights[1:]:
        out = out * w
    return out


def combined_weight(melt, draft, distance, dynamic, a: float = 1, b: float = 1, c: float = 1, d: float = 1, e: float = 1, f: float = 1) -> Column:
    """Six factors, each to its power: melt, draft, inverse distance (left out without one), the Gaussian of draft, the
    threshold weight of draft, and the threshold weight at ``dynamic`` (the region's own); null where melt is."""
    own = [melt_weight(melt, a), F.pow(F.abs(_c(draft)), F.lit(b))]
    if distance is not None:
        own.append(inverse_distance_weight(distance, c))
    own += [F.pow(x, F.lit(p)) for x, p in ((gaussian_weight(draft), d), (threshold_weight(draft), e), (threshold_weight(draft, _c(dynamic)), f))]
    return F.when(_c(melt).isNotNull(), product(*own))


def piecewise(draft, threshold, slope, intercept, shallow) -> Column:
    """shallow below the threshold, the line from it on."""
    return F.when(_c(draft) < _c(threshold), _c(shallow)).otherwise(_c(slope) * _c(draft) + _c(intercept))


def piecewise_three(draft, threshold, slope, intercept, shallow_mean) -> dict[str, Column]:
    """The three shallow behaviours: zero, the shallow mean, the line's value at the threshold."""
    at = _c(slope) * _c(threshold) + _c(intercept)
    return {name: piecewise(draft, threshold, slope, intercept, low) for name, low in (("zero", F.lit(0.0)), ("mean", _c(shallow_mean)), ("threshold", at))}


def from_parameters(draft, min_draft="minDraft", constant="constantValue", kind="paramType", alpha0="alpha0", alpha1="alpha1") -> Column:
    """Melt from the five stored parameters: the constant for type 1 and above the least draft, else the line."""
    return F.when((_c(kind) == 1) | (_c(draft) < _c(min_draft)), _c(constant)).otherwise(_c(alpha0) + _c(alpha1) * _c(draft))


def from_model(draft, threshold, slope, intercept, kind, constant=None) -> Column:
    """Melt by model type: zero, constant, or a line beyond the threshold; never below 0."""
    line = F.when(_c(draft) < _c(threshold), 0.0).otherwise(F.greatest(_c(slope) * _c(draft) + _c(intercept), F.lit(0.0)))
    return F.when(_c(kind) == "zero", 0.0).when(_c(kind) == "constant", F.greatest(_c(constant) if constant is not None else F.lit(0.0), F.lit(0.0))).otherwise(line)


def from_strategy(draft, threshold, slope, intercept, kind) -> Column:
    """Melt by the type of a region's model: its line from the threshold on and the line's value there below it, or else its
    intercept; never below 0, null without a positive draft."""
    line = piecewise(draft, threshold, slope, intercept, _c(slope) * _c(threshold) + _c(intercept))
    return F.when(_c(draft) > 0, F.greatest(F.when(_c(kind) == "piecewise_linear", line).otherwise(_c(intercept)), F.lit(0.0)))


def melt_to_flux(v) -> Column:
    """m of ice a year to kg/m2/s."""
    return _c(v) * (ICE / YEAR_S)


def flux_to_melt(v) -> Column:
    return _c(v) * (YEAR_S / ICE)


def scaled(name, value, unit: str) -> Column:
    """A statistic in the wished unit (m3, kg or Gt), by what its name says it is: volume, area, mass balance or flux."""
    volume = {"m3": 1.0, "kg": ICE, "Gt": ICE / 1e12}[unit]
    mass = {"m3": 1.0 / ICE, "kg": 1.0, "Gt": 1e-12}[unit]
    n = F.lower(_c(name))
    return _c(value) * F.when(n.contains("volume"), volume).when(n.contains("area"), 1e-6).when(n.contains("flux") | n.contains("massbal"), mass).otherwise(1.0)


def flotation_to_sea_level(volume, to_m3: float = 1.0) -> Column:
    """Volume above flotation to mm of sea level."""
    return _c(volume) * (to_m3 / OCEAN_M2 * ICE / SEA * 1000.0)


def sea_level_to_flotation(mm, to_m3: float = 1.0) -> Column:
    return _c(mm) / (to_m3 / OCEAN_M2 * ICE / SEA * 1000.0)


def kg_s_to_gt_year(v) -> Column:
    return _c(v) * (365.25 * 86400 / 1e12)


def speed(u, v, per_year: bool = True) -> Column:
    return F.hypot(_c(u), _c(v)) * (YEAR_S if per_year else 1.0)


def log10_or_null(v) -> Column:
    return F.when(_c(v) > 0, F.log10(_c(v)))


def has_bits(mask, bits: int) -> Column:
    return _c(mask).bitwiseAND(bits) == bits


def floating(thickness, bed) -> tuple[Column, Column]:
    """(grounded, inside the ice's extent) from thickness and bed."""
    return _c(thickness) > -(SEA / ICE) * _c(bed), _c(thickness) > 0


def polar_stereographic(lon, lat, lat_true: float = -71.0, lon0: float = 0.0, a: float = 6378137.0, e: float = 0.0818191908426215) -> tuple[Column, Column]:
    """x and y (m) of the south polar stereographic plane on the ellipsoid, by its closed form."""

    def t(phi):
        s = F.sin(phi)
        return F.tan(math.pi / 4 + phi / 2) * F.pow((1 - e * s) / (1 + e * s), F.lit(-e / 2))

    phi_c = math.radians(lat_true)
    s = math.sin(phi_c)
    tc = math.tan(math.pi / 4 + phi_c / 2) * ((1 - e * s) / (1 + e * s)) ** (-e / 2)
    mc = math.cos(phi_c) / math.sqrt(1 - (e * s) ** 2)
    rho = a * mc / tc * t(F.radians(_c(lat)))
    turn = F.radians(_c(lon) - lon0)
    return rho * F.sin(turn), rho * F.cos(turn)


def sector(x, y, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """The name of the first rule (name, SQL condition on x and y) that holds."""
    out = None
    for name, rule in rules:
        test = F.expr(rule.replace("{x}", x).replace("{y}", y))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(other)


def plain_name(text) -> Column:
    return F.regexp_replace(F.trim(_c(text)), "[^A-Za-z0-9]", "")


def year_in(text) -> Column:
    """The first number of four digits; null without one."""
    found = F.regexp_extract(_c(text), "([0-9]{4})", 1)
    return F.when(found != "", found.cast("int"))


def member_in(text, prefix: str) -> Column:
    return F.replace(_c(text), F.lit(prefix), F.lit("")).cast("int")


def stamp(year, width: int = 64) -> Column:
    """YYYY-07-01_00:00:00, padded."""
    return F.rpad(F.format_string("%04d-07-01_00:00:00", _c(year).cast("int")), width, " ")
