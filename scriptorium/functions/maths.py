"""Numeric functions as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _known(value: Column, *parts: Column) -> Column:
    """``value`` where no part is null, else null: greatest and least pass over nulls."""
    known = parts[0].isNotNull()
    for p in parts[1:]:
        known = known & p.isNotNull()
    return F.when(known, value)


def least(*parts: Column) -> Column:
    return _known(F.least(*parts), *parts)


def greatest(*parts: Column) -> Column:
    return _known(F.greatest(*parts), *parts)


def clamp(x: Column, low: float, high: float) -> Column:
    """M3; null stays null."""
    return greatest(F.lit(low), least(F.lit(high), x))


def half_up(x: Column) -> Column:
    """Rounding of halves toward plus infinity."""
    return F.floor(x + 0.5)


def sql_round(x: Column, digits: int = 6) -> Column:
    """Rounding as DuckDB's: of the double ``x`` times a power of ten, halves away from zero. F.round goes by the printed digits instead."""
    scaled = x * 10.0**digits
    return F.when(F.abs(scaled) < math.inf, F.round(scaled) / 10.0**digits).otherwise(x)


def linspace(low: Column, high: Column, steps: Column) -> Column:
    """M1: values rounded to three decimals; none for no steps, ``low`` for one."""
    at = lambda i: half_up((low + (high - low) / F.greatest(steps - 1, F.lit(1)) * i) * 1000) / 1000
    empty = F.array().cast("array<double>")
    return F.when(steps <= 0, empty).when(steps == 1, F.array(low.cast("double"))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(steps, F.lit(1)) - 1), at))


def overlap(ax, ay, aw, ah, bx, by, bw, bh) -> Column:  # noqa: ANN001
    """Area that two boxes share."""
    w = least(ax + aw, bx + bw) - greatest(ax, bx)
    h = least(ay + ah, by + bh) - greatest(ay, by)
    return greatest(w, F.lit(0.0)) * greatest(h, F.lit(0.0))


def iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:  # noqa: ANN001
    """M4: intersection over union, 0 for boxes without area."""
    both = overlap(ax, ay, aw, ah, bx, by, bw, bh)
    union = aw * ah + bw * bh - both
    return F.when(union > 0, both / union).when(union.isNotNull(), 0.0)


def contained(ax, ay, aw, ah, bx, by, bw, bh) -> Column:  # noqa: ANN001
    """Share of box b that lies in box a."""
    return F.when(bw * bh > 0, overlap(ax, ay, aw, ah, bx, by, bw, bh) / (bw * bh)).when((bw * bh).isNotNull(), 0.0)


def index_position(values: Column, value: Column) -> Column:
    """M5: place of a value among n, as index / (n - 1); 0 where it is unknown or alone."""
    at = F.array_position(values, value)
    return F.when((F.size(values) <= 1) | (at == 0), 0.0).otherwise((at - 1) / (F.size(values) - 1))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def rbf(a: Column, b: Column, length: float = 0.5, variance: float = 1.0) -> Column:
    """M7."""
    return F.lit(variance) * F.exp(-0.5 * squared_distance(a, b) / (length * length))


# The five-term rational approximation of the error function (Abramowitz and Stegun 7.1.26).
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    """M8."""
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def expected_improvement(mean: Column, deviation: Column, best: Column) -> Column:
    """M9, for a minimum; 0 where the deviation is next to nothing."""
    z = (best - mean) / deviation
    cdf = 0.5 * (1 + erf(z / math.sqrt(2)))
    pdf = F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    return F.when(deviation < 1e-8, 0.0).otherwise((best - mean) * cdf + deviation * pdf)


def rotated_size(width: Column, height: Column, degrees: Column) -> tuple[Column, Column]:
    """M12."""
    c, s = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    return F.floor(width * c + height * s), F.floor(width * s + height * c)


def unclipped(x, y, w, h, ratio: float) -> tuple[Column, Column, Column, Column]:  # noqa: ANN001
    """A box grown around its centre by area * ratio / perimeter on each side."""
    d = w * h * ratio / (2 * (w + h))
    return x - d, y - d, w + 2 * d, h + 2 * d


def dpi_scale(capital_height: Column, least: float, most: float) -> Column:
    """1 where the scale would be 1.05 or less."""
    scale = _known(F.least(F.lit(least) / F.nullif(capital_height, F.lit(0)), F.lit(most)), capital_height)
    return F.when((capital_height <= 0) | (scale <= 1.05), 1.0).otherwise(scale)


def rectification_confidence(area: Column, image: Column) -> Column:
    """M18."""
    return least(area / image * 1.5, F.lit(0.95))


def output_size(corners: Column) -> tuple[Column, Column]:
    """Width and height of a quadrilateral, the longer of opposite sides."""
    side = lambda a, b: F.hypot(corners[a]["x"] - corners[b]["x"], corners[a]["y"] - corners[b]["y"])
    return greatest(side("topLeft", "topRight"), side("bottomLeft", "bottomRight")), greatest(side("topLeft", "bottomLeft"), side("topRight", "bottomRight"))


def grid_scale(value: Column, low: float, high: float) -> Column:
    """M6: a parameter in [0, 1]."""
    return F.lit(0.0) if high == low else (value - low) / (high - low)


def grid_value(share: Column, low: float, high: float, step: float | None = None, integer: bool = False) -> Column:
    """M6: back from [0, 1], on the step's grid."""
    v = share * (high - low) + low
    if step:
        v = half_up((v - low) / step) * step + low
    return half_up(v) if integer else clamp(v, low, high)
