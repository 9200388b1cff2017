"""Expected demand above a sell-out, from a count distribution matched to mean and variance."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, functions as F

# Fixed value: below this upper-tail probability the estimate is the cap plus one.
NEGLIGIBLE_TAIL = 1e-9
#: Widths of the integrand's peak that hold all of it on the left; panels on the right double in width.
LEFT_WIDTHS = 12.0
RIGHT_PANELS = 52
#: Panels that hold all of the right side of a log-concave integrand, and points on each.
CONCAVE_PANELS = 8
POINTS = 8


def _panels(edges: list[float], points: int) -> tuple[list[float], list[float]]:
    """Places and weights of a Gauss-Legendre rule on each panel."""
    x, w = np.polynomial.legendre.leggauss(points)
    places, weights = [], []
    for low, high in zip(edges, edges[1:]):
        half = (high - low) / 2
        places += (low + half * (x + 1)).tolist()
        weights += (half * w).tolist()
    return places, weights


_LEFT = _panels([0.0, 0.25, 0.5, 1.0], 16)
_RIGHT = _panels([0.0, *[2.0**k for k in range(-1, RIGHT_PANELS)]], POINTS)


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, and back by the recurrence."""
    z = x + 8.0
    steps = x
    for k in range(1, 8):
        steps = steps * (x + float(k))
    series = 1.0 / (12.0 * z) - 1.0 / (360.0 * z * z * z) + 1.0 / (1260.0 * z * z * z * z * z)
    return (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + series - F.ln(steps)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tail_mean(mean: Column, variance: Column, cap: Column) -> Column:
    """E[D | D > cap]: negative binomial when variance exceeds mean, else Poisson.

    Both families have the ratio P(k) / P(k - 1) = (a + b (k - 1)) / k. Summing k P(k) over all k above
    the cap c gives E = (a (1 + q) + b c q) / (1 - b) with q = P(c) / P(D > c), so only q is needed.
    1 / q is the integral over u > 0 of exp(-(c + 1) u) times a smooth factor of the family. It is taken
    on panels around its peak that double in width, so the cost is the same for every cap and
    every mean, and no difference of nearly equal sums occurs in a thin tail.
    """
    mean, variance, cap = (x.cast("double") for x in (mean, variance, cap))
    size = F.when(variance > mean, mean * mean / (variance - mean)).otherwise(1.0)  # not used when Poisson
    family = F.struct(
        mean.alias("mean"),
        cap.alias("cap"),
        F.greatest(F.floor(cap).cast("double"), F.lit(0.0)).alias("c"),
        (variance > mean).alias("wide"),
        size.alias("size"),
        (mean / (size + mean)).alias("b"),
        (size / (size + mean)).alias("rest"),  # 1 - b
    )
    above = _let(family, lambda f: _let(_peak(f), lambda p: _let(_log_top(f, p), lambda top: _above(f, p, top))))
    return F.when(mean <= 0, cap).otherwise(above)


def _log_f(f: Column, u: Column) -> Column:
    """The integrand's logarithm."""
    grown = -F.expm1(-u)
    factor = F.when(f["wide"], (f["size"] - 1.0) * F.log1p(f["b"] * grown / f["rest"])).otherwise(f["mean"] * grown)
    return factor - (f["c"] + 1.0) * u


def _peak(f: Column) -> Column:
    """Where the integrand is largest, and how wide it is there."""
    mean, c, size, b, rest = (f[x] for x in ("mean", "c", "size", "b", "rest"))
    at = F.when(f["wide"], F.ln(b * (c + size) / (c + 1.0))).otherwise(F.ln(mean / (c + 1.0)))
    bend = F.when(f["wide"], (c + 1.0) * (c + size) / (size - 1.0)).otherwise(c + 1.0)
    slope = c + 1.0 - F.when(f["wide"], (size - 1.0) * b / rest).otherwise(mean)
    bend_at_0 = F.when(f["wide"], F.greatest((size - 1.0) * b / (rest * rest), F.lit(0.0))).otherwise(mean)
    return _let(
        at,
        lambda at: F.struct(
            F.greatest(at, F.lit(0.0)).alias("at"), (1.0 / F.when(at > 0, F.sqrt(bend)).otherwise(slope + F.sqrt(bend_at_0))).alias("width")
        ),
    )


def _log_top(f: Column, p: Column) -> Column:
    return _log_f(f, p["at"])


def _above(f: Column, p: Column, top: Column) -> Column:
    mean, c, size, b, rest = (f[x] for x in ("mean", "c", "size", "b", "rest"))

    def integral(places: Column, weights: Column, step: Column) -> Column:
        values = F.zip_with(places, weights, lambda x, w: w * F.exp(_log_f(f, p["at"] + step * x) - top))
        return F.abs(step) * F.aggregate(values, F.lit(0.0), lambda a, v: a + v)

    # With a size below 1 the integrand falls as a power before exp(-(c + 1) u) ends it.
    long = F.ceil(F.log2(60.0 / ((c + 1.0) * p["width"]))) + 3
    panels = F.when(f["wide"] & (size < 1), F.least(F.greatest(long, F.lit(CONCAVE_PANELS)), F.lit(RIGHT_PANELS))).otherwise(CONCAVE_PANELS)
    points = (panels * POINTS).cast("int")
    right = integral(F.slice(F.lit(_RIGHT[0]), F.lit(1), points), F.slice(F.lit(_RIGHT[1]), F.lit(1), points), p["width"])
    reach = F.least(p["at"], LEFT_WIDTHS * p["width"])
    left = F.when(p["at"] > 0, integral(F.lit(_LEFT[0]), F.lit(_LEFT[1]), -reach)).otherwise(0.0)
    scale = F.when(f["wide"], (c + size) * b / rest).otherwise(mean)
    log_p = F.when(
        f["wide"], _log_gamma(c + size) - _log_gamma(size) - _log_gamma(c + 1.0) + size * F.ln(rest) + c * F.ln(b)
    ).otherwise(c * F.ln(mean) - mean - _log_gamma(c + 1.0))

    def from_ratio(q: Column) -> Column:
        negligible = (c > mean) & (log_p - F.ln(q) < float(np.log(NEGLIGIBLE_TAIL)))
        wide = (size * b * (1.0 + q) + b * c * q) / rest
        return F.when(negligible, f["cap"] + 1.0).when(f["wide"], wide).otherwise(mean * (1.0 + q))

    return _let(F.exp(-top) / (scale * (right + left)), from_ratio)
