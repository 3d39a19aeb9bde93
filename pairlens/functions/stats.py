"""p-values of t and r as column expressions, on the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: the asymptotic series at x + 8, brought back by the recurrence."""
    y = x + 8.0
    inverse = 1.0 / (y * y)
    # Coefficients B(2k) / (2k (2k - 1)) of the series, k = 1 to 5.
    series = ((((1 / 1188 * inverse - 1 / 1680) * inverse + 1 / 1260) * inverse - 1 / 360) * inverse + 1 / 12) / y
    back = x
    for step in range(1, 8):
        back = back * (x + float(step))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(back)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, evaluated front to back as a ratio of convergents."""
    tiny = 1e-300

    def away(v: Column) -> Column:
        return F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    def step(s: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        term = F.when(k % 2 == 0, even).otherwise(odd)
        d = 1 / away(1 + term * s["d"])
        c = away(1 + term / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    # The convergents settle within a few times the root of the larger parameter.
    steps = F.sequence(F.lit(1), (60 + 12 * F.sqrt(F.greatest(a, b))).cast("int"))
    start = F.struct(F.lit(1 / tiny).alias("c"), F.lit(1.0).alias("d"), F.lit(1.0).alias("h"))
    return F.aggregate(steps, start, step, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b) for a, b > 0 and x in 0 to 1."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    direct = front * _fraction(a, b, x) / a
    mirrored = 1 - front * _fraction(b, a, 1 - x) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), direct).otherwise(mirrored)


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t; null for a null t or no degrees of freedom."""
    n = df.cast("double")
    return F.when(t.isNotNull() & (n > 0), F.least(F.greatest(incomplete_beta(n / 2, F.lit(0.5), n / (n + t * t)), F.lit(0.0)), F.lit(1.0)))


def r_two_sided(r: Column, df: Column) -> Column:
    """Two-sided p-value of a correlation with `df` = n - 2 degrees of freedom; 0 for |r| = 1."""
    n = df.cast("double")
    left = F.greatest(1 - r * r, F.lit(0.0))
    return F.when(r.isNotNull() & (n > 0), F.least(F.greatest(incomplete_beta(n / 2, F.lit(0.5), left), F.lit(0.0)), F.lit(1.0)))
