"""Tail probabilities and test constants for a handful of driver-side statistics."""

from __future__ import annotations

import math



def upper_gamma_ratio(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    # Lentz's continued fraction
    tiny = 1e-300
    b = x + 1 - a
    c = 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1 / d
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return min(1.0, scale * h)


def chi2_tail(stat: float, dof: int) -> float:
    """P(chi-square with ``dof`` degrees of freedom > stat)."""
    return upper_gamma_ratio(dof / 2.0, stat / 2.0)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def harmonic(m: int, power: int = 1) -> float:
    """Sum of 1 / i**power for i = 1..m (power 1 or 2), by the Euler-Maclaurin series taken 16 terms further on."""
    x = m + 16.0
    if power == 1:
        far = math.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    else:
        far = math.pi**2 / 6 - 1 / x + 1 / (2 * x**2) - 1 / (6 * x**3) + 1 / (30 * x**5) - 1 / (42 * x**7)
    return far - math.fsum((m + k) ** -float(power) for k in range(1, 17))


def anderson_darling_sigma(n1: int, n2: int) -> float:
    """Standard deviation of the two-sample A2kN statistic (Scholz and Stephens, 1987), by one formula for every size."""
    n, k = n1 + n2, 2
    inverse = 1.0 / n1 + 1.0 / n2
    h = harmonic(n - 1)
    # g = sum_{i<j<n} 1 / ((n - i) j), which is the sum of squared reciprocals less a harmonic term
    g = harmonic(n - 1, 2) - 2 * h / n
    a = (4 * g - 6) * (k - 1) + (10 - 6 * g) * inverse
    b = (2 * g - 4) * k**2 + 8 * h * k + (2 * g - 14 * h - 4) * inverse - 8 * h + 4 * g - 6
    c = (6 * h + 2 * g - 2) * k**2 + (4 * h - 4 * g + 6) * k + (2 * h - 6) * inverse + 4 * h
    d = (2 * h + 6) * k**2 - 4 * h * k
    n = float(n)
    variance = (a * n**3 + b * n**2 + c * n + d) / ((n - 1) * (n - 2) * (n - 3))
    return math.sqrt(variance)
