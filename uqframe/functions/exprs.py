"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from uqframe.constants import ATOMIC_WEIGHTS, ID_PREFIXES, LOGIT_EPS


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and both infinities become null."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def to_number(c: str | Column) -> Column:
    """Text or number to a finite double; anything unreadable becomes null."""
    return finite(col(c).try_cast("double"))


def norm_text(c: str | Column) -> Column:
    return F.lower(F.trim(F.coalesce(col(c).cast("string"), F.lit(""))))


def normalize_id(c: str | Column, strict: bool = False) -> Column:
    """Trim, lower and strip one leading identifier prefix; null stays null.

    ``strict`` also knows the secure ``dx`` address and trims after the prefix is gone.
    """
    prefixes = (["https://dx.doi.org/"] if strict else []) + ID_PREFIXES
    pattern = "^(" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")"
    out = F.regexp_replace(F.lower(F.trim(col(c))), pattern, "")
    return F.trim(out) if strict else out


def hash_bucket(*parts: str | Column, seed: str = "42") -> Column:
    """First 32 bits of an md5 over the seed and the parts: the same on every engine."""
    text = F.concat_ws("|", F.lit(seed), *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def row_sum(columns: list[str | Column]) -> Column:
    """Sum that skips nulls; a row of nulls sums to 0."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(col(c).cast("double"), F.lit(0.0))
    return total


def bounded(c: str | Column, low: float, high: float) -> Column:
    """``c`` moved into [low, high]; null stays null."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def frac_to_logit(c: str | Column) -> Column:
    p = bounded(c, LOGIT_EPS, 1 - LOGIT_EPS)
    return F.log(p / (F.lit(1.0) - p))


def logit_to_frac(c: str | Column) -> Column:
    return bounded(F.lit(1.0) / (F.lit(1.0) + F.exp(-col(c))), LOGIT_EPS, 1 - LOGIT_EPS)


def pct_to_logit(c: str | Column) -> Column:
    return frac_to_logit(col(c) / F.lit(100.0))


def logit_to_pct(c: str | Column) -> Column:
    return F.lit(100.0) * logit_to_frac(c)


def yeo_johnson(c: str | Column, lam: float | Column) -> Column:
    """Yeo-Johnson power transform; ``lam`` may be a column."""
    y, k = col(c), lam if isinstance(lam, Column) else F.lit(float(lam))
    near_zero, near_two = F.abs(k) < 1e-12, F.abs(k - 2.0) < 1e-12
    up = F.when(near_zero, F.log1p(F.greatest(y, F.lit(0.0)))).otherwise(
        (F.pow(F.greatest(y, F.lit(0.0)) + 1.0, k) - 1.0) / F.when(near_zero, 1.0).otherwise(k)
    )
    down = F.when(near_two, -F.log1p(F.greatest(-y, F.lit(0.0)))).otherwise(
        -(F.pow(F.greatest(-y, F.lit(0.0)) + 1.0, F.lit(2.0) - k) - 1.0)
        / F.when(near_two, 1.0).otherwise(F.lit(2.0) - k)
    )
    return F.when(y >= 0, up).when(y < 0, down)


def yeo_johnson_inverse(c: str | Column, lam: float) -> Column:
    """Inverse of :func:`yeo_johnson`; values outside the transform's range become null."""
    z, k = col(c), float(lam)
    if abs(k) < 1e-12:
        up = F.exp(z) - 1.0
    else:
        base = z * k + 1.0
        up = F.when(base > 0, F.pow(base, F.lit(1.0 / k)) - 1.0)
    if abs(k - 2.0) < 1e-12:
        down = F.lit(1.0) - F.exp(-z)
    else:
        base = F.lit(1.0) - z * (2.0 - k)
        down = F.when(base > 0, F.lit(1.0) - F.pow(base, F.lit(1.0 / (2.0 - k))))
    return F.when(z >= 0, up).when(z < 0, down)


def atomic_ratio(
    numerator: str | Column, denominator: str | Column, num_element: str, den_element: str,
    weights: dict[str, float] = ATOMIC_WEIGHTS, eps: float = 0.0,
) -> Column:
    """Molar ratio of two elements from their weight percentages; null when undefined."""
    top = col(numerator) / F.lit(weights[num_element])
    bottom = col(denominator) / F.lit(weights[den_element]) + F.lit(eps)
    return F.try_divide(top, bottom)


def z_value(prob: float) -> float:
    return NormalDist().inv_cdf(prob)


def student_quantile(prob: float, dof: Column) -> Column:
    """Student-t quantile: exact up to 30 degrees of freedom, beyond that by the
    Cornish-Fisher series around the normal quantile."""
    exact = F.array(*[F.lit(exact_student_quantile(prob, n)) for n in range(1, 31)])
    z = z_value(prob)
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    v = F.when(dof > 0, dof.cast("double"))
    series = F.lit(z) + F.lit(g1) / v + F.lit(g2) / (v * v) + F.lit(g3) / (v * v * v)
    return F.when(v <= 30, F.get(exact, v.cast("int") - 1)).otherwise(series)


def student_probability(t: float, dof: int) -> float:
    """P(|T| <= t) for whole degrees of freedom, as a finite sum of cosine powers."""
    angle = math.atan(t / math.sqrt(dof))
    c, term, total = math.cos(angle), 1.0, 0.0
    if dof % 2:
        for j in range(1, (dof - 1) // 2 + 1):
            term = c if j == 1 else term * c * c * (2 * j - 2) / (2 * j - 1)
            total += term
        return 2 / math.pi * (angle + math.sin(angle) * total)
    for j in range(dof // 2):
        term = 1.0 if j == 0 else term * c * c * (2 * j - 1) / (2 * j)
        total += term
    return math.sin(angle) * total


def exact_student_quantile(prob: float, dof: int) -> float:
    """By halving the range in which the probability lies."""
    if prob < 0.5:
        return -exact_student_quantile(1 - prob, dof)
    low, high = 0.0, 1.0
    while student_probability(high, dof) < 2 * prob - 1:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if student_probability(middle, dof) < 2 * prob - 1 else (low, middle)
    return (low + high) / 2


def normal_density(z: Column) -> Column:
    return F.exp(F.lit(-0.5) * z * z) / F.lit(math.sqrt(2 * math.pi))


def bin_number(c: Column, low: Column, high: Column, bins: int) -> Column:
    """Zero-based bin of equal width; the last bin is closed on the right.

    A constant column (``low == high``) gets the unit range around its value.
    """
    flat = high <= low
    lo = F.when(flat, low - 0.5).otherwise(low)
    hi = F.when(flat, high + 0.5).otherwise(high)
    raw = F.floor((c - lo) / (hi - lo) * F.lit(float(bins)))
    return F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)).cast("int")


def array_quantile(values: Column, prob: float) -> Column:
    """Linear-interpolation quantile of a small sorted array."""
    pos = F.lit(float(prob)) * (F.size(values) - 1).cast("double")
    low = F.element_at(values, F.floor(pos).cast("int") + 1)
    high = F.element_at(values, F.ceil(pos).cast("int") + 1)
    return low + (high - low) * (pos - F.floor(pos))
