"""Named statistics as aggregate builders, bands with labels, and the distributions that the tests need."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from airloom.session import TubeError

#: The standard normal quantile at 0.975.
NORMAL_975 = 1.959963984540054


@dataclass(frozen=True)
class Stat:
    """Named aggregates of one column. With the single name "" the result has the column's own name.

    ``parts`` maps a name to a function from a column to an aggregate; ``text`` says which parts are text."""

    parts: dict[str, Callable[[Column], Column]]
    text: frozenset[str] = frozenset()

    def columns(self, x: Column, name: str) -> list[tuple[str, Column, bool]]:
        return [(f"{name}.{part}" if part else name, build(x), part in self.text) for part, build in self.parts.items()]


def finite(x: Column) -> Column:
    """Whether a number is present and not infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def n_finite(x: Column) -> Column:
    return F.count(F.when(finite(x), 1))


def quantile7(x: Column, p: float | list[float]) -> Column:
    """Exact linear-interpolation quantiles."""
    return F.percentile(x, F.array(*[F.lit(float(v)) for v in p]) if isinstance(p, list) else F.lit(float(p)))


def n_distinct(x: Column) -> Column:
    """Distinct values, missing counting as one."""
    return F.count_distinct(x) + F.coalesce(F.max(F.when(x.isNull(), 1).otherwise(0)), F.lit(0))


def options(x: Column) -> Column:
    """Distinct present values as 'a'|'b', in code point order."""
    return F.array_join(F.transform(F.array_sort(F.collect_set(x)), lambda v: F.concat(F.lit("'"), v, F.lit("'"))), "|")


MEAN = Stat({"": F.avg})
SUMMARY = Stat({"n": n_finite, "mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max})
STATS = {
    "mean": MEAN, "median": Stat({"": F.median}), "sd": Stat({"": F.stddev_samp}), "var": Stat({"": F.var_samp}), "min": Stat({"": F.min}), "max": Stat({"": F.max}),
    "sum": Stat({"": F.sum}), "n": Stat({"": n_finite}), "summary": SUMMARY,
}


def as_stat(stat) -> Stat:
    """A Stat from itself, a name, a function of a column, or a dict of such functions."""
    if stat is None:
        return MEAN
    if isinstance(stat, Stat):
        return stat
    if isinstance(stat, str) and stat in STATS:
        return STATS[stat]
    if callable(stat):
        return Stat({"": stat})
    if isinstance(stat, dict):
        return Stat(dict(stat))
    raise TubeError(f"not a statistic: {stat!r}")


def general(x: float, digits: int) -> str:
    """C's %.{digits}g."""
    return f"{x:.{digits}g}"


def band_labels(breaks: list[float], digits: int = 3, right: bool = True) -> list[str]:
    """Labels of the bands between breaks, with as many digits as tell all breaks apart."""
    for d in range(digits, max(12, digits) + 1):
        shown = [general(b, d) for b in breaks]
        if len(set(shown)) == len(shown):
            break
    left, close = ("(", "]") if right else ("[", ")")
    return [f"{left}{a},{b}{close}" for a, b in zip(shown[:-1], shown[1:], strict=True)]


def cut(x: Column, breaks: list[float], right: bool = True, include_lowest: bool = False) -> Column:
    """The label of the band that a number lies in; NULL outside all bands."""
    breaks = sorted(breaks)
    out = None
    for k, label in enumerate(band_labels(breaks, right=right)):
        lo, hi = F.lit(float(breaks[k])), F.lit(float(breaks[k + 1]))
        inside = (x > lo) & (x <= hi) if right else (x >= lo) & (x < hi)
        if include_lowest and right and k == 0:
            inside = (x >= lo) & (x <= hi)
        if include_lowest and not right and k == len(breaks) - 2:
            inside = (x >= lo) & (x <= hi)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def t_upper(t: float, df: int) -> float:
    """P(T > t) of Student's distribution with whole degrees of freedom, by its finite sum; accurate in the tail."""
    if df < 1 or t != t:
        return math.nan
    if t < 0:
        return 1.0 - t_upper(-t, df)
    if math.isinf(t):
        return 0.0
    x = df / (df + t * t)
    if x < 0.5:
        return 0.5 * _beta(x, df / 2)
    theta, cos2 = math.atan(t / math.sqrt(df)), x
    if df % 2:
        total, part = theta, math.sin(theta) * math.cos(theta)
        for k in range(1, (df - 1) // 2 + 1):
            total += part
            part *= cos2 * (2 * k) / (2 * k + 1)
        return 0.5 - total / math.pi
    total, part = 0.0, 1.0
    for k in range(1, df // 2 + 1):
        total += part
        part *= cos2 * (2 * k - 1) / (2 * k)
    return 0.5 - 0.5 * math.sin(theta) * total


def _beta(x: float, a: float, b: float = 0.5) -> float:
    """The regularised incomplete beta function for small x, by its power series."""
    if x <= 0:
        return 0.0
    term = math.exp(a * math.log(x) + math.lgamma(a + b) - math.lgamma(a + 1) - math.lgamma(b))
    total, k = 0.0, 0
    while True:
        total += term
        step = (k + 1 - b) * x / (k + 1) * (a + k) / (a + k + 1)
        term *= step
        k += 1
        if term < total * 1e-17 or k > 5000:
            return total


def t_quantile(p: float, df: int) -> float:
    """The quantile of Student's distribution, by bisection."""
    if df < 1 or not 0 < p < 1:
        return math.nan
    if p < 0.5:
        return -t_quantile(1 - p, df)
    lo, hi = 0.0, 1.0
    while t_upper(hi, df) > 1 - p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_upper(mid, df) > 1 - p else (lo, mid)
        if hi - lo <= 1e-15 * hi:
            break
    return (lo + hi) / 2


def t_two_sided(t: float, df: int) -> float:
    """The p-value of a t statistic."""
    return min(1.0, 2 * t_upper(abs(t), df))


def significant(x: float | None, digits: int = 4) -> str:
    """A number to so many significant digits, as text."""
    if x is None or x != x:
        return "NA"
    if x == 0 or math.isinf(x):
        return "0" if x == 0 else ("Inf" if x > 0 else "-Inf")
    v = float(f"{x:.{digits - 1}e}")
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
