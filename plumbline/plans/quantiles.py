"""Exact quantiles in a few passes, each of which holds a number of values that does not grow with the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from math import ceil, floor
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the sketches that narrow an interval, and the share of its rows that is left to each side of a rank: twice a sketch's error.
K, MARGIN = 4096, 0.0025
#: Rows of an interval whose values one task may sort.
FEW = 100_000


@dataclass(frozen=True)
class _Interval:
    """The values between two others, both excluded; None is no bound. `before` rows lie below, `rows` in it."""

    low: float | None
    high: float | None
    before: int
    rows: int
    ranks: tuple[int, ...]

    def inside(self, x: Column) -> Column:
        bounds = ([] if self.low is None else [x > self.low]) + ([] if self.high is None else [x < self.high])
        return reduce(lambda a, b: a & b, bounds) if bounds else F.lit(True)


def _of_intervals(df: DataFrame, intervals: list[_Interval], state: Column, values: Callable[[_Interval], Column]) -> list[tuple[_Interval, list[float]]]:
    """Intervals with the values taken from an aggregate `state` of the rows of each."""
    x = F.col("x")
    number = F.coalesce(*(F.when(t.inside(x), i) for i, t in enumerate(intervals)))
    states = df.filter(reduce(or_, (t.inside(x) for t in intervals))).groupBy(number.alias("i")).agg(state.alias("state"))
    taken = F.coalesce(*(F.when(F.col("i") == i, values(t)) for i, t in enumerate(intervals)))
    return [(intervals[i], list(found)) for i, found in states.select("i", taken).collect()]


def _cuts(df: DataFrame, intervals: list[_Interval]) -> list[tuple[_Interval, list[float]]]:
    """Values of each interval to both sides of its ranks, from a sketch of its rows."""

    def values(t: _Interval) -> Column:
        shares = [min(max((r - t.before + 0.5) / t.rows + e, 0.0), 1.0) for r in t.ranks for e in (-MARGIN, MARGIN)]
        return F.call_function("kll_sketch_get_quantile_double", F.col("state"), F.array(*map(F.lit, shares)))

    return _of_intervals(df, intervals, F.call_function("kll_sketch_agg_double", F.col("x"), F.lit(K)), values)


def _narrowed(df: DataFrame, cuts: list[tuple[_Interval, list[float]]], known: dict[int, float]) -> list[_Interval]:
    """Rows are counted at and between the cuts. A rank is at a cut, or in the interval of the rows between two."""
    x = F.col("x")
    points = sorted({p for t, found in cuts for p in (*found, t.low, t.high) if p is not None})
    zone = reduce(lambda c, ip: c.when(x < ip[1], 2 * ip[0]).when(x == ip[1], 2 * ip[0] + 1), enumerate(points), F).otherwise(2 * len(points))
    counts = dict(df.filter(reduce(or_, (t.inside(x) for t, _ in cuts))).groupBy(zone.alias("zone")).count().collect())
    out = []
    for t, found in cuts:
        start = t.before
        for i in range(0 if t.low is None else points.index(t.low) + 1, len(points) + 1 if t.high is None else points.index(t.high) + 1):
            between, at = counts.get(2 * i, 0), counts.get(2 * i + 1, 0)
            ranks = tuple(r for r in t.ranks if start <= r < start + between)
            if ranks:
                out.append(_Interval(points[i - 1] if i else None, points[i] if i < len(points) else None, start, between, ranks))
            start += between
            if i < len(points):
                known |= {r: points[i] for r in t.ranks if start <= r < start + at}
            start += at
    return out


def _sorted(df: DataFrame, intervals: list[_Interval], known: dict[int, float]) -> None:
    """The values of ranks in intervals of few rows."""

    def values(t: _Interval) -> Column:
        return F.array(*(F.element_at("state", r - t.before + 1) for r in t.ranks))

    for t, found in _of_intervals(df, intervals, F.sort_array(F.collect_list("x")), values):
        known |= zip(t.ranks, found, strict=True)


def order_statistics(df: DataFrame, ranks: Iterable[int], rows: int, few: int = FEW) -> dict[int, float]:
    """The values at some ranks, from 0, of a table of so many rows with one column x of doubles, neither null nor NaN.

    Sketches give values that each rank probably lies between, and counts say where it lies. If it is not at
    such a value, only the rows between two of them are left: twice MARGIN of the rows, or more where a sketch
    was wrong, and always fewer values than before.
    """
    known: dict[int, float] = {}
    todo = [_Interval(None, None, 0, rows, tuple(sorted(set(ranks))))] if rows else []
    while todo:
        small, large = [t for t in todo if t.rows <= few], [t for t in todo if t.rows > few]
        if small:
            _sorted(df, small, known)
        todo = _narrowed(df, _cuts(df, large), known) if large else []
    return known


def exact_quantiles(df: DataFrame, column: str, quantiles: Iterable[float], few: int = FEW) -> list[float | None]:
    """Quantiles of a numeric column with linear interpolation; NaN is the greatest value, None the quantile of no values.

    The same as Spark's `percentile`, in which one task holds all distinct values.
    """
    x, quantiles = F.col(column).cast("double"), list(quantiles)
    n, nans = df.agg(F.count(x), F.count_if(F.isnan(x))).first()
    if not n:
        return [None] * len(quantiles)
    places = [(n - 1) * q for q in quantiles]
    ends = {end for p in places for end in (floor(p), ceil(p))}
    known = order_statistics(df.select(x.alias("x")).filter("x IS NOT NULL AND NOT isnan(x)"), (r for r in ends if r < n - nans), n - nans, few)
    at = known | {r: float("nan") for r in ends if r >= n - nans}
    out = []
    for p in places:
        low, high = at[floor(p)], at[ceil(p)]
        out.append(low if low == high or floor(p) == ceil(p) else (ceil(p) - p) * low + (p - floor(p)) * high)
    return out
