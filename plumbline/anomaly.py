"""Anomalies in the history of a metric: on the driver for short series, over windows for frames of many."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Anomaly:
    """Equal when value and confidence are."""

    value: float | None
    confidence: float = 1.0
    detail: str | None = field(default=None, compare=False)


@dataclass(frozen=True)
class DataPoint:
    time: int
    value: float | None


class Strategy:
    """detect() finds anomalies of a series in [start, end) of its indices, as (index, anomaly)."""

    def detect(self, series: Sequence[float], interval: tuple[int, int] | None = None) -> list[tuple[int, Anomaly]]:
        raise NotImplementedError

    def flag(self, value: Column, by: list[str], time: str) -> Column:
        """The same as a boolean column over the rows of a frame, by series."""
        raise NotImplementedError


def _bounds(series, interval) -> tuple[int, int]:
    start, end = interval if interval is not None else (0, len(series))
    if start > end:
        raise ValueError("The start of the interval cannot be larger than the end.")
    return max(0, start), min(end, len(series))


@dataclass(frozen=True, kw_only=True)
class _Change(Strategy):
    order: int = 1

    #: Least and greatest change that is no anomaly.
    def limits(self) -> tuple[float, float]:
        raise NotImplementedError

    def changes(self, x: np.ndarray) -> np.ndarray:
        """Changes of a series; the first of them belongs to index `order`."""
        raise NotImplementedError

    def detect(self, series, interval=None):
        start, end = _bounds(series, interval)
        low, high = self.limits()
        x = np.asarray(series, float)[max(0, start - self.order) : end]
        base = max(0, start - self.order) + self.order
        out = []
        for i, change in enumerate(self.changes(x)):
            at = base + i
            if start <= at < end and not (math.isnan(change) and math.isinf(low) and math.isinf(high)) and not low <= change <= high:
                out.append((at, Anomaly(float(series[at]), 1.0, f"[{type(self).__name__}]: Change of {change} is not in bounds [{low}, {high}]. Order={self.order}")))
        return out


@dataclass(frozen=True, kw_only=True)
class AbsoluteChange(_Change):
    """Differences, of differences for a higher order, within limits; order 0 looks at the values themselves."""

    max_decrease: float | None = None
    max_increase: float | None = None

    def __post_init__(self):
        if self.max_decrease is None and self.max_increase is None:
            raise ValueError("At least one of the two limits (max_decrease or max_increase) has to be specified.")
        if self.order < 0:
            raise ValueError("Order of derivative cannot be negative.")
        if (self.limits()[0]) > self.limits()[1]:
            raise ValueError("The maximal rate of increase has to be bigger than the maximal rate of decrease.")

    def limits(self):
        return (-math.inf if self.max_decrease is None else self.max_decrease), (math.inf if self.max_increase is None else self.max_increase)

    def changes(self, x):
        return np.diff(x, self.order) if len(x) > self.order else x[:0]

    def flag(self, value, by, time):
        low, high = self.limits()
        w = Window.partitionBy(*by).orderBy(time)
        # The order-th difference is a sum over lags with binomial factors.
        change = sum((F.lit(float((-1) ** k * math.comb(self.order, k))) * F.lag(value, k).over(w) for k in range(1, self.order + 1)), value)
        return F.coalesce((change < low) | (change > high), F.lit(False))


@dataclass(frozen=True, kw_only=True)
class RelativeRateOfChange(_Change):
    """Ratios of a value to the one `order` before it, within limits."""

    max_rate_decrease: float | None = None
    max_rate_increase: float | None = None

    def __post_init__(self):
        if self.max_rate_decrease is None and self.max_rate_increase is None:
            raise ValueError("At least one of the two limits (max_rate_decrease or max_rate_increase) has to be specified.")
        if self.order < 1:
            raise ValueError("Order of derivative must be at least 1.")
        if (self.limits()[0]) > self.limits()[1]:
            raise ValueError("The maximal rate of increase has to be bigger than the maximal rate of decrease.")

    def limits(self):
        return (-math.inf if self.max_rate_decrease is None else self.max_rate_decrease), (math.inf if self.max_rate_increase is None else self.max_rate_increase)

    def changes(self, x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return x[self.order :] / x[: len(x) - self.order] if len(x) > self.order else x[:0]

    def flag(self, value, by, time):
        low, high = self.limits()
        change = F.try_divide(value, F.lag(value, self.order).over(Window.partitionBy(*by).orderBy(time)))
        return F.coalesce((change < low) | (change > high), F.lit(False))


@dataclass(frozen=True, kw_only=True)
class OnlineNormal(Strategy):
    """Values further from the running mean than factors times the running population deviation, both with the value itself.

    The first ignore_start share of the series is never flagged; with ignore_anomalies a flagged value
    leaves mean and deviation as they were.
    """

    lower_factor: float | None = 3.0
    upper_factor: float | None = 3.0
    ignore_start: float = 0.1
    ignore_anomalies: bool = True

    def __post_init__(self):
        if self.lower_factor is None and self.upper_factor is None:
            raise ValueError("At least one factor has to be specified.")
        if (self.lower_factor or 0) < 0 or (self.upper_factor or 0) < 0:
            raise ValueError("Factors cannot be smaller than zero.")
        if not 0 <= self.ignore_start <= 1:
            raise ValueError("Percentage of start values to ignore must be in interval [0, 1].")

    def statistics(self, series, interval=None) -> list[tuple[float, float, bool]]:
        """Mean, deviation and whether it is an anomaly, of each point."""
        start, end = _bounds(series, interval)
        skip = len(series) * self.ignore_start
        mean = spread = 0.0
        out = []
        for i, x in enumerate(map(float, series)):
            new_mean = x if i == 0 else mean + (x - mean) / (i + 1)
            new_spread = spread + (x - mean) * (x - new_mean)
            deviation = math.sqrt(max(0.0, new_spread / (i + 1)))
            low = -math.inf if self.lower_factor is None else new_mean - self.lower_factor * deviation
            high = math.inf if self.upper_factor is None else new_mean + self.upper_factor * deviation
            odd = i >= skip and start <= i < end and not low <= x <= high
            if not (odd and self.ignore_anomalies):
                mean, spread = new_mean, new_spread
            # A rolled-back point reports the deviation that it was tested with.
            out.append((mean, deviation, odd))
        return out

    def detect(self, series, interval=None):
        found = self.statistics(series, interval)
        return [(i, Anomaly(float(series[i]), 1.0, f"[OnlineNormal]: Value {series[i]} is not within the bounds around mean {m} with deviation {d}.")) for i, (m, d, odd) in enumerate(found) if odd]

    def flag(self, value, by, time):
        if self.ignore_anomalies:
            raise ValueError("rolling back is sequential; use anomalies_by_series")
        w = Window.partitionBy(*by).orderBy(time)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        mean, deviation = F.avg(value).over(upto), F.stddev_pop(value).over(upto)
        n = F.count(F.lit(1)).over(Window.partitionBy(*by))
        low = F.lit(-math.inf) if self.lower_factor is None else mean - self.lower_factor * deviation
        high = F.lit(math.inf) if self.upper_factor is None else mean + self.upper_factor * deviation
        return (F.row_number().over(w) - 1 >= n * self.ignore_start) & ((value < low) | (value > high))


def flag_anomalies(history: DataFrame, strategy: Strategy, value: str = "value", time: str = "time", by: list[str] | None = None) -> DataFrame:
    """history with a column is_anomaly; missing values are left out first. Window functions only."""
    there = history.filter(F.col(value).isNotNull())
    return there.withColumn("is_anomaly", strategy.flag(F.col(value).cast("double"), by or [F.lit(0)], time))


def anomalies_by_series(history: DataFrame, strategy: Strategy, by: list[str], value: str = "value", time: str = "time") -> DataFrame:
    """The same for strategies that go through a series in order, a series at a time."""
    import pandas as pd

    there = history.filter(F.col(value).isNotNull())

    def detect(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values(time)
        odd = {i for i, _ in strategy.detect(series[value].astype(float).tolist())}
        return series.assign(is_anomaly=[i in odd for i in range(len(series))])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in history.schema.fields) + ", is_anomaly boolean"
    return there.groupBy(*by).applyInPandas(detect, schema)


@dataclass(frozen=True)
class AnomalyDetector:
    strategy: Strategy

    def is_new_point_anomalous(self, history: Sequence[DataPoint], new: DataPoint) -> list[tuple[int, Anomaly]]:
        """Anomalies at the new point, which lies after all of history."""
        known = sorted((p for p in history if p.value is not None), key=lambda p: p.time)
        if not known:
            raise ValueError("historicalDataPoints must not be empty!")
        if new.time <= known[-1].time:
            raise ValueError(f"Can't decide which range to use for anomaly detection. New data point with time {new.time} is in history range ({known[0].time} - {known[-1].time})!")
        return self.detect_anomalies_in_history([*known, new], new.time, None)

    def detect_anomalies_in_history(self, points: Sequence[DataPoint], start: int | None = None, end: int | None = None) -> list[tuple[int, Anomaly]]:
        """Anomalies at times in [start, end), as (time, anomaly)."""
        if start is not None and end is not None and start > end:
            raise ValueError("The first interval element has to be smaller or equal to the last.")
        known = sorted((p for p in points if p.value is not None), key=lambda p: p.time)
        first = sum(start is not None and p.time < start for p in known)
        last = sum(end is None or p.time < end for p in known)
        return [(known[i].time, a) for i, a in self.strategy.detect([p.value for p in known], (first, max(first, last)))]
