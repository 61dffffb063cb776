"""Checks: named lists of constraints with a level."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import Column

from plumbline.anomaly import AnomalyDetector, DataPoint, Strategy
from plumbline.constraints import ConstrainableType, Constraint, ConstraintResult, ConstraintStatus, type_share
from plumbline.functions import patterns
from plumbline.model import Distribution, Metric
from plumbline.operators import grouping as G
from plumbline.operators import scan as S
from plumbline.operators.base import Analyzer

Assertion = Callable[[float], bool]


def is_one(x: float) -> bool:
    return x == 1


def quoted(column: str) -> str:
    """A column's path in SQL text; one with back-quotes stays as it is."""
    return column if "`" in column else ".".join(f"`{part}`" for part in column.split("."))


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class CheckLevel(str, Enum):
    ERROR = "Error"
    WARNING = "Warning"


class CheckStatus(str, Enum):
    SUCCESS = "Success"
    WARNING = "Warning"
    ERROR = "Error"

    @property
    def rank(self) -> int:
        return list(CheckStatus).index(self)


@dataclass(frozen=True)
class CheckResult:
    check: Check
    status: CheckStatus
    constraint_results: tuple[ConstraintResult, ...]



@dataclass(frozen=True)
class Check:
    """Every method returns a new check. After one that adds a constraint, where() gives that constraint a filter."""

    level: CheckLevel
    description: str
    constraints: tuple[Constraint, ...] = ()
    #: Makes the last constraint anew with a filter.
    last: Callable[[str | None], Constraint] | None = None

    def _add(self, label: str, analyzer: Callable[[str | None], Analyzer], assertion, hint=None, pick=None, name=None) -> Check:
        def make(where: str | None) -> Constraint:
            a = analyzer(where)
            return Constraint(a, assertion, name or f"{label}Constraint({a})", pick, hint)

        return replace(self, constraints=(*self.constraints, make(None)), last=make)

    def add_constraint(self, constraint: Constraint) -> Check:
        return replace(self, constraints=(*self.constraints, constraint), last=None)

    def where(self, condition: str) -> Check:
        if self.last is None:
            raise ValueError("the last constraint takes no filter")
        return replace(self, constraints=(*self.constraints[:-1], self.last(condition)), last=None)

    # Sizes and completeness
    def has_size(self, assertion: Callable[[float], bool], hint: str | None = None) -> Check:
        return self._add("Size", S.Size, assertion, hint)

    def is_complete(self, column: str, hint: str | None = None) -> Check:
        return self.has_completeness(column, is_one, hint)

    def has_completeness(self, column: str, assertion: Assertion, hint: str | None = None) -> Check:
        return self._add("Completeness", lambda w: S.Completeness(column, w), assertion, hint)

    def are_complete(self, columns: Iterable[str], hint: str | None = None) -> Check:
        return self.have_completeness(columns, is_one, hint)

    def have_completeness(self, columns: Iterable[str], assertion: Assertion, hint: str | None = None) -> Check:
        columns = tuple(columns)
        return self.satisfies(" AND ".join(f"{quoted(c)} IS NOT NULL" for c in columns), f"Combined Completeness: {','.join(columns)}", assertion, hint)

    def are_any_complete(self, columns: Iterable[str], hint: str | None = None) -> Check:
        return self.have_any_completeness(columns, is_one, hint)

    def have_any_completeness(self, columns: Iterable[str], assertion: Assertion, hint: str | None = None) -> Check:
        columns = tuple(columns)
        return self.satisfies(" OR ".join(f"{quoted(c)} IS NOT NULL" for c in columns), f"Any Completeness: {','.join(columns)}", assertion, hint)

    # Keys and frequencies
    def is_unique(self, column: str, hint: str | None = None) -> Check:
        return self.has_uniqueness((column,), is_one, hint)

    def are_unique(self, columns: Iterable[str], hint: str | None = None) -> Check:
        return self.has_uniqueness(columns, is_one, hint)

    def is_primary_key(self, column: str, *columns: str, hint: str | None = None) -> Check:
        """The combination is unique; nulls are not looked at."""
        return self.has_uniqueness((column, *columns), is_one, hint)

    def has_uniqueness(self, columns: str | Iterable[str], assertion: Assertion, hint: str | None = None) -> Check:
        columns = G._columns(columns)
        return self._add("Uniqueness", lambda w: G.Uniqueness(columns, w), assertion, hint)

    def has_distinctness(self, columns: str | Iterable[str], assertion: Assertion, hint: str | None = None) -> Check:
        columns = G._columns(columns)
        return self._add("Distinctness", lambda w: G.Distinctness(columns, w), assertion, hint)

    def has_unique_value_ratio(self, columns: str | Iterable[str], assertion: Assertion, hint: str | None = None) -> Check:
        columns = G._columns(columns)
        return self._add("UniqueValueRatio", lambda w: G.UniqueValueRatio(columns, w), assertion, hint)

    def has_count_distinct(self, columns: str | Iterable[str], assertion: Assertion, hint: str | None = None) -> Check:
        columns = G._columns(columns)
        return self._add("CountDistinct", lambda w: G.CountDistinct(columns, w), assertion, hint)

    def has_number_of_distinct_values(self, column: str, assertion: Callable[[int], bool], binning=None, max_bins: int = G.MOST_BINS, hint: str | None = None) -> Check:
        """Null counts as a value."""
        return self._add("HistogramBin", lambda w: G.Histogram(column, binning, max_bins, w), assertion, hint, lambda d: d.number_of_bins)

    def has_histogram_values(self, column: str, assertion: Callable[[Distribution], bool], binning=None, max_bins: int = 100, hint: str | None = None) -> Check:
        return self._add("Histogram", lambda w: G.Histogram(column, binning, max_bins, w), assertion, hint)

    def kll_sketch_satisfies(self, column: str, assertion: Callable[[Distribution], bool], buckets: int = 100, hint: str | None = None) -> Check:
        return self._add("Kll", lambda w: S.KllSketch(column, buckets, w), assertion, hint)

    def has_entropy(self, column: str, assertion: Assertion, hint: str | None = None) -> Check:
        return self._add("Entropy", lambda w: G.Entropy(column, w), assertion, hint)

    def has_mutual_information(self, first: str, second: str, assertion: Assertion, hint: str | None = None) -> Check:
        return self._add("MutualInformation", lambda w: G.MutualInformation((first, second), w), assertion, hint)

    # Statistics of a column
    def has_min(self, column: str, assertion: Assertion, hint: str | None = None) -> Check:
        return self._add("Minimum", lambda w: S.Minimum(column, w), assertion, hint)

    def has_max(self, column: str, assertion: Assertion, hint: str | None = None) -> Check:
        return self._add("Maximum", lambda w: S.Maximum(column, w), assertion, hint)

    def has_mean(self, column: str, assertion: Assertion, hint: str | None = None) -> Check:
        return self._add("Mean", lambda w: S.Mean(column, w), assertion, hint)

    def has_sum(self, column: str, assertion: Assertion, hint: str | None = None) -> Check:
        return self._add("Sum", lambda w: S.Sum(column, w), assertion, hint)

    def has_standard_deviation(self, column: str, assertion: Assertion, hint: str | None = None) -> Check:
        return self._add("StandardDeviation", lambda w: S.StandardDeviation(column, w), assertion, hint)

    def has_min_length(self, column: str, assertion: Assertion, hint: str | None = None) -> Check:
        return self._add("MinLength", lambda w: S.MinLength(column, w), assertion, hint)

    def has_max_length(self, column: str, assertion: Assertion, hint: str | None = None) -> Check:
        return self._add("MaxLength", lambda w: S.MaxLength(column, w), assertion, hint)

    def has_approx_count_distinct(self, column: str, assertion: Assertion, hint: str | None = None) -> Check:
        return self._add("ApproxCountDistinct", lambda w: S.ApproxCountDistinct(column, w), assertion, hint)

    def has_approx_quantile(self, column: str, quantile: float, assertion: Assertion, hint: str | None = None) -> Check:
        return self._add("ApproxQuantile", lambda w: S.ApproxQuantile(column, quantile, w), assertion, hint)

    def has_correlation(self, first: str, second: str, assertion: Assertion, hint: str | None = None) -> Check:
        return self._add("Correlation", lambda w: S.Correlation(first, second, w), assertion, hint)

    def has_data_type(self, column: str, kind: ConstrainableType, assertion: Assertion = is_one, hint: str | None = None) -> Check:
        return self._add("DataType", lambda w: S.DataType(column, w), assertion, hint, type_share(kind))

    # Predicates and patterns
    def satisfies(self, predicate: str | Column, name: str, assertion: Assertion = is_one, hint: str | None = None) -> Check:
        return self._add("Compliance", lambda w: S.Compliance(name, predicate, w), assertion, hint)

    def has_pattern(self, column: str, pattern: str, assertion: Assertion = is_one, name: str | None = None, hint: str | None = None) -> Check:
        return self._add("PatternMatch", lambda w: S.PatternMatch(column, pattern, w), assertion, hint, name=name)

    def contains_credit_card_number(self, column: str, assertion: Assertion = is_one, hint: str | None = None) -> Check:
        return self.has_pattern(column, patterns.CREDIT_CARD, assertion, f"ContainsCreditCardNumber({column})", hint)

    def contains_email(self, column: str, assertion: Assertion = is_one, hint: str | None = None) -> Check:
        return self.has_pattern(column, patterns.EMAIL, assertion, f"ContainsEmail({column})", hint)

    def contains_url(self, column: str, assertion: Assertion = is_one, hint: str | None = None) -> Check:
        return self.has_pattern(column, patterns.URL, assertion, f"ContainsURL({column})", hint)

    def contains_ssn(self, column: str, assertion: Assertion = is_one, hint: str | None = None) -> Check:
        return self.has_pattern(column, patterns.SOCIAL_SECURITY_NUMBER_US, assertion, f"ContainsSSN({column})", hint)

    def is_non_negative(self, column: str, assertion: Assertion = is_one, hint: str | None = None) -> Check:
        """Nulls pass."""
        return self.satisfies(f"coalesce(try_cast({quoted(column)} AS double), 0.0D) >= 0", f"{column} is non-negative", assertion, hint)

    def is_positive(self, column: str, assertion: Assertion = is_one, hint: str | None = None, strict: bool = False) -> Check:
        """Nulls pass. Zero passes too, unless strict."""
        return self.satisfies(f"coalesce(try_cast({quoted(column)} AS double), 1.0D) {'>' if strict else '>='} 0", f"{column} is positive", assertion, hint)

    def is_less_than(self, a: str, b: str, assertion: Assertion = is_one, hint: str | None = None) -> Check:
        return self.satisfies(f"{quoted(a)} < {quoted(b)}", f"{a} is less than {b}", assertion, hint)

    def is_less_than_or_equal_to(self, a: str, b: str, assertion: Assertion = is_one, hint: str | None = None) -> Check:
        return self.satisfies(f"{quoted(a)} <= {quoted(b)}", f"{a} is less than or equal to {b}", assertion, hint)

    def is_greater_than(self, a: str, b: str, assertion: Assertion = is_one, hint: str | None = None) -> Check:
        return self.satisfies(f"{quoted(a)} > {quoted(b)}", f"{a} is greater than {b}", assertion, hint)

    def is_greater_or_equal_to(self, a: str, b: str, assertion: Assertion = is_one, hint: str | None = None) -> Check:
        return self.satisfies(f"{quoted(a)} >= {quoted(b)}", f"{a} is greater than or equal to {b}", assertion, hint)

    def is_contained_in(self, column: str, values: Iterable[str], assertion: Assertion = is_one, hint: str | None = None) -> Check:
        """Null or one of the values."""
        values = tuple(values)
        return self.satisfies(f"{quoted(column)} IS NULL OR cast({quoted(column)} AS string) IN ({', '.join(literal(str(v)) for v in values)})", f"{column} contained in {','.join(map(str, values))}", assertion, hint)

    def is_contained_in_range(self, column: str, low: float, high: float, include_low: bool = True, include_high: bool = True, hint: str | None = None) -> Check:
        """Null or a number between two others."""
        x, above, below = quoted(column), ">=" if include_low else ">", "<=" if include_high else "<"
        return self.satisfies(f"{x} IS NULL OR ({x} {above} {float(low)!r}D AND {x} {below} {float(high)!r}D)", f"{column} between {low} and {high}", is_one, hint)

    def is_newest_point_non_anomalous(self, repository, strategy: Strategy, analyzer: Analyzer, with_tags: Mapping[str, str] | None = None, after: int | None = None, before: int | None = None, hint: str | None = None) -> Check:
        """The metric is no anomaly after those of the repository; without any there the constraint fails."""

        def normal(value: float) -> bool:
            loader = repository.load().for_analyzers([analyzer])
            loader = loader if with_tags is None else loader.with_tag_values(with_tags)
            loader = loader if after is None else loader.after(after)
            loader = loader if before is None else loader.before(before)
            results = loader.get()
            if not results:
                raise ValueError("There have to be previous results in the MetricsRepository!")
            points = []
            for r in results:
                metric = next(iter(r.context.metrics.values()), None)
                points.append(DataPoint(r.key.data_set_date, float(metric.value) if metric is not None and metric.ok else None))
            now = max(p.time for p in points) + 1
            return not AnomalyDetector(strategy).is_new_point_anomalous(points, DataPoint(now, float(value)))

        constraint = Constraint(analyzer, normal, f"AnomalyConstraint({analyzer})", None, hint)
        return replace(self, constraints=(*self.constraints, constraint), last=None)

    def required_analyzers(self) -> list[Analyzer]:
        return [c.analyzer for c in self.constraints]

    def evaluate(self, metrics: Mapping[Analyzer, Metric]) -> CheckResult:
        results = tuple(c.evaluate(metrics) for c in self.constraints)
        ok = all(r.status is ConstraintStatus.SUCCESS for r in results)
        return CheckResult(self, CheckStatus.SUCCESS if ok else CheckStatus(self.level.value), results)
