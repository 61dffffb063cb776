"""Constraints: an analyzer, what to read of its metric, and an assertion on it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from enum import Enum

from plumbline.model import Distribution, Metric, show_number
from plumbline.operators.base import Analyzer


class ConstraintStatus(str, Enum):
    SUCCESS = "Success"
    FAILURE = "Failure"


@dataclass(frozen=True)
class ConstraintResult:
    constraint: Constraint
    status: ConstraintStatus
    message: str = ""
    metric: Metric | None = None


@dataclass(frozen=True)
class Constraint:
    """name is shown; pick reads the asserted value of the metric's (by default the value itself)."""

    analyzer: Analyzer
    assertion: Callable[[object], bool]
    name: str
    pick: Callable[[object], object] | None = None
    hint: str | None = None

    def __str__(self) -> str:
        return self.name

    def evaluate(self, metrics: Mapping[Analyzer, Metric]) -> ConstraintResult:
        metric = metrics.get(self.analyzer)
        fail = lambda text: ConstraintResult(self, ConstraintStatus.FAILURE, text, metric)
        if metric is None:
            return fail("Missing Analysis, can't run the constraint!")
        if not metric.ok:
            return fail(str(metric.outcome.error))
        try:
            value = self.pick(metric.value) if self.pick else metric.value
        except Exception as e:  # noqa: BLE001  outcomes are values
            return fail(f"Can't retrieve the value to assert on: {e}!")
        try:
            ok = self.assertion(value)
        except Exception as e:  # noqa: BLE001
            return fail(f"Can't execute the assertion: {e}!")
        if ok:
            return ConstraintResult(self, ConstraintStatus.SUCCESS, "", metric)
        shown = show_number(value) if isinstance(value, (int, float)) else str(value)
        return fail(f"Value: {shown} does not meet the constraint requirement!{self.hint or ''}")


class ConstrainableType(str, Enum):
    """Kinds of inferred types that HasDataType takes; Numeric is Fractional and Integral together."""

    NULL = "Null"
    FRACTIONAL = "Fractional"
    INTEGRAL = "Integral"
    BOOLEAN = "Boolean"
    STRING = "String"
    NUMERIC = "Numeric"


def type_share(kind: ConstrainableType) -> Callable[[Distribution], float]:
    """The share of a kind among the values that are not null; of nulls, among all."""

    def share(d: Distribution) -> float:
        if kind is ConstrainableType.NULL:
            return d["Unknown"].ratio
        known = sum(b.absolute for k, b in d.values.items() if k != "Unknown")
        if not known:
            return 0.0
        wanted = {"Fractional", "Integral"} if kind is ConstrainableType.NUMERIC else {kind.value}
        return sum(d[k].absolute for k in wanted) / known

    return share
