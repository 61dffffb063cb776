"""What a metric is made of: states over rows, their merge, and a number from a state."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.model import EmptyStateError, Entity, Metric, MetricError, Outcome

#: How the parts of a state are merged; both forms, over rows and of two values, follow from the kind.
_MERGES = {
    "sum": (F.sum, lambda a, b: a + b),
    "min": (F.min, min),
    "max": (F.max, max),
}


@dataclass(frozen=True)
class Analyzer:
    """A metric of a table. Subclasses are values: equal when their fields are."""

    metric_name: ClassVar[str] = ""
    entity_kind: ClassVar[Entity] = Entity.COLUMN

    @property
    def entity(self) -> Entity:
        return self.entity_kind

    @property
    def instance(self) -> str:
        return getattr(self, "column", "*")

    @property
    def filter(self) -> str | None:
        return getattr(self, "where", None)

    def preconditions(self) -> list:
        return []

    def check(self, schema: T.StructType) -> Exception | None:
        """The first precondition that a schema does not meet."""
        for condition in self.preconditions():
            try:
                condition(schema)
            except MetricError as e:
                return e
        return None

    def metric(self, value) -> Metric:
        return Metric(self.entity, self.metric_name, self.instance, Outcome(value))

    def failure(self, error: Exception) -> Metric:
        return Metric(self.entity, self.metric_name, self.instance, Outcome(error=error if isinstance(error, MetricError) else MetricError(str(error))))

    def with_where(self, where: str | None) -> Analyzer:
        values = {f.name: getattr(self, f.name) for f in fields(self)}
        return type(self)(**(values | {"where": where}))

    def arguments(self) -> list[str]:
        return [self.instance] if hasattr(self, "column") else []

    def __str__(self) -> str:
        return f"{type(self).__name__}({','.join([*self.arguments(), self.filter or 'None'])})"

    def calculate(self, df: DataFrame) -> Metric:
        """The metric of one table; errors become its outcome."""
        from plumbline.plans.runner import run_analysis

        return run_analysis(df, [self])[self]


@dataclass(frozen=True)
class State:
    """The sufficient statistic of a scanning analyzer: named numbers, or None where nothing was seen."""

    values: Mapping[str, object]


class ScanAnalyzer(Analyzer):
    """An analyzer whose state is a few aggregates over rows, so that many share one scan."""

    #: Part of the state: kind of its merge.
    parts: ClassVar[Mapping[str, str]] = {}

    def state_exprs(self) -> dict[str, Column]:
        raise NotImplementedError

    def value_expr(self, state: Mapping[str, Column]) -> Column:
        """The metric's number from the state's columns; null for an empty state."""
        raise NotImplementedError

    def value_of(self, state: Mapping[str, object]):
        """The same from a state's numbers."""
        raise NotImplementedError

    def merge_exprs(self, state: Mapping[str, Column]) -> dict[str, Column]:
        """Aggregates that merge rows of states."""
        return {k: _MERGES[kind][0](state[k]) for k, kind in self.parts.items()}

    def merge(self, a: State, b: State) -> State:
        out = {}
        for k, kind in self.parts.items():
            x, y = a.values[k], b.values[k]
            out[k] = y if x is None else x if y is None else _MERGES[kind][1](x, y)
        return State(out)

    def aggregate_state_to(self, a, b, target) -> None:
        """Keep in target what two providers' states merge to; of one alone, that one; of none, nothing."""
        states = [s for s in (a.load(self), b.load(self)) if s is not None]
        if states:
            target.persist(self, states[0] if len(states) == 1 else self.merge(*states))

    def load_state_and_compute_metric(self, source) -> Metric:
        """The metric of the state that a provider keeps."""
        return self.metric_from(source.load(self))

    def copy_state_to(self, source, target) -> None:
        state = source.load(self)
        if state is not None:
            target.persist(self, state)

    def is_empty(self, state: State) -> bool:
        return any(state.values[k] is None for k in self.parts)

    def metric_from(self, state: State | None) -> Metric:
        if state is None or self.is_empty(state):
            return self.failure(EmptyStateError(f"Empty state for analyzer {self}, all input values were NULL."))
        try:
            return self.metric(self.value_of(state.values))
        except Exception as e:  # noqa: BLE001  failures are values
            return self.failure(e)


def quotient(part, whole) -> float:
    return float("nan") if not whole else float(part) / float(whole)
