"""Metrics, distributions, outcomes and the keys under which runs are stored."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from enum import Enum


class Entity(str, Enum):
    DATASET = "Dataset"
    COLUMN = "Column"
    MULTICOLUMN = "Multicolumn"


class MetricError(Exception):
    """Why a metric has no value."""


class EmptyStateError(MetricError):
    pass


@dataclass(frozen=True)
class Outcome:
    """A value or the error in its place."""

    value: object = None
    error: Exception | None = None

    @property
    def ok(self) -> bool:
        return self.error is None

    def get(self):
        if self.error is not None:
            raise self.error
        return self.value


@dataclass(frozen=True)
class Bin:
    absolute: int
    ratio: float


@dataclass(frozen=True)
class Distribution:
    """Bins by value; number_of_bins counts those left out of a top-N report too."""

    values: Mapping[str, Bin]
    number_of_bins: int

    def __getitem__(self, key: str) -> Bin:
        return self.values[key]


@dataclass(frozen=True)
class Metric:
    """A number or, for histograms, a Distribution."""

    entity: Entity
    name: str
    instance: str
    outcome: Outcome

    @property
    def ok(self) -> bool:
        return self.outcome.ok

    @property
    def value(self):
        return self.outcome.get()

    def flatten(self) -> list[Metric]:
        """Metrics with one number each."""
        if self.ok and not isinstance(self.outcome.value, Distribution):
            return [self]
        if not self.ok:
            return [self]
        d: Distribution = self.outcome.value
        number = lambda name, x: Metric(self.entity, f"{self.name}.{name}", self.instance, Outcome(float(x)))
        out = [number("bins", d.number_of_bins)]
        for key, b in d.values.items():
            out += [number(f"abs.{key}", b.absolute), number(f"ratio.{key}", b.ratio)]
        return out


@dataclass(frozen=True)
class ResultKey:
    """When a run was made, and its tags; keys are equal by value."""

    data_set_date: int
    tags: Mapping[str, str] = field(default_factory=dict)

    def __hash__(self) -> int:
        return hash((self.data_set_date, frozenset(self.tags.items())))

    def __eq__(self, other) -> bool:
        return isinstance(other, ResultKey) and (self.data_set_date, dict(self.tags)) == (other.data_set_date, dict(other.tags))


def show_number(x: float) -> str:
    """The shortest form of a number: 4 rather than 4.0."""
    if isinstance(x, float) and x == x and abs(x) < 1e16 and x == int(x):
        return str(int(x))
    return repr(x) if isinstance(x, float) else str(x)
