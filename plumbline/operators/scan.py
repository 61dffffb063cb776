"""Metrics that one pass over the rows gives, all in a single aggregation."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import ClassVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.functions import patterns
from plumbline.model import Bin, Distribution, Entity, MetricError
from plumbline.operators.base import ScanAnalyzer, State, quotient


@dataclass(frozen=True)
class Size(ScanAnalyzer):
    """Rows, or those that meet the filter."""

    where: str | None = None
    metric_name: ClassVar[str] = "Size"
    entity_kind: ClassVar[Entity] = Entity.DATASET
    parts: ClassVar[Mapping[str, str]] = {"n": "sum"}

    def state_exprs(self):
        return {"n": X.count_where(self.where)}

    def value_expr(self, state):
        return state["n"].cast("double")

    def value_of(self, state):
        return float(state["n"])


class _Share(ScanAnalyzer):
    """The share of rows that match; the filter's rows are the whole."""

    parts: ClassVar[Mapping[str, str]] = {"matches": "sum", "n": "sum"}

    def matching(self) -> Column:
        raise NotImplementedError

    def state_exprs(self):
        hit = F.coalesce(X.only_where(self.matching(), self.filter), F.lit(False))
        return {"matches": F.sum(hit.cast("long")), "n": X.count_where(self.filter)}

    def value_expr(self, state):
        return F.when(state["matches"].isNotNull(), X.ratio(state["matches"], state["n"]))

    def value_of(self, state):
        return quotient(state["matches"], state["n"])


@dataclass(frozen=True)
class Completeness(_Share):
    """The share of values that are not null."""

    column: str
    where: str | None = None
    metric_name: ClassVar[str] = "Completeness"

    def preconditions(self):
        return [X.exists(self.column), X.not_nested(self.column)]

    def matching(self):
        return F.col(self.column).isNotNull()


@dataclass(frozen=True)
class Compliance(_Share):
    """The share of rows that meet a predicate: SQL text or a Column. An unknown truth counts as not met."""

    name: str
    predicate: str | Column
    where: str | None = None
    metric_name: ClassVar[str] = "Compliance"

    @property
    def instance(self):
        return self.name

    def arguments(self):
        return [self.name, self.text]

    @property
    def text(self) -> str:
        return self.predicate if isinstance(self.predicate, str) else str(self.predicate)

    def __eq__(self, other):
        return isinstance(other, Compliance) and str(self) == str(other)

    def __hash__(self):
        return hash(str(self))

    def matching(self):
        return F.expr(self.predicate) if isinstance(self.predicate, str) else self.predicate


@dataclass(frozen=True)
class PatternMatch(_Share):
    """The share of rows in whose text a regex (Java syntax) finds something that is not empty."""

    column: str
    pattern: str
    where: str | None = None
    metric_name: ClassVar[str] = "PatternMatch"

    def preconditions(self):
        return [X.text(self.column)]

    def arguments(self):
        return [self.column, self.pattern]

    def matching(self):
        return F.regexp_extract(F.col(self.column), self.pattern, 0) != ""


class _One(ScanAnalyzer):
    """A state of one number that is the metric."""

    def aggregate(self, x: Column) -> Column:
        raise NotImplementedError

    def input(self) -> Column:
        return F.col(self.column)

    def preconditions(self):
        return [X.numeric(self.column), X.not_nested(self.column)]

    def state_exprs(self):
        return {"value": self.aggregate(X.only_where(self.input(), self.filter)).cast("double")}

    def value_expr(self, state):
        return state["value"]

    def value_of(self, state):
        return float(state["value"])


@dataclass(frozen=True)
class Minimum(_One):
    column: str
    where: str | None = None
    metric_name: ClassVar[str] = "Minimum"
    parts: ClassVar[Mapping[str, str]] = {"value": "min"}

    def aggregate(self, x):
        return F.min(x)


@dataclass(frozen=True)
class Maximum(_One):
    column: str
    where: str | None = None
    metric_name: ClassVar[str] = "Maximum"
    parts: ClassVar[Mapping[str, str]] = {"value": "max"}

    def aggregate(self, x):
        return F.max(x)


@dataclass(frozen=True)
class Sum(_One):
    column: str
    where: str | None = None
    metric_name: ClassVar[str] = "Sum"
    parts: ClassVar[Mapping[str, str]] = {"value": "sum"}

    def aggregate(self, x):
        return F.sum(x.cast("double"))


class _Length(_One):
    def preconditions(self):
        return [X.text(self.column)]

    def input(self):
        return F.length(F.col(self.column))


@dataclass(frozen=True)
class MinLength(_Length):
    column: str
    where: str | None = None
    metric_name: ClassVar[str] = "MinLength"
    parts: ClassVar[Mapping[str, str]] = {"value": "min"}

    def aggregate(self, x):
        return F.min(x)


@dataclass(frozen=True)
class MaxLength(_Length):
    column: str
    where: str | None = None
    metric_name: ClassVar[str] = "MaxLength"
    parts: ClassVar[Mapping[str, str]] = {"value": "max"}

    def aggregate(self, x):
        return F.max(x)


@dataclass(frozen=True)
class Mean(ScanAnalyzer):
    column: str
    where: str | None = None
    metric_name: ClassVar[str] = "Mean"
    parts: ClassVar[Mapping[str, str]] = {"total": "sum", "n": "sum"}

    def preconditions(self):
        return [X.numeric(self.column), X.not_nested(self.column)]

    def state_exprs(self):
        x = X.only_where(F.col(self.column), self.where)
        return {"total": F.sum(x.cast("double")), "n": F.count(x)}

    def value_expr(self, state):
        return F.when(state["total"].isNotNull(), X.ratio(state["total"], state["n"]))

    def value_of(self, state):
        return quotient(state["total"], state["n"])


class _Moments(ScanAnalyzer):
    """States with a count, means and sums of products of deviations, merged by the parallel formula."""

    #: Of each sum of products: the two means it belongs to.
    products: ClassVar[Mapping[str, tuple[str, str]]] = {}
    means: ClassVar[tuple[str, ...]] = ()

    def is_empty(self, state: State) -> bool:
        return not state.values["n"]

    def merge(self, a: State, b: State) -> State:
        a, b = a.values, b.values
        if not a["n"] or not b["n"]:
            return State(b if not a["n"] else a)
        n = a["n"] + b["n"]
        out = {"n": n} | {m: a[m] + (b[m] - a[m]) * b["n"] / n for m in self.means}
        for k, (x, y) in self.products.items():
            out[k] = a[k] + b[k] + (b[x] - a[x]) * (b[y] - a[y]) * a["n"] * b["n"] / n
        return State(out)

    def merge_exprs(self, state):
        n = F.sum(state["n"])
        mean = {m: F.sum(state[m] * state["n"]) / F.nullif(n, F.lit(0)) for m in self.means}
        out = {"n": n} | mean
        for k, (x, y) in self.products.items():
            out[k] = F.sum(state[k]) + F.sum(state["n"] * state[x] * state[y]) - n * mean[x] * mean[y]
        return out


@dataclass(frozen=True)
class StandardDeviation(_Moments):
    """The population standard deviation."""

    column: str
    where: str | None = None
    metric_name: ClassVar[str] = "StandardDeviation"
    parts: ClassVar[Mapping[str, str]] = {"n": "", "mean": "", "m2": ""}
    means: ClassVar[tuple[str, ...]] = ("mean",)
    products: ClassVar[Mapping[str, tuple[str, str]]] = {"m2": ("mean", "mean")}

    def preconditions(self):
        return [X.numeric(self.column), X.not_nested(self.column)]

    def state_exprs(self):
        x = X.only_where(F.col(self.column).cast("double"), self.where)
        return {"n": F.count(x), "mean": F.avg(x), "m2": F.var_pop(x) * F.count(x)}

    def value_expr(self, state):
        return F.when(state["n"] > 0, F.sqrt(F.greatest(state["m2"], F.lit(0.0)) / F.nullif(state["n"], F.lit(0))))

    def value_of(self, state):
        return math.sqrt(max(state["m2"], 0.0) / state["n"])


@dataclass(frozen=True)
class Correlation(_Moments):
    """Pearson's correlation over the rows where both values are present."""

    first: str
    second: str
    where: str | None = None
    metric_name: ClassVar[str] = "Correlation"
    entity_kind: ClassVar[Entity] = Entity.MULTICOLUMN
    parts: ClassVar[Mapping[str, str]] = {"n": "", "mx": "", "my": "", "cxy": "", "cxx": "", "cyy": ""}
    means: ClassVar[tuple[str, ...]] = ("mx", "my")
    products: ClassVar[Mapping[str, tuple[str, str]]] = {"cxy": ("mx", "my"), "cxx": ("mx", "mx"), "cyy": ("my", "my")}

    @property
    def instance(self):
        return f"{self.first},{self.second}"

    def arguments(self):
        return [self.first, self.second]

    def preconditions(self):
        return [X.numeric(self.first), X.not_nested(self.first), X.numeric(self.second), X.not_nested(self.second)]

    def state_exprs(self):
        both = F.col(self.first).isNotNull() & F.col(self.second).isNotNull()
        both = both if self.where is None else both & F.expr(self.where)
        x, y = (F.when(both, F.col(c).cast("double")) for c in (self.first, self.second))
        n = F.count(x)
        return {"n": n, "mx": F.avg(x), "my": F.avg(y), "cxy": F.covar_pop(x, y) * n, "cxx": F.var_pop(x) * n, "cyy": F.var_pop(y) * n}

    def value_expr(self, state):
        return F.when(state["n"] > 0, F.try_divide(state["cxy"], F.sqrt(state["cxx"]) * F.sqrt(state["cyy"])))

    def value_of(self, state):
        scale = math.sqrt(state["cxx"]) * math.sqrt(state["cyy"])
        return state["cxy"] / scale if scale else float("nan")


#: Bins of an inferred-type distribution, in the order in which values are tried; Unknown is null.
TYPE_BINS = ("Unknown", "Fractional", "Integral", "Boolean", "String")


@dataclass(frozen=True)
class DataType(ScanAnalyzer):
    """How many values look like each kind of type; rows outside the filter count as Unknown."""

    column: str
    where: str | None = None
    metric_name: ClassVar[str] = "Histogram"
    parts: ClassVar[Mapping[str, str]] = {k: "sum" for k in TYPE_BINS}

    def preconditions(self):
        return [X.exists(self.column), X.not_nested(self.column)]

    def state_exprs(self):
        x = X.only_where(F.col(self.column).cast("string"), self.where)
        kind = F.when(x.isNull(), "Unknown").when(x.rlike(patterns.FRACTIONAL), "Fractional").when(x.rlike(patterns.INTEGRAL), "Integral").when(x.rlike(patterns.BOOLEAN), "Boolean").otherwise("String")
        return {k: F.sum((kind == k).cast("long")) for k in TYPE_BINS}

    def value_expr(self, state):
        whole = sum((state[k] for k in TYPE_BINS[1:]), state["Unknown"])
        return F.struct(*(F.struct(state[k].alias("absolute"), X.ratio(state[k], whole).alias("ratio")).alias(k) for k in TYPE_BINS))

    def value_of(self, state):
        whole = sum(state[k] for k in TYPE_BINS)
        return Distribution({k: Bin(int(state[k]), quotient(state[k], whole)) for k in TYPE_BINS}, len(TYPE_BINS))


class _Sketch(ScanAnalyzer):
    """A state that is a sketch's bytes: merged by Spark over rows of states, so two states meet in a small frame."""

    def merge_frames(self, state_rows):
        raise NotImplementedError

    def merge(self, a: State, b: State) -> State:
        from pyspark.sql import SparkSession

        if a.values["sketch"] is None or b.values["sketch"] is None:
            return State({"sketch": a.values["sketch"] if b.values["sketch"] is None else b.values["sketch"]})
        spark = SparkSession.active()
        rows = spark.createDataFrame([(bytearray(s.values["sketch"]),) for s in (a, b)], "sketch binary")
        return State({"sketch": bytes(rows.agg(self.merge_exprs({"sketch": F.col("sketch")})["sketch"]).first()[0])})

    def value_of(self, state):
        from pyspark.sql import SparkSession

        if state["sketch"] is None:
            raise MetricError("no values")
        rows = SparkSession.active().createDataFrame([(bytearray(state["sketch"]),)], "sketch binary")
        return rows.select(self.value_expr({"sketch": F.col("sketch")})).first()[0]


def merge_all(states: Mapping[ScanAnalyzer, list[State]]) -> dict[ScanAnalyzer, State]:
    """The merged state of each analyzer's states. Sketches of all analyzers are merged in one job."""
    out, rows, columns = {}, [], {}
    for a, found in states.items():
        there = [s.values["sketch"] for s in found if s.values["sketch"] is not None] if isinstance(a, _Sketch) else []
        if len(there) < 2:
            out[a] = reduce(a.merge, found)
            continue
        i = len(columns)
        rows += [(i, bytearray(x)) for x in there]
        columns[a] = a.merge_exprs({"sketch": F.when(F.col("i") == i, F.col("sketch"))})["sketch"].alias(f"s{i}")
    if columns:
        from pyspark.sql import SparkSession

        row = SparkSession.active().createDataFrame(rows, "i int, sketch binary").agg(*columns.values()).first()
        out |= {a: State({"sketch": bytes(x)}) for a, x in zip(columns, row, strict=True)}
    return out


@dataclass(frozen=True)
class ApproxCountDistinct(_Sketch):
    """Distinct values by a mergeable HyperLogLog sketch."""

    column: str
    where: str | None = None
    metric_name: ClassVar[str] = "ApproxCountDistinct"
    parts: ClassVar[Mapping[str, str]] = {"sketch": "sketch"}

    def preconditions(self):
        return [X.exists(self.column), X.not_nested(self.column)]

    def state_exprs(self):
        return {"sketch": F.hll_sketch_agg(X.only_where(F.col(self.column).cast("string"), self.where), 14)}

    def merge_exprs(self, state):
        return {"sketch": F.hll_union_agg(state["sketch"])}

    def value_expr(self, state):
        return F.hll_sketch_estimate(state["sketch"]).cast("double")


class _Kll(_Sketch):
    def preconditions(self):
        return [X.numeric(self.column), X.not_nested(self.column)]

    def state_exprs(self):
        return {"sketch": F.expr(f"kll_sketch_agg_double({self._sql()}, {self.k})")}

    def _sql(self) -> str:
        c = self.column if self.column.startswith("`") else ".".join(f"`{p}`" for p in self.column.split("."))
        x = f"cast({c} AS double)"
        return x if self.where is None else f"CASE WHEN {self.where} THEN {x} END"

    def merge_exprs(self, state):
        return {"sketch": F.call_function("kll_merge_agg_double", state["sketch"])}


@dataclass(frozen=True)
class ApproxQuantile(_Kll):
    """A quantile by a mergeable KLL sketch."""

    column: str
    quantile: float
    where: str | None = None
    k: int = 2048
    metric_name: ClassVar[str] = "ApproxQuantile"
    parts: ClassVar[Mapping[str, str]] = {"sketch": "sketch"}

    def preconditions(self):
        def inside(schema):
            if not 0 <= self.quantile <= 1:
                raise X.PreconditionError("Quantile must lie in [0, 1]!")

        return [inside, *super().preconditions()]

    def arguments(self):
        return [self.column, repr(self.quantile)]

    def value_expr(self, state):
        return F.call_function("kll_sketch_get_quantile_double", state["sketch"], F.lit(float(self.quantile)))


@dataclass(frozen=True)
class ApproxQuantiles(_Kll):
    """Several quantiles of one sketch: a struct by quantile."""

    column: str
    quantiles: tuple[float, ...]
    where: str | None = None
    k: int = 2048
    metric_name: ClassVar[str] = "ApproxQuantiles"
    parts: ClassVar[Mapping[str, str]] = {"sketch": "sketch"}

    def arguments(self):
        return [self.column, ",".join(map(repr, self.quantiles))]

    def value_expr(self, state):
        return F.map_from_entries(F.array(*(F.struct(F.lit(repr(q)), F.call_function("kll_sketch_get_quantile_double", state["sketch"], F.lit(float(q)))) for q in self.quantiles)))

    def value_of(self, state):
        found = super().value_of(state)
        return Distribution({k: Bin(0, float(v)) for k, v in found.items()}, len(found))


@dataclass(frozen=True)
class KllSketch(_Kll):
    """A distribution over equally wide buckets between the least and the greatest value, from a KLL sketch."""

    column: str
    buckets: int = 100
    where: str | None = None
    k: int = 2048
    GRID: ClassVar[int] = 1000
    metric_name: ClassVar[str] = "KLL"
    parts: ClassVar[Mapping[str, str]] = {"sketch": "sketch"}

    def arguments(self):
        return [self.column, str(self.buckets)]

    def value_expr(self, state):
        grid = F.array(*(F.lit(i / self.GRID) for i in range(self.GRID + 1)))
        return F.struct(F.call_function("kll_sketch_get_n_double", state["sketch"]).alias("n"), F.call_function("kll_sketch_get_quantile_double", state["sketch"], grid).alias("quantiles"))

    def value_of(self, state):
        found = super().value_of(state)
        points = list(found["quantiles"])
        low, high = points[0], points[-1]
        edges = [low + (high - low) * i / self.buckets for i in range(self.buckets + 1)]
        # A bucket's share is the share of evenly spaced quantiles that lie below its upper edge and not below its lower.
        ranks = [0.0, *(bisect_left(points, e) / len(points) for e in edges[1:-1]), 1.0]
        bins = {}
        for i in range(self.buckets):
            share = max(0.0, ranks[i + 1] - ranks[i])
            bins[f"[{edges[i]!r}, {edges[i + 1]!r}{']' if i == self.buckets - 1 else ')'}"] = Bin(round(share * found["n"]), share)
        return Distribution(bins, self.buckets)
