"""Metrics over the frequencies of values or combinations of values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.model import Bin, Distribution, EmptyStateError, Entity
from plumbline.operators.base import Analyzer

#: Column of frequency tables with the count of each group.
FREQUENCY = "__freq"
NULL_BIN = "NullValue"
MOST_BINS = 1000


def frequencies(df: DataFrame, columns: tuple[str, ...], where: str | None = None) -> DataFrame:
    """Rows by combination of values: those where a column at least is not null, and that meet the filter.

    A merge of two such tables is their union, grouped again; rows with nulls in their keys merge too.
    """
    some = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in columns))
    rows = df.filter(some) if where is None else df.filter(some).filter(where)
    return rows.groupBy(*(F.col(c).alias(f"k{i}") for i, c in enumerate(columns))).agg(F.count(F.lit(1)).alias(FREQUENCY))


def merge_frequencies(*tables: DataFrame) -> DataFrame:
    """All tables united and grouped once, however many they are."""
    if len(tables) == 1:
        return tables[0]
    keys = [c for c in tables[0].columns if c != FREQUENCY]
    return reduce(DataFrame.unionByName, tables).groupBy(*keys).agg(F.sum(FREQUENCY).alias(FREQUENCY))


class GroupingAnalyzer(Analyzer):
    """columns, in any order, name the frequency table; it is shared by all analyzers with the same and the same filter."""

    @property
    def instance(self):
        return ",".join(self.columns)

    @property
    def entity(self):
        return Entity.COLUMN if len(self.columns) == 1 else Entity.MULTICOLUMN

    def arguments(self):
        return [f"List({self.instance})"]

    @property
    def grouping(self) -> tuple[tuple[str, ...], str | None]:
        return tuple(sorted(self.columns)), self.filter

    def preconditions(self):
        return [X.at_least_one(self.columns), *(X.exists(c) for c in self.columns), *(X.not_nested(c) for c in self.columns)]

    def aggregate_state_to(self, a, b, target) -> None:
        """Keep in target the frequency table that two providers' tables merge to."""
        tables = [t for t in (a.load_frequencies(self.grouping), b.load_frequencies(self.grouping)) if t is not None]
        if tables:
            target.persist_frequencies(self.grouping, merge_frequencies(*tables))

    def load_state_and_compute_metric(self, source):
        """The metric of the frequency table that a provider keeps."""
        from plumbline.plans.runner import grouping_aggs

        table = source.load_frequencies(self.grouping)
        return self.metric_from(None if table is None else grouping_aggs(table, self.grouping[0], [self]).first()[0])

    def copy_state_to(self, source, target) -> None:
        table = source.load_frequencies(self.grouping)
        if table is not None:
            target.persist_frequencies(self.grouping, table)

    def value_frame(self, table: DataFrame) -> DataFrame | None:
        """The metric as a frame of one row (value), where it takes more than one aggregation of the frequency table."""
        return None

    def value_agg(self) -> Column:
        """The metric as an aggregate over the frequency table; null if it is empty."""
        raise NotImplementedError

    def metric_from(self, value):
        if value is None:
            return self.failure(EmptyStateError(f"Empty state for analyzer {self}, all input values were NULL."))
        return self.metric(float(value))


def _freq() -> Column:
    return F.col(FREQUENCY)


def _columns(columns) -> tuple[str, ...]:
    return (columns,) if isinstance(columns, str) else tuple(columns)


class _Columns(GroupingAnalyzer):
    def __post_init__(self):
        object.__setattr__(self, "columns", _columns(self.columns))


@dataclass(frozen=True)
class Uniqueness(_Columns):
    """The share of rows whose combination of values occurs once."""

    columns: tuple[str, ...]
    where: str | None = None
    metric_name: ClassVar[str] = "Uniqueness"

    def value_agg(self):
        return F.sum((_freq() == 1).cast("double")) / F.sum(_freq())


@dataclass(frozen=True)
class Distinctness(_Columns):
    """Distinct combinations of values by row."""

    columns: tuple[str, ...]
    where: str | None = None
    metric_name: ClassVar[str] = "Distinctness"

    def value_agg(self):
        return F.count_if(_freq() >= 1).cast("double") / F.sum(_freq())


@dataclass(frozen=True)
class UniqueValueRatio(_Columns):
    """The share of distinct combinations that occur once."""

    columns: tuple[str, ...]
    where: str | None = None
    metric_name: ClassVar[str] = "UniqueValueRatio"

    def value_agg(self):
        return F.sum((_freq() == 1).cast("double")) / F.nullif(F.count(_freq()), F.lit(0))


@dataclass(frozen=True)
class CountDistinct(_Columns):
    """Distinct combinations, exactly."""

    columns: tuple[str, ...]
    where: str | None = None
    metric_name: ClassVar[str] = "CountDistinct"

    def value_agg(self):
        return F.count(_freq()).cast("double")


@dataclass(frozen=True)
class Entropy(GroupingAnalyzer):
    """Of the distribution of values, in nats: ln N - sum(f ln f) / N, so that N is no second pass."""

    column: str
    where: str | None = None
    metric_name: ClassVar[str] = "Entropy"

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.column,)

    def arguments(self):
        return [self.column]

    def value_agg(self):
        return F.ln(F.sum(_freq())) - F.sum(_freq() * F.ln(_freq())) / F.sum(_freq())


@dataclass(frozen=True)
class MutualInformation(_Columns):
    """Of two columns, in nats. Pairs with a null add to the marginals and the number of rows, not to the sum.

    sum f/N ln(f N / (x y)) over the pairs without null is (sum f ln f - sum t ln x - sum t ln y + ln N sum f) / N,
    where t is the part of a marginal that lies in such pairs: three aggregations, each combined in its
    tasks before it is shuffled, whose rows are added up. No window, no join.
    """

    columns: tuple[str, ...]
    where: str | None = None
    metric_name: ClassVar[str] = "MutualInformation"
    entity_kind: ClassVar[Entity] = Entity.MULTICOLUMN

    @property
    def entity(self):
        return Entity.MULTICOLUMN

    def preconditions(self):
        return [X.exactly(2, self.columns), *super().preconditions()]

    def value_frame(self, table):
        there = F.when(F.col("k0").isNotNull() & F.col("k1").isNotNull(), _freq()).otherwise(0)
        pairs = table.select((there * F.ln(_freq())).alias("part"), there.alias("there"), _freq().alias("n"))
        parts = [pairs.agg(F.sum("part").alias("part"), F.sum("there").alias("there"), F.sum("n").alias("n"))]
        for k in ("k0", "k1"):
            marginal = table.groupBy(k).agg(F.sum(there).alias("t"), F.sum(_freq()).alias("x"))
            parts.append(marginal.select((-F.col("t") * F.ln("x")).alias("part"), F.lit(0).alias("there"), F.lit(0).alias("n")))
        whole = reduce(DataFrame.unionByName, parts).agg(F.sum("part").alias("part"), F.sum("there").alias("there"), F.sum("n").alias("n"))
        return whole.select(F.when(F.col("n") > 0, (F.col("part") + F.ln("n") * F.col("there")) / F.col("n")).alias("value"))


@dataclass(frozen=True)
class Histogram(Analyzer):
    """Values of a column as text, with their numbers and shares of all rows, the filtered-out ones included.

    binning turns the column into bins first. The max_bins most frequent are reported, ties by value;
    number_of_bins counts all.
    """

    column: str
    binning: Callable[[Column], Column] | None = None
    max_bins: int = MOST_BINS
    where: str | None = None
    metric_name: ClassVar[str] = "Histogram"

    def preconditions(self):
        def few(schema):
            if self.max_bins > MOST_BINS:
                raise X.PreconditionError(f"Cannot return histogram values for more than {MOST_BINS} values")

        return [few, X.exists(self.column), X.not_nested(self.column)]

    def counts(self, df: DataFrame) -> DataFrame:
        """A row for each bin: value, absolute and rows (with those that the filter leaves out)."""
        x = F.col(self.column)
        x = self.binning(x) if self.binning else x
        kept = F.lit(True) if self.where is None else F.coalesce(F.expr(self.where), F.lit(False))
        value = F.coalesce(x.cast("string"), F.lit(NULL_BIN))
        return df.select(value.alias("value"), kept.alias("kept")).groupBy("value").agg(F.count_if("kept").alias("absolute"), F.count(F.lit(1)).alias("rows"))

    def distribution(self, df: DataFrame) -> Distribution:
        """One job: totals are observed while the most frequent bins are taken."""
        from pyspark.sql import Observation

        seen = Observation()
        table = self.counts(df).observe(seen, F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count_if(F.col("absolute") > 0).alias("bins"))
        top = table.filter("absolute > 0").orderBy(F.desc("absolute"), "value").limit(self.max_bins).collect()
        totals = seen.get
        return Distribution({r["value"]: Bin(r["absolute"], r["absolute"] / totals["rows"]) for r in top}, totals["bins"])

    def bins_frame(self, df: DataFrame) -> DataFrame:
        """The report as a frame: value, absolute, ratio, number_of_bins."""
        table = self.counts(df)
        totals = table.agg(F.sum("rows").alias("all_rows"), F.count_if(F.col("absolute") > 0).alias("number_of_bins")).withColumn("one", F.lit(1))
        top = table.filter("absolute > 0").orderBy(F.desc("absolute"), "value").limit(self.max_bins).withColumn("one", F.lit(1))
        joined = top.join(F.broadcast(totals), "one")  # totals are one row
        return joined.select("value", "absolute", (F.col("absolute") / F.col("all_rows")).alias("ratio"), "number_of_bins")


