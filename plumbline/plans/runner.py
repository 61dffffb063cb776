"""Planning and running analyzers: one scan for all scanning ones, one grouping for each set of keys."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from plumbline.model import Metric, MetricError, ResultKey
from plumbline.operators.base import Analyzer, ScanAnalyzer, State
from plumbline.operators.grouping import GroupingAnalyzer, Histogram, frequencies, merge_frequencies
from plumbline.operators.scan import DataType, merge_all
from plumbline.operators.states import InMemoryStateProvider

METRIC_SCHEMA = "entity string, instance string, name string, value double"


@dataclass(frozen=True)
class AnalyzerContext:
    """Metrics by analyzer. Contexts are values; of two with the same analyzer the right one's metric counts."""

    metrics: Mapping[Analyzer, Metric] = field(default_factory=dict)

    def __getitem__(self, analyzer: Analyzer) -> Metric:
        return self.metrics[analyzer]

    def get(self, analyzer: Analyzer) -> Metric | None:
        return self.metrics.get(analyzer)

    def __add__(self, other: AnalyzerContext) -> AnalyzerContext:
        return AnalyzerContext({**self.metrics, **other.metrics})

    @property
    def all_metrics(self) -> list[Metric]:
        return list(self.metrics.values())

    def rows(self, for_analyzers: Iterable[Analyzer] | None = None) -> list[dict]:
        """Numbers of the successful metrics, histograms by bin; the filter is part of the name."""
        wanted = None if for_analyzers is None else set(for_analyzers)
        out = []
        for analyzer, metric in self.metrics.items():
            if not metric.ok or (wanted is not None and analyzer not in wanted):
                continue
            for m in metric.flatten():
                tail = f" (where: {analyzer.filter} )" if analyzer.filter else ""
                # The class names the analyzer; parts of a histogram keep their part after the metric's name.
                name = type(analyzer).__name__ + m.name.removeprefix(metric.name)
                out.append({"entity": m.entity.value, "instance": m.instance, "name": name + tail, "value": m.value})
        return out

    def success_metrics_as_dataframe(self, spark: SparkSession, for_analyzers=None) -> DataFrame:
        return spark.createDataFrame([tuple(r.values()) for r in self.rows(for_analyzers)], METRIC_SCHEMA)

    def success_metrics_as_json(self, for_analyzers=None) -> str:
        return json.dumps(self.rows(for_analyzers))


# --- Scanning ---------------------------------------------------------------------------------------


def _names(i: int, analyzer: ScanAnalyzer) -> dict[str, str]:
    return {k: f"s{i}_{k}" for k in analyzer.parts}


def _common_filter(analyzers: list[ScanAnalyzer]) -> str | None:
    """The filter that all have, if the rows outside it mean nothing to any of them."""
    filters = {a.filter for a in analyzers}
    if len(filters) == 1 and None not in filters and not any(isinstance(a, DataType) for a in analyzers):
        return next(iter(filters))
    return None


def state_frame(df: DataFrame, analyzers: list[ScanAnalyzer], by: list[str] | None = None) -> DataFrame:
    """States of all analyzers in one aggregation; with `by`, a row of states for each group (a partition's states)."""
    where = None if by else _common_filter(analyzers)
    if where is not None:
        # Pushed down to the scan. Counts keep their meaning, since every row left meets the filter.
        df = df.filter(F.expr(where))
    exprs = [e.alias(_names(i, a)[k]) for i, a in enumerate(analyzers) for k, e in a.state_exprs().items()]
    return df.groupBy(*by).agg(*exprs) if by else df.agg(*exprs)


def merged_states(states: DataFrame, analyzers: list[ScanAnalyzer]) -> DataFrame:
    """One row of states from many, such as those of partitions."""
    exprs = []
    for i, a in enumerate(analyzers):
        names = _names(i, a)
        exprs += [e.alias(names[k]) for k, e in a.merge_exprs({k: F.col(n) for k, n in names.items()}).items()]
    return states.agg(*exprs)


def metric_frame(states: DataFrame, analyzers: list[ScanAnalyzer]) -> DataFrame:
    """A lazy frame of metrics (entity, instance, name, value) from a frame of states; for analyzers with one number."""
    rows = []
    for i, a in enumerate(analyzers):
        value = a.value_expr({k: F.col(n) for k, n in _names(i, a).items()})
        rows.append(F.struct(F.lit(a.entity.value).alias("entity"), F.lit(a.instance).alias("instance"), F.lit(a.metric_name).alias("name"), value.cast("double").alias("value")))
    return states.select(F.inline(F.array(*rows)))


def scan_metrics(df: DataFrame, analyzers: list[ScanAnalyzer]) -> DataFrame:
    return metric_frame(state_frame(df, analyzers), analyzers)


def _analysable(df: DataFrame, analyzer: ScanAnalyzer) -> Exception | None:
    """What Spark says against an analyzer's expressions, without a job, so that it cannot spoil a shared scan."""
    try:
        df.agg(*(e.alias(k) for k, e in analyzer.state_exprs().items())).schema  # noqa: B018
    except Exception as e:  # noqa: BLE001  failures are values
        return MetricError(str(e))
    return None


def _scan(df: DataFrame, analyzers: list[ScanAnalyzer]) -> dict[ScanAnalyzer, State | Exception]:
    out: dict[ScanAnalyzer, State | Exception] = {}
    good = []
    for a in analyzers:
        error = _analysable(df, a)
        if error is None:
            good.append(a)
        else:
            out[a] = error
    if not good:
        return out
    try:
        row = state_frame(df, good).first()
        for i, a in enumerate(good):
            values = {k: row[n] for k, n in _names(i, a).items()}
            out[a] = State({k: bytes(v) if isinstance(v, bytearray) else v for k, v in values.items()})
    except Exception as e:  # noqa: BLE001
        if len(good) == 1:
            out[good[0]] = MetricError(str(e))
        else:  # one bad value must not fail the others
            for a in good:
                out |= _scan(df, [a])
    return out


# --- Grouping ---------------------------------------------------------------------------------------


def grouping_aggs(table: DataFrame, keys: tuple[str, ...], analyzers: list[GroupingAnalyzer]) -> DataFrame:
    """The metrics m0, m1, .. of analyzers that share a frequency table: one aggregation for all whose metric is one."""
    frames = {i: f for i, a in enumerate(analyzers) if (f := a.value_frame(table)) is not None}
    plain = [(i, a) for i, a in enumerate(analyzers) if i not in frames]
    if not frames:
        return table.agg(*(a.value_agg().alias(f"m{i}") for i, a in plain))
    rows = [f.select(F.lit(i).alias("i"), F.col("value").cast("double").alias("value")) for i, f in frames.items()]
    if plain:
        one = table.agg(*(a.value_agg().cast("double").alias(f"m{i}") for i, a in plain))
        rows.append(one.select(F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"m{i}").alias("value")) for i, _ in plain)))))
    return reduce(DataFrame.unionByName, rows).agg(*(F.max(F.when(F.col("i") == i, F.col("value"))).alias(f"m{i}") for i in range(len(analyzers))))


def grouping_metrics(df: DataFrame, analyzers: list[GroupingAnalyzer]) -> DataFrame:
    """A lazy frame of metrics of analyzers with one set of keys and one filter."""
    keys, where = analyzers[0].grouping
    if any(a.grouping != (keys, where) for a in analyzers):
        raise ValueError("analyzers of one frame share their columns and filter")
    values = grouping_aggs(frequencies(df, keys, where), keys, analyzers)
    rows = [F.struct(F.lit(a.entity.value).alias("entity"), F.lit(a.instance).alias("instance"), F.lit(a.metric_name).alias("name"), F.col(f"m{i}").cast("double").alias("value")) for i, a in enumerate(analyzers)]
    return values.select(F.inline(F.array(*rows)))


def _group(table: DataFrame, keys, analyzers: list[GroupingAnalyzer]) -> dict[Analyzer, Metric]:
    try:
        row = grouping_aggs(table, keys, analyzers).first()
        return {a: a.metric_from(row[f"m{i}"]) for i, a in enumerate(analyzers)}
    except Exception as e:  # noqa: BLE001
        if len(analyzers) == 1:
            return {analyzers[0]: analyzers[0].failure(e)}
        out = {}
        for a in analyzers:
            out |= _group(table, keys, [a])
        return out


# --- Runs -------------------------------------------------------------------------------------------


def _failed(schema: T.StructType, analyzers: list[Analyzer]) -> dict[Analyzer, Metric]:
    return {a: a.failure(e) for a in analyzers if (e := a.check(schema)) is not None}


def run_analysis(
    df: DataFrame,
    analyzers: Iterable[Analyzer],
    aggregate_with=None,
    save_states_with=None,
    repository=None,
    reuse_key: ResultKey | None = None,
    fail_if_results_missing: bool = False,
    save_key: ResultKey | None = None,
) -> AnalyzerContext:
    """Metrics of df. Earlier states are merged in and states saved where providers are given; results of
    reuse_key are taken from the repository instead of computed; those of save_key are appended to it."""
    wanted = list(dict.fromkeys(analyzers))
    reused = {}
    if repository is not None and reuse_key is not None:
        known = repository.load_by_key(reuse_key)
        by_text = {str(a): m for a, m in known.metrics.items()} if known is not None else {}
        reused = {a: by_text[str(a)] for a in wanted if str(a) in by_text}
        missing = [a for a in wanted if a not in reused]
        if fail_if_results_missing and missing:
            raise MetricError("Could not find all necessary results in the MetricsRepository, the calculation of the metrics for these analyzers would be needed: " + ", ".join(map(str, missing)))
    todo = [a for a in wanted if a not in reused]
    metrics: dict[Analyzer, Metric] = _failed(df.schema, todo)
    good = [a for a in todo if a not in metrics]

    scanning = [a for a in good if isinstance(a, ScanAnalyzer)]
    for a, state in _scan(df, scanning).items():
        if isinstance(state, Exception):
            metrics[a] = a.failure(state)
            continue
        earlier = aggregate_with.load(a) if aggregate_with is not None else None
        state = state if earlier is None else a.merge(earlier, state)
        if save_states_with is not None and not a.is_empty(state):
            save_states_with.persist(a, state)
        metrics[a] = a.metric_from(state)

    groups: dict[tuple, list[GroupingAnalyzer]] = {}
    for a in good:
        if isinstance(a, GroupingAnalyzer):
            groups.setdefault(a.grouping, []).append(a)
    for (keys, where), members in groups.items():
        held = None  # a provider that keeps the table itself frees it with clear()
        try:
            table = frequencies(df, keys, where)
            earlier = aggregate_with.load_frequencies((keys, where)) if aggregate_with is not None else None
            table = table if earlier is None else merge_frequencies(earlier, table)
            if save_states_with is not None:
                table = held = table.persist(StorageLevel.MEMORY_AND_DISK)
                save_states_with.persist_frequencies((keys, where), table)
            metrics |= _group(table, keys, members)
        except Exception as e:  # noqa: BLE001
            metrics |= {a: a.failure(e) for a in members}
        finally:
            if held is not None and not getattr(save_states_with, "keeps_tables", False):
                held.unpersist()

    for a in good:
        if isinstance(a, Histogram):
            try:
                metrics[a] = a.metric(a.distribution(df))
            except Exception as e:  # noqa: BLE001
                metrics[a] = a.failure(e)

    context = AnalyzerContext({a: reused.get(a) or metrics[a] for a in wanted})
    if repository is not None and save_key is not None:
        repository.save_or_append(save_key, context)
    return context


def run_on_aggregated_states(schema: T.StructType, analyzers: Iterable[Analyzer], providers: Iterable, save_states_with=None, repository=None, save_key: ResultKey | None = None) -> AnalyzerContext:
    """Metrics from the merged states of several providers, without their data. Histograms keep no states."""
    wanted, providers = list(dict.fromkeys(analyzers)), list(providers)
    metrics = _failed(schema, wanted)
    merged = InMemoryStateProvider()
    found = {a: [x for p in providers if (x := p.load(a)) is not None] for a in wanted if a not in metrics and isinstance(a, ScanAnalyzer)}
    states = merge_all({a: x for a, x in found.items() if x})
    for a in wanted:
        if a in found:
            state = states.get(a)
            if state is not None:
                merged.persist(a, state)
                if save_states_with is not None:
                    save_states_with.persist(a, state)
            metrics[a] = a.metric_from(state)
        elif a not in metrics and not isinstance(a, GroupingAnalyzer):
            metrics[a] = a.failure(MetricError(f"{a} has no mergeable state"))
    groups: dict[tuple, list[GroupingAnalyzer]] = {}
    for a in wanted:
        if a not in metrics:
            groups.setdefault(a.grouping, []).append(a)
    for key, members in groups.items():
        tables = [x for p in providers if (x := p.load_frequencies(key)) is not None]
        if not tables:
            metrics |= {a: a.metric_from(None) for a in members}
            continue
        table = merge_frequencies(*tables)
        if save_states_with is not None:
            save_states_with.persist_frequencies(key, table)
        metrics |= _group(table, key[0], members)
    context = AnalyzerContext({a: metrics[a] for a in wanted})
    if repository is not None and save_key is not None:
        repository.save_or_append(save_key, context)
    return context


@dataclass(frozen=True)
class Analysis:
    """A set of analyzers to run together."""

    analyzers: tuple[Analyzer, ...] = ()

    def add_analyzer(self, analyzer: Analyzer) -> Analysis:
        return Analysis((*self.analyzers, analyzer))

    def add_analyzers(self, analyzers: Iterable[Analyzer]) -> Analysis:
        return Analysis((*self.analyzers, *analyzers))

    def run(self, df: DataFrame, aggregate_with=None, save_states_with=None) -> AnalyzerContext:
        return run_analysis(df, self.analyzers, aggregate_with, save_states_with)


class AnalysisRunBuilder:
    """Fluent form of run_analysis."""

    def __init__(self, df: DataFrame):
        self._df, self._analyzers, self._options, self._json, self._overwrite = df, [], {}, None, False

    def add_analyzer(self, analyzer: Analyzer) -> AnalysisRunBuilder:
        self._analyzers.append(analyzer)
        return self

    def add_analyzers(self, analyzers: Iterable[Analyzer]) -> AnalysisRunBuilder:
        self._analyzers += analyzers
        return self

    def aggregate_with(self, provider) -> AnalysisRunBuilder:
        self._options["aggregate_with"] = provider
        return self

    def save_states_with(self, provider) -> AnalysisRunBuilder:
        self._options["save_states_with"] = provider
        return self

    def use_repository(self, repository) -> AnalysisRunBuilder:
        self._options["repository"] = repository
        return self

    def reuse_existing_results_for_key(self, key: ResultKey, fail_if_results_missing: bool = False) -> AnalysisRunBuilder:
        self._options |= {"reuse_key": key, "fail_if_results_missing": fail_if_results_missing}
        return self

    def save_or_append_result(self, key: ResultKey) -> AnalysisRunBuilder:
        self._options["save_key"] = key
        return self

    def save_success_metrics_json_to_path(self, path: str) -> AnalysisRunBuilder:
        self._json = path
        return self

    def overwrite_previous_files(self, overwrite: bool = True) -> AnalysisRunBuilder:
        self._overwrite = overwrite
        return self

    def run(self) -> AnalyzerContext:
        from plumbline.sources.files import write_text

        context = run_analysis(self._df, self._analyzers, **self._options)
        if self._json:
            write_text(self._df.sparkSession, self._json, context.success_metrics_as_json(), self._overwrite)
        return context


class AnalysisRunner:
    @staticmethod
    def on_data(df: DataFrame) -> AnalysisRunBuilder:
        return AnalysisRunBuilder(df)

    run = staticmethod(run_analysis)
    run_on_aggregated_states = staticmethod(run_on_aggregated_states)
