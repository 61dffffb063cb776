"""Repositories of metrics: results of runs by date and tags."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.model import ResultKey
from plumbline.operators.base import Analyzer
from plumbline.plans.runner import AnalyzerContext


def tag_columns(tags: Iterable[str], taken: Iterable[str]) -> dict[str, str]:
    """A column name for each tag: lower case, letters, digits and underscores; `_2` and so on where it is taken."""
    used, out = {c.lower() for c in taken}, {}
    for tag in tags:
        base = re.sub(r"[^a-z0-9_]", "", tag.lower())
        name, n = base, 2
        while name in used:
            name, n = f"{base}_{n}", n + 1
        used.add(name)
        out[tag] = name
    return out


@dataclass(frozen=True)
class AnalysisResult:
    key: ResultKey
    context: AnalyzerContext

    def rows(self, with_tags: Iterable[str] | None = None, for_analyzers: Iterable[Analyzer] | None = None) -> list[dict]:
        """The context's rows with the date and the tags asked for (all without a list)."""
        wanted = None if with_tags is None else set(with_tags)
        tags = {t: v for t, v in self.key.tags.items() if wanted is None or t in wanted}
        names = tag_columns(tags, ["entity", "instance", "name", "value", "dataset_date"])
        return [r | {"dataset_date": self.key.data_set_date} | {names[t]: v for t, v in tags.items()} for r in self.context.rows(for_analyzers)]


class Loader:
    """Results of a repository, narrowed down step by step; each step gives a new loader."""

    def __init__(self, results: list[AnalysisResult], tags=None, analyzers=None, after=None, before=None, match_all: bool = False):
        self._results, self._tags, self._analyzers, self._after, self._before, self._all = results, tags, analyzers, after, before, match_all

    def _with(self, **new) -> Loader:
        old = {"tags": self._tags, "analyzers": self._analyzers, "after": self._after, "before": self._before, "match_all": self._all}
        return Loader(self._results, **(old | new))

    def with_tag_values(self, tags: Mapping[str, str], match_all: bool = False) -> Loader:
        """Results with any (or all) of the tags."""
        return self._with(tags=dict(tags), match_all=match_all)

    def for_analyzers(self, analyzers: Iterable[Analyzer]) -> Loader:
        """Only these metrics; of an empty list, none."""
        return self._with(analyzers={str(a) for a in analyzers})

    def after(self, date: int) -> Loader:
        return self._with(after=date)

    def before(self, date: int) -> Loader:
        return self._with(before=date)

    def get(self) -> list[AnalysisResult]:
        """Dates count inclusively."""
        out = []
        for r in sorted(self._results, key=lambda r: r.key.data_set_date):
            if self._after is not None and r.key.data_set_date < self._after or self._before is not None and r.key.data_set_date > self._before:
                continue
            if self._tags is not None and not (all if self._all else any)(r.key.tags.get(k) == v for k, v in self._tags.items()):
                continue
            metrics = {a: m for a, m in r.context.metrics.items() if self._analyzers is None or str(a) in self._analyzers}
            out.append(AnalysisResult(r.key, AnalyzerContext(metrics)))
        return out

    def rows(self, with_tags: Iterable[str] | None = None) -> list[dict]:
        """Rows of all results with the same columns: a tag that a result lacks is None."""
        found = [row for r in self.get() for row in r.rows(with_tags)]
        columns = list(dict.fromkeys(c for row in found for c in row))
        return [{c: row.get(c) for c in columns} for row in found]

    def success_metrics_as_dataframe(self, spark: SparkSession, with_tags: Iterable[str] | None = None) -> DataFrame:
        rows = self.rows(with_tags)
        base = "entity string, instance string, name string, value double, dataset_date bigint"
        extra = [c for c in (rows[0] if rows else {}) if c not in {"entity", "instance", "name", "value", "dataset_date"}]
        schema = base + "".join(f", `{c}` string" for c in extra)
        order = ["entity", "instance", "name", "value", "dataset_date", *extra]
        return spark.createDataFrame([tuple(r[c] for c in order) for r in rows], schema)

    def success_metrics_as_json(self, with_tags: Iterable[str] | None = None) -> str:
        return json.dumps([{"dataSetDate" if k == "dataset_date" else k: v for k, v in r.items()} for r in self.rows(with_tags)])


class MetricsRepository:
    """Results by key. Only successful metrics are kept."""

    def _read(self) -> list[AnalysisResult]:
        raise NotImplementedError

    def _write(self, results: list[AnalysisResult]) -> None:
        raise NotImplementedError

    def save(self, key: ResultKey, context: AnalyzerContext) -> None:
        """Store a run, in place of an earlier one with the same key."""
        good = AnalyzerContext({a: m for a, m in context.metrics.items() if m.ok})
        self._write([*(r for r in self._read() if r.key != key), AnalysisResult(key, good)])

    def save_or_append(self, key: ResultKey, context: AnalyzerContext) -> None:
        """Add to the run with that key; of two metrics of one analyzer the new one stays."""
        known = self.load_by_key(key)
        new = {str(a) for a in context.metrics}
        old = {} if known is None else {a: m for a, m in known.metrics.items() if str(a) not in new}
        self.save(key, AnalyzerContext({**old, **context.metrics}))

    def load_by_key(self, key: ResultKey) -> AnalyzerContext | None:
        return next((r.context for r in self._read() if r.key == key), None)

    def load(self) -> Loader:
        return Loader(self._read())


class InMemoryMetricsRepository(MetricsRepository):
    def __init__(self):
        self._results: list[AnalysisResult] = []

    def _read(self):
        return self._results

    def _write(self, results):
        self._results = results


class FileMetricsRepository(MetricsRepository):
    """All results in one JSON file on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self):
        from plumbline.sources.files import read_text
        from plumbline.sources.serde import deserialize

        text = read_text(self.spark, self.path)
        return [] if text is None else deserialize(text)

    def _write(self, results):
        from plumbline.sources.files import write_text
        from plumbline.sources.serde import serialize

        write_text(self.spark, self.path, serialize(results), True)


def history_filter(history: DataFrame, tags: Mapping[str, str] | None = None, after: int | None = None, before: int | None = None, names: Iterable[str] | None = None) -> DataFrame:
    """The loader's filters over a table of metrics (dataset_date, name, and a column for each tag), however long."""
    out = history
    if after is not None:
        out = out.filter(F.col("dataset_date") >= after)
    if before is not None:
        out = out.filter(F.col("dataset_date") <= before)
    if tags is not None:
        out = out.filter(reduce(lambda a, b: a | b, (F.col(k) == v for k, v in tags.items()), F.lit(False)))
    if names is not None:
        out = out.filter(F.col("name").isin(*names))
    return out
