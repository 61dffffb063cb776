"""Analyzers, metrics and results as JSON, without loss."""

from __future__ import annotations

import json
from dataclasses import fields

from plumbline.model import Bin, Distribution, Entity, Metric, MetricError, Outcome, ResultKey
from plumbline.operators import grouping as G
from plumbline.operators import scan as S
from plumbline.operators.base import Analyzer
from plumbline.plans.runner import AnalyzerContext

KINDS: dict[str, type[Analyzer]] = {
    k.__name__: k
    for k in (
        S.Size, S.Completeness, S.Compliance, S.PatternMatch, S.Minimum, S.Maximum, S.Sum, S.Mean, S.MinLength, S.MaxLength, S.StandardDeviation,
        S.Correlation, S.DataType, S.ApproxCountDistinct, S.ApproxQuantile, S.ApproxQuantiles, S.KllSketch,
        G.Uniqueness, G.Distinctness, G.UniqueValueRatio, G.CountDistinct, G.Entropy, G.MutualInformation, G.Histogram,
    )
}


def analyzer_to_dict(a: Analyzer) -> dict:
    if isinstance(a, G.Histogram) and a.binning is not None:
        raise ValueError("a histogram with a binning function cannot be written")
    out = {f.name: getattr(a, f.name) for f in fields(a) if f.name != "binning"}
    if isinstance(a, S.Compliance):
        out["predicate"] = a.text
    return {"analyzerName": type(a).__name__} | {k: list(v) if isinstance(v, tuple) else v for k, v in out.items()}


def analyzer_from_dict(d: dict) -> Analyzer:
    kind = KINDS[d["analyzerName"]]
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items() if k != "analyzerName"})


def metric_to_dict(m: Metric) -> dict:
    if not m.ok:
        raise MetricError("Unable to serialize failed metrics.")
    head = {"entity": m.entity.value, "instance": m.instance, "name": m.name}
    if isinstance(m.value, Distribution):
        values = {k: {"absolute": b.absolute, "ratio": b.ratio} for k, b in m.value.values.items()}
        return head | {"metricName": "HistogramMetric", "value": {"numberOfBins": m.value.number_of_bins, "values": values}}
    return head | {"metricName": "DoubleMetric", "value": m.value}


def metric_from_dict(d: dict) -> Metric:
    value = d["value"]
    if d["metricName"] == "HistogramMetric":
        value = Distribution({k: Bin(b["absolute"], b["ratio"]) for k, b in value["values"].items()}, value["numberOfBins"])
    return Metric(Entity(d["entity"]), d["name"], d["instance"], Outcome(value))


def context_to_list(c: AnalyzerContext) -> list[dict]:
    return [{"analyzer": analyzer_to_dict(a), "metric": metric_to_dict(m)} for a, m in c.metrics.items()]


def context_from_list(rows: list[dict]) -> AnalyzerContext:
    return AnalyzerContext({analyzer_from_dict(r["analyzer"]): metric_from_dict(r["metric"]) for r in rows})


def serialize(results) -> str:
    """Analysis results (key and context) as JSON."""
    return json.dumps([{"resultKey": {"dataSetDate": r.key.data_set_date, "tags": dict(r.key.tags)}, "analyzerContext": {"metricMap": context_to_list(r.context)}} for r in results])


def deserialize(text: str) -> list:
    from plumbline.sources.repository import AnalysisResult

    return [AnalysisResult(ResultKey(d["resultKey"]["dataSetDate"], d["resultKey"]["tags"]), context_from_list(d["analyzerContext"]["metricMap"])) for d in json.loads(text)]
