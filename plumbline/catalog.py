"""Queries of the driver contract with their DuckDB oracles.

Single metrics are lazy frames of one row (metric); verification, repository and anomaly queries run
the library and return its exports, and exact quantiles are found before their frame is returned. Doubles are rounded on both sides.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.anomaly import AbsoluteChange, AnomalyDetector, DataPoint, OnlineNormal, RelativeRateOfChange, anomalies_by_series, flag_anomalies
from plumbline.applicability import check_applicability
from plumbline.checks import Check, CheckLevel
from plumbline.constraints import ConstrainableType, Constraint
from plumbline.functions import patterns
from plumbline.model import Entity, Metric, Outcome, ResultKey
from plumbline.operators import grouping as G
from plumbline.operators import scan as S
from plumbline.operators.states import FileStateProvider, InMemoryStateProvider
from plumbline.plans.quantiles import exact_quantiles
from plumbline.plans.runner import Analysis, AnalysisRunner, AnalyzerContext, grouping_metrics, merged_states, metric_frame, run_analysis, run_on_aggregated_states, scan_metrics, state_frame
from plumbline.sources.files import read_text
from plumbline.sources.repository import AnalysisResult, FileMetricsRepository, InMemoryMetricsRepository, history_filter
from plumbline.sources.serde import deserialize, serialize
from plumbline.verification import VerificationSuite, evaluate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(name: str) -> Query:
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """documents with their labels, null where there is none."""
    return _table("documents")(spark, d).select("doc_id", "lang", "n_chars").join(_table("labels")(spark, d), "doc_id", "left")


LABELLED = "documents LEFT JOIN labels USING (doc_id)"


def _sources(spark: SparkSession, d: str, kind: str) -> DataFrame:
    if kind == LABELLED:
        return _labelled(spark, d)
    return _table(kind)(spark, d)


def _metric(name: str, table: str, analyzer, sql: str, digits: int = 6) -> None:
    """Register a query of one metric: column metric."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        df = _sources(spark, d, table)
        frame = scan_metrics(df, [analyzer]) if hasattr(analyzer, "parts") else grouping_metrics(df, [analyzer])
        return frame.select(F.round("value", digits).alias("metric"))

    QUERIES[name] = query
    ORACLE_SQL[name] = f"SELECT round(({sql})::DOUBLE, {digits}) AS metric" + ("" if sql.lstrip().upper().startswith("WITH") or "FROM" in sql else f" FROM {table}")


def _freq(table: str, keys: str, value: str, where: str = "TRUE") -> str:
    some = " OR ".join(f"{k.strip()} IS NOT NULL" for k in keys.split(","))
    return f"SELECT {value} FROM (SELECT {keys}, count(*) AS f FROM {table} WHERE ({some}) AND ({where}) GROUP BY ALL)"


# --- Scans --------------------------------------------------------------------------------------------

_metric("size", "lineitem", S.Size(), "count(*)")
_metric("size_where", "lineitem", S.Size("l_returnflag = 'R'"), "count(*) FILTER (WHERE l_returnflag = 'R')")
_metric("completeness", LABELLED, S.Completeness("quality"), "avg((quality IS NOT NULL)::INT)")
_metric("completeness_where", LABELLED, S.Completeness("quality", "lang = 'en'"), "avg((quality IS NOT NULL)::INT) FILTER (WHERE lang = 'en')")
_metric("compliance", "orders", S.Compliance("large", "o_totalprice > 1000"), "avg((o_totalprice > 1000)::INT)")
_metric("compliance_where", "orders", S.Compliance("large", "o_totalprice > 1000", "o_orderkey % 2 = 0"), "avg((o_totalprice > 1000)::INT) FILTER (WHERE o_orderkey % 2 = 0)")
_metric("compliance_nulls", LABELLED, S.Compliance("good", "quality = 1"), "sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) / count(*)")
_metric("minimum", "lineitem", S.Minimum("l_extendedprice"), "min(l_extendedprice)")
_metric("maximum", "lineitem", S.Maximum("l_extendedprice"), "max(l_extendedprice)")
_metric("mean", "lineitem", S.Mean("l_extendedprice"), "avg(l_extendedprice)", 4)
_metric("mean_where", "lineitem", S.Mean("l_quantity", "l_returnflag = 'A'"), "avg(l_quantity) FILTER (WHERE l_returnflag = 'A')")
_metric("sum", "lineitem", S.Sum("l_quantity"), "sum(l_quantity)", 2)
_metric("stddev", "lineitem", S.StandardDeviation("l_extendedprice"), "stddev_pop(l_extendedprice)", 4)
_metric("stddev_where", "lineitem", S.StandardDeviation("l_quantity", "l_discount > 0.05"), "stddev_pop(l_quantity) FILTER (WHERE l_discount > 0.05)")
_metric("min_length", "part", S.MinLength("p_name"), "min(length(p_name))")
_metric("max_length", "part", S.MaxLength("p_name"), "max(length(p_name))")
_metric("max_length_documents", "documents", S.MaxLength("text"), "max(length(text))")
_metric("correlation", "lineitem", S.Correlation("l_quantity", "l_extendedprice"), "corr(l_quantity, l_extendedprice)")
_metric("correlation_where", "lineitem", S.Correlation("l_quantity", "l_extendedprice", "l_returnflag = 'N'"), "corr(l_quantity, l_extendedprice) FILTER (WHERE l_returnflag = 'N')")
_metric("pattern_match", "customer", S.PatternMatch("c_name", "#0*[1-5]"), "avg((regexp_extract(c_name, '#0*[1-5]', 0) <> '')::INT)")
_metric("pattern_match_url", "pages", S.PatternMatch("url", patterns.URL), f"avg((regexp_extract(url, '{patterns.URL}', 0) <> '')::INT)")
_metric("pattern_match_url_html", "pages", S.PatternMatch("html", patterns.URL), f"avg((regexp_extract(html, '{patterns.URL}', 0) <> '')::INT)")

# RE2 has neither references nor look-ahead: separators are written out, and numbers by their digits.
_CARDS = "|".join(rf"\b3[47]\d{{2}}{x}\d{{6}}{x}\d{{5}}\b|\b((4\d|5[1-5]|65)\d{{2}}|6011){x}\d{{4}}{x}\d{{4}}{x}\d{{4}}\b" for x in ("", "-", " "))
_SSN_PARTS = r"(00[1-9]|0[1-9]\d|[1-57-8]\d{2}|6[0-57-9]\d|66[0-57-9])", r"(0[1-9]|[1-9]\d)", r"(000[1-9]|00[1-9]\d|0[1-9]\d{2}|[1-9]\d{3})"
_SSNS = "|".join(x.join(_SSN_PARTS) for x in ("-", " ", ""))
EMAIL_SQL = "(regexp_extract(text, '" + patterns.EMAIL.replace("'", "''") + "', 0) <> '')"
CARD_SQL = f"(regexp_extract(text, '{_CARDS}', 0) <> '')"
SSN_SQL = f"(len([x FOR x IN regexp_extract_all(text, '{_SSNS}') IF regexp_replace(x, '[- ]', '', 'g') NOT IN ('219099999', '078051120')]) > 0)"
_metric("pattern_match_email", "documents", S.PatternMatch("text", patterns.EMAIL), f"avg(coalesce({EMAIL_SQL}, FALSE)::INT)")
_metric("pattern_match_credit_card", "documents", S.PatternMatch("text", patterns.CREDIT_CARD), f"avg(coalesce({CARD_SQL}, FALSE)::INT)")
_metric("pattern_match_ssn", "documents", S.PatternMatch("text", patterns.SOCIAL_SECURITY_NUMBER_US), f"avg(coalesce({SSN_SQL}, FALSE)::INT)")


def _data_type(column: str, table: str, name: str) -> None:
    analyzer = S.DataType(column)

    def query(spark: SparkSession, d: str) -> DataFrame:
        states = state_frame(_sources(spark, d, table), [analyzer])
        rows = [F.struct(F.lit(k).alias("kind"), F.col(f"s0_{k}").cast("bigint").alias("absolute")) for k in S.TYPE_BINS]
        return states.select(F.inline(F.array(*rows)))

    QUERIES[name] = query
    x = f"CAST({column} AS VARCHAR)"
    kind = f"CASE WHEN {x} IS NULL THEN 'Unknown' WHEN regexp_matches({x}, '^(-|\\+)? ?\\d*\\.\\d*$') THEN 'Fractional' WHEN regexp_matches({x}, '^(-|\\+)? ?\\d*$') THEN 'Integral' WHEN regexp_matches({x}, '^(true|false)$') THEN 'Boolean' ELSE 'String' END"
    ORACLE_SQL[name] = f"SELECT k.kind, count(t.kind)::BIGINT AS absolute FROM (VALUES ('Unknown'), ('Fractional'), ('Integral'), ('Boolean'), ('String')) k(kind) LEFT JOIN (SELECT {kind} AS kind FROM {table}) t ON k.kind = t.kind GROUP BY k.kind"


_data_type("p_size", "part", "data_type_integral")
_data_type("c_name", "customer", "data_type_string")
_data_type("quality", LABELLED, "data_type_nulls")


def _within(name: str, table: str, analyzer, exact: Callable[[DataFrame], DataFrame], sql: str, exact_sql: str) -> None:
    """Register a query of exact numbers, and whether an approximate metric is within its error of them."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        df = _sources(spark, d, table)
        there = exact(df).withColumn("one", F.lit(1))
        found = scan_metrics(df, [analyzer]).withColumn("one", F.lit(1)).join(F.broadcast(there), "one")  # both have one row
        return found.select(*(c for c in there.columns if c != "one"), F.expr(sql).alias("within"))

    QUERIES[name] = query
    ORACLE_SQL[name] = f"SELECT {exact_sql}, TRUE AS within FROM {table}"


_within("approx_count_distinct_within_error", "lineitem", S.ApproxCountDistinct("l_partkey"), lambda df: df.agg(F.countDistinct("l_partkey").alias("exact")), "abs(value - exact) <= 0.05 * exact", "count(DISTINCT l_partkey) AS exact")


def _around_median(df: DataFrame) -> DataFrame:
    """The exact bounds 2 % of rows lower and higher than the median: found here, the frame holds the numbers."""
    bounds = exact_quantiles(df, "l_extendedprice", (0.48, 0.52))
    return df.sparkSession.createDataFrame([tuple(bounds)], "low double, high double").select(*(F.round(c, 6).alias(c) for c in ("low", "high")))


_within(
    "approx_quantile_within_error", "lineitem", S.ApproxQuantile("l_extendedprice", 0.5), _around_median, "value BETWEEN low AND high",
    "round(quantile_cont(l_extendedprice, 0.48)::DOUBLE, 6) AS low, round(quantile_cont(l_extendedprice, 0.52)::DOUBLE, 6) AS high",
)


def _kll(spark: SparkSession, d: str) -> DataFrame:
    """Buckets of the sketch, their edges, exact counts up to each edge, and whether the sketch's counts are near them."""
    df, analyzer = _table("lineitem")(spark, d), S.KllSketch("l_extendedprice", 10)
    found = list(run_analysis(df, [analyzer])[analyzer].value.values.values())
    low, high = df.agg(F.min("l_extendedprice").cast("double"), F.max("l_extendedprice").cast("double")).first()
    edges = [low + (high - low) * (i + 1) / 10 for i in range(10)]
    exact = df.agg(*(F.count(F.when(F.col("l_extendedprice") <= e if i < 9 else F.lit(True), 1)).alias(f"n{i}") for i, e in enumerate(edges))).first()
    rows, sketched = [], 0
    for i, b in enumerate(found):
        sketched += b.absolute
        rows.append((i, exact[i], abs(sketched - exact[i]) <= 0.02 * exact[9] + 10))
    return spark.createDataFrame(rows, "bucket int, up_to bigint, near boolean")


QUERIES["kll_sketch"] = _kll
ORACLE_SQL["kll_sketch"] = "WITH e AS (SELECT min(l_extendedprice)::DOUBLE AS lo, max(l_extendedprice)::DOUBLE AS hi FROM lineitem) SELECT i::INT AS bucket, (SELECT count(*) FROM lineitem WHERE i = 9 OR l_extendedprice <= lo + (hi - lo) * (i + 1) / 10)::BIGINT AS up_to, TRUE AS near FROM e, range(10) t(i)"


def _quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles of one sketch beside the exact bounds 2 % of rows lower and higher."""
    df, qs = _table("lineitem")(spark, d), (0.25, 0.5, 0.75)
    analyzer = S.ApproxQuantiles("l_extendedprice", qs)
    found = run_analysis(df, [analyzer])[analyzer].value.values
    bounds = exact_quantiles(df, "l_extendedprice", [q + e for q in qs for e in (-0.02, 0.02)])
    rows = [(q, round(bounds[2 * i], 4), round(bounds[2 * i + 1], 4), bounds[2 * i] <= found[repr(q)].ratio <= bounds[2 * i + 1]) for i, q in enumerate(qs)]
    return spark.createDataFrame(rows, "quantile double, low double, high double, within boolean")


QUERIES["approx_quantiles"] = _quantiles
ORACLE_SQL["approx_quantiles"] = " UNION ALL ".join(f"SELECT {q}::DOUBLE AS quantile, round(quantile_cont(l_extendedprice, {q - 0.02})::DOUBLE, 4) AS low, round(quantile_cont(l_extendedprice, {q + 0.02})::DOUBLE, 4) AS high, TRUE AS within FROM lineitem" for q in (0.25, 0.5, 0.75))

# --- Frequencies ----------------------------------------------------------------------------------------

_metric("count_distinct", "orders", G.CountDistinct("o_custkey"), _freq("orders", "o_custkey", "count(*)"))
_metric("uniqueness", "lineitem", G.Uniqueness("l_orderkey"), _freq("lineitem", "l_orderkey", "sum((f = 1)::INT) / sum(f)"))
_metric("uniqueness_multi", "lineitem", G.Uniqueness(("l_orderkey", "l_linenumber")), _freq("lineitem", "l_orderkey, l_linenumber", "sum((f = 1)::INT) / sum(f)"))
_metric("uniqueness_where", "lineitem", G.Uniqueness("l_orderkey", "l_returnflag = 'R'"), _freq("lineitem", "l_orderkey", "sum((f = 1)::INT) / sum(f)", "l_returnflag = 'R'"))
_metric("distinctness", "lineitem", G.Distinctness("l_partkey"), _freq("lineitem", "l_partkey", "count(*) / sum(f)"))
_metric("distinctness_multi", LABELLED, G.Distinctness(("quality", "toxic")), _freq(LABELLED, "quality, toxic", "count(*) / sum(f)"))
_metric("unique_value_ratio", "orders", G.UniqueValueRatio("o_custkey"), _freq("orders", "o_custkey", "sum((f = 1)::INT) / count(*)"))
_metric("entropy", "events", G.Entropy("event_type"), "WITH t AS (SELECT count(*) AS f FROM events WHERE event_type IS NOT NULL GROUP BY event_type), n AS (SELECT sum(f) AS n FROM t) SELECT sum(-(f / n) * ln(f / n)) FROM t, n")
_metric("entropy_where", "lineitem", G.Entropy("l_returnflag", "l_quantity > 25"), "WITH t AS (SELECT count(*) AS f FROM lineitem WHERE l_quantity > 25 AND l_returnflag IS NOT NULL GROUP BY l_returnflag), n AS (SELECT sum(f) AS n FROM t) SELECT sum(-(f / n) * ln(f / n)) FROM t, n")


def _information(table: str, a: str, b: str) -> str:
    return f"""WITH j AS (SELECT {a} AS a, {b} AS b, count(*) AS f FROM {table} WHERE {a} IS NOT NULL OR {b} IS NOT NULL GROUP BY ALL),
    x AS (SELECT a, sum(f) AS fx FROM j GROUP BY a), y AS (SELECT b, sum(f) AS fy FROM j GROUP BY b), n AS (SELECT sum(f) AS n FROM j)
    SELECT sum((f / n) * ln((f / n) / ((fx / n) * (fy / n)))) FROM j JOIN x ON j.a = x.a JOIN y ON j.b = y.b, n"""


_metric("mutual_information", "part", G.MutualInformation(("p_brand", "p_type")), _information("part", "p_brand", "p_type"))
_metric("mutual_information_nulls", LABELLED, G.MutualInformation(("quality", "toxic")), _information(LABELLED, "quality", "toxic"), 9)


def _histogram(name: str, table: str, analyzer: G.Histogram, value: str) -> None:
    QUERIES[name] = lambda spark, d: analyzer.bins_frame(_sources(spark, d, table)).select("value", "absolute", F.round("ratio", 9).alias("ratio"), "number_of_bins")
    ORACLE_SQL[name] = f"""WITH t AS (SELECT coalesce(CAST({value} AS VARCHAR), 'NullValue') AS value, count(*) FILTER (WHERE {analyzer.where or 'TRUE'}) AS absolute, count(*) AS r FROM {table} GROUP BY 1),
    n AS (SELECT sum(r) AS n, count(*) FILTER (WHERE absolute > 0) AS bins FROM t)
    SELECT value, absolute, round(absolute / n, 9)::DOUBLE AS ratio, bins AS number_of_bins FROM t, n WHERE absolute > 0 ORDER BY absolute DESC, value LIMIT {analyzer.max_bins}"""


_histogram("histogram", "orders", G.Histogram("o_orderstatus"), "o_orderstatus")
_histogram("histogram_nulls", LABELLED, G.Histogram("quality"), "quality")
_histogram("histogram_where", "lineitem", G.Histogram("l_returnflag", where="l_quantity > 25"), "l_returnflag")
_histogram("histogram_binned", "part", G.Histogram("p_size", lambda c: F.floor(c / 10).cast("int")), "floor(p_size / 10)::INT")
_histogram("histogram_topn", "lineitem", G.Histogram("l_suppkey", max_bins=20), "l_suppkey")

# --- Batches --------------------------------------------------------------------------------------------

_BATCH = [
    (S.Size(), "count(*)"), (S.Completeness("l_partkey"), "avg((l_partkey IS NOT NULL)::INT)"), (S.Compliance("cheap", "l_discount >= 0.05"), "avg((l_discount >= 0.05)::INT)"),
    (S.Minimum("l_quantity"), "min(l_quantity)"), (S.Maximum("l_quantity"), "max(l_quantity)"), (S.Mean("l_quantity"), "avg(l_quantity)"), (S.Sum("l_quantity"), "sum(l_quantity)"),
    (S.StandardDeviation("l_quantity"), "stddev_pop(l_quantity)"), (S.MinLength("l_returnflag"), "min(length(l_returnflag))"), (S.MaxLength("l_returnflag"), "max(length(l_returnflag))"),
    (S.Correlation("l_quantity", "l_discount"), "corr(l_quantity, l_discount)"), (S.PatternMatch("l_returnflag", "[AR]"), "avg((regexp_extract(l_returnflag, '[AR]', 0) <> '')::INT)"),
]


def _rows_sql(pairs, table: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a.entity.value}' AS entity, '{a.instance}' AS instance, '{a.metric_name}' AS name, round(({sql})::DOUBLE, 6) AS value FROM {table}" for a, sql in pairs)


def _rounded(frame: DataFrame) -> DataFrame:
    return frame.withColumn("value", F.round("value", 6))


QUERIES["analysis_batch"] = lambda spark, d: _rounded(scan_metrics(_table("lineitem")(spark, d), [a for a, _ in _BATCH]))
ORACLE_SQL["analysis_batch"] = _rows_sql(_BATCH, "lineitem")

_GROUPED = [(G.Uniqueness(("l_orderkey", "l_partkey")), "sum((f = 1)::INT) / sum(f)"), (G.Distinctness(("l_orderkey", "l_partkey")), "count(*) / sum(f)"), (G.UniqueValueRatio(("l_orderkey", "l_partkey")), "sum((f = 1)::INT) / count(*)"), (G.CountDistinct(("l_orderkey", "l_partkey")), "count(*)")]
QUERIES["grouping_batch"] = lambda spark, d: _rounded(grouping_metrics(_table("lineitem")(spark, d), [a for a, _ in _GROUPED]))
ORACLE_SQL["grouping_batch"] = _rows_sql(_GROUPED, "(SELECT l_orderkey, l_partkey, count(*) AS f FROM lineitem GROUP BY ALL)")


def _partition_states(spark: SparkSession, d: str) -> DataFrame:
    """States by l_returnflag, merged as rows: the metrics of the whole."""
    analyzers = [a for a, _ in _BATCH]
    states = state_frame(_table("lineitem")(spark, d), analyzers, by=["l_returnflag"])
    return _rounded(metric_frame(merged_states(states, analyzers), analyzers))


QUERIES["incremental_scan_states"] = _partition_states
ORACLE_SQL["incremental_scan_states"] = ORACLE_SQL["analysis_batch"]


def _aggregated(spark: SparkSession, d: str) -> DataFrame:
    """States of three parts kept by providers, and metrics from them alone."""
    df = _table("lineitem")(spark, d)
    analyzers = [S.Size(), S.Mean("l_quantity"), S.StandardDeviation("l_quantity"), S.Correlation("l_quantity", "l_discount"), G.Uniqueness("l_orderkey"), G.Entropy("l_suppkey")]
    providers = []
    for flag in ("A", "N", "R"):
        providers.append(InMemoryStateProvider())
        run_analysis(df.filter(F.col("l_returnflag") == flag), analyzers, save_states_with=providers[-1])
    return _rounded(run_on_aggregated_states(df.schema, analyzers, providers).success_metrics_as_dataframe(spark))


QUERIES["incremental_frequency_states"] = _aggregated
ORACLE_SQL["incremental_frequency_states"] = " UNION ALL ".join([
    _rows_sql([(S.Size(), "count(*)"), (S.Mean("l_quantity"), "avg(l_quantity)"), (S.StandardDeviation("l_quantity"), "stddev_pop(l_quantity)"), (S.Correlation("l_quantity", "l_discount"), "corr(l_quantity, l_discount)")], "lineitem"),
    _rows_sql([(G.Uniqueness("l_orderkey"), "sum((f = 1)::INT) / sum(f)")], "(SELECT count(*) AS f FROM lineitem GROUP BY l_orderkey)"),
    _rows_sql([(G.Entropy("l_suppkey"), "ln(sum(f)) - sum(f * ln(f)) / sum(f)")], "(SELECT count(*) AS f FROM lineitem GROUP BY l_suppkey)"),
])

# --- Checks -----------------------------------------------------------------------------------------------

_CHECKS: list[tuple[str, str, Callable[[Check], Check], str]] = [
    ("check_size", "lineitem", lambda c: c.has_size(lambda n: n > 1000), "count(*) > 1000"),
    ("check_is_complete", "orders", lambda c: c.is_complete("o_custkey"), "bool_and(o_custkey IS NOT NULL)"),
    ("check_has_completeness", LABELLED, lambda c: c.has_completeness("quality", lambda x: x > 0.3), "avg((quality IS NOT NULL)::INT) > 0.3"),
    ("check_are_complete", LABELLED, lambda c: c.are_complete(["doc_id", "quality"]), "bool_and(doc_id IS NOT NULL AND quality IS NOT NULL)"),
    ("check_have_completeness", LABELLED, lambda c: c.have_completeness(["quality", "toxic"], lambda x: x > 0.1), "avg((quality IS NOT NULL AND toxic IS NOT NULL)::INT) > 0.1"),
    ("check_are_any_complete", LABELLED, lambda c: c.are_any_complete(["quality", "lang"]), "bool_and(quality IS NOT NULL OR lang IS NOT NULL)"),
    ("check_have_any_completeness", LABELLED, lambda c: c.have_any_completeness(["quality", "toxic"], lambda x: x > 0.9), "avg((quality IS NOT NULL OR toxic IS NOT NULL)::INT) > 0.9"),
    ("check_is_unique", "orders", lambda c: c.is_unique("o_orderkey"), "count(DISTINCT o_orderkey) = count(o_orderkey)"),
    ("check_are_unique", "lineitem", lambda c: c.are_unique(["l_orderkey", "l_linenumber"]), "count(DISTINCT (l_orderkey, l_linenumber)) = count(*)"),
    ("check_is_primary_key", "documents", lambda c: c.is_primary_key("doc_id", "lang"), "count(DISTINCT (doc_id, lang)) = count(*)"),
    ("check_has_uniqueness", "orders", lambda c: c.has_uniqueness("o_custkey", lambda x: x < 0.5), f"({_freq('orders', 'o_custkey', 'sum((f = 1)::INT) / sum(f)')}) < 0.5"),
    ("check_has_distinctness", "orders", lambda c: c.has_distinctness("o_custkey", lambda x: x < 0.5), f"({_freq('orders', 'o_custkey', 'count(*) / sum(f)')}) < 0.5"),
    ("check_has_unique_value_ratio", "orders", lambda c: c.has_unique_value_ratio("o_orderkey", lambda x: x == 1), f"({_freq('orders', 'o_orderkey', 'sum((f = 1)::INT) / count(*)')}) = 1"),
    ("check_distinct_values", LABELLED, lambda c: c.has_number_of_distinct_values("quality", lambda n: n == 3), "count(DISTINCT coalesce(CAST(quality AS VARCHAR), 'NullValue')) = 3"),
    ("check_histogram_values", "orders", lambda c: c.has_histogram_values("o_orderstatus", lambda d: d["F"].ratio > 0.4), "avg((o_orderstatus = 'F')::INT) > 0.4"),
    ("check_has_entropy", "events", lambda c: c.has_entropy("event_type", lambda x: x > 1), "(SELECT ln(sum(f)) - sum(f * ln(f)) / sum(f) FROM (SELECT count(*) AS f FROM events GROUP BY event_type)) > 1"),
    ("check_has_mutual_information", "part", lambda c: c.has_mutual_information("p_brand", "p_type", lambda x: x > 0), f"({_information('part', 'p_brand', 'p_type')}) > 0"),
    ("check_has_min", "lineitem", lambda c: c.has_min("l_quantity", lambda x: x >= 1), "min(l_quantity) >= 1"),
    ("check_has_max", "lineitem", lambda c: c.has_max("l_quantity", lambda x: x <= 40), "max(l_quantity) <= 40"),
    ("check_has_mean", "lineitem", lambda c: c.has_mean("l_quantity", lambda x: 20 < x < 30), "avg(l_quantity) > 20 AND avg(l_quantity) < 30"),
    ("check_has_sum", "lineitem", lambda c: c.has_sum("l_quantity", lambda x: x > 1000), "sum(l_quantity) > 1000"),
    ("check_has_standard_deviation", "lineitem", lambda c: c.has_standard_deviation("l_quantity", lambda x: x < 10), "stddev_pop(l_quantity) < 10"),
    ("check_has_min_length", "part", lambda c: c.has_min_length("p_name", lambda x: x > 2), "min(length(p_name)) > 2"),
    ("check_has_max_length", "part", lambda c: c.has_max_length("p_name", lambda x: x < 5), "max(length(p_name)) < 5"),
    ("check_has_approx_count_distinct", "lineitem", lambda c: c.has_approx_count_distinct("l_suppkey", lambda x: x > 5), "count(DISTINCT l_suppkey) > 5"),
    ("check_has_approx_quantile", "lineitem", lambda c: c.has_approx_quantile("l_quantity", 0.5, lambda x: 20 < x < 30), "median(l_quantity) BETWEEN 20 AND 30"),
    ("check_kll_sketch", "lineitem", lambda c: c.kll_sketch_satisfies("l_quantity", lambda d: d.number_of_bins == 8 and 0.4 < sum(b.ratio for b in list(d.values.values())[:4]) < 0.6, 8), "(SELECT avg((l_quantity <= (lo + hi) / 2)::INT) FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)) BETWEEN 0.4 AND 0.6"),
    ("check_has_correlation", "lineitem", lambda c: c.has_correlation("l_quantity", "l_extendedprice", lambda x: x < 1), "corr(l_quantity, l_extendedprice) < 1"),
    ("check_satisfies", "orders", lambda c: c.satisfies("o_totalprice > 0", "paid"), "bool_and(o_totalprice > 0)"),
    ("check_has_pattern", "customer", lambda c: c.has_pattern("c_name", "^Customer"), "bool_and(regexp_matches(c_name, '^Customer'))"),
    ("check_contains_url", "pages", lambda c: c.contains_url("url", lambda x: x > 0.9), f"avg((regexp_extract(url, '{patterns.URL}', 0) <> '')::INT) > 0.9"),
    ("check_contains_email", "documents", lambda c: c.contains_email("text", lambda x: 0 < x < 0.1), f"avg(coalesce({EMAIL_SQL}, FALSE)::INT) > 0 AND avg(coalesce({EMAIL_SQL}, FALSE)::INT) < 0.1"),
    ("check_contains_credit_card", "documents", lambda c: c.contains_credit_card_number("text", lambda x: x < 0.1), f"avg(coalesce({CARD_SQL}, FALSE)::INT) < 0.1"),
    ("check_contains_ssn", "documents", lambda c: c.contains_ssn("text", lambda x: x < 0.1), f"avg(coalesce({SSN_SQL}, FALSE)::INT) < 0.1"),
    ("check_add_constraint", "orders", lambda c: c.add_constraint(Constraint(S.Mean("o_totalprice"), lambda x: x > 150000, "mean price")), "avg(o_totalprice) > 150000"),
    ("check_data_type", "part", lambda c: c.has_data_type("p_size", ConstrainableType.NUMERIC), r"bool_and(regexp_matches(CAST(p_size AS VARCHAR), '^(-|\+)? ?\d*\.?\d*$'))"),
    ("check_non_negative", "orders", lambda c: c.is_non_negative("o_totalprice"), "bool_and(coalesce(o_totalprice, 0) >= 0)"),
    ("check_positive", LABELLED, lambda c: c.is_positive("quality"), "bool_and(coalesce(quality, 1) >= 0)"),
    ("check_positive_strict", LABELLED, lambda c: c.is_positive("quality", strict=True), "bool_and(coalesce(quality, 1) > 0)"),
    ("check_less_than", "lineitem", lambda c: c.is_less_than("l_discount", "l_quantity"), "bool_and(l_discount < l_quantity)"),
    ("check_less_than_or_equal", "lineitem", lambda c: c.is_less_than_or_equal_to("l_linenumber", "l_quantity"), "bool_and(l_linenumber <= l_quantity)"),
    ("check_greater_than", "lineitem", lambda c: c.is_greater_than("l_extendedprice", "l_quantity"), "bool_and(l_extendedprice > l_quantity)"),
    ("check_greater_or_equal", "lineitem", lambda c: c.is_greater_or_equal_to("l_quantity", "l_linenumber", lambda x: x > 0.5), "avg((l_quantity >= l_linenumber)::INT) > 0.5"),
    ("check_contained_in", "orders", lambda c: c.is_contained_in("o_orderstatus", ["F", "O", "P"]), "bool_and(o_orderstatus IS NULL OR o_orderstatus IN ('F', 'O', 'P'))"),
    ("check_contained_in_range", "lineitem", lambda c: c.is_contained_in_range("l_quantity", 1, 50, include_high=False), "bool_and(l_quantity IS NULL OR (l_quantity >= 1 AND l_quantity < 50))"),
    ("check_where", "lineitem", lambda c: c.has_min("l_quantity", lambda x: x > 25).where("l_quantity > 25"), "min(l_quantity) FILTER (WHERE l_quantity > 25) > 25"),
]


def _check(name: str, table: str, build: Callable[[Check], Check], sql: str) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        check = build(Check(CheckLevel.ERROR, name))
        result = evaluate([check], run_analysis(_sources(spark, d, table), check.required_analyzers()))
        return result.check_results_as_dataframe(spark).select("check", "check_status", "constraint_status")

    QUERIES[name] = query
    ok = f"SELECT ({sql}) AS ok FROM {table}" if not sql.startswith("(") and sql != "TRUE" else f"SELECT {sql} AS ok"
    ORACLE_SQL[name] = f'SELECT \'{name}\' AS "check", CASE WHEN ok THEN \'Success\' ELSE \'Error\' END AS check_status, CASE WHEN ok THEN \'Success\' ELSE \'Failure\' END AS constraint_status FROM ({ok})'


for _row in _CHECKS:
    _check(*_row)


def _suite(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: two checks over lineitem, run in a scan and a grouping."""
    quality = Check(CheckLevel.ERROR, "lineitem quality").has_size(lambda n: n > 0).is_complete("l_orderkey").has_min("l_quantity", lambda x: x >= 0).is_non_negative("l_extendedprice").is_contained_in("l_returnflag", ["A", "N", "R"])
    keys = Check(CheckLevel.WARNING, "lineitem keys").are_unique(["l_orderkey", "l_linenumber"]).has_distinctness(["l_orderkey", "l_linenumber"], lambda x: x > 0.1)
    result = VerificationSuite().on_data(_table("lineitem")(spark, d)).add_checks([quality, keys]).run()
    return result.check_results_as_dataframe(spark).select("check", "check_level", "check_status", "constraint_status")


QUERIES["verification_suite"] = _suite
ORACLE_SQL["verification_suite"] = """
WITH q AS (SELECT count(*) > 0 AS c1, bool_and(l_orderkey IS NOT NULL) AS c2, min(l_quantity) >= 0 AS c3, bool_and(coalesce(l_extendedprice, 0) >= 0) AS c4, bool_and(l_returnflag IS NULL OR l_returnflag IN ('A', 'N', 'R')) AS c5 FROM lineitem),
k AS (SELECT count(DISTINCT (l_orderkey, l_linenumber)) = count(*) AS c1, count(DISTINCT (l_orderkey, l_linenumber)) / count(*) > 0.1 AS c2 FROM lineitem),
r AS (SELECT 'lineitem quality' AS "check", 'Error' AS check_level, c1 AND c2 AND c3 AND c4 AND c5 AS ok, unnest([c1, c2, c3, c4, c5]) AS c FROM q UNION ALL SELECT 'lineitem keys', 'Warning', c1 AND c2, unnest([c1, c2]) FROM k)
SELECT "check", check_level, CASE WHEN ok THEN 'Success' ELSE check_level END AS check_status, CASE WHEN c THEN 'Success' ELSE 'Failure' END AS constraint_status FROM r"""

# --- Repository and anomalies -------------------------------------------------------------------------------

DAILY_SQL = "SELECT epoch(date_trunc('day', ts::TIMESTAMP))::BIGINT // 86400 AS day, count(*) AS n, avg(value) AS v FROM events GROUP BY 1"


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of events by day, as a history table: states of each day, one row a metric."""
    analyzers = [S.Size(), S.Mean("value")]
    events = _table("events")(spark, d).withColumn("dataset_date", F.unix_date(F.to_date("ts")).cast("bigint"))
    states = state_frame(events, analyzers, by=["dataset_date"])
    n, total = F.col("s0_n").cast("double"), F.col("s1_total") / F.col("s1_n")
    rows = F.array(F.struct(F.lit("Size").alias("name"), n.alias("value")), F.struct(F.lit("Mean").alias("name"), total.alias("value")))
    return states.select("dataset_date", F.inline(rows))


QUERIES["repository_history"] = lambda spark, d: _rounded(daily(spark, d))
ORACLE_SQL["repository_history"] = f"WITH t AS ({DAILY_SQL}) SELECT day AS dataset_date, 'Size' AS name, round(n::DOUBLE, 6) AS value FROM t UNION ALL SELECT day, 'Mean', round(v, 6) FROM t"


def _history_filtered(spark: SparkSession, d: str) -> DataFrame:
    history = daily(spark, d)
    first = history.agg(F.min("dataset_date")).first()[0]
    return _rounded(history_filter(history, after=first + 5, before=first + 15, names=["Size"]))


QUERIES["repository_history_filtered"] = _history_filtered
ORACLE_SQL["repository_history_filtered"] = f"WITH t AS ({DAILY_SQL}), m AS (SELECT min(day) AS m FROM t) SELECT day AS dataset_date, 'Size' AS name, round(n::DOUBLE, 6) AS value FROM t, m WHERE day BETWEEN m + 5 AND m + 15"


def _repository(spark: SparkSession, d: str) -> DataFrame:
    """Runs by return flag in a repository with tags, loaded back by tag as a frame."""
    repository, df = InMemoryMetricsRepository(), _table("lineitem")(spark, d)
    for i, flag in enumerate(("A", "N", "R")):
        run_analysis(df, [S.Size(f"l_returnflag = '{flag}'")], repository=repository, save_key=ResultKey(i, {"flag": flag}))
    return repository.load().after(1).success_metrics_as_dataframe(spark)


QUERIES["repository_loader"] = _repository
ORACLE_SQL["repository_loader"] = "SELECT 'Dataset' AS entity, '*' AS instance, 'Size (where: l_returnflag = ''' || f || ''' )' AS name, count(*)::DOUBLE AS value, i::BIGINT AS dataset_date, f AS flag FROM lineitem JOIN (VALUES (1, 'N'), (2, 'R')) t(i, f) ON l_returnflag = f GROUP BY i, f"


def _scratch(spark: SparkSession, name: str) -> str:
    """A new path for small files: in the cluster's shared folder, or, where none is set, in a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="plumbline-")
    return f"{root}/plumbline-queries/{name}-{uuid.uuid4().hex}"


_KEPT = [(S.Size(), "count(*)"), (S.Mean("l_quantity"), "avg(l_quantity)"), (S.Completeness("l_partkey"), "avg((l_partkey IS NOT NULL)::INT)")]


def _file_repository(spark: SparkSession, d: str) -> DataFrame:
    """Runs by flag saved in a JSON file with two tags, the metrics of a key appended in turn; loaded by one tag."""
    df, path = _table("lineitem")(spark, d), _scratch(spark, "repository") + ".json"
    for i, flag in enumerate(("A", "N", "R")):
        for analyzer, _ in _KEPT:
            run_analysis(df.filter(F.col("l_returnflag") == flag), [analyzer], repository=FileMetricsRepository(spark, path), save_key=ResultKey(i, {"flag": flag, "kind": "kept" if i else "old"}))
    loaded = FileMetricsRepository(spark, path).load().with_tag_values({"kind": "kept"}).for_analyzers([a for a, _ in _KEPT[:2]])
    return _rounded(loaded.success_metrics_as_dataframe(spark, ["flag"]))


QUERIES["repository_file_tags"] = _file_repository
ORACLE_SQL["repository_file_tags"] = " UNION ALL ".join(f"SELECT * EXCLUDE (value), round(value, 6) AS value FROM (SELECT '{a.entity.value}' AS entity, '{a.instance}' AS instance, '{a.metric_name}' AS name, ({sql})::DOUBLE AS value, i::BIGINT AS dataset_date, f AS flag FROM lineitem JOIN (VALUES (1, 'N'), (2, 'R')) t(i, f) ON l_returnflag = f GROUP BY i, f)" for a, sql in _KEPT[:2])


def _append(spark: SparkSession, d: str) -> DataFrame:
    """Runs over two halves under one key: of a metric that both have the later stays, the others are kept."""
    repository, df = InMemoryMetricsRepository(), _table("lineitem")(spark, d)
    run_analysis(df.filter("l_quantity <= 25"), [S.Size(), S.Minimum("l_quantity")], repository=repository, save_key=ResultKey(7))
    run_analysis(df.filter("l_quantity > 25"), [S.Size(), S.Maximum("l_quantity")], repository=repository, save_key=ResultKey(7))
    return repository.load().success_metrics_as_dataframe(spark)


QUERIES["repository_append"] = _append
ORACLE_SQL["repository_append"] = "SELECT 'Dataset' AS entity, '*' AS instance, 'Size' AS name, count(*) FILTER (WHERE l_quantity > 25)::DOUBLE AS value, 7::BIGINT AS dataset_date FROM lineitem UNION ALL SELECT 'Column', 'l_quantity', 'Minimum', min(l_quantity)::DOUBLE, 7 FROM lineitem WHERE l_quantity <= 25 UNION ALL SELECT 'Column', 'l_quantity', 'Maximum', max(l_quantity)::DOUBLE, 7 FROM lineitem WHERE l_quantity > 25"


def _round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Results of a batch and a histogram, written as JSON and read again."""
    context = run_analysis(_table("lineitem")(spark, d), [*(a for a, _ in _BATCH), G.Histogram("l_returnflag")])
    found = deserialize(serialize([AnalysisResult(ResultKey(3, {"a": "b"}), context)]))[0]
    return _rounded(found.context.success_metrics_as_dataframe(spark).filter("name NOT LIKE 'Histogram.ratio%'"))


QUERIES["serde_round_trip"] = _round_trip
ORACLE_SQL["serde_round_trip"] = ORACLE_SQL["analysis_batch"] + " UNION ALL SELECT 'Column', 'l_returnflag', 'Histogram.bins', count(DISTINCT l_returnflag)::DOUBLE FROM lineitem UNION ALL SELECT 'Column', 'l_returnflag', 'Histogram.abs.' || l_returnflag, count(*)::DOUBLE FROM lineitem GROUP BY l_returnflag"


def _built(spark: SparkSession, d: str) -> DataFrame:
    """A fluent run whose metrics go to a JSON file, and the file's rows."""
    path = _scratch(spark, "metrics") + ".json"
    AnalysisRunner.on_data(_table("lineitem")(spark, d)).add_analyzers([a for a, _ in _KEPT]).save_success_metrics_json_to_path(path).run()
    rows = json.loads(read_text(spark, path))
    return _rounded(spark.createDataFrame([(r["entity"], r["instance"], r["name"], r["value"]) for r in rows], "entity string, instance string, name string, value double"))


QUERIES["analysis_builder"] = _built
ORACLE_SQL["analysis_builder"] = _rows_sql(_KEPT, "lineitem")


def _analysis(spark: SparkSession, d: str) -> DataFrame:
    """An Analysis over the later half, merged with the states of the first that files keep."""
    df, provider = _table("lineitem")(spark, d), FileStateProvider(spark, _scratch(spark, "states"))
    analyzers = [*(a for a, _ in _KEPT), G.Uniqueness("l_orderkey")]
    run_analysis(df.filter("l_linenumber <= 3"), analyzers, save_states_with=provider)
    found = Analysis().add_analyzers(analyzers).run(df.filter("l_linenumber > 3"), aggregate_with=provider)
    return _rounded(found.success_metrics_as_dataframe(spark))


QUERIES["analysis_with_file_states"] = _analysis
ORACLE_SQL["analysis_with_file_states"] = _rows_sql(_KEPT, "lineitem") + " UNION ALL " + _rows_sql([(G.Uniqueness("l_orderkey"), "sum((f = 1)::INT) / sum(f)")], "(SELECT count(*) AS f FROM lineitem GROUP BY l_orderkey)")


def _state_operations(spark: SparkSession, d: str) -> DataFrame:
    """States of two parts merged into a third provider, copied to a fourth, and the metrics of that."""
    df, wanted = _table("lineitem")(spark, d), [S.Mean("l_quantity"), S.StandardDeviation("l_quantity"), G.Distinctness("l_suppkey")]
    a, b, both, copied = (InMemoryStateProvider() for _ in range(4))
    run_analysis(df.filter("l_quantity <= 10"), wanted, save_states_with=a)
    run_analysis(df.filter("l_quantity > 10"), wanted, save_states_with=b)
    for x in wanted:
        x.aggregate_state_to(a, b, both)
        x.copy_state_to(both, copied)
    return _rounded(AnalyzerContext({x: x.load_state_and_compute_metric(copied) for x in wanted}).success_metrics_as_dataframe(spark))


QUERIES["state_operations"] = _state_operations
ORACLE_SQL["state_operations"] = _rows_sql([(S.Mean("l_quantity"), "avg(l_quantity)"), (S.StandardDeviation("l_quantity"), "stddev_pop(l_quantity)")], "lineitem") + " UNION ALL " + _rows_sql([(G.Distinctness("l_suppkey"), "count(*) / sum(f)")], "(SELECT count(*) AS f FROM lineitem GROUP BY l_suppkey)")


def _series(spark: SparkSession, d: str, name: str) -> DataFrame:
    return daily(spark, d).filter(F.col("name") == name).select(F.col("dataset_date").alias("time"), "value", F.lit("events").alias("series"))


def _anomaly(key: str, metric: str, strategy, sql: str) -> None:
    flag = flag_anomalies if not getattr(strategy, "ignore_anomalies", False) else anomalies_by_series
    QUERIES[key] = lambda spark, d: flag(_series(spark, d, metric), strategy, by=["series"]).select("time", F.round("value", 6).alias("value"), "is_anomaly")
    column = "n::DOUBLE" if metric == "Size" else "v"
    if sql:
        ORACLE_SQL[key] = f"WITH t AS (SELECT day AS time, {column} AS value FROM ({DAILY_SQL})) SELECT time, round(value, 6) AS value, coalesce({sql}, FALSE) AS is_anomaly FROM t WINDOW w AS (ORDER BY time), u AS (ORDER BY time ROWS UNBOUNDED PRECEDING)"


_anomaly("anomaly_absolute", "Size", AbsoluteChange(max_decrease=-10.0, max_increase=10.0), "value - lag(value) OVER w < -10 OR value - lag(value) OVER w > 10")
_anomaly("anomaly_absolute_order2", "Size", AbsoluteChange(max_decrease=-20.0, max_increase=20.0, order=2), "value - 2 * lag(value) OVER w + lag(value, 2) OVER w NOT BETWEEN -20 AND 20")
_anomaly("anomaly_threshold", "Size", AbsoluteChange(max_decrease=100.0, max_increase=350.0, order=0), "value < 100 OR value > 350")
_anomaly("anomaly_relative", "Mean", RelativeRateOfChange(max_rate_decrease=0.97, max_rate_increase=1.03), "value / lag(value) OVER w NOT BETWEEN 0.97 AND 1.03")
_anomaly("anomaly_online_normal", "Mean", OnlineNormal(lower_factor=1.5, upper_factor=1.5, ignore_anomalies=False), "row_number() OVER w - 1 >= 0.1 * count(*) OVER () AND abs(value - avg(value) OVER u) > 1.5 * stddev_pop(value) OVER u")
_anomaly("anomaly_online_normal_rollback", "Mean", OnlineNormal(lower_factor=1.5, upper_factor=1.5), "")
# Mean and spread go on from the last point that was no anomaly.
ORACLE_SQL["anomaly_online_normal_rollback"] = f"""
WITH RECURSIVE p AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, day AS time, v AS value, count(*) OVER () AS n FROM ({DAILY_SQL}) WHERE v IS NOT NULL),
w AS (
  SELECT i, time, value, value AS mean, 0.0::DOUBLE AS spread, FALSE AS odd FROM p WHERE i = 0
  UNION ALL
  SELECT i, time, value, CASE WHEN odd THEN mean ELSE new_mean END, CASE WHEN odd THEN spread ELSE new_spread END, odd FROM (
    SELECT *, i >= 0.1 * n AND abs(value - new_mean) > 1.5 * sqrt(greatest(0, new_spread / (i + 1))) AS odd FROM (
      SELECT *, spread + (value - mean) * (value - new_mean) AS new_spread FROM (
        SELECT p.i, p.time, p.value, p.n, w.mean, w.spread, w.mean + (p.value - w.mean) / (p.i + 1) AS new_mean FROM w JOIN p ON p.i = w.i + 1)))
)
SELECT time, round(value, 6) AS value, odd AS is_anomaly FROM w"""


def _interval(spark: SparkSession, d: str) -> DataFrame:
    """Anomalies of daily sizes at days 10 to 19 of the series, with their values: changes look at days before."""
    points = [DataPoint(r["time"], r["value"]) for r in _series(spark, d, "Size").collect()]  # a row a day
    first = min(p.time for p in points)
    found = AnomalyDetector(AbsoluteChange(max_decrease=-5.0, max_increase=5.0)).detect_anomalies_in_history(points, first + 10, first + 20)
    return spark.createDataFrame([(t, a.value, a.confidence) for t, a in found], "time bigint, value double, confidence double")


QUERIES["anomaly_interval"] = _interval
ORACLE_SQL["anomaly_interval"] = f"WITH t AS (SELECT day AS time, n::DOUBLE AS value, n - lag(n) OVER (ORDER BY day) AS change, min(day) OVER () AS first FROM ({DAILY_SQL})) SELECT time, value, 1.0::DOUBLE AS confidence FROM t WHERE time >= first + 10 AND time < first + 20 AND abs(change) > 5"


def _anomaly_check(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of every day but the last in a repository, then the whole table with an anomaly check."""
    repository, size = InMemoryMetricsRepository(), S.Size()
    days = daily(spark, d).filter("name = 'Size' AND dataset_date IS NOT NULL").orderBy("dataset_date").collect()
    for r in days[:-1]:
        repository.save(ResultKey(r["dataset_date"]), AnalyzerContext({size: Metric(Entity.DATASET, "Size", "*", Outcome(r["value"]))}))
    result = VerificationSuite().on_data(_table("events")(spark, d)).use_repository(repository).add_anomaly_check(RelativeRateOfChange(max_rate_increase=2.0), S.Size()).run()
    return result.check_results_as_dataframe(spark).select("check_level", "check_status", "constraint_status")


QUERIES["anomaly_check"] = _anomaly_check
ORACLE_SQL["anomaly_check"] = "SELECT 'Warning' AS check_level, 'Warning' AS check_status, 'Failure' AS constraint_status"


def _applicability(spark: SparkSession, d: str) -> DataFrame:
    check = Check(CheckLevel.ERROR, "orders").is_complete("o_custkey").has_mean("o_totalprice", lambda x: x > 0).has_mean("o_orderstatus", lambda x: x > 0)
    found = check_applicability(check, _table("orders")(spark, d).schema, spark)
    return spark.createDataFrame([(found.applicable, k) for k in found.failures], "applicable boolean, failure string")


QUERIES["applicability"] = _applicability
ORACLE_SQL["applicability"] = "SELECT FALSE AS applicable, 'MeanConstraint(Mean(o_orderstatus,None))' AS failure"
