"""Verification: run the analyzers that checks need, evaluate the checks, keep and export results."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from plumbline.anomaly import Strategy
from plumbline.checks import Check, CheckLevel, CheckResult, CheckStatus
from plumbline.constraints import ConstraintStatus
from plumbline.model import Metric, ResultKey
from plumbline.operators.base import Analyzer
from plumbline.plans.runner import AnalyzerContext, run_analysis, run_on_aggregated_states

CHECK_SCHEMA = "check string, check_level string, check_status string, constraint string, constraint_status string, constraint_message string"


@dataclass(frozen=True)
class AnomalyCheckConfig:
    """Of the check that an anomaly check makes: its level and text, and which history counts."""

    level: CheckLevel = CheckLevel.WARNING
    description: str | None = None
    with_tag_values: Mapping[str, str] = field(default_factory=dict)
    after: int | None = None
    before: int | None = None


@dataclass(frozen=True)
class VerificationResult:
    status: CheckStatus
    check_results: Mapping[Check, CheckResult]
    context: AnalyzerContext

    @property
    def metrics(self) -> Mapping[Analyzer, Metric]:
        return self.context.metrics

    def check_rows(self, for_checks: Iterable[Check] | None = None) -> list[dict]:
        wanted = None if for_checks is None else list(for_checks)
        return [
            {"check": c.description, "check_level": c.level.value, "check_status": r.status.value, "constraint": str(x.constraint), "constraint_status": x.status.value, "constraint_message": x.message}
            for c, r in self.check_results.items()
            if wanted is None or c in wanted
            for x in r.constraint_results
        ]

    def check_results_as_dataframe(self, spark: SparkSession, for_checks=None) -> DataFrame:
        return spark.createDataFrame([tuple(r.values()) for r in self.check_rows(for_checks)], CHECK_SCHEMA)

    def check_results_as_json(self, for_checks=None) -> str:
        return json.dumps(self.check_rows(for_checks))

    def success_metrics_as_dataframe(self, spark: SparkSession, for_analyzers=None) -> DataFrame:
        return self.context.success_metrics_as_dataframe(spark, for_analyzers)

    def success_metrics_as_json(self, for_analyzers=None) -> str:
        return self.context.success_metrics_as_json(for_analyzers)

    def debug(self) -> None:
        """Print whether all is well, and what is not."""
        if self.status is CheckStatus.SUCCESS:
            print("Success: the data passed the checks, everything looks good!")
            return
        print(f"{self.status.value}: there were problems in the data, the following constraints were not satisfied:")
        for row in self.check_rows():
            if row["constraint_status"] != ConstraintStatus.SUCCESS.value:
                print(f"{row['constraint']} failed: {row['constraint_message']}")


def evaluate(checks: Iterable[Check], context: AnalyzerContext) -> VerificationResult:
    """Results of all checks, at once; the status is the worst of theirs."""
    results = {c: c.evaluate(context.metrics) for c in checks}
    worst = max((r.status for r in results.values()), key=lambda s: s.rank, default=CheckStatus.SUCCESS)
    return VerificationResult(worst, results, context)


class VerificationRunBuilder:
    def __init__(self, df: DataFrame):
        self._df, self._spark = df, df.sparkSession
        self._checks: list[Check] = []
        self._analyzers: list[Analyzer] = []
        self._options: dict = {}
        self._repository = self._save_key = self._checks_json = self._metrics_json = None
        self._overwrite = False

    def add_check(self, check: Check) -> VerificationRunBuilder:
        self._checks.append(check)
        return self

    def add_checks(self, checks: Iterable[Check]) -> VerificationRunBuilder:
        self._checks += checks
        return self

    def add_required_analyzer(self, analyzer: Analyzer) -> VerificationRunBuilder:
        self._analyzers.append(analyzer)
        return self

    def add_required_analyzers(self, analyzers: Iterable[Analyzer]) -> VerificationRunBuilder:
        self._analyzers += analyzers
        return self

    def save_states_with(self, provider) -> VerificationRunBuilder:
        self._options["save_states_with"] = provider
        return self

    def aggregate_with(self, provider) -> VerificationRunBuilder:
        self._options["aggregate_with"] = provider
        return self

    def use_repository(self, repository) -> VerificationRunBuilder:
        self._repository = self._options["repository"] = repository
        return self

    def use_spark_session(self, spark: SparkSession) -> VerificationRunBuilder:
        self._spark = spark
        return self

    def reuse_existing_results_for_key(self, key: ResultKey, fail_if_results_missing: bool = False) -> VerificationRunBuilder:
        self._options |= {"reuse_key": key, "fail_if_results_missing": fail_if_results_missing}
        return self

    def save_or_append_result(self, key: ResultKey) -> VerificationRunBuilder:
        self._save_key = key
        return self

    def add_anomaly_check(self, strategy: Strategy, analyzer: Analyzer, config: AnomalyCheckConfig | None = None) -> VerificationRunBuilder:
        if self._repository is None:
            raise ValueError("an anomaly check needs use_repository first")
        config = config or AnomalyCheckConfig()
        check = Check(config.level, config.description or f"Anomaly check for {analyzer}")
        self._checks.append(check.is_newest_point_non_anomalous(self._repository, strategy, analyzer, config.with_tag_values or None, config.after, config.before))
        return self

    def save_check_results_json_to_path(self, path: str) -> VerificationRunBuilder:
        self._checks_json = path
        return self

    def save_success_metrics_json_to_path(self, path: str) -> VerificationRunBuilder:
        self._metrics_json = path
        return self

    def overwrite_previous_files(self, overwrite: bool = True) -> VerificationRunBuilder:
        self._overwrite = overwrite
        return self

    def run(self) -> VerificationResult:
        needed = [*self._analyzers, *(a for c in self._checks for a in c.required_analyzers())]
        context = run_analysis(self._df, needed, **self._options)
        result = evaluate(self._checks, context)
        # Saved after the evaluation: anomaly checks compare with earlier runs only.
        if self._repository is not None and self._save_key is not None:
            self._repository.save_or_append(self._save_key, context)
        from plumbline.sources.files import write_text

        if self._checks_json:
            write_text(self._spark, self._checks_json, result.check_results_as_json(), self._overwrite)
        if self._metrics_json:
            write_text(self._spark, self._metrics_json, result.success_metrics_as_json(), self._overwrite)
        return result


class VerificationSuite:
    def on_data(self, df: DataFrame) -> VerificationRunBuilder:
        return VerificationRunBuilder(df)

    @staticmethod
    def run_on_aggregated_states(schema: T.StructType, checks: Iterable[Check], providers: Iterable, required_analyzers: Iterable[Analyzer] = (), save_states_with=None, repository=None, save_key: ResultKey | None = None) -> VerificationResult:
        checks = list(checks)
        needed = [*required_analyzers, *(a for c in checks for a in c.required_analyzers())]
        result = evaluate(checks, run_on_aggregated_states(schema, needed, providers, save_states_with))
        if repository is not None and save_key is not None:
            repository.save_or_append(save_key, result.context)
        return result

    @staticmethod
    def is_check_applicable_to_data(check: Check, schema: T.StructType, spark: SparkSession):
        from plumbline.applicability import check_applicability

        return check_applicability(check, schema, spark)

    @staticmethod
    def are_analyzers_applicable_to_data(analyzers: Iterable[Analyzer], schema: T.StructType, spark: SparkSession):
        from plumbline.applicability import analyzer_applicability

        return analyzer_applicability(analyzers, schema, spark)
