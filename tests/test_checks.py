import json

import pytest
from fixtures import frame

from plumbline.anomaly import AbsoluteChange, OnlineNormal, RelativeRateOfChange
from plumbline.checks import Check, CheckLevel, CheckStatus
from plumbline.constraints import ConstrainableType
from plumbline.model import MetricError, ResultKey
from plumbline.operators import grouping as G
from plumbline.operators import scan as S
from plumbline.plans.runner import AnalysisRunner, run_analysis
from plumbline.sources import serde
from plumbline.sources.repository import FileMetricsRepository, InMemoryMetricsRepository, history_filter, tag_columns
from plumbline.verification import AnomalyCheckConfig, VerificationSuite, evaluate

E = Check(CheckLevel.ERROR, "e")


def status(df, check):
    return evaluate([check], run_analysis(df, check.required_analyzers())).status


@pytest.mark.parametrize(
    ("name", "check", "ok"),
    [
        ("full", E.is_complete("att1").is_complete("att2"), True),
        ("missing", E.is_complete("att1"), False),
        ("missing", E.has_completeness("att1", lambda x: x == 0.5).are_any_complete(["item", "att1"]), True),
        ("missing", E.are_complete(["item", "att1"]), False),
        ("missing", E.have_completeness(["att1", "att2"], lambda x: 0 < x < 1), True),
        ("unique", E.is_unique("unique").is_unique("uniqueWithNulls").is_primary_key("nonUnique", "onlyUniqueWithOtherNonUnique"), True),
        ("unique", E.is_unique("nonUnique"), False),
        ("distinct", E.has_distinctness("att1", lambda x: x == 3 / 5).has_number_of_distinct_values("att1", lambda n: n == 4), True),
        ("numeric", E.has_min("att1", lambda x: x == 1).has_max("att1", lambda x: x == 6).has_mean("att1", lambda x: x == 3.5).has_sum("att1", lambda x: x == 21), True),
        ("numeric", E.is_positive("att2"), True),
        ("numeric", E.is_positive("att2", strict=True), False),
        ("numeric", E.is_less_than("att2", "att1"), False),
        ("numeric", E.is_less_than("att2", "att1").where("att1 < 4"), True),
        ("numeric", E.is_contained_in_range("att1", 1, 6), True),
        ("numeric", E.is_contained_in_range("att1", 1, 6, include_high=False), False),
        ("full", E.is_contained_in("att1", ["a", "b"]).has_histogram_values("att1", lambda d: d["a"].absolute == 3), True),
        ("full", E.has_entropy("att1", lambda x: x < 0.6).has_mutual_information("att1", "att2", lambda x: x > 0.5), True),
        ("numeric", E.has_data_type("item", ConstrainableType.NUMERIC).has_data_type("item", ConstrainableType.NULL, lambda x: x == 0), True),
        ("lengths", E.has_min_length("att1", lambda x: x == 0).has_max_length("att1", lambda x: x == 4), True),
        ("low", E.has_correlation("att1", "att2", lambda x: abs(x) < 0.2).has_approx_quantile("att1", 0.5, lambda x: 5 < x < 9).has_approx_count_distinct("att1", lambda x: 5 < x < 7), True),
    ],
)
def test_checks(spark, name, check, ok):
    assert status(frame(spark, name), check) is (CheckStatus.SUCCESS if ok else CheckStatus.ERROR)


def test_results_are_exported(spark, tmp_path):
    df = frame(spark, "full")
    checks = [Check(CheckLevel.ERROR, "group-1").is_complete("att1"), Check(CheckLevel.ERROR, "group-2-E").has_size(lambda n: n > 5, "Should be greater than 5!"), Check(CheckLevel.WARNING, "group-2-W").has_distinctness("item", lambda x: x < 0.8, "Should be smaller than 0.8!")]
    path = str(tmp_path / "checks.json")
    run = VerificationSuite().on_data(df).add_checks(checks).add_required_analyzer(S.Mean("item")).save_check_results_json_to_path(path)
    result = run.run()
    assert result.status is CheckStatus.ERROR
    rows = [tuple(r) for r in result.check_results_as_dataframe(spark).collect()]
    assert rows == [
        ("group-1", "Error", "Success", "CompletenessConstraint(Completeness(att1,None))", "Success", ""),
        ("group-2-E", "Error", "Error", "SizeConstraint(Size(None))", "Failure", "Value: 4 does not meet the constraint requirement!Should be greater than 5!"),
        ("group-2-W", "Warning", "Warning", "DistinctnessConstraint(Distinctness(List(item),None))", "Failure", "Value: 1 does not meet the constraint requirement!Should be smaller than 0.8!"),
    ]
    assert len(json.loads(open(path).read())) == 3
    with pytest.raises(FileExistsError):
        run.run()
    run.overwrite_previous_files().run()
    assert len(result.check_rows([checks[1]])) == 1
    assert {r["name"] for r in json.loads(result.success_metrics_as_json())} == {"Completeness", "Size", "Distinctness"}


def test_constraint_messages(spark):
    context = run_analysis(frame(spark, "full"), [S.Size()])

    def message(c):
        return evaluate([c], context).check_rows()[0]["constraint_message"]

    assert message(E.is_complete("att1")) == "Missing Analysis, can't run the constraint!"
    assert message(E.has_size(lambda n: 1 / 0)).startswith("Can't execute the assertion")


def test_repository_and_loader(spark, tmp_path):
    df = frame(spark, "full")
    for repo in (InMemoryMetricsRepository(), FileMetricsRepository(spark, str(tmp_path / "r.json"))):
        for date, region in ((1, "EU"), (2, "NA"), (3, "EU")):
            run_analysis(df, [S.Size(), G.Histogram("att1"), S.Mean("item")], repository=repo, save_key=ResultKey(date, {"Region!": region}))
        run_analysis(df, [S.Completeness("att1")], repository=repo, save_key=ResultKey(1, {"Region!": "EU"}))
        assert len(repo.load_by_key(ResultKey(1, {"Region!": "EU"})).metrics) == 3
        assert [r.key.data_set_date for r in repo.load().with_tag_values({"Region!": "EU"}).after(2).get()] == [3]
        assert [r.key.data_set_date for r in repo.load().before(2).get()] == [1, 2]
        assert all(not r.context.metrics for r in repo.load().for_analyzers([]).get())
        rows = repo.load().for_analyzers([S.Size()]).success_metrics_as_dataframe(spark).orderBy("dataset_date").collect()
        assert [(r["name"], r["value"], r["region"]) for r in rows] == [("Size", 4.0, "EU"), ("Size", 4.0, "NA"), ("Size", 4.0, "EU")]
        assert json.loads(repo.load().success_metrics_as_json(["Region!"]))[0]["dataSetDate"] in (1, 2, 3)
        names = {r["name"] for r in repo.load().rows()}
        assert {"Histogram.bins", "Histogram.abs.a", "Histogram.ratio.a"} <= names
    assert tag_columns(["Name", "A b"], ["name"]) == {"Name": "name_2", "A b": "ab"}
    frame_ = spark.createDataFrame([(1, "Size", "EU"), (2, "Size", "NA")], "dataset_date bigint, name string, region string")
    assert history_filter(frame_, {"region": "EU"}, 1, 2, ["Size"]).count() == 1


def test_reuse_and_missing_results(spark):
    df, repo, key = frame(spark, "full"), InMemoryMetricsRepository(), ResultKey(0)
    AnalysisRunner.on_data(df).add_analyzer(S.Size()).use_repository(repo).save_or_append_result(key).run()
    found = AnalysisRunner.on_data(df.limit(1)).add_analyzers([S.Size(), S.Completeness("att1")]).use_repository(repo).reuse_existing_results_for_key(key).run()
    assert found[S.Size()].value == 4.0 and found[S.Completeness("att1")].value == 1.0
    with pytest.raises(MetricError):
        run_analysis(df, [S.Mean("item")], repository=repo, reuse_key=key, fail_if_results_missing=True)


def test_serde_round_trip(spark):
    df = frame(spark, "numeric")
    analyzers = [S.Size("att1 > 1"), S.Compliance("p", "att1 > 1"), S.PatternMatch("item", "a|b"), S.Correlation("att1", "att2"), S.DataType("item"), G.Uniqueness(("att1", "att2"), "att1 > 1"), G.Histogram("att1"), G.Entropy("att1"), G.MutualInformation(("att1", "att2")), S.ApproxQuantile("att1", 0.5), S.KllSketch("att1", 3)]
    context = run_analysis(df, analyzers)
    again = serde.context_from_list(json.loads(json.dumps(serde.context_to_list(context))))
    assert list(again.metrics) == analyzers
    assert [m.value for m in again.metrics.values()] == [m.value for m in context.metrics.values()]
    with pytest.raises(MetricError):
        serde.metric_to_dict(S.Mean("item").calculate(df))


def test_anomaly_checks(spark):
    repo = InMemoryMetricsRepository()
    df = spark.range(11)
    bad = VerificationSuite().on_data(df).use_repository(repo).add_anomaly_check(AbsoluteChange(max_decrease=-2.0, max_increase=2.0), S.Size()).run()
    assert bad.status is CheckStatus.WARNING and "previous results" in bad.check_rows()[0]["constraint_message"]
    for i in range(1, 5):
        run_analysis(spark.range(i), [S.Size()], repository=repo, save_key=ResultKey(i, {"t": "x"}))
    run = lambda limit, **kw: VerificationSuite().on_data(df).use_repository(repo).add_anomaly_check(AbsoluteChange(max_decrease=-limit, max_increase=limit), S.Size(), AnomalyCheckConfig(CheckLevel.ERROR, **kw)).save_or_append_result(ResultKey(9)).run().status
    assert run(2.0, before=4) is CheckStatus.ERROR
    assert run(7.0, with_tag_values={"t": "x"}) is CheckStatus.SUCCESS


def test_anomaly_check_query_keeps_every_day(spark, tmp_path):
    from plumbline import catalog

    rows = [(f"2024-01-0{day} 0{hour % 10}:00:00", 1.0) for day, n in enumerate([1] * 7 + [9, 1], 1) for hour in range(n)]
    spark.createDataFrame(rows, "ts string, value double").selectExpr("cast(ts AS timestamp) AS ts", "value").write.parquet(str(tmp_path / "events.parquet"))
    # 17 rows after a day of 9 are no more than twice as many; after the fifth day, of 1, they are.
    assert [r["constraint_status"] for r in catalog.QUERIES["anomaly_check"](spark, str(tmp_path)).collect()] == ["Success"]


def test_aggregated_suite_applicability_and_debug(spark, capsys):
    from plumbline.operators.states import InMemoryStateProvider

    df, provider = frame(spark, "full"), InMemoryStateProvider()
    check = E.is_complete("att1").has_size(lambda n: n == 8)
    run_analysis(df, check.required_analyzers(), save_states_with=provider)
    result = VerificationSuite.run_on_aggregated_states(df.schema, [check], [provider, provider])
    assert result.status is CheckStatus.SUCCESS
    result.debug()
    assert "Success" in capsys.readouterr().out
    assert VerificationSuite.is_check_applicable_to_data(check, df.schema, spark).applicable
    found = VerificationSuite.are_analyzers_applicable_to_data([S.Mean("att1"), S.Size()], df.schema, spark)
    assert not found.applicable and list(found.failures) == ["Mean(att1,None)"]
    assert OnlineNormal() and RelativeRateOfChange(max_rate_increase=1.0)
