import pytest
from fixtures import frame
from pyspark.sql import functions as F

from plumbline.operators import grouping as G
from plumbline.operators import scan as S
from plumbline.operators.states import FileStateProvider, InMemoryStateProvider
from plumbline.plans.runner import Analysis, merged_states, metric_frame, run_analysis, run_on_aggregated_states, state_frame
from plumbline.streaming.incremental import track_stream

ANALYZERS = [
    S.Size(), S.Size("att1 > 2"), S.Completeness("att2"), S.Compliance("p", "att2 > 4"), S.Minimum("att1"), S.Maximum("att1"), S.Mean("att1"), S.Sum("att2"), S.StandardDeviation("att2"),
    S.Correlation("att1", "att2"), S.MinLength("item"), S.MaxLength("item"), S.PatternMatch("item", "[1-3]"), S.DataType("item"), S.ApproxCountDistinct("att2"), S.ApproxQuantile("att1", 0.5),
    G.Uniqueness("att2"), G.Distinctness(("att1", "att2")), G.UniqueValueRatio("att2"), G.Entropy("att2"), G.MutualInformation(("att2", "att3")), G.CountDistinct("att3"),
]


def same(a, b):
    return a.value == b.value if not isinstance(a.value, float) else a.value == pytest.approx(b.value)


@pytest.mark.parametrize("kind", ["memory", "files"])
def test_merged_states_equal_the_whole(spark, tmp_path, kind):
    df = frame(spark, "numeric")
    parts = [df.filter("att1 <= 2"), df.filter("att1 BETWEEN 3 AND 4"), df.filter("att1 > 4"), df.filter("att1 > 100")]
    providers = [InMemoryStateProvider() if kind == "memory" else FileStateProvider(spark, str(tmp_path / str(i))) for i in range(4)]
    for part, provider in zip(parts, providers):
        run_analysis(part, ANALYZERS, save_states_with=provider)
    merged, whole = run_on_aggregated_states(df.schema, ANALYZERS, providers), run_analysis(df, ANALYZERS)
    for a in ANALYZERS:
        assert same(merged[a], whole[a]), str(a)


def test_aggregate_with(spark):
    df, provider = frame(spark, "numeric"), InMemoryStateProvider()
    some = [S.Mean("att1"), S.StandardDeviation("att1"), G.Uniqueness("att2")]
    run_analysis(df.filter("att1 < 3"), some, save_states_with=provider)
    found = Analysis(tuple(some)).run(df.filter("att1 >= 3"), aggregate_with=provider)
    whole = run_analysis(df, some)
    assert all(same(found[a], whole[a]) for a in some)


def test_null_keys_merge(spark):
    df = frame(spark, "distinct")
    a = [G.Distinctness(("att1", "att2"))]
    providers = [InMemoryStateProvider(), InMemoryStateProvider()]
    for p, part in zip(providers, [df.limit(1), df]):
        run_analysis(part, a, save_states_with=p)
    assert run_on_aggregated_states(df.schema, a, providers)[a[0]].value == pytest.approx(4 / 7)


def test_states_by_partition_as_rows(spark):
    df = frame(spark, "numeric")
    some = [a for a in ANALYZERS[:13]]
    rows = metric_frame(merged_states(state_frame(df.withColumn("g", F.col("att1") % 2), some, by=["g"]), some), some).collect()
    whole = run_analysis(df, some)
    assert [r["value"] for r in rows] == pytest.approx([whole[a].value for a in some])


def test_stream_metrics_follow_all_batches(spark, tmp_path):
    source = tmp_path / "in"
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(source))
    seen = {}
    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(str(source))
    query = track_stream(stream, [S.Size(), S.Mean("id"), G.Uniqueness("id")], str(tmp_path / "states"), lambda n, c: seen.__setitem__(n, c), str(tmp_path / "ck"), availableNow=True)
    query.awaitTermination(120)
    last = seen[max(seen)]
    assert last[S.Size()].value == 30 and last[S.Mean("id")].value == 14.5 and last[G.Uniqueness("id")].value == 1.0


def test_many_sketch_states_merge_in_one_job(spark):
    from plumbline.operators.scan import merge_all

    df, sketches = frame(spark, "numeric"), [S.ApproxCountDistinct("att2"), S.ApproxQuantile("att1", 0.5), S.ApproxCountDistinct("att1"), S.Mean("att1")]
    providers = [InMemoryStateProvider() for _ in range(4)]
    for i, provider in enumerate(providers):
        run_analysis(df.filter(f"att1 % 4 = {i} AND att1 < 100"), sketches, save_states_with=provider)
    states = {a: [s for p in providers if (s := p.load(a)) is not None] for a in sketches}
    tracker, group = spark.sparkContext.statusTracker(), "merge-all"
    spark.sparkContext.setJobGroup(group, group)
    merged = merge_all(states)
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    whole = run_analysis(df, sketches)
    assert jobs <= 2 and all(same(a.metric_from(merged[a]), whole[a]) for a in sketches)


def test_state_operations_by_analyzer(spark):
    df = frame(spark, "numeric")
    for a in (S.Mean("att1"), S.ApproxCountDistinct("att2"), G.Uniqueness("att2")):
        one, two, both, copied = (InMemoryStateProvider() for _ in range(4))
        run_analysis(df.filter("att1 < 3"), [a], save_states_with=one)
        run_analysis(df.filter("att1 >= 3"), [a], save_states_with=two)
        a.aggregate_state_to(one, two, both)
        a.copy_state_to(both, copied)
        a.aggregate_state_to(InMemoryStateProvider(), InMemoryStateProvider(), empty := InMemoryStateProvider())
        assert same(a.load_state_and_compute_metric(copied), run_analysis(df, [a])[a]) and not a.load_state_and_compute_metric(empty).ok
        both.clear()
        assert not a.load_state_and_compute_metric(both).ok


def test_frequency_tables_are_freed(spark, tmp_path):
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    run_analysis(frame(spark, "numeric"), [G.Uniqueness("att2")], save_states_with=FileStateProvider(spark, str(tmp_path)))
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_mutual_information_has_no_window(spark):
    from plumbline.plans.runner import grouping_metrics

    analyzer = G.MutualInformation(("att2", "att3"))
    plan = grouping_metrics(frame(spark, "numeric"), [analyzer])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    df = frame(spark, "numeric")
    together = run_analysis(df, [analyzer, G.Uniqueness(("att2", "att3")), G.CountDistinct(("att2", "att3"))])
    assert all(same(together[a], run_analysis(df, [a])[a]) for a in together.metrics)


def test_a_stream_keeps_two_state_folders(spark, tmp_path):
    source, states = tmp_path / "in", tmp_path / "states"
    for i in range(5):
        frame(spark, "numeric").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(frame(spark, "numeric").schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    seen = []
    track_stream(stream, [S.Size(), G.CountDistinct("att2")], str(states), lambda n, c: seen.append(c[S.Size()].value), str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
    assert seen[-1] == 5 * frame(spark, "numeric").count() and len([f for f in states.iterdir() if f.is_dir()]) == 2
