import math

import pytest
from fixtures import frame

from plumbline.functions import patterns
from plumbline.model import EmptyStateError
from plumbline.operators import grouping as G
from plumbline.operators import scan as S
from plumbline.plans.runner import run_analysis

GOLDEN = [
    ("missing", S.Size(), 12), ("missing", S.Size("item > '5'"), 4), ("missing", S.Completeness("att1"), 0.5), ("missing", S.Completeness("att2"), 0.75),
    ("missing", S.Completeness("att1", "item IN ('1', '2')"), 1.0), ("full", G.Uniqueness("att1"), 0.25), ("full", G.Uniqueness("att2"), 0.25),
    ("missing", G.Uniqueness("att1"), 0.0), ("missing", G.Uniqueness("att2"), 0.0), ("unique", G.Uniqueness("unique"), 1.0), ("unique", G.Uniqueness("uniqueWithNulls"), 1.0),
    ("unique", G.Uniqueness("nonUnique"), 0.5), ("full", G.Entropy("att2"), -(0.75 * math.log(0.75) + 0.25 * math.log(0.25))),
    ("full", G.MutualInformation(("att1", "att2")), -(0.75 * math.log(0.75) + 0.25 * math.log(0.25))), ("uninformative", G.MutualInformation(("att1", "att2")), 0.0),
    ("numeric", S.Maximum("att1"), 6), ("numeric", S.Maximum("att1", "item != '6'"), 5), ("numeric", S.Minimum("att1"), 1), ("numeric", S.Minimum("att1", "item != '1'"), 2),
    ("numeric", S.Mean("att1"), 3.5), ("numeric", S.Mean("att1", "item != '6'"), 3.0), ("numeric", S.Sum("att1"), 21), ("numeric", S.StandardDeviation("att1"), 1.707825127659933),
    ("lengths", S.MinLength("att1"), 0), ("lengths", S.MinLength("att1", "att1 <> ''"), 1), ("lengths", S.MaxLength("att1"), 4), ("lengths", S.MaxLength("att1", "att1 <> 'dddd'"), 3),
    ("numeric", S.Compliance("r", "att1 > 3"), 0.5), ("numeric", S.Compliance("r", "att1 > 2"), 4 / 6), ("numeric", S.Compliance("r", "att2 = 0", "att1 < 4"), 1.0),
    ("positive", S.Correlation("att1", "att2"), 1.0), ("negative", S.Correlation("att1", "att2"), -1.0),
    ("distinct", G.Distinctness("att1"), 3 / 5), ("distinct", G.Distinctness("att1", "att2 IS NOT NULL"), 2 / 3), ("distinct", G.Distinctness(("att1", "att2")), 4 / 6),
    ("unique", G.UniqueValueRatio("nonUnique"), 0.75), ("distinct", G.CountDistinct(("att1", "att2")), 4),
]


def test_golden_values(spark):
    for name in dict.fromkeys(g[0] for g in GOLDEN):
        context = run_analysis(frame(spark, name), [a for n, a, _ in GOLDEN if n == name])
        for n, a, want in GOLDEN:
            if n == name:
                assert context[a].value == pytest.approx(want), str(a)


def test_one_by_one_equals_batch(spark):
    df = frame(spark, "numeric")
    analyzers = [S.Size(), S.Mean("att1"), S.Correlation("att1", "att2"), G.Entropy("att2"), S.StandardDeviation("att3", "att1 > 1")]
    batch = run_analysis(df, analyzers)
    for a in analyzers:
        assert a.calculate(df).value == pytest.approx(batch[a].value)


def test_one_failure_does_not_spoil_the_scan(spark):
    context = run_analysis(frame(spark, "numeric"), [S.Mean("att1"), S.Mean("item"), S.Compliance("bad", "nope > 3"), S.Completeness("gone"), S.Compliance("late", "raise_error('x') IS NULL"), G.MutualInformation(("att1",))])
    assert context[S.Mean("att1")].value == 3.5
    assert sum(not m.ok for m in context.all_metrics) == 5


def test_empty_states(spark):
    df = frame(spark, "numeric").filter("att1 > 100")
    context = run_analysis(df, [S.Size(), S.Mean("att1"), S.Minimum("att1"), S.StandardDeviation("att1"), G.Uniqueness("att1"), S.Correlation("att1", "att2")])
    assert context[S.Size()].value == 0
    for a in list(context.metrics)[1:]:
        assert isinstance(context[a].outcome.error, EmptyStateError), str(a)


def test_histogram(spark):
    df = frame(spark, "missing")
    d = run_analysis(df, [h := G.Histogram("att1")])[h].value
    assert d.number_of_bins == 3 and d["a"].absolute == 4 and d["NullValue"].ratio == 0.5
    d = run_analysis(df, [h := G.Histogram("att1", max_bins=2)])[h].value
    assert set(d.values) == {"a", "NullValue"} and d.number_of_bins == 3
    assert not run_analysis(df, [h := G.Histogram("att1", max_bins=1002)])[h].ok
    d = run_analysis(df, [h := G.Histogram("att1", where="item = '1'")])[h].value
    assert d["a"].ratio == 1 / 12


def test_data_type(spark):
    df = spark.createDataFrame([("1.0",), ("1",), ("true",), ("x",), (None,), ("-3",), ("2020-01-01",)], "a string")
    d = run_analysis(df, [S.DataType("a")])[S.DataType("a")].value
    assert {k: b.absolute for k, b in d.values.items()} == {"Unknown": 1, "Fractional": 1, "Integral": 2, "Boolean": 1, "String": 2}


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        (patterns.EMAIL, ["someone@somewhere.org"], ["someone@else"]),
        (patterns.URL, ["http://foo.com/blah_blah", "https://a.b/c", "ftp://x.yz"], ["http://", "//a", "foo.com"]),
        (patterns.SOCIAL_SECURITY_NUMBER_US, ["111-05-1130", "111051130"], ["666-05-1120", "078-05-1120", "111-00-1234"]),
        (patterns.CREDIT_CARD, ["378282246310005", "4111111111111111", "5555 5555 5555 4444"], ["0000000000000000", "123"]),
    ],
)
def test_patterns(spark, pattern, yes, no):
    df = spark.createDataFrame([(x,) for x in [*yes, *no]] + [(None,)], "s string")
    assert S.PatternMatch("s", pattern).calculate(df).value == pytest.approx(len(yes) / (len(yes) + len(no) + 1))


def test_nested_column_and_schema_checks(spark):
    df = spark.read.json(spark.sparkContext.parallelize(['{"source": {"sensor-igauge": {"id": 10, "ip": "68.28.91.22"}}}']))
    assert S.PatternMatch("source.sensor-igauge.ip", r"\d+\.\d+").calculate(df).value == 1.0
    assert not S.Completeness("source").calculate(df).ok


def test_approximations(spark):
    df = spark.range(10000).selectExpr("id % 1000 AS a", "cast(id AS double) AS b")
    context = run_analysis(df, [S.ApproxCountDistinct("a"), S.ApproxQuantile("b", 0.25), S.ApproxQuantiles("b", (0.1, 0.9)), S.KllSketch("b", 4)])
    assert context[S.ApproxCountDistinct("a")].value == pytest.approx(1000, rel=0.05)
    assert context[S.ApproxQuantile("b", 0.25)].value == pytest.approx(2500, abs=150)
    assert context[S.ApproxQuantiles("b", (0.1, 0.9))].value["0.9"].ratio == pytest.approx(9000, abs=150)
    assert [b.ratio for b in context[S.KllSketch("b", 4)].value.values.values()] == pytest.approx([0.25] * 4, abs=0.02)


def test_decimal_columns(spark):
    df = spark.sql("SELECT cast(id AS decimal(10, 2)) AS d FROM range(5)")
    assert run_analysis(df, [S.Mean("d"), S.Sum("d")])[S.Mean("d")].value == 2.0


def test_common_filter_is_pushed_down(spark, tmp_path):
    from plumbline.plans.runner import state_frame

    spark.range(100).selectExpr("id", "id * 2 AS v").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = state_frame(df, [S.Size("id > 50"), S.Sum("v", "id > 50")])._jdf.queryExecution().toString()
    assert "GreaterThan(id,50)" in plan
    assert run_analysis(df, [S.Size("id > 50"), S.Sum("v", "id > 50")])[S.Size("id > 50")].value == 49
