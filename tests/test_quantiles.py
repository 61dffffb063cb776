import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.catalog import QUERIES
from plumbline.plans.quantiles import exact_quantiles

QS = [0.0, 0.001, 0.23, 0.25 + 0.02, 0.48, 0.5, 0.52, 0.75 - 0.02, 0.999, 1.0]
DRAW = random.Random(3)
COLUMNS = {
    "spread": [DRAW.random() * 1e5 for _ in range(3000)],
    "prices": [round(DRAW.random() * 20, 2) for _ in range(3000)],
    "few values": [float(DRAW.choice([1, 1, 1, 1, 2, 7])) for _ in range(3000)],
    "one value": [4.5] * 500,
    "tails": [DRAW.choice([-1, 1]) * 10.0 ** DRAW.randint(-300, 300) for _ in range(2000)],
    "nulls": [None if i % 3 else float(i) for i in range(2000)],
    "odd values": [math.inf, -math.inf, math.nan, 0.0, None] * 90 + [float(i) for i in range(400)],
    "NaN alone": [math.nan] * 5 + [None],
    "one row": [3.0],
    "two rows": [3.0, 4.0],
    "nulls alone": [None, None],
    "no rows": [],
}


@pytest.mark.parametrize("few", [1, 100_000])
@pytest.mark.parametrize("name", COLUMNS)
def test_quantiles_are_those_of_percentile(spark, name, few):
    df = spark.createDataFrame([(x,) for x in COLUMNS[name]], "x double").repartition(3)
    want = df.agg(*(F.percentile("x", q) for q in QS)).first()
    assert [*map(str, exact_quantiles(df, "x", QS, few))] == [*map(str, want)]


@pytest.mark.parametrize("kind", ["int", "bigint", "decimal(12, 2)", "float"])
def test_quantiles_of_other_numbers(spark, kind):
    df = spark.range(700).select((F.col("id") * 7919 % 701 / 4).cast(kind).alias("a.b"))
    want = df.agg(*(F.percentile("`a.b`", q) for q in QS)).first()
    assert exact_quantiles(df, "`a.b`", QS, 20) == list(want)


def test_a_wrong_sketch_costs_a_round_and_no_result(spark, monkeypatch):
    from plumbline.plans import quantiles

    right, rounds = quantiles._cuts, []

    def wrong(df, intervals):
        rounds.append(1)
        return [(t, [max(found)] * len(found) if len(rounds) % 2 else found) for t, found in right(df, intervals)]

    monkeypatch.setattr(quantiles, "_cuts", wrong)
    df = spark.range(2000).select((F.col("id") % 500 + 0.5).alias("x"))
    assert exact_quantiles(df, "x", [0.1, 0.5], 30) == list(df.agg(F.percentile("x", 0.1), F.percentile("x", 0.5)).first())


def bytes_read(spark) -> dict[int, int]:
    """Bytes of shuffles read by each stage so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    jvm, gateway = sc._jvm, sc._gateway
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(s := stages.apply(i)).stageId(): s.shuffleReadBytes() for i in range(stages.size())}


@pytest.mark.parametrize("name", ["approx_quantiles", "approx_quantile_within_error"])
def test_no_task_reads_all_values(spark, tmp_path, name):
    spark.range(600_000).select((F.col("id") * 7919 % 600_011 * 0.01).alias("l_extendedprice")).write.parquet(str(tmp_path / "lineitem.parquet"))
    before = bytes_read(spark)
    rows = QUERIES[name](spark, str(tmp_path)).collect()
    read = [n for stage, n in bytes_read(spark).items() if stage not in before]
    assert rows and all(r["within"] for r in rows) and read and max(read) < 2_000_000
