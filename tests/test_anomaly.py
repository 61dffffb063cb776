import math

import numpy as np
import pytest

from plumbline.anomaly import AbsoluteChange, Anomaly, AnomalyDetector, DataPoint, OnlineNormal, RelativeRateOfChange, anomalies_by_series, flag_anomalies

SERIES = [1.0 if not 20 <= i <= 30 else float(i if i % 2 == 0 else -i) for i in range(51)][:50]


def test_differences():
    s = AbsoluteChange(max_increase=1.0, order=2)
    assert s.changes(np.array([1, 2, 4, 1, 2, 8.0])).tolist() == [1, -5, 4, 5]
    assert [i for i, _ in AbsoluteChange(max_decrease=-2.0, max_increase=2.0).detect(SERIES)] == [*range(20, 32)]
    assert [i for i, _ in AbsoluteChange(max_decrease=-2.0, max_increase=2.0).detect(SERIES, (25, 50))] == [*range(25, 32)]
    assert [i for i, _ in AbsoluteChange(max_decrease=0.0, order=0).detect([1, -1, 2])] == [1]
    for bad in ({}, {"max_increase": 1.0, "order": -1}, {"max_increase": -1.0, "max_decrease": 1.0}):
        with pytest.raises(ValueError):
            AbsoluteChange(**bad)


def test_relative():
    x = [1.0 if not 20 <= i <= 30 else float(i if i % 2 == 0 else 1) for i in range(50)]
    assert [i for i, _ in RelativeRateOfChange(max_rate_decrease=0.5, max_rate_increase=2.0).detect(x)] == [*range(20, 32)]
    with pytest.raises(ValueError):
        RelativeRateOfChange(max_rate_increase=1.0, order=0)


def test_online_normal():
    rng = np.random.default_rng(1)
    x = rng.normal(1, 1, 50)
    for i in range(20, 31):
        x[i] += i * (1 if i % 2 == 0 else -1)
    assert [i for i, _ in OnlineNormal(lower_factor=3.5, upper_factor=3.5, ignore_start=0.2).detect(x.tolist())] == [*range(20, 31)]
    s = OnlineNormal(ignore_start=0.0, ignore_anomalies=False).statistics([1.0, 2.0, 3.0, 7.0])
    assert s[3][0] == pytest.approx(3.25) and s[3][1] == pytest.approx(np.std([1, 2, 3, 7]))


def test_detector():
    d = AnomalyDetector(AbsoluteChange(max_decrease=-2.0, max_increase=2.0))
    history = [DataPoint(2, 2.0), DataPoint(0, 1.0), DataPoint(1, None)]
    assert d.is_new_point_anomalous(history, DataPoint(3, 9.0)) == [(3, Anomaly(9.0))]
    assert d.is_new_point_anomalous(history, DataPoint(3, 3.0)) == []
    with pytest.raises(ValueError):
        d.is_new_point_anomalous([], DataPoint(3, 3.0))
    with pytest.raises(ValueError):
        d.is_new_point_anomalous(history, DataPoint(2, 3.0))


@pytest.mark.parametrize("strategy", [AbsoluteChange(max_decrease=-2.0, max_increase=2.0), AbsoluteChange(max_decrease=-5.0, max_increase=5.0, order=2), RelativeRateOfChange(max_rate_decrease=0.5, max_rate_increase=2.0), OnlineNormal(lower_factor=1.5, upper_factor=1.5, ignore_anomalies=False)])
def test_frames_agree_with_arrays(spark, strategy):
    df = spark.createDataFrame([(s, i, x + k) for k, s in enumerate("ab") for i, x in enumerate(SERIES)] + [("a", 99, None)], "s string, time int, value double")
    for flag in (flag_anomalies, anomalies_by_series):
        got = {(r["s"], r["time"]) for r in flag(df, strategy, by=["s"]).filter("is_anomaly").collect()}
        want = {(s, i) for k, s in enumerate("ab") for i, _ in strategy.detect([x + k for x in SERIES])}
        assert got == want
    assert math.isfinite(1.0)
